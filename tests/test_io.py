"""Readers and streams."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayline.sources import readers
from wayline.streaming.commits import commit_reports, commit_stream, committed_reports, compact, current_rows
from wayline.streaming.drives import capture_gate, stream_capture_gate, without_replays


def test_readers(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"resources": {"p": {"kind": "tenders", "bytes": 3}}}')
    (tmp_path / "docs/b.json").write_bytes(b'{"resources": "\xff"}')
    docs = readers.json_documents(spark, str(tmp_path / "docs"), f"resources map<string,struct<{readers.RESOURCE.replace(' ', ':').replace(',:', ',')}>>")
    entries = readers.manifest_entries(docs.where("raw IS NOT NULL").select("doc.resources"))
    assert [(r["entry_id"], r["kind"], r["bytes"]) for r in entries.collect()] == [("p", "tenders", 3)]
    (tmp_path / "lines.geojson").write_text('\x1e{"properties":{"highway":"trunk","ref":"NH1"},"geometry":{"type":"LineString","coordinates":[[70,20],[71,20]]}}\n\n{"properties":{},"geometry":null}\n')
    lines = readers.line_features(spark, str(tmp_path / "lines.geojson")).orderBy("line_id").collect()
    assert [r["ref"] for r in lines] == ["NH1", None] and lines[0]["coordinates"] == [[70.0, 20.0], [71.0, 20.0]]
    (tmp_path / "t.csv").write_text("tn,t,loc,c,d,b\n1,Road works,Town,Firm,2020-01-02T00,305850\n")
    assert readers.slim_tenders(readers.tenders_csv(spark, str(tmp_path / "t.csv"))).first()["d"] == "2020-01-02"
    (tmp_path / "packs").mkdir()
    for name in ("ok", "bad", "extra"):
        (tmp_path / "packs" / name).write_text(name)
    rows = [(f"x/{n}", len(n), hashlib.sha256((n if n != "bad" else "BAD").encode()).hexdigest()) for n in ("ok", "bad", "lost")]
    states = readers.integrity(spark, str(tmp_path / "packs"), spark.createDataFrame(rows, "path string, bytes long, sha256 string"))
    assert {(r["name"], r["state"]) for r in states.collect()} == {("ok", "ok"), ("bad", "sha256"), ("lost", "missing"), ("extra", "unlisted")}


def test_streams(spark: SparkSession, tmp_path: Path) -> None:
    fixes = spark.range(60).select(
        (F.col("id") % 2).cast("string").alias("drive_id"), (F.col("id") / 2).alias("ts"), (12.9 + F.col("id") / 1e5).alias("lat"), F.lit(77.6).alias("lng"),
        F.lit(5.0).alias("accuracy"), F.lit(3.0).alias("speed_mps"), F.concat(F.lit("k"), F.expr("id div 4")).alias("source_event_key"),
        F.timestamp_seconds(F.col("id")).alias("captured_at"), F.col("id"),
    ).coalesce(1)
    fixes.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream_capture_gate(stream()).writeStream.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(out).awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {tuple(r) for r in capture_gate(fixes).collect()} and any(r[-1] for r in got) and not all(r[-1] for r in got)
    once = str(tmp_path / "once")
    without_replays(stream()).writeStream.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(once).awaitTermination(60)
    assert spark.read.parquet(once).count() == 15
    commit_stream(stream(), str(tmp_path / "table"), str(tmp_path / "c3"), ["source_event_key"], "id").awaitTermination(60)
    newest = current_rows(spark.read.option("basePath", f"{tmp_path}/table").parquet(f"{tmp_path}/table"), ["source_event_key"], "id")
    assert newest.count() == 15 and newest.agg(F.min("id")).first()[0] == 3
    compact(spark, f"{tmp_path}/table", f"{tmp_path}/short", ["source_event_key"], "id")
    assert spark.read.parquet(f"{tmp_path}/short").count() == 15


def test_commits_with_the_rule_inside_are_the_fold_of_all(spark: SparkSession, tmp_path: Path) -> None:
    """Reports in batches that follow capture, one of them twice, give the events of one fold over all."""
    import random

    from wayline.operators.dedupe import fold_reports

    r, metre = random.Random(8), 1 / 111_195
    rows = [
        (i, "accept", "draft", True, False, "drive", f"d{i // 60}", f"k{i - i % 2}" if i % 7 == 0 else f"k{i}", float(i), 1000.0 + i * 10, 1000.0 + i * 10,
         12.9 + r.randint(0, 6) * 20 * metre + r.uniform(0, 3) * metre, 77.6, 5.0, 8.0, 90.0, "pothole_cavity", None)
        for i in range(180)
    ]
    schema = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (rows[:70], rows[70:110], rows[100:180]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        commit_reports(stream, log, str(tmp_path / "c")).awaitTermination(120)
    got = {x["id"]: (x["canonical_id"], x["match"], x["seen_count"]) for x in committed_reports(spark, log).collect()}
    want = {x["id"]: (x["canonical_id"], x["match"], x["seen_count"]) for x in fold_reports(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len({c for c, _, _ in want.values()}) < 60


def test_writers(spark: SparkSession, tmp_path: Path) -> None:
    from wayline.operators import evalstats
    from wayline.sources import writers

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "x")], "i int, s string").repartition(2)
    path = str(tmp_path / "t")
    assert writers.write_if_changed(a, path) and not writers.write_if_changed(b, path)
    assert writers.write_if_changed(a.limit(1), path) and writers.current(spark, path).count() == 1
    entry = writers.publish(a, str(tmp_path / "site"), "ka-routing")
    assert writers.publish(b, str(tmp_path / "site"), "ka-routing") == entry and writers.published(spark, str(tmp_path / "site"), entry).count() == 2
    a.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/site/{entry['path']}")
    try:
        writers.published(spark, str(tmp_path / "site"), entry)
        raise AssertionError("a changed table was read")
    except ValueError:
        pass
    tiles = spark.createDataFrame([("e070n10", 1), ("e072n10", 2)], "tile_id string, ordinal int")
    writers.write_tiles(tiles, f"{tmp_path}/tiles")
    assert sorted(p.name for p in (tmp_path / "tiles").glob("tile_id=*")) == ["tile_id=e070n10", "tile_id=e072n10"]
    writers.write_labelled(spark.createDataFrame([(1, "pothole"), (2, None)], "id int, human_label string"), f"{tmp_path}/labelled")
    assert spark.read.json(f"{tmp_path}/labelled").count() == 1
    trials = spark.createDataFrame([(1, "a", "e", "pothole_cavity", "accept", None)], "ordinal int, arm string, event string, label string, decision string, error string")
    writers.write_evaluation(trials, evalstats.arm_rates(trials), f"{tmp_path}/eval")
    told = spark.read.json(f"{tmp_path}/eval/manifest").first()
    assert told["rows"] == 1 and told["raw_sha256"] == writers.content_digest(trials)
    (tmp_path / "clips").mkdir()
    for n in (10, 9, 1):
        (tmp_path / f"clips/seg-{n}.mp4").write_bytes(b"x" * n)
    assert [tuple(x) for x in writers.blobs_in_order(spark, f"{tmp_path}/clips").select("seq", "bytes").collect()] == [(1, 1), (9, 9), (10, 10)]


def test_validators(spark: SparkSession) -> None:
    from wayline.operators import validators
    from wayline.operators.tables import violations

    good = {"authority_id": "mh-pune", "name": "Pune", "officer_email": "a@b.in", "handoff_name": None, "handoff_url": None, "alternate_handoff_name": None, "alternate_handoff_url": None, "handoff_package": None, "whatsapp_url": None, "helpline": None, "aliases": ["Pune"]}
    rows = [good, good, {**good, "authority_id": "mh-xx", "officer_email": None}, {**good, "authority_id": "mh-yy", "officer_email": "", "handoff_name": "App", "handoff_url": "http://x", "handoff_package": "in.app", "aliases": ["PUNE "]}]
    schema = ", ".join(f"{c} {'array<string>' if c == 'aliases' else 'string'}" for c in good)
    got = {tuple(x) for x in validators.authority_violations(spark.createDataFrame([tuple(x.values()) for x in rows], schema), ["in.gov"]).collect()}
    assert got == {("mh-pune", "duplicate"), ("mh-xx", "handoff"), ("mh-yy", "handoff"), ("mh-yy", "handoff_https"), ("mh-yy", "package"), ("pune", "alias_collision")}
    sha = "0" * 64
    entry = ("p", "p", "KA", "tenders", 1, 1, "a", f"packs/v1/states/ka/tenders-{sha}.json", f"https://s/packs/v1/states/ka/tenders-{sha}.json", 10, sha, "city", False, "2024-01-02", "2024-02-02", ["x"], 5)
    table = spark.createDataFrame([entry, ("q", *entry[1:9], 0, *entry[10:16], None)], f"entry_id string, {readers.RESOURCE}")
    assert {tuple(x) for x in violations(table, ["entry_id"], validators.resource_rules("https://s/")).collect()} == {("q", "entry"), ("q", "bytes"), ("q", "records")}
    ring = lambda *ps: [[[{"x": float(x), "y": float(y)} for x, y in ps]]]
    shapes = spark.createDataFrame([("ka-a", "boundary", ring((0, 0), (1, 0), (1, 1), (0, 0))), ("B", "odd", ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)))], "region_id string, routing_mode string, geometry array<array<array<struct<x:double,y:double>>>>")
    assert {tuple(x) for x in violations(shapes, ["region_id"], validators.region_rules()).collect()} == {("B", "id"), ("B", "mode"), ("B", "simple")}


def test_entry_without_the_libraries_of_the_corpus_operators() -> None:
    """The other queries stay where a library of the corpus operators is missing."""
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['tiktoken'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'drive_summary' in names and set(e.oracle_sql()) <= names, names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)


def test_stored_tables_are_dropped(spark: SparkSession) -> None:
    from wayline.sources.shared import discard, stored

    table = stored(spark.range(5), "some")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    discard(table)
    assert not folder.exists()
    discard(stored(spark.range(0), "none"))


def test_commits_read_what_they_touch_and_know_every_replay(spark: SparkSession, tmp_path: Path, monkeypatch) -> None:  # noqa: ANN001
    """The files that a batch reads do not grow with the log; a replay after forty days is caught; rows of one id are settled by their fields."""
    from wayline.operators.dedupe import FIELDS, fold_reports
    from wayline.streaming import commits

    schema = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"
    day = 86_400.0
    row = lambda i, at, lat, key=None, size=None: (i, "accept", "draft", True, False, "drive", f"d{i // 3}", key or f"k{i}", None, at, at, lat, 77.6, 5.0, 8.0, 90.0, "pothole_cavity", size)
    source, log, files = str(tmp_path / "in"), str(tmp_path / "log"), []
    before = commits.Buckets.read
    monkeypatch.setattr(commits.Buckets, "read", lambda self, buckets, number: (lambda df: (files.append((number, len(df.inputFiles()))), df)[1])(before(self, buckets, number)))
    rows = [row(10 * n + k, n * day + k, 12.0 + n / 100 + k / 1000) for n in range(40) for k in range(3)]
    parts = [rows[i : i + 20] for i in range(0, 120, 20)]
    parts[5] = parts[5] + [row(500, 45 * day, 12.0, key="k0"), row(501, 45 * day + 1, 13.0, size="large"), row(501, 45 * day + 1, 13.0, size="small")]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = commit_reports(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "c"), buckets=8)
        assert query.awaitTermination(200) and query.exception() is None
    read = {n: sum(f for m, f in files if m == n) for n, _ in files}
    assert len(read) == 6 and max(read[n] for n in range(1, 6)) <= 4 * 8 and read[5] <= read[2] + 8
    got = {x["id"]: x for x in committed_reports(spark, log, buckets=8).collect()}
    assert len(got) == 122 and (got[500]["canonical_id"], got[500]["match"]) == (0, "same_source") and got[0]["seen_count"] == 1
    assert got[501]["size"] == "large"
    once = [r for r in rows + parts[5][-3:] if r[0] != 501 or r[-1] == "large"]
    want = {x["id"]: (x["canonical_id"], x["match"], x["seen_count"]) for x in fold_reports(spark.createDataFrame(once, schema)).collect()}
    assert {i: (x["canonical_id"], x["match"], x["seen_count"]) for i, x in got.items()} == want
    assert len(list((tmp_path / "log" / "events").glob("bucket=*/batch=*"))) <= 2 * 8 and set(FIELDS) <= set(committed_reports(spark, log, buckets=8).columns)
