"""Rules on literal cases."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from wayline.functions import dates, decide, geo, text
from wayline.operators import containment, evalstats, nearest, tables
from wayline.operators.dedupe import Event, fold_component, match_kind
from wayline.streaming.drives import cadence, gate

GOOD = {
    "reportable": True, "damage_type": "pothole_cavity", "on_surface": True, "assessment": "clear", "quality": "usable", "temporal": "single_view", "edge": True, "depth": False,
}


def test_decisions(spark: SparkSession) -> None:
    cases = [({"damage_type": d}, "accept") for d in decide.DAMAGE_TYPES] + [
        ({"assessment": "probable"}, "accept"), ({"assessment": "uncertain"}, "review"), ({"quality": "unusable"}, "review"), ({"damage_type": "none"}, "reject"),
        ({"on_surface": False}, "reject"), ({"edge": False}, "review"), ({"reportable": None}, "reject"), ({"temporal": "inconsistent"}, "review"), ({"assessment": "absent"}, "reject"),
    ]
    rows = spark.createDataFrame([Row(**{**GOOD, **change}, want=want) for change, want in cases])
    assert rows.where(decide.decision(*[F.col(k) for k in GOOD]) != F.col("want")).count() == 0


def test_no_prefix_of_an_accepted_answer_is_rejected(spark: SparkSession) -> None:
    answer = json.dumps({
        "reportable": True, "assessment": "clear", "image_quality": "usable", "damage_type": "failed_patch", "on_drivable_surface": True,
        "has_broken_edge_or_rim": True, "has_depth_or_surface_loss": False, "temporal_consistency": "consistent",
    })
    rows = spark.createDataFrame([(answer[:n],) for n in range(len(answer) + 1)], "text string")
    got = [r[0] for r in rows.select(decide.prefix_decision(F.col("text"))).collect()]
    assert got[0] is None and set(got) == {None, "accept"}
    early = spark.createDataFrame([('{"reportable": false',), ('{"reportable": true, "damage_type": "no',)], "text string")
    assert [r[0] for r in early.select(decide.prefix_decision(F.col("text"))).collect()] == ["reject", None]


BASE = {
    "id": 1, "decision": "accept", "status": "draft", "dedupe_eligible": True, "debug_capture": False, "capture_source": "drive", "drive_id": "d1", "source_event_key": "k1",
    "source_offset_s": 10.0, "captured_at": 1000.0, "created_at": 1000.0, "last_seen_at": None, "lat": 12.9115, "lng": 77.6427, "gps_accuracy": 5.0, "speed_mps": 8.0,
    "heading": 90.0, "damage_type": "pothole_cavity", "size": None,
}
METRE = 1 / 111_195
OTHER = {"drive_id": "d2", "captured_at": 2000.0, "source_offset_s": 700.0, "lat": 12.9115 + 7 * METRE}


@pytest.mark.parametrize(
    ("change", "prior", "want"),
    [
        ({"source_event_key": "k1", "capture_source": "drive_vod"}, {}, "same_source"),
        ({"captured_at": 1003.0, "source_offset_s": 13.0, "lat": 12.9115 + 10 * METRE}, {}, "same_drive"),
        ({"captured_at": 1005.0, "source_offset_s": 15.0}, {}, None),
        ({"captured_at": 1001.0, "source_offset_s": 11.0, "lat": None}, {}, "same_drive"),
        ({"captured_at": 1003.001, "source_offset_s": 13.001, "lat": None}, {}, None),
        (OTHER, {}, "prior_drive"),
        ({**OTHER, "lat": 12.9115 + 10 * METRE}, {}, None),
        ({**OTHER, "captured_at": 1000.0 + 31 * 86_400}, {}, None),
        ({**OTHER, "damage_type": "surface_breakup"}, {}, None),
        ({**OTHER, "heading": 270.0}, {}, None),
        ({**OTHER, "gps_accuracy": 40.0}, {}, None),
        ({**OTHER, "damage_type": "failed_patch", "lat": 12.9115 + 4 * METRE}, {}, "prior_drive"),
        ({**OTHER, "damage_type": "failed_patch", "lat": 12.9115 + 6 * METRE}, {}, None),
        (OTHER, {"status": "unrouted"}, None),
        (OTHER, {"debug_capture": True}, None),
        ({**OTHER, "capture_source": "manual"}, {}, None),
        ({**OTHER, "size": "large"}, {"size": "small"}, None),
        ({**OTHER, "dedupe_eligible": False}, {}, None),
        ({**OTHER, "damage_type": None}, {}, None),
    ],
)
def test_matches(change: dict, prior: dict, want: str | None) -> None:
    old = {**BASE, **prior}
    assert match_kind({**BASE, "id": 2, "source_event_key": "k2", **change}, Event(old, [old], ["k1"])) == want


def test_a_middle_sighting_does_not_chain_two_outer_ones() -> None:
    import pandas as pd

    at = lambda i, metres, s: {**BASE, "id": i, "source_event_key": f"k{i}", "lat": 12.9115 + metres * METRE, "captured_at": 1000.0 + s, "source_offset_s": 10.0 + s}
    rows = [at(1, 0, 0), at(2, 10, 1), at(3, 20, 2)]
    out = fold_component(pd.DataFrame(rows)).set_index("id")
    assert list(out.canonical_id) == [1, 1, 3] and list(out.seen_count) == [2, 2, 1]


def _naive_fold(rows: list[dict]) -> dict[int, tuple]:
    """Every report against every event before it, in the order of the access paths."""
    from wayline.operators.dedupe import BAND, _merge

    rows = sorted(({**r, "last_seen_at": None} for r in rows), key=lambda r: (r["captured_at"], r["drive_id"] or "", r["id"]))
    events, out = [], {}
    for r in rows:
        asked = [e for e in events if r["drive_id"] is not None and any(s["drive_id"] == r["drive_id"] for s in e.sightings)]
        asked += [e for e in events if r["drive_id"] is not None and e.row["drive_id"] == r["drive_id"]]
        if r["lat"] is not None:
            asked += sorted((e for e in events if e.row["lat"] is not None and abs(e.row["lat"] - r["lat"]) <= BAND), key=lambda e: (e.row["lat"], e.row["id"]))
        hit = next(((e, k) for e in asked if (k := match_kind(r, e))), None)
        if hit:
            _merge(hit[0], r, hit[1])
            out[r["id"]] = (hit[0].row["id"], hit[1])
        else:
            events.append(Event(r, [r], [r["source_event_key"]] if r["source_event_key"] else []))
            out[r["id"]] = (r["id"], None)
    return out


def test_fold_against_every_pair(spark: SparkSession) -> None:
    import random

    from wayline.operators.dedupe import FIELDS, fold_reports

    r = random.Random(5)
    rows = []
    for i in range(700):
        spot = r.randint(0, 40)
        rows.append({
            **BASE, "id": i, "source_event_key": f"k{i // 2}" if r.random() < 0.2 else None if r.random() < 0.3 else f"u{i}", "drive_id": r.choice(["d1", "d2", "d3", "d4", None]),
            "captured_at": 1000.0 + r.randint(0, 4000), "source_offset_s": r.choice([None, 10.0 + i]), "lat": None if r.random() < 0.05 else 12.9 + (spot % 8) * 9 * METRE + r.uniform(-4, 4) * METRE,
            "lng": 77.6 + (spot // 8) * 9 * METRE + r.uniform(-4, 4) * METRE, "gps_accuracy": r.choice([5.0, 12.0, 40.0, None]), "speed_mps": r.choice([0.0, 8.0]), "heading": float(r.choice([0, 90, 100])),
            "damage_type": r.choice(["pothole_cavity", "failed_patch", "surface_breakup"]), "size": r.choice([None, "small", "large"]), "dedupe_eligible": r.random() < 0.95,
        })
    want = _naive_fold(rows)
    schema = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"
    got = fold_reports(spark.createDataFrame([[x[c] for c in FIELDS] for x in rows], schema)).collect()
    assert {x["id"]: (x["canonical_id"], x["match"]) for x in got} == want
    assert {k for _, k in want.values()} == {None, "same_source", "same_drive", "prior_drive"}


REPORTS = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"


def _told_components(batches: Iterator) -> Iterator:
    """In place of the fold: the component of every report."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        told = [batch.column("id"), batch.column("component"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(told, ["id", "canonical_id", "match", "seen_count", "last_seen_at", "source_event_keys", "sighting_drive_ids"])


def test_keys_and_drives_of_places_far_apart_make_no_large_component(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Spots a kilometre apart: a key is met again at the next spot on another drive, a drive is at two spots within 30 seconds."""
    from wayline.operators import dedupe

    rows = []
    for i in range(600):
        spot = (i + 1) // 2 % 40
        rows.append({**BASE, "id": i, "source_event_key": f"k{i // 2}", "drive_id": f"d{i // 14 * 7 + i % 7}", "source_offset_s": None, "captured_at": 1000.0 + 4 * i, "lat": 12.9 + 1000 * METRE * spot, "lng": 77.6})
    monkeypatch.setattr(dedupe, "_fold_sorted", _told_components)
    told = {x["id"]: x["canonical_id"] for x in dedupe.fold_reports(spark.createDataFrame([[x[c] for c in dedupe.FIELDS] for x in rows], REPORTS)).collect()}
    assert told == {i: min(j for j in range(600) if (j + 1) // 2 % 40 == (i + 1) // 2 % 40) for i in range(600)}


def test_reports_that_cannot_match_by_place_are_dealt_to_all_tasks(spark: SparkSession) -> None:
    from wayline.operators.dedupe import FIELDS, with_nodes

    rows = [{**BASE, "id": i, "gps_accuracy": 20.0 if i % 4 else 5.0} for i in range(400)]
    for conf in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(conf, {"spark.sql.adaptive.enabled": "false"}.get(conf, "-1"))
    try:
        told = with_nodes(spark.createDataFrame([[x[c] for c in FIELDS] for x in rows], REPORTS)).select("id", "node", F.spark_partition_id().alias("task")).collect()
    finally:
        for conf in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(conf)
    assert {x["id"]: x["node"] for x in told} == {i: i if i % 4 else 0 for i in range(400)}
    assert len({x["task"] for x in told if x["id"] % 4}) == 4


@pytest.mark.parametrize(("seed", "most"), [(1, 64), (2, 64), (3, 2)])
def test_fold_of_places_apart_is_the_fold_of_all_as_one(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, seed: int, most: int) -> None:
    """Keys and drives that join places on the same latitude or not, blurred positions, drives that stand, places beside 180 degrees and the pole."""
    import math
    import random

    import pandas as pd

    from wayline.operators import dedupe

    r, rows = random.Random(seed), []
    spots = [(12.9 + r.choice([0, 0, 6, 500, 900]) * METRE, 77.6 + 0.01 * k) for k in range(12)] + [(0.0, 180.0), (0.0, -180.0), (89.9999, 10.0), (89.9999, 100.0), (-33.0, 18.0)]
    for i in range(900):
        lat, lng = r.choice(spots)
        at = 1e9 + r.choice([0, 86_400, 50 * 86_400]) + r.choice([r.randint(0, 40), r.randint(0, 4000)])
        rows.append({
            **BASE, "id": i, "source_event_key": r.choice([None, "", f"u{i}", f"k{i // 2}", f"k{i % 60}", f"k{i % 8}"]), "drive_id": r.choice([None, "d1", "d2", "d3", f"e{i % 30}", f"e{i % 100}", f"f{i}"]),
            "captured_at": at, "created_at": at, "source_offset_s": r.choice([None, math.nan, float(r.randint(0, 60)), at - 1e9]), "lat": None if r.random() < 0.05 else lat + r.choice([0, r.uniform(-9, 9)]) * METRE,
            "lng": None if r.random() < 0.03 else lng + r.choice([0, r.uniform(-9, 9)]) * METRE / math.cos(math.radians(lat)), "gps_accuracy": r.choice([5.0, 12.0, 15.0, 20.0, 30.0, 40.0, None]),
            "speed_mps": r.choice([0.0, 0.5, 8.0, None]), "heading": float(r.choice([0, 40, 90, 350])), "damage_type": r.choice(["pothole_cavity", "failed_patch", "failed_patch", "surface_breakup", "other_road_damage", "", None]),
            "size": r.choice([None, "small", "large"]), "dedupe_eligible": r.choice([True, True, True, True, False, None]), "capture_source": r.choice(["drive", "drive", "manual"]), "debug_capture": r.random() < 0.1,
        })
    want = {x["id"]: x for x in fold_component(pd.DataFrame(rows)).astype(object).to_dict("records")}
    monkeypatch.setattr(dedupe, "MOST_CORES", most)
    reports = spark.createDataFrame([[x[c] for c in dedupe.FIELDS] for x in rows], REPORTS)
    assert {x["id"]: x.asDict() for x in dedupe.fold_reports(reports).collect()} == want
    assert {x["match"] for x in want.values()} == {None, "same_source", "same_drive", "prior_drive"}
    monkeypatch.setattr(dedupe, "_fold_sorted", _told_components)
    assert len({x["canonical_id"] for x in dedupe.fold_reports(reports).collect()}) > 20


def test_components_are_folded_one_at_a_time_as_their_rows_come() -> None:
    import pyarrow as pa

    from wayline.operators.dedupe import _fold_sorted

    taken = []

    def batches() -> Iterator[pa.RecordBatch]:
        for component in range(3):
            for part in range(4):
                taken.append(component)
                yield pa.RecordBatch.from_pylist([{**BASE, "id": 10_000 * component + 2000 * part + i, "source_event_key": None, "captured_at": 1e6 * (2000 * part + i), "component": component} for i in range(2000)])

    told = []
    for out in _fold_sorted(batches()):
        told += out.column("id").to_pylist()
        assert max(told) // 10_000 >= taken[-1] - 1 and out.num_rows <= 5000
    assert sorted(told) == sorted(10_000 * c + i for c in range(3) for i in range(8000))


def test_spots_out_of_reach_are_not_linked(spark: SparkSession) -> None:
    """A grid of spots 10 metres apart, many reports each: the component of a report is its spot."""
    from wayline.operators.components import connected_components
    from wayline.operators.dedupe import candidate_links, fold_reports, with_nodes

    rows = [(i, "accept", "draft", True, False, "drive", f"d{i}", None, None, 1000.0 * i, 1000.0 * i, 12.9 + i % 9 * 10 * METRE, 77.6 + i // 9 % 5 * 10 * METRE / 0.9748, 5.0, 8.0, 90.0, "failed_patch", None) for i in range(450)]
    schema = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"
    reports = spark.createDataFrame(rows, schema)
    assert connected_components(candidate_links(with_nodes(reports))).count() == 0
    assert {x["id"]: x["canonical_id"] for x in fold_reports(reports).collect()} == {i: i % 45 for i in range(450)}


def test_a_place_seen_for_years_asks_only_the_last_month(monkeypatch: pytest.MonkeyPatch) -> None:
    import pandas as pd

    from wayline.operators import dedupe

    asked = []
    monkeypatch.setattr(dedupe, "match_kind", lambda new, event: asked.append(1) or match_kind(new, event))
    rows = [{**BASE, "id": i, "source_event_key": f"k{i}", "drive_id": f"d{i}", "source_offset_s": None, "captured_at": i // 2 * 32 * 86_400.0 + i} for i in range(4000)]
    out = fold_component(pd.DataFrame(rows)).set_index("id")
    assert (out.canonical_id == out.index // 2 * 2).all() and len(asked) < 3 * len(rows)


def test_a_report_of_a_lone_place_costs_few_calls() -> None:
    """Cells, months and drives without an event are passed over together, not looked up one by one."""
    import sys

    import pandas as pd

    rows = [{**BASE, "id": i, "source_event_key": None, "drive_id": f"d{i}", "source_offset_s": None, "captured_at": i // 2 * 32 * 86_400.0 + i} for i in range(3000)]
    frame, calls = pd.DataFrame(rows), [0]

    def count(_frame: object, event: str, _arg: object) -> None:
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        fold_component(frame)
    finally:
        sys.setprofile(None)
    assert calls[0] < 200 * len(rows)


def _sorted_batches(rows: list[dict], size: int) -> Iterator:
    import math

    import pyarrow as pa

    rows = sorted(rows, key=lambda r: (r["component"], r["captured_at"] if r["captured_at"] is not None and math.isfinite(r["captured_at"]) else math.inf, r["drive_id"] or "", r["id"]))
    texts = ("decision", "status", "capture_source", "drive_id", "source_event_key", "damage_type", "size")
    schema = pa.schema([(c, pa.string() if c in texts else pa.int64() if c in ("id", "component") else pa.bool_() if isinstance(rows[0][c], bool) else pa.float64()) for c in rows[0]])
    return iter(pa.Table.from_pylist(rows, schema).to_batches(size))


@pytest.mark.parametrize("seed", range(6))
def test_spells_of_components_against_every_event(seed: int) -> None:
    """Places with long pauses: drives and keys that come back after these, empty keys, components with a report of no time."""
    import math
    import random

    import pandas as pd

    from wayline.operators.dedupe import FIELDS, _fold_sorted, fold_component

    r, rows = random.Random(seed), []
    for i in range(1200):
        if i % 3 == 0:
            c, day = r.choice([1, 2, 3, 5, 9, 10 + i]), r.choice([3, 20, 45, 47]) * r.randint(0, 60)
        at = math.inf if c == 9 and r.random() < 0.05 else 1e9 + 86_400.0 * (day + r.choice([0, 0, 0, 29, 31])) + r.randint(0, 9)
        rows.append({
            **{k: BASE[k] for k in FIELDS}, "id": i, "component": c, "source_event_key": r.choice(["", None, f"k{i}"]) if r.random() < 0.97 else f"k{i % 20}", "drive_id": r.choice([None, f"e{i}", f"e{i // 3}", f"e{i // 3}"]) if r.random() < 0.97 else "d",
            "captured_at": at, "created_at": 1e9 + r.randint(0, 150 * 86_400), "source_offset_s": r.choice([None, float(r.randint(0, 300))]), "lat": 12.9 + r.uniform(-6, 6) * METRE, "lng": 77.6 + r.uniform(-6, 6) * METRE,
            "gps_accuracy": r.choice([5.0, 12.0, 40.0]), "speed_mps": r.choice([0.0, 8.0]), "heading": float(r.choice([0, 90, 100])), "size": r.choice([None, "small", "large"]), "dedupe_eligible": r.random() < 0.9,
        })
    got = {x["id"]: x for b in _fold_sorted(_sorted_batches(rows, 7 + 100 * seed)) for x in b.to_pylist()}
    want, whole = {}, {}
    for c in {x["component"] for x in rows}:
        of = [x for x in rows if x["component"] == c]
        want |= _naive_fold(of)
        whole |= {x["id"]: x for x in fold_component(pd.DataFrame(of)).to_dict("records")}
    assert {i: (x["canonical_id"], x["match"]) for i, x in got.items()} == want
    for c in ("seen_count", "last_seen_at", "source_event_keys", "sighting_drive_ids"):
        assert {i: x[c] for i, x in got.items()} == {i: x[c] for i, x in whole.items()}
    assert {"same_source", "same_drive", "prior_drive"} <= {k for _, k in want.values()}


def test_reports_alone_in_their_spell_are_not_folded_row_by_row(monkeypatch: pytest.MonkeyPatch) -> None:
    from wayline.operators import dedupe

    taken = []
    take = dedupe._Events.take
    monkeypatch.setattr(dedupe._Events, "take", lambda self, r: taken.append(r["id"]) or take(self, r))
    rows = [{**BASE, "id": i, "source_event_key": None, "drive_id": f"d{i}", "source_offset_s": None, "captured_at": i * 32 * 86_400.0 + (i % 10 == 1) * -31 * 86_400.0, "component": i // 500} for i in range(2000)]
    told = [x for b in dedupe._fold_sorted(_sorted_batches(rows, 300)) for x in b.to_pylist()]
    assert sorted(taken) == [i for i in range(2000) if i % 10 < 2]
    assert {x["id"]: x["canonical_id"] for x in told} == {i: i - (i % 10 == 1) for i in range(2000)}


def test_tasks_of_the_fold_grow_with_the_reports(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from wayline.operators import dedupe

    monkeypatch.setattr(dedupe, "TASK_ROWS", 10)
    schema = "id long, decision string, status string, dedupe_eligible boolean, debug_capture boolean, capture_source string, drive_id string, source_event_key string, source_offset_s double, captured_at double, created_at double, lat double, lng double, gps_accuracy double, speed_mps double, heading double, damage_type string, size string"
    rows = [(i, "accept", "draft", True, False, "drive", f"d{i}", None, None, 1000.0 * i, 1000.0 * i, 12.9 + i % 40 * 100 * METRE, 77.6, 5.0, 8.0, 90.0, "failed_patch", None) for i in range(200)]
    assert dedupe.fold_reports(spark.createDataFrame(rows, schema)).rdd.getNumPartitions() == 21


@pytest.mark.parametrize("seed", range(6))
def test_fold_over_months_against_every_event(seed: int) -> None:
    """Keys and drives that come back after months, reports of no time, places up to 60 degrees north."""
    import math
    import random

    import pandas as pd

    r, rows = random.Random(seed), []
    lat, lng = r.choice([(12.9, 77.6), (60.0, 150.0), (-45.0, -170.0)])
    for i in range(900):
        at = r.choice([1e9 + r.randint(0, 150 * 86_400), 1e9 + r.randint(0, 90), math.inf if r.random() < 0.1 else 1e9 + 86_400.0 * r.randint(0, 150)])
        rows.append({
            **BASE, "id": i, "source_event_key": f"k{i % 60}" if r.random() < 0.2 else "", "drive_id": r.choice(["d1", "d2", None, f"e{i}", f"e{i - 1}"]), "captured_at": at, "created_at": 1e9 + r.randint(0, 150 * 86_400),
            "source_offset_s": r.choice([None, float(r.randint(0, 300))]), "lat": lat + r.uniform(-12, 12) * METRE, "lng": lng + r.uniform(-12, 12) * METRE / math.cos(math.radians(lat)), "gps_accuracy": r.choice([5.0, 5.0, 12.0, 40.0]),
            "speed_mps": r.choice([0.0, 8.0]), "heading": float(r.choice([0, 90, 100])), "damage_type": r.choice(["pothole_cavity", "failed_patch", "surface_breakup", "other_road_damage"]), "size": r.choice([None, "small", "large"]),
            "dedupe_eligible": r.choice([True, True, True, False]), "capture_source": r.choice(["drive", "drive", "manual"]),
        })
    out = fold_component(pd.DataFrame(rows))
    got = {x.id: (x.canonical_id, x.match) for x in out.itertuples()}
    assert {i: (c, k if isinstance(k, str) else None) for i, (c, k) in got.items()} == _naive_fold(rows)
    assert set(out.match.dropna()) == {"same_source", "same_drive", "prior_drive"}


def test_gate() -> None:
    assert cadence(0.0, 12.0) == 8 and cadence(3.0, 5.0) == 2 and cadence(12.0, 5.0) == 0.75 and cadence(None, 60.0) == 1
    fix = lambda t, lat=12.9, speed=0.0, now=None: {"ts": t, "now": t if now is None else now, "lat": lat, "lng": 77.6, "accuracy": 5.0, "speed_mps": speed}
    parked = [fix(float(t)) for t in range(20)]
    assert [r["ts"] for r, f in zip(parked, gate(parked, None)[0]) if f] == [0, 8, 16]
    moving = [fix(float(t), 12.9 + t * 8.3 * METRE, 8.3) for t in range(10)]
    assert all(gate(moving, None)[0])
    assert gate([fix(0.0, now=11.0)], None)[0] == [False]


def test_dates(spark: SparkSession) -> None:
    now = F.lit(datetime(2026, 8, 20, tzinfo=timezone.utc))
    cases = {"20-08-2026": "dlp", "21-08-2025": "dlp", "20-08-2024": "maint", "20-08-2020": "record", "21-08-2026": "record", "31-02-2026": "dlp", "01-13-2025": "record", "x": "record", None: "record"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "d string, want string")
    assert rows.where(dates.warranty_code(F.col("d"), now) != F.col("want")).count() == 0
    assert [r[0].isoformat() for r in spark.createDataFrame([("31-02-2024",)], "d string").select(dates.rolled_date(F.col("d"))).collect()] == ["2024-03-02"]


def test_places_and_roads(spark: SparkSession) -> None:
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    square, hole = ring((70, 10), (72, 10), (72, 12), (70, 12), (70, 10)), ring((70.5, 10.5), (71, 10.5), (71, 11), (70.5, 11), (70.5, 10.5))
    regions = spark.createDataFrame([("a", "auth-a", [[square, hole]]), ("b", "auth-b", [[ring((71.5, 11.5), (73, 11.5), (73, 13), (71.5, 13))]])], "region_id string, authority_id string, geometry array<array<array<struct<x:double,y:double>>>>")
    where = {1: (70.2, 10.2), 2: (70.7, 10.7), 3: (70.0, 11.0), 4: (70.5, 10.7), 5: (71.7, 11.7), 6: (60.0, 1.0), 7: (None, None), 8: (70.00001, 11.0)}
    points = spark.createDataFrame([(i, y, x, 5.0, None, None) for i, (x, y) in where.items()], "id int, lat double, lng double, gps_accuracy double, heading double, speed double")
    got = {r["id"]: (r["region_id"], r["reason"]) for r in containment.exclusive_region(points, regions, "id").collect()}
    assert [got[i] for i in range(1, 8)] == [("a", "covered"), (None, "outside"), ("a", "covered"), (None, "outside"), (None, "location_uncertain"), (None, "outside"), (None, "outside")]
    boxes = spark.createDataFrame([("a", 10.19, 10.21, 70.19, 70.21)], "region_id string, south double, north double, west double, east double")
    roads = spark.createDataFrame([("e070n20", 0, "NH-1", [6990000, 2000000, 7010000, 2000000], [6990000, 2000000, 20000, 0]), ("e070n20", 1, "NH-2", [7000500, 1999000, 7000500, 2001000], [7000500, 1999000, 0, 2000])], "tile_id string, ordinal int, refs string, bbox array<long>, deltas array<long>")
    routed = {r["id"]: r["reason"] for r in containment.route(points, regions, boxes, nearest.match_highway(points, roads, "id"), "id").collect()}
    assert routed == {1: "outside_area", 2: "outside_area", 3: "location_uncertain", 4: "location_uncertain", 5: "location_uncertain", 6: "outside_area", 7: "no_location", 8: "location_uncertain"}
    metre = 1 / 110_540
    more = {
        10: (70.3, 11.5, 5.0, "municipal"), 11: (70.3, 10 - 1.1 * metre, 10.0, "location_uncertain"), 12: (70.3, 10 - 20 * metre, 10.0, "outside_area"),
        13: (60.0, 1.0, 31.0, "location_uncertain"), 14: (60.0, 1.0, None, "location_uncertain"), 15: (40.0, 1.0, 31.0, "outside_area"), 16: (70.3, 11.5, 31.0, "location_uncertain"),
        17: (70.21 + 2 * metre, 10.2, 5.0, "location_uncertain"), 18: (72.5, 12.5, 5.0, "jurisdiction_unavailable"), 19: (70.3, 11.5, float("nan"), "location_uncertain"),
    }
    regions = regions.withColumn("authority_id", F.when(F.col("region_id") == "a", F.col("authority_id")))
    points = spark.createDataFrame([(i, y, x, accuracy, None, None) for i, (x, y, accuracy, _) in more.items()], points.schema)
    none = spark.createDataFrame([], "id int, ref string, uncertain boolean")
    routed = {r["id"]: r["reason"] for r in containment.route(points, regions, boxes, none, "id", (0.0, 20.0, 50.0, 80.0)).collect()}
    assert routed == {i: want for i, (*_, want) in more.items()}
    free = containment.route(points.where("id = 13"), regions, boxes, none, "id", enforce=False).first()
    assert free["reason"] == "outside_area"

    fixes = [(1, 20.0, 70.0, 5.0, 90.0, 10.0), (2, 20.0, 70.0, 5.0, 0.0, 10.0), (3, 20.0, 70.0, None, 90.0, 10.0), (4, 20.0, 70.00501, 5.0, None, None), (5, 20.002, 70.0, 5.0, 90.0, 10.0)]
    on = nearest.match_highway(spark.createDataFrame(fixes, points.schema), roads, "id")
    assert {r["id"]: (r["ref"] if r["id"] != 4 else "", r["uncertain"]) for r in on.collect()} == {1: ("NH-1", False), 3: ("NH-1", True), 4: ("", True)}


def test_near_pairs_on_the_globe(spark: SparkSession) -> None:
    """Against all pairs: across 180 degrees, near the poles, and at random."""
    import random

    from wayline.operators.near_join import near_join

    r = random.Random(3)
    spots = [(r.choice([0.0, 45.0, 89.5, -89.99, 12.9]) + r.uniform(0, 4e-4), (180 - r.uniform(0, 3e-4)) * r.choice([-1, 1])) for _ in range(300)] + [(90.0, 0.0), (89.99999, 120.0)]
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "id int, lat double, lng double")
    got = {(x["a"]["id"], x["b"]["id"]) for x in near_join(table, table, 15.0).collect()}
    rows = {i: {"lat": la, "lng": ln} for i, (la, ln) in enumerate(spots)}
    from wayline.operators.dedupe import _metres

    assert got == {(i, j) for i in rows for j in rows if _metres(rows[i], rows[j]) <= 15.0}


def test_id_pairs_of_places_that_repeat(spark: SparkSession) -> None:
    """Against all pairs: places of many lists, keys that repeat or are null, rows without a place."""
    import random

    from wayline.operators.dedupe import _metres
    from wayline.operators.near_join import near_id_pairs

    r = random.Random(9)
    rows = [(r.choice([None, *range(150)]) if i < 40 else i, 12.9 + r.choice([0, 0, 0, 5, 9, 30]) * METRE, 77.6 + r.choice([0, 0, 8]) * METRE) for i in range(260)] + [(1000, None, 77.6), (1001, float("nan"), 77.6)]
    got = near_id_pairs(spark.createDataFrame(rows, "id long, lat double, lng double"), "id", 10.0, most=7).collect()
    known = [{"id": i, "lat": la, "lng": ln} for i, la, ln in rows[:260] if i is not None]
    want = [(a["id"], b["id"], round(_metres(a, b), 3)) for a in known for b in known if a["id"] < b["id"] and _metres(a, b) <= 10.0]
    assert sorted((x["a"], x["b"], x["metres"]) for x in got) == sorted(want) and len(want) > 10_000


def test_lines(spark: SparkSession) -> None:
    line = spark.createDataFrame([([{"x": 70.000005, "y": 20.0}, {"x": 70.000005, "y": 20.0}, {"x": 70.00002, "y": 20.00001}],)], "p array<struct<x:double,y:double>>")
    coded = line.select(geo.encode_line(F.col("p")).alias("d"))
    assert coded.first()["d"] == [7000000, 2000000, 2, 1]
    assert [(round(p["x"], 5), round(p["y"], 5)) for p in coded.select(geo.decode_line(F.col("d")).alias("q")).first()["q"]] == [(70.0, 20.0), (70.00002, 20.00001)]


def test_simplified_lines() -> None:
    """Against the rule by recursion, and parts by their definition."""
    import math
    import random

    import numpy as np

    from wayline.operators.highways import pieces, simplified

    def off(p: tuple, a: tuple, b: tuple) -> float:
        kx = 111_320 * math.cos(math.radians(p[1]))
        u, v = ((a[0] - p[0]) * kx, (a[1] - p[1]) * 110_540), ((b[0] - p[0]) * kx, (b[1] - p[1]) * 110_540)
        return min(math.hypot(u[0] + t / 2000 * (v[0] - u[0]), u[1] + t / 2000 * (v[1] - u[1])) for t in range(2001))

    def rule(ps: list) -> list:
        if len(ps) < 3:
            return ps
        far = max(range(1, len(ps) - 1), key=lambda i: off(ps[i], ps[0], ps[-1]))
        return rule(ps[: far + 1])[:-1] + rule(ps[far:]) if off(ps[far], ps[0], ps[-1]) > 2 else [ps[0], ps[-1]]

    r = random.Random(4)
    for _ in range(8):
        line = [(77.6 + i * 2e-5, 12.9 + r.uniform(0, 8e-5)) for i in range(40)]
        assert [tuple(p) for p in simplified(np.array(line), 2.0)] == rule(line)
    line = np.array([(77 + i * 0.001, 20.0) for i in range(30)])
    parts = list(pieces(line, 500.0, 4))
    assert all(2 <= len(p) <= 5 for p in parts) and (np.concatenate([p[:-1] for p in parts] + [line[-1:]]) == line).all()


def test_texts(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("  Ａuthority   X ", '{"b":1,"a":[2,null]}'), (None, "{")], "n string, j string")
    assert [tuple(r) for r in rows.select(text.authority_key("n"), text.canonical_json("j")).collect()] == [("authority x", '{"a":[2,null],"b":1}'), (None, None)]
    refs = spark.createDataFrame([("NH 048;NE-1; xNH5", None), ("44a", "IN:NH"), ("44", None)], "r string, n string")
    assert [r[0] for r in refs.select(text.highway_refs(F.col("r"), F.col("n"))).collect()] == [["NH-48", "NE-1"], ["NH-44A"], []]
    odd = ["nh - 7abc", "NH--7", "NH7abcd", "NH 12345", "NHNH5", "NH NH 5", "NE 3/NH3;NH03", "(NH-44)", None, "NH", "anh44 nh44"]
    want = [["NH-7ABC"], [], [], [], [], ["NH-5"], ["NH-3", "NE-3"], ["NH-44"], [], [], ["NH-44"]]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, r string").orderBy("i").select(text.highway_refs(F.col("r"), F.lit(None).cast("string")))
    assert [r[0] for r in rows.collect()] == want
    wards = {"K/E WARD": "K/E", "x, k-w ward, y": "K/W", "WARD G/N,": "G/N", "L Ward": "L", "H  East   Ward": "H/E", "Z Ward": None, "aK/E WARD": None, "F NORTH WARD, Z WARD": "F/N", "": None}
    rows = spark.createDataFrame(list(wards.items()), "w string, want string")
    assert [tuple(r) for r in rows.select("w", text.ward_code(F.col("w"))).collect()] == list(wards.items())


def test_tables(spark: SparkSession) -> None:
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, at int")
    b = spark.createDataFrame([(2, "z", 1), (3, "w", 1)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in tables.upsert(a, b, ["id"], "at").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert [r["id"] for r in tables.deleted(a, b, ["id"]).collect()] == [1] and not tables.same_rows(a, b) and tables.same_rows(a, a)
    raw = spark.createDataFrame([(1, '{"a":1,"c":2}')], "id int, raw string")
    assert [r["unexpected"] for r in tables.unexpected_keys(raw, "id", "raw", ["a", "b"]).collect()] == ["c"]


def test_interval() -> None:
    assert evalstats.interval([]) == (0.0, 0.0, 0.0)
    mean, low, high = evalstats.interval([0.0, 1.0, 1.0, 1.0])
    assert mean == 0.75 and low <= mean <= high


def test_rings_that_cross_themselves(spark: SparkSession) -> None:
    ring = lambda *ps: ([{"x": float(x), "y": float(y)} for x, y in ps],)
    rows = [ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)), ring((0, 0), (4, 0), (2, 0), (2, 3), (0, 0)), ring((0, 0), (4, 0), (1, 1), (0, 4), (0, 0))]
    rings = spark.createDataFrame(rows, "r array<struct<x:double,y:double>>")
    assert [r[0] for r in rings.select(geo.self_intersects(F.col("r"))).collect()] == [False, True, True, False]
    assert [r[0] for r in rings.select(geo.valid_ring(F.col("r"))).collect()] == [True] * 4
    assert rings.select(geo.ring_area_km2(F.col("r"))).first()[0] == pytest.approx(197_600, rel=0.01)


def test_frames(spark: SparkSession) -> None:
    from wayline.functions.frames import frame_measures

    grid = [0.0] * 4 + [0.0, 100.0, 250.0, 0.0] + [0.0] * 4
    got = spark.createDataFrame([(grid, 4)], "g array<double>, w int").select(frame_measures("g", "w").alias("m")).first()["m"]
    assert got["sharpness"] == (150 + 900) / 2 and got["luminance"] == pytest.approx(350 / 12) and got["clipped"] == pytest.approx(11 / 12)
    lift = spark.createDataFrame([(40.0, 0.01), (80.0, 0.01), (10.0, 0.5)], "m double, b double")
    assert [r[0] for r in lift.select(decide.low_light_lift(F.col("m"), F.col("b"))).collect()] == [1.65, 1.0, 1.0]


def test_authorities(spark: SparkSession) -> None:
    from wayline.operators.authorities import alias_collisions, matched_authorities, report_routes

    aliases = spark.createDataFrame([("Thane", "t"), ("thane  West", "t"), ("Pune", "p"), ("PUNE ", "q")], "alias string, authority_id string")
    places = spark.createDataFrame([(1, " THANE west", "thane"), (2, None, ""), (3, "pune", None)], "id int, suburb string, city string")
    got = {(r["id"], r["authority_id"], r["field"]) for r in matched_authorities(places, aliases, "id", ["suburb", "city"]).collect()}
    assert got == {(1, "t", "suburb"), (3, "p", "suburb"), (3, "q", "suburb")}
    assert [r["alias"] for r in alias_collisions(aliases).collect()] == ["pune"]
    known = spark.createDataFrame([("t", "Thane", "a@b.in", None)], "authority_id string, authority_name string, email string, handoff_url string")
    routed = spark.createDataFrame([(1, "t", True), (2, "t", False)], "id int, authority_id string, covered boolean")
    assert {(r["id"], r["email"]) for r in report_routes(routed, known, "id").collect()} == {(1, "a@b.in"), (2, None)}
