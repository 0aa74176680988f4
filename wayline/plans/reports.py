"""Queries over report tables: reads by key, imports, provenance, statuses and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import dates, decide, geo, text
from wayline.operators import footage, reports, tables, validators
from wayline.operators.dedupe import fold_reports
from wayline.plans.define import FIXES_SQL, MICROS, Book, Tables, fixes
from wayline.streaming.drives import first_verdicts

book = Book()


@book.query("SELECT event_id AS id, event_type AS status, props AS photo_url FROM events ORDER BY event_id DESC")
def report_listing(table: Tables) -> DataFrame:
    stored = table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("props").alias("photo"), F.repeat("props", 20).alias("photo_full"))
    return reports.listing(stored)


@book.query("SELECT event_id AS id, event_type AS status FROM events ORDER BY event_id DESC LIMIT 40")
def newest_reports(table: Tables) -> DataFrame:
    return reports.listing(table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status")), 40)


@book.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def report_by_key(table: Tables) -> DataFrame:
    some = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reports.by_key(some, "o_orderkey", some.agg(F.max("o_orderkey")).first()[0])


@book.query("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS drive_id, value FROM events WHERE user_id = 7 ORDER BY event_id")
def footage_of_drive(table: Tables) -> DataFrame:
    clips = table("events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("drive_id"), "value")
    return reports.of_drive(clips, "7", [F.asc("seq")])


@book.query("SELECT event_id AS id FROM events WHERE user_id % 50 = 3 OR event_id % 50 = 3")
def reports_sighted_on_drive(table: Tables) -> DataFrame:
    ids = F.array((F.col("user_id") % 50).cast("string"), (F.col("event_id") % 50).cast("string"))
    return reports.sighted_on(table("events").select(F.col("event_id").alias("id"), ids.alias("sighting_drive_ids")), "3").select("id")


@book.query(f"WITH {FIXES_SQL} SELECT event_id, round(lat, 6) AS lat FROM fixes WHERE lat BETWEEN 12.95 - 8 / 110900.0::DOUBLE AND 12.95 + 8 / 110900.0::DOUBLE")
def latitude_band(table: Tables) -> DataFrame:
    return reports.latitude_band(fixes(table), 12.95).select("event_id", F.round("lat", 6).alias("lat"))


_ODD = "CASE event_id % {n} WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@book.query(f"""
WITH s AS (SELECT event_id, user_id, {", ".join(f"{_ODD.format(n=5 + k)} AS c{k}" for k in range(7))} FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS drive_id, {", ".join(f"CASE WHEN isfinite(c{k}) THEN c{k} END AS {name}" for k, name in enumerate(decide.MEASURED))},
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'k' || event_id END AS source_event_key FROM s""")
def clean_sightings(table: Tables) -> DataFrame:
    given = table("events").select("event_id", F.col("user_id").alias("drive_id"), *[F.expr(_ODD.format(n=5 + k)).alias(name) for k, name in enumerate(decide.MEASURED)], F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("k"), "event_id")).alias("source_event_key"))
    return given.select("event_id", reports.clean_sighting().alias("s")).select("event_id", "s.*")


_NATIVE = (
    "event_id - 5 AS id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE 'key-' || event_id END AS source_event_key; CASE event_id % 6 WHEN 0 THEN 91.5 WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS lat;"
    " CASE WHEN event_id % 17 = 0 THEN -181.0 ELSE 77.25 END AS lng; CASE WHEN event_id % 3 = 0 THEN 'Road ' || user_id END AS address; CASE WHEN event_id % 2 = 0 THEN 1 END AS is_reportable;"
    " CASE WHEN event_id % 5 = 0 THEN 'probable' END AS assessment; CAST(NULL AS {s}) AS image_quality; CASE WHEN event_id % 7 = 0 THEN 'failed_patch' WHEN event_id % 7 = 1 THEN '' END AS damage_type;"
    " CASE WHEN event_id % 9 = 0 THEN 'single_view' END AS temporal_consistency; event_id * 250 AS captured_ms; CASE event_id % 3 WHEN 0 THEN 'drive' WHEN 1 THEN 'odd' END AS mode;"
    " CASE WHEN event_id % 2 = 0 THEN 'My Dashcam' END AS source; CASE event_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'huge' END AS size"
)


@book.query(f"""
WITH n AS (SELECT {_NATIVE.format(s="VARCHAR").replace(";", ",")} FROM events)
SELECT CAST(id AS BIGINT) AS native_id, coalesce(nullif(source_event_key, ''), 'native:' || id) AS source_event_key, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng,
  coalesce(address, printf('%.5f, %.5f', CAST(lat AS DOUBLE), CAST(lng AS DOUBLE))) AS address, CAST(coalesce(is_reportable, 0) AS INTEGER) AS is_reportable, coalesce(assessment, 'clear') AS assessment,
  coalesce(image_quality, 'usable') AS image_quality, coalesce(nullif(damage_type, ''), 'pothole_cavity') AS damage_type, coalesce(temporal_consistency, 'consistent') AS temporal_consistency,
  CAST(coalesce(nullif(damage_type, ''), 'pothole_cavity') = 'pothole_cavity' AS INTEGER) AS is_pothole, captured_ms / 1000.0::DOUBLE AS captured_at,
  CASE WHEN mode = 'drive' THEN 'drive' WHEN source IS NOT NULL THEN 'drive' ELSE 'manual' END AS entry_mode, CASE WHEN size = 'small' THEN size ELSE 'unknown' END AS size
FROM n WHERE id > 0 AND isfinite(lat) AND abs(lat) <= 90 AND abs(lng) <= 180""")
def native_imports(table: Tables) -> DataFrame:
    parts = [c for piece in _NATIVE.format(s="STRING").split(";") for c in ([piece] if " AS id, " not in piece else piece.split(", ", 1))]
    return reports.imported(table("events").selectExpr(*parts))


@book.query("""
WITH r AS (SELECT c_custkey AS id, c_nationkey, c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS covered, n_name AS authority_name, 'mail' || n_nationkey || '@x.in' AS email FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c.c_custkey AS id, coalesce(r.covered, false) AS covered, CASE WHEN r.covered THEN r.authority_name END AS authority_name, CASE WHEN r.covered THEN r.email END AS email,
  CASE WHEN c.c_nationkey % 3 <> 0 THEN 'p' || (c.c_nationkey % 5) END AS routing_pack_id, CASE WHEN c.c_nationkey % 3 <> 0 AND c.c_nationkey % 5 < 4 THEN CAST(c.c_nationkey % 5 + 1 AS VARCHAR) END AS version
FROM customer c LEFT JOIN r ON c.c_custkey = r.id""".replace("'p' || (c.c_nationkey % 5) END AS routing_pack_id", "CASE WHEN c.c_nationkey % 5 < 4 THEN 'p' || (c.c_nationkey % 5) END END AS routing_pack_id"))
def report_records(table: Tables) -> DataFrame:
    people, i, n = table("customer"), F.col("c_custkey"), F.col("c_nationkey")
    routed = people.join(table("nation"), n == F.col("n_nationkey")).select(
        i.alias("id"), F.when(i % 5 != 0, i % 4 != 0).alias("covered"), F.col("n_name").alias("authority_name"), F.concat(F.lit("mail"), "n_nationkey", F.lit("@x.in")).alias("email")
    )
    packs = people.sparkSession.range(4).selectExpr("'p' || id AS pack_id", "CAST(id + 1 AS INT) AS pack_version", "sha2(CAST(id AS STRING), 256) AS sha256", "'KA' AS state_code")
    told = people.select(i.alias("id"), F.when(n % 3 != 0, F.concat(F.lit("p"), n % 5)).alias("pack"))
    made = reports.provenance(reports.records(told, routed, "id", ["authority_name", "email"]), packs, "pack")
    return made.select("id", "covered", "authority_name", "email", "routing_pack_id", F.col("routing_pack_version").cast("string").alias("version"))


@book.query(f"""
WITH {FIXES_SQL}, cache AS (SELECT CAST(round(lat * 10000) AS BIGINT) AS y, CAST(round(lng * 10000) AS BIGINT) AS x, arg_min('Street ' || event_id, event_id) AS address FROM fixes WHERE event_type = 'click' GROUP BY 1, 2)
SELECT event_id, c.address FROM fixes f LEFT JOIN cache c ON CAST(round(f.lat * 10000) AS BIGINT) = c.y AND CAST(round(f.lng * 10000) AS BIGINT) = c.x""")
def geocode_cache(table: Tables) -> DataFrame:
    points = fixes(table)
    cached = points.where("event_type = 'click'").select("lat", "lng", F.concat(F.lit("Street "), "event_id").alias("address"), F.col("event_id").alias("ordinal"))
    return reports.geocoded(points, cached).select("event_id", "address")


@book.query("""
WITH m AS (SELECT n_nationkey % 20 AS sha, min('n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS owner FROM nation GROUP BY 1)
SELECT c_custkey AS id, owner FROM customer JOIN m ON sha = c_custkey % 30 WHERE owner <> 'n' || lpad(CAST(c_custkey % 25 AS VARCHAR), 2, '0')""")
def foreign_digests(table: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 2, "0"))
    manifest = table("nation").select(name(F.col("n_nationkey")).alias("pack_id"), F.sha2((F.col("n_nationkey") % 20).cast("string"), 256).alias("sha256"))
    saved = table("customer").select(F.col("c_custkey").alias("id"), name(F.col("c_custkey") % 25).alias("routing_pack_id"), F.sha2((F.col("c_custkey") % 30).cast("string"), 256).alias("routing_pack_sha256"))
    return reports.foreign_digests(saved, manifest).select("id", "owner")


@book.query("""
WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'queued' WHEN 2 THEN 'sent' WHEN 3 THEN 'unrouted' WHEN 4 THEN 'review' ELSE 'rejected' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'submit' WHEN 2 THEN 'edit' ELSE 'delete' END AS action, CASE user_id % 3 WHEN 0 THEN ' ab ' WHEN 1 THEN 'BMC-1234' END AS reference, user_id % 2 = 0 AS required FROM events)
SELECT event_id, status, action, CASE
  WHEN action = 'open' AND status IN ('draft', 'queued') THEN 'queued'
  WHEN action = 'submit' AND status IN ('draft', 'queued', 'sent') AND (NOT required OR length(trim(coalesce(reference, ''))) >= 4) THEN 'sent'
  WHEN action = 'edit' AND status IN ('draft', 'queued') THEN status WHEN action = 'delete' AND status <> 'sent' THEN 'deleted' END AS after FROM a""")
def status_transitions(table: Tables) -> DataFrame:
    pick = lambda c, names: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    status, action = pick("event_id", ["draft", "queued", "sent", "unrouted", "review", "rejected"]), pick("event_id", ["open", "submit", "edit", "delete"])
    given = table("events").select("event_id", status.alias("status"), action.alias("action"), pick("user_id", [" ab ", "BMC-1234", None]).alias("reference"), (F.col("user_id") % 2 == 0).alias("required"))
    return given.select("event_id", "status", "action", reports.transition(F.col("status"), F.col("action"), F.col("reference"), F.col("required")).alias("after"))


@book.query("""
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN epoch_us(ts) ELSE max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS commit_at FROM events""")
def ordered_commits(table: Tables) -> DataFrame:
    done = table("events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("drive_id"), (-F.col("event_id")).alias("seq"), F.expr(MICROS).alias("ready_at"))
    return reports.in_commit_order(done).select("event_id", "commit_at")


@book.query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT CAST(user_id AS VARCHAR) AS drive_id, count(*) AS captures, max(us) - min(us) AS span, round((max(us) - min(us)) / (count(*) - 1), 3) AS spacing, max(gap) AS longest FROM g GROUP BY user_id""")
def capture_gaps(table: Tables) -> DataFrame:
    made = reports.capture_gaps(table("events").select(F.col("user_id").cast("string").alias("drive_id"), F.col("event_id").alias("seq"), F.expr(MICROS).alias("ts")))
    return made.withColumn("spacing", F.round("spacing", 3))


@book.query("SELECT doc_id, lang, source, CAST(quality AS INTEGER) AS human_label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def labelled_reports(table: Tables) -> DataFrame:
    told = table("labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("human_label"))
    return table("documents").select("doc_id", "lang", "source").join(told, "doc_id")


@book.query("SELECT count(*) AS labelled, count(*) FILTER (quality = 1) AS positive FROM labels WHERE quality IS NOT NULL")
def labelled_count(table: Tables) -> DataFrame:
    return table("labels").where("quality IS NOT NULL").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("positive"))


@book.query("""
SELECT doc_id AS id, 'label ' || quality AS kind FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def candidates_without_repeats(table: Tables) -> DataFrame:
    first = table("labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("label "), "quality").alias("kind"))
    return reports.without_repeats(first, table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind")))


@book.query("SELECT event_id, event_id % 3 = user_id % 3 AS same FROM events")
def set_equality(table: Tables) -> DataFrame:
    members = lambda c: F.array((F.col(c) % 3).cast("int"), F.lit(9), (F.col(c) % 3).cast("int"))
    return table("events").select("event_id", reports.same_members(members("event_id"), F.reverse(members("user_id"))).alias("same"))


@book.query("""
SELECT event_id, (epoch_us(ts) + 500) // 1000 AS millis, strftime(make_timestamp((epoch_us(ts) + 500) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
  strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y %H:%M') AS india FROM events""")
def epoch_conversions(table: Tables) -> DataFrame:
    seconds = F.expr(f"({MICROS} + 500) div 1000") / 1000
    at = F.timestamp_micros(F.expr(MICROS))
    return table("events").select("event_id", dates.epoch_millis(seconds).alias("millis"), dates.iso_text(seconds).alias("iso"), dates.in_kolkata(at).alias("india"))


@book.query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN trunc(value) WHEN 2 THEN -trunc(value) WHEN 3 THEN event_id - 1 ELSE 0 END AS INTEGER) AS whole FROM events""")
def whole_numbers(table: Tables) -> DataFrame:
    odd = F.expr("CASE event_id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN value WHEN 2 THEN -value WHEN 3 THEN 4294967295D + event_id ELSE CAST(NULL AS DOUBLE) END")
    return table("events").select("event_id", dates.whole32(odd).alias("whole"))


@book.query("""
SELECT event_id, event_id % 6 IN (0, 1) AS inside, event_id % 6 <> 2 AS sound_id FROM events""")
def footage_paths(table: Tables) -> DataFrame:
    drive = F.expr("CASE event_id % 6 WHEN 2 THEN '../d' || user_id ELSE 'd-' || user_id END")
    path = F.expr("CASE event_id % 6 WHEN 0 THEN 'footage/d-' || user_id || '/1.mp4' WHEN 1 THEN 'footage/d-' || user_id || '/x' WHEN 2 THEN 'footage/../d' || user_id || '/1.mp4' WHEN 3 THEN 'footage/d-' || user_id || '/..' WHEN 4 THEN 'footage/other/1.mp4' ELSE 'footage/d-' || user_id || '/a/b' END")
    return table("events").select("event_id", text.path_in_drive(path, drive).alias("inside"), text.well_formed(drive, "drive_id").alias("sound_id"))


_IDENTITY = {
    "authority_id": ("CASE p_partkey % 4 WHEN 0 THEN 'mh-' || p_partkey || 'x' WHEN 1 THEN 'MH-pune' WHEN 2 THEN 'm-pune' ELSE 'ka-bbmp-east' END", "p_partkey % 4 IN (0, 3)"),
    "email": ("CASE p_partkey % 4 WHEN 0 THEN 'a.b@c.in' WHEN 1 THEN 'a@b' WHEN 2 THEN 'a b@c.in' ELSE 'x@y.z.in' END", "p_partkey % 4 IN (0, 3)"),
    "https": ("CASE p_partkey % 3 WHEN 0 THEN 'https://x.in/y' WHEN 1 THEN 'http://x.in' ELSE 'https://x y' END", "p_partkey % 3 = 0"),
    "whatsapp": ("CASE p_partkey % 3 WHEN 0 THEN 'https://wa.me/919999999999' WHEN 1 THEN 'https://wa.me/0999999999' ELSE 'https://wa.me/91' END", "p_partkey % 3 = 0"),
    "package": ("CASE p_partkey % 3 WHEN 0 THEN 'in.gov.app_1' WHEN 1 THEN 'app' ELSE '1n.gov' END", "p_partkey % 3 = 0"),
    "helpline": ("CASE p_partkey % 3 WHEN 0 THEN '1916' WHEN 1 THEN '19' ELSE '19-16' END", "p_partkey % 3 = 0"),
    "sha256": ("CASE p_partkey % 3 WHEN 0 THEN repeat('0a', 32) WHEN 1 THEN repeat('0A', 32) ELSE repeat('0', 63) END", "p_partkey % 3 = 0"),
}


@book.query(" UNION ALL ".join(f"SELECT p_partkey, '{form}' AS rule FROM part WHERE NOT ({ok})" for form, (_, ok) in _IDENTITY.items()))
def registry_violations(table: Tables) -> DataFrame:
    rules = {form: text.well_formed(F.expr(value), form) for form, (value, _) in _IDENTITY.items()}
    return tables.violations(table("part"), ["p_partkey"], rules)


@book.query("""
SELECT c_custkey AS id, c_custkey % 5 IN (0, 1) AS in_state, c_custkey % 3 = 0 AS place FROM customer""")
def places_by_alias(table: Tables) -> DataFrame:
    i = F.col("c_custkey")
    country, state = F.when(i % 5 == 2, "us").when(i % 5 == 3, F.lit(None)).otherwise(" IN "), F.when(i % 5 == 0, "karnataka").when(i % 5 == 4, "goa").otherwise("ka")
    city, town = F.when(i % 3 == 0, "pune").when(i % 3 == 1, "thane"), F.when(i % 3 == 0, "").when(i % 3 == 1, "pune")
    known = decide.in_state(country, state, F.array(F.lit("karnataka"), F.lit("ka")))
    return table("customer").select(i.alias("id"), known.alias("in_state"), decide.place_match(F.array(city, town), F.array(F.lit("pune"), F.lit("poona"))).alias("place"))


@book.query("""
WITH d AS (SELECT event_id // 8 AS answer, event_id % 8 AS seq FROM events)
SELECT answer, CASE WHEN answer % 3 = 0 THEN 'reject' WHEN answer % 3 = 1 THEN 'accept' END AS decision, CASE WHEN answer % 3 = 0 THEN 0 ELSE 7 END AS decided_at
FROM d GROUP BY answer HAVING answer % 3 <> 2 AND count(*) FILTER (seq = CASE WHEN answer % 3 = 0 THEN 0 ELSE 7 END) = 1 AND (answer % 3 = 0 OR count(*) = 8)""")
def streamed_verdicts(table: Tables) -> DataFrame:
    full = '{"reportable":true,|"assessment":"clear",|"image_quality":"usable",|"damage_type":"failed_patch",|"on_drivable_surface":true,|"has_broken_edge_or_rim":true,|"has_depth_or_surface_loss":false,|"temporal_consistency":"consistent"}'
    parts = F.array(*[F.lit(p) for p in full.split("|")])
    i = F.expr("event_id div 8")
    delta = F.when((i % 3 == 0) & (F.col("event_id") % 8 == 0), '{"reportable":false,').when((i % 3 == 2) & (F.col("event_id") % 8 == 3), '"dama').otherwise(F.get(parts, (F.col("event_id") % 8).cast("int")))
    return first_verdicts(table("events").select(i.alias("answer"), (F.col("event_id") % 8).alias("seq"), delta.alias("delta")), "answer")


@book.query("""
SELECT o_orderkey AS id, o_orderkey % 9 < 4 AS accepted, o_orderkey % 4 < 2 OR o_orderkey % 4 = 3 AS compatible, o_orderkey % 3 = 0 AS conflict, o_custkey % 3 = 0 AS shared FROM orders""")
def event_predicates(table: Tables) -> DataFrame:
    i = F.col("o_orderkey")
    pick = lambda c, n, names: F.get(F.array(*map(F.lit, names)), (F.col(c) % n).cast("int"))
    status = pick("o_orderkey", 9, [*decide.ACCEPTED_STATUSES, "review", "rejected", None, "odd", ""])
    a, b = pick("o_orderkey", 4, ["pothole_cavity", "rut_or_depression", "none", "failed_patch"]), pick("o_orderkey", 4, ["failed_patch", "rut_or_depression", "pothole_cavity", "pothole_cavity"])
    sizes = F.when(i % 3 == 0, "small").when(i % 3 == 1, "medium"), F.when(i % 3 == 0, "large").otherwise("small")
    refs = text.shared_ref(F.lit("NH-1 / NH-2"), pick("o_custkey", 3, ["NH-2 / NE-4", "NH-22", None]))
    return table("orders").select(i.alias("id"), decide.is_accepted(F.lit("review"), status).alias("accepted"), decide.compatible_damage(a, b).alias("compatible"), decide.size_conflict(*sizes).alias("conflict"), refs.alias("shared"))


@book.query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '2024-' || lpad(CAST(1 + event_id % 12 AS VARCHAR), 2, '0') || '-05' END AS day, CAST(user_id AS VARCHAR) || chr(35) || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS segment,
  CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS names, round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 ELSE value + 2 END, 6) AS seen,
  round(greatest(0, 100 - value) * 1000 / 86400, 6) AS age, 4 AS photos FROM events""")
def record_columns(table: Tables) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    day = F.when(i % 4 == 0, F.concat(F.lit("2024-"), F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lit("-05"))).when(i % 4 == 1, "2024-13-05").when(i % 4 == 2, "05-01-2024")
    names = F.when(i % 2 == 0, '["a","b"]').otherwise("[")
    nan = F.lit(float("nan"))
    seen = dates.event_time(F.when(i % 3 == 0, v).otherwise(nan), F.when(i % 3 == 1, v + 1), v + 2)
    return table("events").select(
        "event_id", dates.iso_date(day).cast("string").alias("day"), text.segment_key(F.col("user_id").cast("string"), i % 100_000).alias("segment"), F.size(text.json_texts(names)).alias("names"),
        F.round(seen, 6).alias("seen"), F.round(dates.age_days(v * 1000, F.lit(100_000.0)), 6).alias("age"), F.size(reports.capped(F.sequence(F.lit(1), F.lit(9)), 4)).alias("photos"),
    )


@book.query("""
SELECT user_id, count(*) AS segments, count(*) FILTER (event_id % 5 <> 0 AND event_id % 3 = 0) AS complete FROM events GROUP BY user_id""")
def complete_segments(table: Tables) -> DataFrame:
    i = F.col("event_id")
    return footage.segment_summary(table("events").select("user_id", (i % 5 != 0).alias("has_file"), (i % 3 == 0).alias("rolled_over")), "user_id")


@book.query("""
WITH t AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'T' || (p_partkey % 1500) END AS tn, CASE p_partkey % 4 WHEN 0 THEN 'BLR' WHEN 1 THEN '305850' WHEN 2 THEN '30' ELSE '12345' END AS b,
  CASE WHEN p_partkey % 6 = 0 THEN '2020-01-01' ELSE '01-02-2020' END AS d, p_name AS t FROM part)
SELECT tn, b, 'number' AS rule FROM t WHERE tn = '' UNION ALL SELECT tn, b, 'body' FROM t WHERE b = '30' UNION ALL SELECT tn, b, 'date' FROM t WHERE d = '2020-01-01'
UNION ALL SELECT tn, b, 'duplicate' FROM t GROUP BY tn, b HAVING count(*) > 1""")
def tender_violations(table: Tables) -> DataFrame:
    i = F.col("p_partkey")
    rows = table("part").select(
        F.when(i % 50 == 0, "").otherwise(F.concat(F.lit("T"), i % 1500)).alias("tn"), F.col("p_name").alias("t"), F.lit("Town").alias("loc"), F.lit("").alias("c"),
        F.when(i % 6 == 0, "2020-01-01").otherwise("01-02-2020").alias("d"), F.when(i % 4 == 0, "BLR").when(i % 4 == 1, "305850").when(i % 4 == 2, "30").otherwise("12345").alias("b"),
    )
    return validators.tender_violations(rows)


@book.query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS synced FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def synced_flags(table: Tables) -> DataFrame:
    stored = table("documents").select("doc_id", F.lit(0).alias("synced"))
    return tables.flagged(stored, table("labels"), ["doc_id"], "synced", F.lit(1))


@book.query("""
WITH a AS (
  SELECT s_suppkey AS i, CASE WHEN s_suppkey % 40 = 0 THEN 'IN-Old' ELSE 'in-a' || (s_suppkey % 900) END AS key, CASE WHEN s_suppkey % 37 = 0 THEN '' ELSE s_name END AS name,
    CASE s_suppkey % 3 WHEN 0 THEN 'desk@city.in' WHEN 1 THEN '' ELSE 'no address' END AS mail, CASE WHEN s_suppkey % 5 = 0 THEN 'http://city.in' ELSE 'https://city.in' END AS url,
    CASE WHEN s_suppkey % 7 = 0 THEN '12' ELSE '1916' END AS helpline, CASE WHEN s_suppkey % 11 = 0 THEN 'Second desk' END AS other FROM supplier)
SELECT key, 'id' AS rule FROM a WHERE i % 40 = 0 UNION ALL SELECT key, 'name' FROM a WHERE name = '' UNION ALL SELECT key, 'email' FROM a WHERE i % 3 = 2
UNION ALL SELECT key, 'handoff' FROM a WHERE i % 3 = 1 AND i % 5 = 0 UNION ALL SELECT key, 'handoff_https' FROM a WHERE i % 5 = 0 UNION ALL SELECT key, 'alternate' FROM a WHERE other IS NOT NULL
UNION ALL SELECT key, 'helpline' FROM a WHERE helpline = '12' UNION ALL SELECT key, 'duplicate' FROM a GROUP BY key HAVING count(*) > 1""")
def authority_violations(table: Tables) -> DataFrame:
    i, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rows = table("supplier").select(
        F.when(i % 40 == 0, "IN-Old").otherwise(F.concat(F.lit("in-a"), i % 900)).alias("authority_id"), F.when(i % 37 == 0, "").otherwise(F.col("s_name")).alias("name"),
        F.when(i % 3 == 0, "desk@city.in").when(i % 3 == 1, "").otherwise("no address").alias("officer_email"), F.lit("Desk").alias("handoff_name"),
        F.when(i % 5 == 0, "http://city.in").otherwise("https://city.in").alias("handoff_url"), F.when(i % 11 == 0, "Second desk").alias("alternate_handoff_name"), none.alias("alternate_handoff_url"),
        none.alias("handoff_package"), none.alias("whatsapp_url"), F.when(i % 7 == 0, "12").otherwise("1916").alias("helpline"), F.lit(None).cast("array<string>").alias("aliases"),
    )
    return validators.authority_violations(rows)


@book.query("""
WITH r AS (SELECT p_partkey AS i, 'p' || p_partkey AS entry_id FROM part)
SELECT entry_id, 'entry' AS rule FROM r WHERE i % 19 = 0 UNION ALL SELECT entry_id, 'kind' FROM r WHERE i % 3 = 2 UNION ALL SELECT entry_id, 'versions' FROM r WHERE i % 23 = 0
UNION ALL SELECT entry_id, 'digest' FROM r WHERE i % 29 = 0 UNION ALL SELECT entry_id, 'path' FROM r WHERE i % 13 = 0 UNION ALL SELECT entry_id, 'bytes' FROM r WHERE i % 17 = 0
UNION ALL SELECT entry_id, 'retrieved' FROM r WHERE i % 31 = 0 UNION ALL SELECT entry_id, 'licenses' FROM r WHERE i % 37 = 0 UNION ALL SELECT entry_id, 'records' FROM r WHERE i % 3 = 1 AND i % 2 = 0""")
def resource_violations(table: Tables) -> DataFrame:
    i = F.col("p_partkey")
    digest = F.when(i % 29 == 0, "short").otherwise(F.sha2(F.col("p_name"), 256))
    kind = F.when(i % 3 == 0, "routing").when(i % 3 == 1, "tenders").otherwise("notes")
    path = F.concat(F.lit("packs/v1/states/ka/"), kind, F.lit("-"), digest, F.when(i % 13 == 0, ".bin").otherwise(".json"))
    rows = table("part").select(
        F.concat(F.lit("p"), i).alias("entry_id"), F.when(i % 19 == 0, "other").otherwise(F.concat(F.lit("p"), i)).alias("pack_id"), F.lit("KA").alias("state_code"), kind.alias("kind"),
        F.lit(1).alias("pack_version"), F.when(i % 23 == 0, 2).otherwise(1).alias("schema_version"), path.alias("path"), F.concat(F.lit("https://s/"), path).alias("url"),
        F.when(i % 17 == 0, 0).otherwise(i).cast("long").alias("bytes"), digest.alias("sha256"), F.lit("state").alias("coverage_scope"), F.lit(True).alias("statewide"),
        F.when(i % 31 == 0, "1 May 2024").otherwise("2024-05-01").alias("source_retrieved_at"), F.lit("2025-05-01").alias("review_after"),
        F.when(i % 37 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("CC"))).alias("licenses"), F.when(i % 2 == 1, 5).alias("records"),
    )
    return tables.violations(rows, ["entry_id"], validators.resource_rules("https://s/"))


@book.query("""
WITH r AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 9 = 0 THEN 'R!' ELSE 'reg-' || c_custkey END AS region_id FROM customer)
SELECT region_id, 'id' AS rule FROM r WHERE i % 9 = 0 UNION ALL SELECT region_id, 'mode' FROM r WHERE i % 10 = 0 UNION ALL SELECT region_id, 'rings' FROM r WHERE i % 7 IN (1, 2)
UNION ALL SELECT region_id, 'simple' FROM r WHERE i % 7 = 3""")
def region_violations(table: Tables) -> DataFrame:
    """Squares; some are open, some lie beyond the globe, some cross themselves."""
    i = F.col("c_custkey")
    x = F.when(i % 7 == 2, 200.0).otherwise(70.0) + i % 11
    corner = lambda dx, dy: geo.named(x=x + dx, y=F.lit(20.0 + dy))
    square = F.when(i % 7 == 1, F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).when(i % 7 == 3, F.array(corner(0, 0), corner(1, 1), corner(1, 0), corner(0, 1), corner(0, 0)))
    ring = square.otherwise(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    rows = table("customer").select(F.when(i % 9 == 0, "R!").otherwise(F.concat(F.lit("reg-"), i)).alias("region_id"), F.when(i % 10 == 0, "guess").otherwise("boundary").alias("routing_mode"), F.array(F.array(ring)).alias("geometry"))
    return tables.violations(rows, ["region_id"], validators.region_rules())


@book.query("""
WITH e AS (SELECT event_id AS id, event_id % 500 AS place, event_id * 600 + event_id // 700 * 3456000 AS t FROM events),
o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY place ORDER BY t) > 2592000, true) AS opens FROM e),
v AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY place ORDER BY t) AS visit FROM o)
SELECT id, first_value(id) OVER (PARTITION BY place, visit ORDER BY t) AS canonical_id, CASE WHEN opens THEN 'new' ELSE 'prior_drive' END AS match, CAST(count(*) OVER (PARTITION BY place, visit) AS INTEGER) AS seen_count FROM v""")
def repeat_visits(table: Tables) -> DataFrame:
    """Every report by another drive at one of 500 far places: where the rule has a closed form, an event lasts until 30 days pass without a sighting."""
    i = F.col("event_id")
    at = (i * 600 + F.expr("event_id div 700") * 3_456_000).cast("double")
    rows = table("events").select(
        i.alias("id"), F.lit("accept").alias("decision"), F.lit("draft").alias("status"), F.lit(True).alias("dedupe_eligible"), F.lit(False).alias("debug_capture"), F.lit("drive").alias("capture_source"),
        F.concat(F.lit("d"), i).alias("drive_id"), F.lit(None).cast("string").alias("source_event_key"), F.lit(None).cast("double").alias("source_offset_s"), at.alias("captured_at"), at.alias("created_at"),
        (10 + i % 500 * 0.01).alias("lat"), F.lit(77.6).alias("lng"), F.lit(5.0).alias("gps_accuracy"), F.lit(8.0).alias("speed_mps"), F.lit(90.0).alias("heading"), F.lit("pothole_cavity").alias("damage_type"), F.lit("medium").alias("size"),
    )
    return fold_reports(rows).select("id", "canonical_id", F.coalesce("match", F.lit("new")).alias("match"), "seen_count")


_DEVICE = (
    "event_id - 5 AS id", "CASE event_id % 6 WHEN 0 THEN 91.5 WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS lat", "CASE WHEN event_id % 17 = 0 THEN -181.0 ELSE 77.25 END AS lng",
    "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 2 THEN 'key-' || event_id END AS source_event_key", "CASE WHEN event_id % 3 = 0 THEN 'Road ' || user_id END AS address", "event_id % 3 AS is_reportable",
    "CASE WHEN event_id % 5 = 0 THEN 'probable' END AS assessment", "CASE WHEN event_id % 7 = 0 THEN 'failed_patch' WHEN event_id % 7 = 1 THEN '' END AS damage_type", "CASE WHEN event_id % 8 = 0 THEN event_id % 16 = 0 END AS on_drivable_surface",
    "CASE WHEN event_id % 11 = 0 THEN 'review' END AS decision", "CASE WHEN event_id % 4 = 0 THEN 'small' END AS size", "CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS evidence_count", "CASE WHEN event_id % 9 > 0 THEN 'd' || user_id END AS drive_id",
    "event_id % 13 = 0 AS debug_capture", "CASE WHEN event_id % 10 > 0 THEN event_id * 0.5 END AS captured_at", "CAST(event_id % 900 - 400 AS DOUBLE) AS heading",
)
_UNSAID = ("image_quality", "temporal_consistency", "description", "detection_model", "image_detail", "prompt_version", "schema_version", "primary_frame_index", "source_offset_s", "gps_accuracy", "speed_mps", "created_at", "has_broken_edge_or_rim", "has_depth_or_surface_loss")


@book.query(f"""
WITH n AS (SELECT event_id, user_id, {", ".join(_DEVICE)} FROM events),
r AS (SELECT *, event_id % 4 <> 0 AS routed, event_id % 4 <> 0 AND event_id % 3 = 0 AS eligible FROM n WHERE id > 0 AND isfinite(lat) AND abs(lat) <= 90 AND abs(lng) <= 180)
SELECT id AS native_id, coalesce(nullif(source_event_key, ''), 'native:' || id) AS source_event_key, coalesce(address, printf('%.5f, %.5f', lat, CAST(lng AS DOUBLE))) AS address, CAST(is_reportable = 1 AS INTEGER) AS is_reportable,
  coalesce(nullif(damage_type, ''), 'pothole_cavity') AS damage_type, CAST(coalesce(nullif(damage_type, ''), 'pothole_cavity') = 'pothole_cavity' AS INTEGER) AS is_pothole, coalesce(assessment, 'clear') AS assessment, coalesce(decision, 'accept') AS decision,
  coalesce(on_drivable_surface, true) AS on_drivable_surface, size, coalesce(evidence_count, 1) AS evidence_count, 7 AS schema_version, 'm1' AS detection_model, (heading % 360 + 360) % 360 AS heading, NOT debug_capture AS dedupe_eligible,
  CASE WHEN drive_id IS NULL THEN 0 ELSE 1 END AS drives, coalesce(captured_at, 1000000.0) AS last_seen_at, CASE WHEN routed THEN 'draft' ELSE 'unrouted' END AS status,
  CASE WHEN NOT routed THEN CASE WHEN event_id % 8 = 0 THEN 'rural_road' ELSE 'outside_area' END END AS unrouted_reason, CASE WHEN NOT routed THEN 'Body ' || (user_id % 5) END AS unrouted_body, CASE WHEN routed THEN 'Body ' || (user_id % 5) END AS authority_name,
  CASE WHEN routed THEN 'email' END AS delivery_channel, routed AND user_id % 2 = 0 AS requires_official_reference, CASE WHEN eligible THEN 'T' || event_id END AS tender_number FROM r""")
def drive_records(table: Tables) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    known = ("authority_name", "unrouted_reason", "routed", "tender_eligible", "requires_official_reference")
    native = table("events").selectExpr(*_DEVICE, *[f"CAST(NULL AS {'BOOLEAN' if c.startswith('has_') else 'STRING'}) AS {c}" for c in _UNSAID])
    routes = table("events").select(
        (i - 5).alias("id"), (i % 4 != 0).alias("routed"), F.when(i % 8 == 0, "rural_road").alias("unrouted_reason"), (i % 3 == 0).alias("tender_eligible"), (u % 2 == 0).alias("requires_official_reference"),
        F.concat(F.lit("Body "), u % 5).alias("authority_name"), F.lit(None).cast("string").alias("delivery_channel"), F.lit(None).cast("boolean").alias("ownership_unverified"),
        *[F.lit(None).cast("string").alias(c) for c in reports.ROUTE_FIELDS if c not in known],
    )
    contracts = table("events").select((i - 5).alias("id"), F.concat(F.lit("T"), i).alias("tender_number"), *[F.lit(None).cast("string").alias(c) for c in reports.TENDER_FIELDS[1:]])
    settings = {"detection_model": "m1", "image_detail": "low", "prompt_version": "p1", "schema_version": 7}
    made = reports.drive_records(native, routes, contracts, settings, F.lit(1_000_000.0))
    shown = (
        "native_id source_event_key address is_reportable damage_type is_pothole assessment decision on_drivable_surface size evidence_count schema_version detection_model heading dedupe_eligible last_seen_at status"
        " unrouted_reason unrouted_body authority_name delivery_channel requires_official_reference tender_number"
    )
    return made.select(*shown.split(), F.size("sighting_drive_ids").alias("drives"))
