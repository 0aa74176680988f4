"""Queries over drives, detections and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import decide, frames, geo
from wayline.functions.geo import haversine
from wayline.operators import evalstats, footage, tables
from wayline.operators.dedupe import fold_reports
from wayline.operators.near_join import near_id_pairs
from wayline.plans.define import FIXES_SQL, HAVERSINE_SQL, MICROS, Book, Tables, fixes
from wayline.streaming.drive_state import FIELDS, drive_log
from wayline.streaming.drives import capture_gate, keep_newest

book = Book()


@book.query(f"""
WITH f AS (SELECT user_id, event_id, event_type, CAST(floor(value * 1000) AS BIGINT) AS bytes, epoch_us(ts) / 1000000.0 AS at_s FROM events)
SELECT CAST(user_id AS VARCHAR) AS drive_id, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(event_type, event_id) AS mime,
       round(min(at_s - CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END), 3) AS started_at, round(max(at_s), 3) AS ended_at
FROM f GROUP BY user_id""")
def drive_summary(table: Tables) -> DataFrame:
    at = F.expr(MICROS) / 1_000_000
    clips = table("events").select(
        F.col("user_id").cast("string").alias("drive_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("key"), F.col("event_type").alias("mime"),
        F.floor(F.col("value") * 1000).alias("bytes"), at.alias("at"), F.when(F.col("event_id") % 5 != 0, (at - 2) * 1000).alias("recording_started_at_ms"),
    )
    return footage.footage_summary(clips).withColumns({"started_at": F.round("started_at", 3), "ended_at": F.round("ended_at", 3)})


DETECTION = {
    "reportable": "event_id % 11 <> 0",
    "damage_type": "CASE event_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'failed_patch' WHEN 2 THEN NULL ELSE 'pothole_cavity' END",
    "on_surface": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 17 <> 0 END",
    "assessment": "CASE event_type WHEN 'click' THEN 'clear' WHEN 'view' THEN 'probable' WHEN 'error' THEN 'uncertain' WHEN 'signup' THEN 'absent' ELSE NULL END",
    "quality": "CASE WHEN value < 2 THEN 'unusable' ELSE 'usable' END",
    "temporal": "CASE WHEN user_id % 19 = 0 THEN 'inconsistent' ELSE 'consistent' END",
    "edge": "event_id % 3 = 0",
    "depth": "event_id % 4 = 0",
}


@book.query(f"""
WITH d AS (SELECT event_id, user_id, {", ".join(f"{v} AS {k}" for k, v in DETECTION.items())} FROM events),
v AS (SELECT *, CASE
    WHEN NOT coalesce(reportable, false) OR coalesce(damage_type = 'none', false) OR NOT coalesce(on_surface, false) OR coalesce(assessment = 'absent', false) THEN 'reject'
    WHEN coalesce(quality = 'unusable', false) OR coalesce(temporal = 'inconsistent', false) OR NOT coalesce(assessment IN ('clear', 'probable'), false) OR NOT (edge OR depth) THEN 'review'
    ELSE 'accept' END AS decision FROM d)
SELECT event_id, decision, CASE WHEN decision = 'accept' AND user_id % 2 = 0 THEN 'draft' WHEN decision = 'accept' THEN 'unrouted' WHEN decision = 'review' THEN 'review' ELSE 'rejected' END AS status FROM v""")
def decision_ladder(table: Tables) -> DataFrame:
    d = table("events").select("event_id", "user_id", *[F.expr(v).alias(k) for k, v in DETECTION.items()])
    verdict = decide.decision(*[F.col(k) for k in DETECTION])
    return d.withColumn("decision", verdict).select("event_id", "decision", decide.status(F.col("decision"), F.col("user_id") % 2 == 0).alias("status"))


@book.query(f"WITH {FIXES_SQL}, depot AS (SELECT CAST(12.95 AS DOUBLE) AS lat, CAST(77.605 AS DOUBLE) AS lng)"
            f" SELECT event_id, round({HAVERSINE_SQL.format(a='f.', b='d.')}, 3) AS metres FROM fixes f, depot d"
            " WHERE f.lat BETWEEN 12.92 AND 12.98 AND f.lng BETWEEN 77.6 AND 77.608")
def haversine_to_depot(table: Tables) -> DataFrame:
    near = fixes(table).where(F.col("lat").between(12.92, 12.98) & F.col("lng").between(77.6, 77.608))
    return near.select("event_id", F.round(haversine(F.col("lat"), F.col("lng"), F.lit(12.95), F.lit(77.605)), 3).alias("metres"))


@book.query(f"WITH {FIXES_SQL} SELECT a.event_id AS a_id, b.event_id AS b_id, round({HAVERSINE_SQL.format(a='a.', b='b.')}, 3) AS metres"
            " FROM fixes a JOIN fixes b ON a.event_id < b.event_id AND abs(a.lat - b.lat) < 0.00015 AND abs(a.lng - b.lng) < 0.00015"
            f" WHERE {HAVERSINE_SQL.format(a='a.', b='b.')} <= 13")
def near_pairs(table: Tables) -> DataFrame:
    pairs = near_id_pairs(fixes(table), "event_id", 13.0)
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "metres")


@book.query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_sighting_per_key(table: Tables) -> DataFrame:
    return tables.newest(table("events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id", "value")


@book.query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def newest_per_key(table: Tables) -> DataFrame:
    old, new = table("events").where("event_id % 2 = 0"), table("events").where("event_id % 2 = 1")
    return tables.upsert(tables.newest(old, ["user_id", "event_type"], [F.desc("event_id")]), new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@book.query("""
SELECT user_id, count(*) AS checked, count(*) FILTER (event_type = 'purchase') AS found, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 50 END) AS already,
       count(*) FILTER (event_type = 'error') AS dropped FROM events GROUP BY user_id""")
def drive_counters(table: Tables) -> DataFrame:
    when = lambda kind: F.count_if(F.col("event_type") == kind)
    return table("events").groupBy("user_id").agg(
        F.count("*").alias("checked"), when("purchase").alias("found"), F.countDistinct(F.when(F.col("event_type") == "view", F.col("event_id") % 50)).alias("already"), when("error").alias("dropped")
    )


@book.query("""
WITH f AS (SELECT user_id % 30 AS drive, event_id // 3 AS seq, event_id % 3 AS frame_idx, value AS sharpness, CAST(event_id % 256 AS DOUBLE) AS luminance, CAST(user_id % 10 AS DOUBLE) / 10 AS clipped FROM events),
s AS (SELECT *, CASE WHEN clipped > 0.7 OR luminance < 18 OR luminance > 238 THEN -100.0 ELSE sharpness - abs(luminance - 115) * 0.055::DOUBLE - clipped * 45 END AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY drive, seq ORDER BY score DESC, frame_idx) AS n FROM s)
SELECT CAST(drive AS VARCHAR) AS drive_id, seq, frame_idx, round(score, 6) AS score FROM r WHERE n = 1""")
def best_burst_frames(table: Tables) -> DataFrame:
    score = decide.frame_score(F.col("value"), (F.col("event_id") % 256).cast("double"), (F.col("user_id") % 10).cast("double") / 10)
    frames = table("events").select((F.col("user_id") % 30).cast("string").alias("drive_id"), F.expr("event_id div 3").alias("seq"), (F.col("event_id") % 3).alias("frame_idx"), score.alias("score"))
    return footage.best_frames(frames).withColumn("score", F.round("score", 6))


EVALUATION = (
    "l.doc_id AS ordinal, d.lang AS arm, d.source AS event, CASE l.quality WHEN 1 THEN 'pothole_cavity' WHEN 0 THEN 'not_pothole' END AS label,"
    " CASE WHEN l.doc_id % 3 = 0 THEN 'accept' WHEN l.doc_id % 3 = 1 THEN 'review' ELSE 'reject' END AS decision,"
    " CASE WHEN l.doc_id % 4 = 0 THEN NULL ELSE 'failed_patch' END AS damage_type,"
    " CASE WHEN l.doc_id % 23 = 0 THEN 'timeout' END AS error, CASE WHEN l.doc_id % 2 = 0 THEN ' Owner' ELSE 'model' END AS labelled_by"
)


def _trials(table: Tables) -> DataFrame:
    return table("labels").alias("l").join(table("documents").drop("text").alias("d"), "doc_id").selectExpr(*_split(EVALUATION))


def _split(text: str) -> list[str]:
    """The columns of a select list; commas here stand only between them."""
    return text.split(", ")


TRIALS_SQL = f"trials AS (SELECT {EVALUATION} FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
EVENTS_SQL = f"""{TRIALS_SQL},
told AS (SELECT *, label = 'pothole_cavity' AS truth FROM trials WHERE error IS NULL AND label IS NOT NULL),
rated AS (SELECT arm, event, arg_min(truth, ordinal) AS truth, count(*) AS calls, avg(CASE WHEN decision = 'accept' THEN 1.0 ELSE 0.0 END) AS rate FROM told GROUP BY arm, event)"""


@book.query(f"WITH {EVENTS_SQL} SELECT arm, truth, count(*) AS events, round(avg(rate), 9) AS rate FROM rated GROUP BY arm, truth")
def eval_rates(table: Tables) -> DataFrame:
    return evalstats.arm_rates(_trials(table)).withColumn("rate", F.round("rate", 9))


@book.query(f"WITH {EVENTS_SQL.replace('error IS NULL', 'error IS NULL AND lower(trim(labelled_by)) = ' + chr(39) + 'owner' + chr(39))}"
            " SELECT arm, event, truth, calls, round(rate, 9) AS rate FROM rated")
def eval_verified_events(table: Tables) -> DataFrame:
    return evalstats.event_rates(evalstats.verified(_trials(table))).withColumn("rate", F.round("rate", 9))


@book.query(f"""WITH {EVENTS_SQL}, first AS (SELECT arm, event, arg_min(label, ordinal) AS event_label FROM told GROUP BY arm, event)
SELECT t.arm, f.event_label, coalesce(t.damage_type, 'none') AS damage_type, count(*) AS calls FROM told t JOIN first f ON t.arm = f.arm AND t.event = f.event GROUP BY ALL""")
def eval_confusion(table: Tables) -> DataFrame:
    return evalstats.confusion(_trials(table))


@book.query(f"""
WITH {EVENTS_SQL}, units AS (SELECT arm, truth, event, CAST(round(rate * {evalstats.RATE_UNIT}) AS BIGINT) AS units FROM rated),
drawn AS (SELECT arm, truth, units, s, CAST('0x' || substr(md5('17:' || coalesce(arm, '') || ':' || truth || ':' || coalesce(event, '') || ':' || s), 1, 12) AS BIGINT) AS number FROM units, range(3000) r(s)),
timed AS (SELECT *, len(list_filter({evalstats.POISSON}, lambda x: x <= number)) AS times FROM drawn),
sums AS (SELECT arm, truth, s, sum(times) AS n, CAST(sum(times * units) AS DOUBLE) AS units FROM timed GROUP BY arm, truth, s),
whole AS (SELECT arm, truth, count(*) AS events, CAST(sum(units) AS DOUBLE) / count(*) / {evalstats.RATE_UNIT} AS mean FROM units GROUP BY arm, truth),
means AS (SELECT s.arm, s.truth, w.events, w.mean, CASE WHEN s.n > 0 THEN s.units / s.n / {evalstats.RATE_UNIT} ELSE w.mean END AS m FROM sums s JOIN whole w ON s.arm IS NOT DISTINCT FROM w.arm AND s.truth = w.truth),
listed AS (SELECT arm, truth, events, mean, list_sort(list(m)) AS l FROM means GROUP BY arm, truth, events, mean)
SELECT arm, truth, events, round(mean, 9) AS mean, round(l[76], 9) AS low, round(l[2926], 9) AS high FROM listed""")
def eval_bootstrap(table: Tables) -> DataFrame:
    told = evalstats.bootstrap(evalstats.event_rates(_trials(table)))
    return told.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


@book.query("""
WITH a AS (SELECT event_id, substr('{"reportable":true,"assessment":"clear","image_quality":"usable","damage_type":"' || CASE event_id % 2 WHEN 0 THEN 'none' ELSE 'failed_patch' END
  || '","on_drivable_surface":true,"has_broken_edge_or_rim":' || CASE event_id % 3 WHEN 0 THEN 'true' ELSE 'false' END || ',"has_depth_or_surface_loss":false,"temporal_consistency":"consistent"}', 1, 40 + CAST(event_id % 200 AS INTEGER)) AS text FROM events)
SELECT event_id, CASE WHEN regexp_matches(text, '"temporal_consistency":"(consistent|single_view|inconsistent|not_applicable)"')
   THEN CASE WHEN event_id % 2 = 0 THEN 'reject' WHEN event_id % 3 = 0 THEN 'accept' ELSE 'review' END END AS decision FROM a""")
def prefix_decision(table: Tables) -> DataFrame:
    text = F.concat(
        F.lit('{"reportable":true,"assessment":"clear","image_quality":"usable","damage_type":"'), F.when(F.col("event_id") % 2 == 0, "none").otherwise("failed_patch"),
        F.lit('","on_drivable_surface":true,"has_broken_edge_or_rim":'), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"),
        F.lit(',"has_depth_or_surface_loss":false,"temporal_consistency":"consistent"}'),
    )
    return table("events").select("event_id", decide.prefix_decision(F.substring(text, F.lit(1), (40 + F.col("event_id") % 200).cast("int"))).alias("decision"))


@book.query()
def capture_gate_fixes(table: Tables) -> DataFrame:
    given = fixes(table).select(
        F.col("user_id").cast("string").alias("drive_id"), (F.col("us") / 1_000_000).alias("ts"), "lat", "lng", (F.col("event_id") % 60).cast("double").alias("accuracy"), F.col("value").alias("speed_mps")
    )
    return capture_gate(given)


@book.query()
def dedupe_fold(table: Tables) -> DataFrame:
    f, i = fixes(table), F.col("event_id")
    return fold_reports(
        f.select(
            i.alias("id"), F.lit("accept").alias("decision"), F.lit("draft").alias("status"), (i % 29 != 0).alias("dedupe_eligible"), (i % 31 == 0).alias("debug_capture"),
            F.when(i % 37 == 0, "manual").otherwise("drive").alias("capture_source"), F.col("user_id").cast("string").alias("drive_id"),
            F.concat(F.lit("key-"), F.expr("event_id div 2").cast("string")).alias("source_event_key"), (F.col("us") / 1e6 - 1_704_067_200).alias("source_offset_s"),
            (F.col("us") / 1e6).alias("captured_at"), (F.col("us") / 1e6).alias("created_at"), "lat", "lng", (i % 20).cast("double").alias("gps_accuracy"),
            (F.col("value") % 12).alias("speed_mps"), (i % 360).cast("double").alias("heading"), F.when(i % 5 == 0, "failed_patch").otherwise("pothole_cavity").alias("damage_type"),
            F.when(i % 9 == 0, "large").otherwise("medium").alias("size"),
        )
    )


@book.query("""SELECT user_id AS drive_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6 AS kept FROM events""")
def bounded_queue(table: Tables) -> DataFrame:
    return keep_newest(table("events").select(F.col("user_id").alias("drive_id"), F.col("event_id").alias("seq")))


@book.query("""
WITH e AS (SELECT event_id, CAST(event_id % 720 AS DOUBLE) AS a, CAST(user_id * 7 % 360 AS DOUBLE) AS b, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) END AS acc, value FROM events)
SELECT event_id, least(abs(a - b) % 360, 360 - abs(a - b) % 360) AS turn, least(abs(a - b) % 180, 180 - abs(a - b) % 180) AS across,
  CASE WHEN acc BETWEEN 0 AND 30 THEN least(45.0, greatest(15.0, acc + 8)) ELSE 15.0 END AS reach, round(0.2126::DOUBLE * (event_id % 256) + 0.7152::DOUBLE * (user_id % 256) + 0.0722::DOUBLE * 10, 6) AS luma,
  round(CASE WHEN value < 72 AND event_id % 20 < 8 THEN least(1.65, greatest(1.15, 85 / greatest(35.0, value))) ELSE 1.0 END, 6) AS lift, round_even(value / 7, 4) AS rounded FROM e JOIN (SELECT event_id AS i, user_id FROM events) ON event_id = i""")
def scalar_measures(table: Tables) -> DataFrame:
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    a, b = (i % 720).cast("double"), (u * 7 % 360).cast("double")
    point = F.array(F.array(F.array(geo.named(x=v / 7, y=v / 7))))
    return table("events").select(
        "event_id", geo.heading_difference(a, b).alias("turn"), geo.heading_difference(a, b, directed=False).alias("across"), geo.match_threshold(F.when(i % 9 != 0, (i % 50).cast("double"))).alias("reach"),
        F.round(frames.luma(i % 256, u % 256, F.lit(10)), 6).alias("luma"), F.round(decide.low_light_lift(v, (i % 20) / 100), 6).alias("lift"), geo.rounded_rings(point, 4)[0][0][0]["x"].alias("rounded"),
    )


FIELD_TYPES = {c: "string" for c in FIELDS if c != "kind"} | {"fix_at": "timestamp", "seq": "int"} | dict.fromkeys(("lat", "lng", "accuracy", "speed_mps", "score"), "double")
#: When the frames of an event's fix come after it, in milliseconds: some too early after the one before, some too late.
FRAME_MS = ("event_id * 37 % 2600", "event_id * 37 % 2600 + 100 + event_id * 53 % 2400", "event_id * 37 % 2600 + 200 + event_id * 53 % 2400 + event_id * 7 % 500")
#: An event every ten minutes, so that no two bursts of a drive meet.
STEP_US = 600_000_000



def _drive_rows(table: Tables) -> DataFrame:
    """Each event as a fix, three frames and a verdict of its drive."""
    i, none = F.col("event_id"), F.lit(None)
    at = i * STEP_US
    row = lambda us, kind, **more: geo.named(at=F.timestamp_micros(us), kind=F.lit(kind), **{c: more.get(c, none.cast(t)) for c, t in FIELD_TYPES.items()})
    fix = row(at, "fix", fix_at=F.timestamp_micros(at - i % 13 * 1_000_000), lat=F.lit(12.9), lng=F.lit(77.6), accuracy=F.lit(5.0), speed_mps=F.lit(8.0))
    frame = [row(at + F.expr(ms) * 1000, "frame", score=((i + F.expr(ms)) % 5).cast("double")) for ms in FRAME_MS]
    accept = F.when(F.col("event_type").isin("click", "view"), "accept").otherwise("reject")
    verdict = row(at + 9_000_000, "verdict", seq=(i % 100).cast("int"), decision=accept, event_key=F.when(i % 4 > 0, (i % 3).cast("string")))
    return table("events").select(F.col("user_id").cast("string").alias("drive_id"), F.explode(F.array(fix, *frame, verdict)).alias("r")).select("drive_id", "r.*")


@book.query(f"""
WITH e AS (SELECT user_id, event_id, event_id * {STEP_US} AS t, [{", ".join(FRAME_MS)}] AS f FROM events),
a AS (SELECT *, list_min(list_filter(f, lambda x: x <= 2000)) AS f0 FROM e WHERE event_id % 13 <= 10),
b AS (SELECT *, coalesce(f0, 2000) + 180 AS b1 FROM a),
c AS (SELECT *, list_min(list_filter(f, lambda x: x >= b1 AND x <= b1 + 2000)) AS f1 FROM b),
d AS (SELECT *, coalesce(f1, b1 + 2000) + 180 AS b2 FROM c),
g AS (SELECT *, list_min(list_filter(f, lambda x: x >= b2 AND x <= b2 + 2000)) AS f2 FROM d),
taken AS (SELECT *, coalesce(f2, b2 + 2000) AS ends, list_filter([f0, f1, f2], lambda x: x IS NOT NULL) AS got FROM g),
scored AS (SELECT *, list_transform(got, lambda x: CAST((event_id + x) % 5 AS DOUBLE)) AS scores FROM taken WHERE len(got) > 0)
SELECT CAST(user_id AS VARCHAR) AS drive_id, t + ends * 1000 AS at_us, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) AS INTEGER) AS seq,
       CAST(len(got) AS INTEGER) AS frames, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS best, list_max(scores) AS score FROM scored""")
def drive_bursts(table: Tables) -> DataFrame:
    return drive_log(_drive_rows(table)).where("kind = 'burst'").select("drive_id", "at_us", "seq", "frames", "best", "score")


@book.query(f"""
WITH told AS (
  SELECT user_id, event_id, event_id * {STEP_US} + 9000000 AS at_us, CASE WHEN event_type IN ('click', 'view') THEN 'accept' ELSE 'reject' END AS decision,
         CASE WHEN event_id % 4 > 0 THEN event_id % 3 END AS key FROM events),
met AS (SELECT *, decision = 'accept' AND key IS NOT NULL AS counts, lag(at_us) OVER (PARTITION BY user_id, key, decision ORDER BY at_us) AS last FROM told),
judged AS (SELECT *, counts AND coalesce(at_us - last <= 2592000000000, false) AS repeated FROM met),
lives AS (SELECT *, count(*) FILTER (counts AND NOT repeated) OVER (PARTITION BY user_id, key ORDER BY at_us) AS life FROM judged),
firsts AS (SELECT *, repeated AND row_number() OVER (PARTITION BY user_id, key, life, repeated ORDER BY at_us) = 1 AS is_first FROM lives)
SELECT CAST(user_id AS VARCHAR) AS drive_id, at_us, CAST(event_id % 100 AS INTEGER) AS seq, decision, repeated, CAST(count(*) OVER so_far AS INTEGER) AS checked,
       CAST(count(*) FILTER (counts AND NOT repeated) OVER so_far AS INTEGER) AS found, CAST(count(*) FILTER (is_first) OVER so_far AS INTEGER) AS already
FROM firsts WINDOW so_far AS (PARTITION BY user_id ORDER BY at_us)""")
def drive_verdicts(table: Tables) -> DataFrame:
    told = drive_log(_drive_rows(table)).where("kind = 'verdict'")
    return told.select("drive_id", "at_us", "seq", "decision", F.coalesce("repeated", F.lit(False)).alias("repeated"), "checked", "found", "already")


@book.query("""
WITH g AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE) * 100 + 128) AS g FROM embeddings)
SELECT vec_id, round((abs(4 * g[6] - g[5] - g[7] - g[2] - g[10]) + abs(4 * g[7] - g[6] - g[8] - g[3] - g[11]) + abs(4 * g[10] - g[9] - g[11] - g[6] - g[14]) + abs(4 * g[11] - g[10] - g[12] - g[7] - g[15])) / 4, 6) AS sharpness,
  round(list_sum(g) / 16, 6) AS luminance, len(list_filter(g, lambda v: v < 12 OR v > 245)) / 16 AS clipped FROM g""")
def frame_quality(table: Tables) -> DataFrame:
    grid = F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double") * 100 + 128)
    measured = table("embeddings").select("vec_id", frames.frame_measures(grid, F.lit(4)).alias("m"))
    return measured.select("vec_id", F.round("m.sharpness", 6).alias("sharpness"), F.round("m.luminance", 6).alias("luminance"), "m.clipped")
