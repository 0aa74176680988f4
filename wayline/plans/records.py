"""Queries over contracts, packs, sessions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import dates, text
from wayline.operators import footage, tables, tenders
from wayline.plans.define import Book, Tables

book = Book()

NOW = "TIMESTAMP '2000-08-20 00:00:00'"
DATE_TEXT = "lpad(CAST(1 + o_orderkey % 31 AS {s}), 2, '0') || '-' || lpad(CAST(o_orderkey % 14 AS {s}), 2, '0') || '-' || CAST(1996 + o_orderkey % 6 AS {s})"
ROLLED = "CAST(make_date({y}, 1, 1) + to_months(CAST({m} - 1 AS INTEGER)) AS DATE) + CAST({d} - 1 AS INTEGER)"


@book.query(f"""
WITH o AS (SELECT o_orderkey, {DATE_TEXT.format(s='VARCHAR')} AS published, 1 + o_orderkey % 31 AS d, o_orderkey % 14 AS m, 1996 + o_orderkey % 6 AS y FROM orders),
a AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 THEN (epoch({NOW}) - datediff('day', DATE '1970-01-01', {ROLLED.format(y='y', m='m', d='d')}) * 86400.0) / (365.25 * 86400) END AS age FROM o)
SELECT o_orderkey, CASE WHEN age >= 0 AND age <= 1 THEN 'dlp' WHEN age >= 0 AND age <= 3 THEN 'maint' ELSE 'record' END AS warranty_code FROM a""")
def warranty_class(table: Tables) -> DataFrame:
    published = F.expr(DATE_TEXT.format(s="STRING"))
    return table("orders").select("o_orderkey", dates.warranty_code(published, F.expr(NOW)).alias("warranty_code"))


@book.query(f"""
WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 31 AS d, o_orderkey % 14 AS m, 1996 + o_orderkey % 6 AS y FROM orders)
SELECT o_orderkey, CAST(datediff('day', DATE '1970-01-01', {ROLLED.format(y='y', m='m', d='d')}) AS INTEGER) AS stamp FROM o""")
def sort_stamps(table: Tables) -> DataFrame:
    return table("orders").select("o_orderkey", dates.sort_stamp(F.expr(DATE_TEXT.format(s="STRING"))).alias("stamp"))


TENDERS = "CAST(p_partkey AS {s}) AS tn, CAST(305850 + p_partkey % 7 AS {s}) AS b, p_name || ' ' || lower(p_type) || ' works' AS title, 'Town ' || p_type AS location"


@book.query(f"""
WITH t0 AS (SELECT p_partkey, {TENDERS.format(s='VARCHAR')}, lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') || '-0' || (1 + p_partkey % 9) || '-2020' AS published, 1 + p_partkey % 28 AS d, 1 + p_partkey % 9 AS m FROM part),
tenders AS (SELECT tn, CASE WHEN p_partkey % 3 = 0 THEN 'BLR' ELSE b END AS b, title, location, d, m FROM t0),
reports AS (SELECT c_custkey AS report_id, CAST(305850 + c_custkey % 7 AS VARCHAR) AS lgd,
  ['red', 'blue', 'small', 'steel', 'ring'][1 + c_custkey % 5] || ' cross, ' || ['widget', 'bolt', 'economy', 'promo'][1 + c_custkey % 4] || ' layout' AS address FROM customer),
words AS (SELECT report_id, lgd, pos, token FROM (SELECT report_id, lgd, unnest(['red', 'blue', 'small', 'steel', 'ring'][1 + report_id % 5:1 + report_id % 5] || ['widget', 'bolt', 'economy', 'promo'][1 + report_id % 4:1 + report_id % 4]) AS token, generate_subscripts([1, 2], 1) AS pos FROM reports)),
pools AS (SELECT DISTINCT lgd, b FROM (SELECT DISTINCT lgd FROM reports), LATERAL (SELECT unnest(CASE WHEN lgd IN ('305850', '305851', '305852', '305853', '305854') THEN [lgd, 'BLR'] ELSE [lgd] END) AS b)),
pool AS (SELECT p.lgd, t.*, p.b = p.lgd AS own FROM pools p JOIN tenders t ON t.b = p.b),
about AS (SELECT lgd, count(*) AS n, arg_min(location, (NOT own, tn)) AS place FROM pool GROUP BY lgd),
asked AS (SELECT w.*, a.n FROM words w JOIN about a ON w.lgd = a.lgd WHERE NOT list_contains(regexp_split_to_array(lower(a.place), '[^a-z]+'), w.token)),
df AS (SELECT a.lgd, a.token, any_value(a.n) AS n, count(*) AS df FROM (SELECT DISTINCT lgd, token, n FROM asked) a JOIN pool p ON p.lgd = a.lgd AND contains(lower(p.title), a.token) GROUP BY a.lgd, a.token),
idf AS (SELECT lgd, token, ln((n + 1) / (df + 0.5)) AS idf FROM df WHERE NOT (n > 1 AND df = n) AND NOT (n >= 8 AND df > n * 0.5)),
scored AS (SELECT a.report_id, p.tn, round(sum(i.idf), 6) AS score, any_value(p.d) AS d, any_value(p.m) AS m FROM asked a JOIN idf i ON a.lgd = i.lgd AND a.token = i.token JOIN pool p ON p.lgd = a.lgd AND contains(lower(p.title), a.token) GROUP BY a.report_id, p.tn),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_id ORDER BY score DESC, m DESC, d DESC, tn) AS INTEGER) AS place FROM scored)
SELECT report_id, place, tn, score FROM ranked WHERE place <= 25""")
def tender_shortlist(table: Tables) -> DataFrame:
    pool = table("part").selectExpr(*TENDERS.format(s="STRING").split(", "), "lpad(1 + p_partkey % 28, 2, '0') || '-0' || (1 + p_partkey % 9) || '-2020' AS published", "p_partkey")
    pool = pool.withColumn("b", F.when(F.col("p_partkey") % 3 == 0, "BLR").otherwise(F.col("b")))
    reports = table("customer").selectExpr(
        "c_custkey AS report_id", "CAST(305850 + c_custkey % 7 AS STRING) AS lgd",
        "element_at(array('red', 'blue', 'small', 'steel', 'ring'), CAST(1 + c_custkey % 5 AS INT)) || ' cross, ' || element_at(array('widget', 'bolt', 'economy', 'promo'), CAST(1 + c_custkey % 4 AS INT)) || ' layout' AS address",
    )
    return tenders.shortlist(reports, pool)


@book.query("""SELECT r.r_name, n.n_name, CASE WHEN s.s_acctbal < 0 THEN 'debt' WHEN s.s_acctbal < 5000 THEN 'low' ELSE 'high' END AS outcome, count(*) AS suppliers
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def region_rollup(table: Tables) -> DataFrame:
    placed = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    outcome = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "low").otherwise("high")
    return placed.groupBy("r_name", "n_name", outcome.alias("outcome")).agg(F.count("*").alias("suppliers"))


@book.query("""SELECT c_custkey AS id, coalesce(n, 0) AS clips, coalesce(b, 0) AS bytes, coalesce(d, 0) AS duration_s FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS b, CAST(sum(o_orderkey % 60) AS DOUBLE) AS d FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def sessions_with_footage(table: Tables) -> DataFrame:
    clips = table("orders").select(F.col("o_custkey").alias("session_id"), F.floor("o_totalprice").alias("bytes"), (F.col("o_orderkey") % 60).cast("double").alias("duration_s"))
    return footage.sessions_with_footage(table("customer").select(F.col("c_custkey").alias("id")), clips)


@book.query("""SELECT doc_id AS key, 'missing' AS side FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT page_id, 'unknown' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def orphans(table: Tables) -> DataFrame:
    return tables.unmatched(table("labels").select(F.col("doc_id").alias("key")), table("pages").select(F.col("page_id").alias("key")), ["key"])


@book.query("""
WITH c AS (SELECT doc_id, n_chars, lang, doc_id % 37 AS used, doc_id % 11 = 0 AS shielded FROM documents),
r AS (SELECT *, coalesce(sum(CASE WHEN shielded THEN 0 ELSE n_chars END) OVER (ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, used, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(n_chars) OVER () AS total FROM c)
SELECT doc_id, NOT shielded AND total - freed > 1000000 AS evicted FROM r""")
def lru_eviction(table: Tables) -> DataFrame:
    cache = table("documents").select("doc_id", "n_chars", "lang", (F.col("doc_id") % 37).alias("used"))
    return tables.evicted(cache, 1_000_000, ["doc_id"], F.when(F.col("lang") == "de", 0).otherwise(1), "used", "n_chars", F.col("doc_id") % 11 == 0).select("doc_id", "evicted")


@book.query("""
WITH m AS (SELECT doc_id, 'k' || doc_id AS cache_key, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE lang END AS sha, n_chars, source, doc_id % 100 AS idle FROM documents WHERE doc_id % 7 <> 0),
j AS (SELECT d.doc_id, d.source, d.n_chars, d.doc_id % 100 AS idle, d.doc_id % 10 = 0 AS is_tender, d.source IN ('src1') AS shielded, m.doc_id IS NOT NULL AND m.sha = d.lang AS same FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id),
r AS (SELECT *, CASE WHEN NOT same THEN 'unlisted' WHEN idle > CASE WHEN is_tender THEN 30 ELSE 90 END AND NOT shielded THEN 'unused' END AS reason FROM j),
k AS (SELECT *, coalesce(sum(CASE WHEN shielded THEN 0 ELSE n_chars END) OVER (ORDER BY CASE WHEN is_tender THEN 0 ELSE 1 END, -idle, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(n_chars) OVER () AS total
      FROM (SELECT *, 'k' || doc_id AS cache_key FROM r WHERE reason IS NULL))
SELECT doc_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN NOT shielded AND total - freed > 500000 THEN 'evicted' END FROM k""")
def pack_retention(table: Tables) -> DataFrame:
    now, i = 1_000_000_000.0, F.col("doc_id")
    docs = table("documents").select("doc_id", "lang", "source", "n_chars", F.concat(F.lit("k"), i).alias("cache_key"), F.col("source").alias("pack_id"), F.col("n_chars").alias("bytes"), F.when(i % 10 == 0, "tenders").otherwise("routing").alias("kind"))
    cache = docs.select("doc_id", "cache_key", "pack_id", F.col("lang").alias("sha256"), "bytes", F.lit(None).cast("double").alias("installed_at"), (F.lit(now) - i % 100 * 86_400.0).alias("last_used_at"))
    manifest = docs.where(i % 7 != 0).select("cache_key", "pack_id", F.when(i % 13 == 0, "x").otherwise(F.col("lang")).alias("sha256"), "bytes", "kind")
    return tables.retention(cache, manifest, now, {"tenders": 30}, 90, 500_000, ["src1"]).select("doc_id", "reason")


@book.query("SELECT source, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY source, md5(text) HAVING count(*) > 1")
def dup_records(table: Tables) -> DataFrame:
    return tables.duplicated(table("documents").select("source", F.md5("text").alias("digest")), ["source", "digest"])


@book.query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def pack_digest(table: Tables) -> DataFrame:
    return table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@book.query("""
SELECT doc_id, 'has_text' AS rule FROM documents WHERE NOT (length(text) >= 20) UNION ALL SELECT doc_id, 'known_lang' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT doc_id, 'source_form' FROM documents WHERE NOT regexp_full_match(source, 'src[0-9]') UNION ALL SELECT doc_id, 'size' FROM documents WHERE n_chars NOT BETWEEN 1 AND 10000""")
def rule_violations(table: Tables) -> DataFrame:
    rules = {"has_text": F.length("text") >= 20, "known_lang": F.col("lang").isin("en", "de", "fr"), "source_form": F.col("source").rlike("^src[0-9]$"), "size": F.col("n_chars").between(1, 10_000)}
    return tables.violations(table("documents"), ["doc_id"], rules)


@book.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(table: Tables) -> DataFrame:
    return table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _chained(column: str) -> str:
    out = f"regexp_replace(lower({column}), '[^a-z]', '', 'g')"
    for a, b in text.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@book.query(f"""WITH k AS (SELECT conv_id, turn, {_chained("text")} AS key FROM conversations)
SELECT conv_id, turn, CASE WHEN rtrim(key, 'u') = '' THEN key ELSE rtrim(key, 'u') END AS key FROM k""")
def place_keys(table: Tables) -> DataFrame:
    return table("conversations").select("conv_id", "turn", text.place_key(F.col("text")).alias("key"))


@book.query("""SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part
WHERE regexp_matches(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' BT road' ELSE '' END, '(?i)road|pothole|asphalt|black\\s*top|\\bbt\\b|resurfac|re-surfac|tar(?:ring)?|drain|footpath|culvert|pavement|kerb|curb|patch')) WHERE n = 1""".replace("\\\\", "\\"))
def road_works(table: Tables) -> DataFrame:
    notices = table("part").select("p_partkey", "p_name", F.col("p_brand").alias("tn"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " BT road").otherwise("")).alias("title"), F.col("p_partkey").alias("ordinal"))
    return tenders.road_works(notices).select("p_partkey", "p_name")


@book.query("""SELECT event_id AS id, user_id % 4 AS n, CASE WHEN event_type IN ('click', 'view') AND event_id <> 7 THEN 'interrupted' ELSE CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'paused' ELSE 'stopped' END END AS status FROM events""")
def stale_sessions(table: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "view", "paused").otherwise("stopped")
    return tables.interrupt_stale(table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("n"), status.alias("status")), 7)


@book.query("""
WITH d AS (SELECT c_custkey, ['a' || (c_custkey % 5), 'b'] AS own, c_custkey % 3 AS already FROM customer), n AS (SELECT c_custkey, ['b', 'c' || (c_custkey % 2)] AS ids FROM customer WHERE c_custkey % 2 = 0)
SELECT d.c_custkey AS id, greatest(already, 2 + CASE WHEN n.ids IS NULL THEN 0 ELSE 1 END) AS already, coalesce(len(n.ids), 0) AS analysis_already FROM d LEFT JOIN n ON d.c_custkey = n.c_custkey""")
def analysis_merge(table: Tables) -> DataFrame:
    c = F.col("c_custkey")
    drives = table("customer").select(c.alias("id"), F.array(F.concat(F.lit("a"), c % 5), F.lit("b")).alias("already_ids"), (c % 3).alias("already"))
    news = table("customer").where(c % 2 == 0).select(c.alias("id"), F.array(F.lit("b"), F.concat(F.lit("c"), c % 2)).alias("already_ids"), F.lit(1).alias("checked_now"), F.lit(1).alias("found_now"), F.lit(0).alias("already_now"))
    return footage.merge_analysis(drives, news).select("id", "already", "analysis_already")


@book.query()
def fuzzy_places(table: Tables) -> DataFrame:
    towns = table("region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("lgd"))
    spelt = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.substring("r_name", 1, 20), F.lit("A"))).otherwise(F.col("r_name"))
    asked = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(spelt, F.lit(" City Corporation")).alias("location"))
    return tenders.resolve_places(asked, towns)


@book.query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'é' || p_name WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN 'E' || p_name ELSE p_name END AS name FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY name COLLATE en, name, p_partkey) AS INTEGER) AS place FROM n""")
def locale_order(table: Tables) -> DataFrame:
    name = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'é' || p_name WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN 'E' || p_name ELSE p_name END"
    order = Window.partitionBy(F.col("p_partkey") % 10).orderBy(tenders.in_locale(F.col("name")), "name", "p_partkey")
    return table("part").selectExpr("p_partkey", f"{name} AS name").select("p_partkey", F.row_number().over(order).alias("place"))


@book.query("""
WITH n AS (SELECT p_partkey, ['DMA/', 'bbmp/', 'PWD/', 'dma/'][1 + p_partkey % 4] || p_partkey AS tn, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Town ' || (p_partkey % 40) END AS loc, p_partkey % 40 AS town FROM part),
k AS (SELECT *, CASE WHEN loc IS NOT NULL AND town % 5 <> 0 AND town < 26 THEN CAST(100 + town AS VARCHAR) END AS code FROM n),
o AS (SELECT *, CASE p_partkey % 4 WHEN 1 THEN 'pooled' WHEN 2 THEN 'other_agency' ELSE CASE WHEN code IS NULL THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = town AND n_regionkey <> 2) THEN 'mapped' ELSE 'no_address' END END AS outcome FROM k)
SELECT p_partkey, outcome, CASE outcome WHEN 'pooled' THEN 'BLR' WHEN 'mapped' THEN code ELSE '' END AS b FROM o""")
def notice_bodies(table: Tables) -> DataFrame:
    i = F.col("p_partkey")
    notices = table("part").select(i, F.concat(F.element_at(F.array(*map(F.lit, ("DMA/", "bbmp/", "PWD/", "dma/"))), (1 + i % 4).cast("int")), i).alias("tn"), F.when(i % 9 != 0, F.concat(F.lit(" Town "), i % 40)).alias("loc"))
    places = table("part").select((i % 40).alias("town")).distinct().where("town % 5 <> 0 AND town < 26").select(F.concat(F.lit("Town "), "town").alias("location"), (F.col("town") + 100).alias("lgd"))
    bodies = table("nation").select((F.col("n_nationkey") + 100).alias("lgd"), F.when(F.col("n_regionkey") != 2, "desk@town.in").otherwise(" ").alias("email"))
    return tenders.notice_bodies(notices, places, bodies).select("p_partkey", "outcome", F.coalesce("b", F.lit("")).alias("b"))


@book.query("""
SELECT event_id, CASE WHEN event_id % 7 > 0 AND 100000.0 - value * 1500 < 86400 THEN value * 1500 ELSE 100000.0 END AS last_used FROM events""")
def pack_touches(table: Tables) -> DataFrame:
    last = F.when(F.col("event_id") % 7 > 0, F.col("value") * 1500)
    return table("events").select("event_id", dates.touched(last, F.lit(100_000.0)).alias("last_used"))
