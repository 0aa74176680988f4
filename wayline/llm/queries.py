"""The registered queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.alignment import align_tokenizers
from wayline.llm.concat_packing import concatenate_and_cut
from wayline.llm.filter_audit import audit_filters
from wayline.llm.html_text import extract_text
from wayline.llm.line_dedup import dedup_lines
from wayline.llm.mixing import mix_sources
from wayline.llm.packing import pack_documents
from wayline.llm.quality_classifier import classify_quality
from wayline.llm.quality_rules import quality_rules
from wayline.llm.simhash import near_duplicates
from wayline.llm.sharding import shard_by_bytes
from wayline.llm.suffix_dedup import remove_repeats
from wayline.llm.topk import exact_top_k, whole_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public vocabulary byte_bpe_50k as ranks: the same ids as its tokenizers file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces() -> str:
    """Path of the public sentencepiece model piece_bpe_32k."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source", "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(md5(text), ''))) AS key, coalesce(md5(text), '') AS digest
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
levelled AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, cap <= level * weight AS is_full FROM levelled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target
  FROM judged),
budgets AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, digest
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(b.budget - b.epochs * b.source_size - p.earlier, p.size)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).drop("text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


#: By another way: equal lines of two places, islands of them on a diagonal are the maximal repeated runs.
OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.content, len(regexp_extract_all(u.content, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS content, generate_subscripts(parts, 1) AS line) u),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM lines WHERE words > 0),
pairs AS (
  SELECT b.doc_id, b.nth, b.line, b.words, a.doc_id AS from_id, b.nth - a.nth AS gap FROM worded a JOIN worded b ON a.content = b.content
  WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.nth < b.nth)),
islands AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, from_id, gap ORDER BY nth) AS island FROM pairs),
repeated AS (SELECT doc_id, min(line) AS first, max(line) AS last FROM islands GROUP BY doc_id, from_id, gap, island HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM (SELECT DISTINCT doc_id, first, last FROM repeated)),
marked AS (
  SELECT l.doc_id, l.line, l.content, l.words, g.line IS NOT NULL AS is_gone
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line)
SELECT doc_id, CAST(count(*) FILTER (words > 0) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (words > 0 AND is_gone) AS BIGINT) AS n_removed_lines,
       sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT is_gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", whole_components("embedding").alias("v"))
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP9_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: By another way: the letters of the filters that a document fails, compared with the letters of each order's steps.
OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts),
counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (FROM good)) AS good, count(*) FILTER (doc_id IN (FROM toxic)) AS toxic
  FROM failed GROUP BY part, fails),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS earlier
  FROM orders, range(1, 6) r(s)),
judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS is_failing, translate(earlier, fails, '') <> earlier AS is_gone
  FROM steps, counted),
summed AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT is_failing AND NOT is_gone), 0) AS kept, coalesce(sum(n) FILTER (is_failing AND NOT is_gone), 0) AS removed,
         coalesce(sum(n) FILTER (is_failing AND is_gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (is_failing AND NOT is_gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (is_failing AND NOT is_gone), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), vocabulary(), pieces(), groups="sha256").withColumnRenamed("groups", "groups_sha256")


def op13_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenate_and_cut(_table(spark, sf_dir, "documents"), vocabulary(), window=1024)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash": op4_simhash,
    "op5_pack_documents": op5_pack_documents,
    "op6_html_text": op6_html_text,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_top_k": op9_top_k,
    "op10_shard_by_bytes": op10_shard_by_bytes,
    "op11_filter_audit": op11_filter_audit,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_concat_and_cut": op13_concat_and_cut,
}

ORACLE_SQL = {
    "op1_mix_sources": OP1_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_top_k": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
}
