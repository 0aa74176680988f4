"""Readers with explicit schemas: documents, line sequences, tables, manifests and files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_FEATURE = "properties struct<highway:string,ref:string,network:string>, geometry struct<type:string,coordinates:array<array<double>>>"
TENDER = "tn string, t string, loc string, c string, d string, b string"
RESOURCE = (
    "pack_id string, state_code string, kind string, pack_version int, schema_version int, adapter string, path string, url string, bytes bigint, sha256 string,"
    " coverage_scope string, statewide boolean, source_retrieved_at string, review_after string, licenses array<string>, records int"
)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files as one JSON document each: (path, doc, raw); doc is null for bytes that are not UTF-8 or not JSON."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.from_json(text, schema).alias("doc"), text.alias("raw"))


def line_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features, one a line, each with or without a record separator before it."""
    lines = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit("\u001e ")).alias("value")).where("trim(value) <> ''")
    doc = lines.select(F.monotonically_increasing_id().alias("line_id"), F.from_json("value", LINE_FEATURE).alias("f"))
    return doc.select("line_id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def tenders_csv(spark: SparkSession, path: str, schema: str = TENDER) -> DataFrame:
    """A CSV file with a header, failing on rows of another form."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def slim_tenders(rows: DataFrame) -> DataFrame:
    """Contracts with short texts and the date's first ten characters."""
    return rows.select("tn", F.substring("t", 1, 150).alias("t"), F.substring("loc", 1, 60).alias("loc"), "c", F.substring("d", 1, 10).alias("d"), "b")


def manifest_entries(manifest: DataFrame, column: str = "resources") -> DataFrame:
    """The entries of a manifest's map as rows."""
    return manifest.select(F.explode(F.map_entries(column)).alias("e")).select(F.col("e.key").alias("entry_id"), "e.value.*")


def integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files against a manifest of (path, bytes, sha256): ok, bytes, sha256, missing or unlisted. Paths match by file name."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = spark.read.format("binaryFile").load(path).select(name(F.col("path")).alias("name"), F.length("content").cast("long").alias("has"), F.sha2("content", 256).alias("digest"))
    listed = manifest.select(name(F.col("path")).alias("name"), "bytes", "sha256")
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("has") != F.col("bytes"), "bytes").when(F.col("digest") != F.col("sha256"), "sha256").otherwise("ok")
    return listed.join(files, "name", "full").select("name", state.alias("state"))

