"""Writing releases and evaluations: only if changed, by content, in tiles, with labels."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(table: DataFrame) -> str:
    """A digest of a table's rows as a bag, whatever their order and files: number and sums of two hashes of the rows."""
    row = F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(row), F.xxhash64(F.reverse(row), F.lit(1)))]
    told = table.agg(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(s, F.lit("0")) for s in sums]).alias("t"))
    return told.select(F.sha2("t", 256).alias("d")).first()["d"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_if_changed(table: DataFrame, path: str) -> bool:
    """Writes a table unless the one at the path has the same rows; the old one is replaced by a new version only once
    that is complete. Returns whether it wrote. Versions are named by content: readers take `current(spark, path)`."""
    spark, digest = table.sparkSession, content_digest(table)
    if _exists(spark, f"{path}/current") and spark.read.text(f"{path}/current").first()["value"] == digest:
        return False
    if not _exists(spark, f"{path}/v-{digest}/_SUCCESS"):
        table.write.mode("overwrite").parquet(f"{path}/v-{digest}")
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_if_changed wrote last."""
    return spark.read.parquet(f"{path}/v-{spark.read.text(f'{path}/current').first()['value']}")


def publish(table: DataFrame, root: str, entry_id: str) -> dict:
    """Writes a table under a path that carries its content digest, and returns its manifest entry."""
    digest = content_digest(table)
    path = f"{entry_id}-{digest}"
    if not _exists(table.sparkSession, f"{root}/{path}/_SUCCESS"):
        table.write.mode("overwrite").parquet(f"{root}/{path}")
    return {"entry_id": entry_id, "path": path, "sha256": digest, "records": table.count()}


def published(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """A published table by its manifest entry; fails if its rows are not those that the digest tells."""
    table = spark.read.parquet(f"{root}/{entry['path']}")
    if content_digest(table) != entry["sha256"]:
        raise ValueError(f"{entry['entry_id']}: content differs from its digest")
    return table


def write_tiles(features: DataFrame, path: str) -> None:
    """Highway features in a folder for each tile, so that readers open only the tiles they ask for."""
    features.write.partitionBy("tile_id").mode("overwrite").parquet(path)


def write_labelled(reports: DataFrame, path: str) -> None:
    """Reports with a human label as JSON, each with the CRC-32 of its text."""
    told = reports.where("human_label IS NOT NULL")
    told.withColumn("crc32", F.crc32(F.to_json(F.struct(*told.columns)))).write.mode("overwrite").json(path)


def write_evaluation(raw: DataFrame, summary: DataFrame, path: str, configuration: Column | None = None) -> None:
    """The outputs of an evaluation: raw rows, their summary, and a manifest of when, how many and by which digest."""
    raw.write.mode("overwrite").json(f"{path}/raw")
    summary.write.mode("overwrite").json(f"{path}/summary")
    made = datetime.now(timezone.utc).isoformat()
    told = raw.agg(F.count("*").alias("rows"), F.countDistinct("arm").alias("arms")).withColumns({"created_at": F.lit(made), "raw_sha256": F.lit(content_digest(raw)), "configuration": F.lit(None).cast("string") if configuration is None else configuration})
    told.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def blobs_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Files (seq, bytes, content) in the order of the number in their names."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[.][^.]*$", "")
    seq = F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1)
    return files.select(F.nullif(seq, F.lit("")).cast("long").alias("seq"), F.length("content").alias("bytes"), "content").orderBy(F.asc_nulls_last("seq"))
