"""Ordered commits of a stream: a log of changes by batch, and reports de-duplicated as they are committed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.functions.geo import M_PER_LAT, M_PER_LNG, finite
from wayline.operators.dedupe import FIELDS, FOLDED, HISTORY_M, fold_reports
from wayline.operators.tables import newest
from wayline.sources.shared import discard, stored

#: Cells of a degree in which reports find events, a little wider than their reach.
PLACES = 5000
INDEX = "value string, canonical_id long"


def current_rows(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of a log of changes."""
    return newest(changes, keys, [F.desc("batch"), F.desc(order)]).drop("batch")


def commit_stream(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Appends the newest row of each key of every batch to a log; a batch that runs again writes the same.

    Only changes are written, not the table; `current_rows` over the log is the table, and `compact` shortens the log.
    """

    def commit(batch: DataFrame, number: int) -> None:
        newest(batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _started(changes, commit, checkpoint)


def compact(spark: SparkSession, path: str, to: str, keys: list[str], order: str) -> None:
    """Writes the table of a log as one batch of a new log."""
    current_rows(spark.read.option("basePath", path).parquet(path), keys, order).write.mode("overwrite").parquet(f"{to}/batch=0")


def _started(changes: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _places(lat: Column, lng: Column, reach_m: float) -> Column:
    """Names of the cells that a circle around a position touches, around the globe; none without a position."""
    north = F.lit(reach_m / M_PER_LAT)
    east = F.least(F.lit(180.0), reach_m / (M_PER_LNG * F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + north))))))
    span = lambda c, pad: F.sequence(F.floor((c - pad) * PLACES), F.floor((c + pad) * PLACES))
    turned = lambda x: F.pmod(x + 180 * PLACES, F.lit(360 * PLACES))
    cells = F.flatten(F.transform(span(lat, north), lambda y: F.transform(span(lng, east), lambda x: F.concat_ws(":", F.lit("place"), y, turned(x)))))
    return F.when(finite(lat) & finite(lng), cells).otherwise(F.array().cast("array<string>"))


def _named(reach_m: float) -> Column:
    """What a report is found by: its id, source key, drive and place. Asked with a reach, kept with none."""
    own = [F.concat(F.lit(f"{name}:"), F.col(c).cast("string")) for name, c in (("id", "id"), ("key", "source_event_key"), ("drive", "drive_id"))]
    return F.array_distinct(F.filter(F.concat(F.array(*own), _places(F.col("lat"), F.col("lng"), reach_m)), lambda v: v.isNotNull()))


class Buckets:
    """A table in hash buckets, each written whole when a batch changes it: bucket=b/batch=n.

    A batch reads of a bucket the newest version before its own, so it can run again, and leaves that one and its own. What it
    reads is as many files as buckets that it can touch, however long the log is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows fall into: at most as many as there are."""
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self, bucket: int) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        names = [f.getPath().getName() for f in self.files.listStatus(where)] if self.files.exists(where) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def read(self, buckets: Iterable[int], before: int) -> DataFrame:
        """The rows of some buckets as they were before a batch."""
        newest = [(b, max((v for v in self._versions(b) if v < before), default=None)) for b in buckets]
        paths = [f"{self.path}/bucket={b}/batch={v}" for b, v in newest if v is not None]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Puts whole buckets in place, each sorted by its key, and clears what no batch will read again."""
        names = [part.split()[0] for part in self.schema.split(", ")]
        touched = self.of(rows)
        dealt = rows.select(*names, self._bucket().alias("bucket"), F.lit(batch).alias("batch")).repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for b in touched:
            for old in [v for v in self._versions(b) if v < batch][:-1]:
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}/batch={old}"), True)


def _tables(spark: SparkSession, path: str, schema: str, buckets: int) -> tuple[Buckets, Buckets]:
    return Buckets(spark, f"{path}/events", schema, "canonical_id", buckets), Buckets(spark, f"{path}/index", INDEX, "value", buckets)


def _schema(fields: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields) + ", " + FOLDED.split(", ", 1)[1]


def commit_reports(reports: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Commits a stream of reports with the de-duplication rule inside the commit.

    A batch looks up in an index which events its reports could repeat: by id, source key, drive and place. These events
    with all their reports are folded together with the new ones in the order of capture, and what comes out takes their
    place: for each report its event, and the event's count, drives and keys. Events and index lie in `buckets` by hash of event
    and of value, and only buckets that a batch can touch are read or written. A report that comes again is known by its
    id, and one of the same source by its key, however late.

    Reports must come in batches that follow the order of capture; within a batch any order will do, and of reports of one id the
    first by capture, then by all fields, counts. One query writes a log, so no two commits decide on the same state; a batch that runs again decides
    the same. `buckets` stays the same for a log, and should be so many that a bucket is a task's work.
    """
    schema = _schema((f.name, f.dataType.simpleString()) for f in reports.select(*FIELDS).schema)

    def commit(batch: DataFrame, number: int) -> None:
        events, index = _tables(batch.sparkSession, path, schema, buckets)
        rows = stored(newest(batch.select(*FIELDS), ["id"], [F.asc_nulls_last("captured_at"), F.struct(*FIELDS).asc()]), "batch")
        asked = rows.select(F.explode(_named(HISTORY_M)).alias("value")).distinct()
        known = stored(index.read(index.of(asked), number).join(asked, "value", "left_semi").select("canonical_id").distinct(), "known")
        old = events.read(events.of(known), number).join(known, "canonical_id", "left_semi")
        given = old.select(*FIELDS).unionByName(rows.join(old.select("id"), "id", "left_anti"))
        folded = stored(given.join(fold_reports(given), "id"), "folded")
        values = folded.select(F.explode(_named(0.0)).alias("value"), "canonical_id").distinct()
        events.write(events.read(events.of(folded), number).join(folded.select("id"), "id", "left_anti").unionByName(folded), number)
        index.write(index.read(index.of(values), number).unionByName(values).distinct(), number)
        for table in (rows, known, folded):
            discard(table)

    return _started(reports, commit, checkpoint)


def committed_reports(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The reports of a log with their present events."""
    of = {f.name: f.dataType.simpleString() for f in spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events").schema}
    events, _ = _tables(spark, path, _schema((c, of[c]) for c in FIELDS), buckets)
    return events.read(range(buckets), 1 << 31)
