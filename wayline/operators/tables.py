"""Keyed tables: newest rows, first rows, upserts, reconciliation, retention and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.sources.shared import stored


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A table after changes: for each key the row with the highest `order`; changes win ties."""
    marked = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return newest(marked, keys, [F.desc(order), F.desc("_new")]).drop("_new")


def deleted(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table without the rows of the given keys."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def flagged(table: DataFrame, chosen: DataFrame, keys: Sequence[str], column: str, value: Column) -> DataFrame:
    """A table with a column set in the rows of the given keys."""
    marks = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return table.join(marks, list(keys), "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def interrupt_stale(sessions: DataFrame, live_id: str | None = None) -> DataFrame:
    """Sessions that were left active or paused, but for the live one, become interrupted."""
    stale = F.col("status").isin("active", "paused")
    if live_id is not None:
        stale = stale & (F.col("id") != live_id)
    return sessions.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand on one side only: `missing` on the right or `unknown` on the left."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    lost = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing"))
    return lost.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("unknown")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables have the same rows, as bags."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def violations(df: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row that breaks a rule; an unknown answer breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def unexpected_keys(df: DataFrame, key: str, raw: str, allowed: Sequence[str]) -> DataFrame:
    """(key, unexpected): keys of a JSON object that a closed schema does not know."""
    names = F.map_keys(F.from_json(F.col(raw), "map<string,string>"))
    return df.select(key, F.explode(F.array_except(names, F.array(*map(F.lit, allowed)))).alias("unexpected"))


def evicted(cache: DataFrame, cap: int, keys: Sequence[str], first: Column, last_used: str, size: str, protected: Column, ranges: int = 64) -> DataFrame:
    """Marks what a cache drops to come down to `cap` bytes: lowest `first`, then least recently used; never protected rows.

    A row is dropped while what is left after the drops before it is still over the cap, which a running sum tells. The
    order is cut into `ranges` ranges by a distributed sort; sums of ranges are accumulated first, then rows inside
    their range, so no task gets the whole table.
    """
    weight = F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0)))
    order = ["_first", last_used, *keys]
    marked = cache.withColumn("_first", first).withColumn("_weight", weight).withColumn("_free", F.when(protected, 0).otherwise(weight))
    placed = stored(marked.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.sum("_free").alias("_sum"), F.sum("_weight").alias("_all"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of one row for each range
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_start") + F.coalesce(F.sum("_free").over(inside), F.lit(0))
    judged = placed.join(F.broadcast(starts), "_range").withColumn("evicted", ~protected & (F.col("_total") - freed > cap))
    return judged.select(*cache.columns, "evicted")


def retention(cache: DataFrame, manifest: DataFrame, now_s: float, days: dict[str, int], default_days: int, cap: int, protected: Sequence[str]) -> DataFrame:
    """Why each cached pack goes (unlisted, unused, evicted) or null if it stays."""
    listed = manifest.select("cache_key", F.col("pack_id").alias("_id"), F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"), F.col("kind").alias("_kind"))
    joined = cache.join(listed, "cache_key", "left")
    same = (F.col("pack_id") == F.col("_id")) & (F.col("sha256") == F.col("_sha")) & (F.col("bytes") == F.col("_bytes"))
    limit = F.lit(default_days)
    for kind, most in days.items():
        limit = F.when(F.col("_kind") == kind, most).otherwise(limit)
    shielded = F.col("pack_id").isin(*protected) if protected else F.lit(False)
    age = F.greatest(F.lit(0.0), F.lit(now_s) - F.coalesce("last_used_at", "installed_at", F.lit(0.0))) / 86_400
    judged = joined.withColumn("reason", F.when(~F.coalesce(same, F.lit(False)), "unlisted").when((age > limit) & ~shielded, "unused"))
    kept = evicted(judged.where("reason IS NULL"), cap, ["cache_key"], F.when(F.col("_kind") == "tenders", 0).otherwise(1), "last_used_at", "bytes", shielded)
    out = judged.where("reason IS NOT NULL").unionByName(kept.withColumn("reason", F.when(F.col("evicted"), F.lit("evicted"))).drop("evicted"))
    return out.drop("_id", "_sha", "_bytes", "_kind")
