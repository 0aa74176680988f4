"""What the corpus operators share: word rules, shared tables, and running totals that no hot group serialises."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.sources.shared import stored

__all__ = ["SPACES", "WORD", "bound", "broadcast_if_few", "key_bucket", "running_total_before", "stored", "words_of"]

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, wherever the optimizer moves the expression.

    A plain column alias does not promise that: a filter pushed below its projection has the expression put in place
    of each use, even inside the function of a transform().
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def key_bucket(key: str, rows: int, rows_in_bucket: int = 65_536) -> Column:
    """The leading hex digits of a hashed key, as many as keep about `rows_in_bucket` of `rows` rows in a bucket; 3 at least."""
    return F.substring(key, 1, max(3, math.ceil(math.log(max(rows, 1) / rows_in_bucket, 16)) if rows > rows_in_bucket else 3))


def broadcast_if_few(table: DataFrame, most: int) -> DataFrame:
    """A table of short rows for the small side of a join: broadcast up to `most` rows, else joined by a sorted shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def running_total_before(df: DataFrame, groups: list[str], bucket: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of the same group that come earlier by (bucket, *order).

    Two levels, so that no task gets a whole group: sums of each (group, bucket) are accumulated over the few buckets
    of a group, and rows are accumulated only inside their bucket. Groups and bucket must not be null; `bucket` must
    be a function of the order's first column, ascending with it.
    """
    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_in_bucket"))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_bucket_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, keys)
        .withColumn(name, F.col("_bucket_start") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("_bucket_start")
    )
