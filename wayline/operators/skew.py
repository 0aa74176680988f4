"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, total: int, salt: Column, parts: int = 32, share: int = 1000) -> DataFrame:
    """rows joined with `table` (one row for each key, none null) on `keys`, with the rows of hot keys dealt to `parts` tasks.

    `count` is the table's column with each key's number of rows, of `total` altogether. Keys with over 1 / `share` of
    the rows are hot; they are fewer than `share`, so their list is broadcast. `salt` says how the rows of a hot key
    are dealt: any expression over `rows` that differs between them. The column `count` is not in the result.
    """
    is_hot = F.col(count) * share > max(total, 1)
    hot = table.where(is_hot).select(*keys, F.lit(True).alias("_hot")).limit(share)
    left = rows.join(F.broadcast(hot), list(keys), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    right = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    return left.join(right, [*keys, "_salt"]).drop("_salt")
