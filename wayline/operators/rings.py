"""Rings of any size that cross themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.geo import EDGE, apart, segments, sides_meet
from wayline.sources.shared import stored

#: Degrees under which all sides are of one level.
SHORTEST = 1e-7


def ring_sides(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, side, s, n, level): the sides of each ring; a level is the power of two of degrees that a side's longer extent is within."""
    # The number is taken before the sides become rows, or every row would carry the ring along.
    sides = rings.select(key, segments(F.col(ring)).alias("_sides")).withColumn("n", F.size("_sides")).select(key, "n", F.posexplode("_sides").alias("side", "s"))
    extent = F.greatest(F.abs(F.col("s.bx") - F.col("s.ax")), F.abs(F.col("s.by") - F.col("s.ay")), F.lit(SHORTEST))
    return sides.withColumn("level", F.ceil(F.log2(extent)).cast("int"))


def crossings(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, a, b): sides a < b of each ring that touch or cross and are no neighbours.

    A side lies in the cells, as large as its level, that its box touches, at most four, and in those of each longer level that
    its ring has. Two sides that meet share a cell of the longer one's level, so pairs come from an equi-join of sides with the
    long ones of each cell. A ring of many small sides makes few pairs; only sides of like length that crowd a cell without meeting make many.
    """
    sides = stored(ring_sides(rings, key, ring), "sides")
    levels = sides.groupBy(key).agg(F.collect_set("level").alias("levels"))  # of powers of two: some thirty at most
    pad = 2 * EDGE
    size = F.pow(F.lit(2.0), F.col("at").cast("double"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - pad) / size), F.floor((F.greatest(a, b) + pad) / size))
    leveled = sides.join(levels, key).withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    celled = leveled.withColumn("cx", F.explode(span(F.col("s.ax"), F.col("s.bx")))).withColumn("cy", F.explode(span(F.col("s.ay"), F.col("s.by"))))
    cell = [key, "at", "cx", "cy"]
    long = celled.where("level = at").select(*cell, F.col("side").alias("i"), F.col("s").alias("p"))
    met = celled.join(long, cell).where("i <> side AND (level < at OR i < side)")
    first, last = F.least("i", "side"), F.greatest("i", "side")
    return met.where(apart(first, last, F.col("n")) & sides_meet(F.col("p"), F.col("s"))).select(key, first.alias("a"), last.alias("b")).distinct()


def self_crossing(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, crossings): every ring with how many pairs of its sides meet; null and short rings have none."""
    found = crossings(rings, key, ring).groupBy(key).agg(F.count("*").alias("crossings"))
    return rings.select(key).join(found, key, "left").na.fill(0, ["crossings"])
