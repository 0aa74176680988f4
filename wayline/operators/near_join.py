"""Pairs of points within a distance, by an equi-join on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.geo import finite, haversine

#: Metres of a degree of latitude, rounded down so that cells are never too small.
SAFE_M_PER_DEGREE = 110_000.0


def _row(lat: Column, metres: float) -> Column:
    return F.floor(lat / (metres / SAFE_M_PER_DEGREE)).cast("long")


def _columns(row: Column, metres: float) -> Column:
    """How many cells a row of cells has around the globe: none is narrower than the distance. One near the poles."""
    height = metres / SAFE_M_PER_DEGREE
    far = F.greatest(F.abs(row * height), F.abs((row + 1) * height))
    width = height / F.cos(F.radians(F.least(far, F.lit(89.0))))
    return F.when(far >= 89, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / width))).cast("long")


def _reach(lat: Column, metres: float) -> Column:
    """Degrees of longitude that a circle around a latitude can touch."""
    height = metres / SAFE_M_PER_DEGREE
    return height / F.cos(F.radians(F.least(F.abs(lat) + height, F.lit(89.0))))


def near_join(left: DataFrame, right: DataFrame, metres: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Every pair of a left and a right row at most `metres` apart, as structs `a` and `b` with their distance.

    A right row has one grid cell, a left row goes to the few cells that its circle can touch, so the join is on equal
    cells and its work grows with the pairs that are near. Rows of cells go around the globe, so pairs on both sides of
    180 degrees meet. Rows without a finite position have no pairs.
    """
    placed = lambda df: df.where(finite(F.col(lat)) & finite(F.col(lng)))
    columns = _columns(F.col("row"), metres)
    at = lambda degrees: F.floor((degrees + 180) / 360 * columns).cast("long")
    target = placed(right).select(F.struct("*").alias("b"), _row(F.col(lat), metres).alias("row")).withColumn("cell", F.pmod(at(F.col(f"b.{lng}")), columns))
    spread = placed(left).select(F.struct("*").alias("a"), F.explode(F.sequence(_row(F.col(lat), metres) - 1, _row(F.col(lat), metres) + 1)).alias("row"))
    here, reach = F.col(f"a.{lng}"), _reach(F.col(f"a.{lat}"), metres)
    cells = F.when(columns <= 3, F.sequence(F.lit(0).cast("long"), columns - 1)).otherwise(F.array_distinct(F.transform(F.sequence(at(here - reach), at(here + reach)), lambda c: F.pmod(c, columns))))
    spread = spread.withColumn("cell", F.explode(cells))
    distance = haversine(F.col(f"a.{lat}"), F.col(f"a.{lng}"), F.col(f"b.{lat}"), F.col(f"b.{lng}"))
    return spread.join(target, ["row", "cell"]).select("a", "b", distance.alias("metres")).where(F.col("metres") <= metres)


def near_id_pairs(rows: DataFrame, key: str, metres: float, lat: str = "lat", lng: str = "lng", digits: int = 3, most: int = 512) -> DataFrame:
    """Every pair of rows at most `metres` apart once, as `a` < `b` by their `key`, with their distance to `digits` places.

    Near places are found once, however many rows stand on them. A place's keys are dealt to lists of about `most`, and
    pairs of lists of near places become the pairs of rows, so that the work is little more than writing these, and
    neither a place nor a pair of places is one task. Null keys have no pairs; equal keys make none with each other.
    """
    placed = rows.where(finite(F.col(lat)) & finite(F.col(lng)) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lat).alias("lat"), F.col(lng).alias("lng"))
    places = placed.groupBy("lat", "lng").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = placed.join(places, ["lat", "lng"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    lists = dealt.groupBy("lat", "lng", "part").agg(F.collect_list("key").alias("keys"))
    near = near_join(places, places, metres).where(F.struct("a.lat", "a.lng") <= F.struct("b.lat", "b.lng"))
    parts = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"{s}.parts") - 1))
    same = (F.col("a.lat") == F.col("b.lat")) & (F.col("a.lng") == F.col("b.lng"))
    pairs = near.select("a", "b", F.round("metres", digits).alias("metres"), same.alias("same"), parts("a").alias("part_a")).select("*", parts("b").alias("part_b")).where("NOT same OR part_a <= part_b")
    pairs = pairs.select("metres", (F.col("same") & (F.col("part_a") == F.col("part_b"))).alias("same"), *[c.alias(n) for s in "ab" for c, n in ((F.col(f"{s}.lat"), f"lat_{s}"), (F.col(f"{s}.lng"), f"lng_{s}"))], "part_a", "part_b")
    for s in "ab":
        at = lists.select(F.col("lat").alias(f"lat_{s}"), F.col("lng").alias(f"lng_{s}"), F.col("part").alias(f"part_{s}"), F.col("keys").alias(f"keys_{s}"))
        pairs = pairs.join(at, [f"lat_{s}", f"lng_{s}", f"part_{s}"]).drop(f"lat_{s}", f"lng_{s}", f"part_{s}")
    both = pairs.select("metres", "same", "keys_b", F.explode("keys_a").alias("x")).select("metres", "same", "x", F.explode("keys_b").alias("y"))
    return both.where(F.when(F.col("same"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "metres")
