"""The nearest road of a point, and the nearest with another name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import COORDINATE_SCALE, M_PER_LAT, M_PER_LNG, bound, decode_line, finite, heading_difference, match_threshold, named, segment_bearing, segment_distance, tile_id

#: Degrees of a cell in which points meet segments, and of one in which they meet whole features.
SEGMENT_CELL, FEATURE_CELL = 0.01, 0.05
#: Metres by which a feature's box is widened, and up to which a rival can matter to a match.
BOX_M, RIVAL_M = 45.0, 75.0


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def _pads(metres: float, lat: Column) -> tuple[Column, Column]:
    """Degrees east and north that are `metres` or more up to a latitude."""
    north = F.lit(metres / M_PER_LAT)
    return metres / (M_PER_LNG * F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + north)))), north


def _in_cells(table: DataFrame, west: Column, south: Column, east: Column, north: Column, size: float) -> DataFrame:
    """A row of `table` for each cell (cx, cy) that its box touches."""
    across, along = F.sequence(_cell(west, size), _cell(east, size)), F.sequence(_cell(south, size), _cell(north, size))
    return table.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(along))


def _sides(deltas: Column) -> Column:
    """The segments (ax, ay, bx, by) of an encoded line, in order."""
    side = lambda p, q: named(ax=p["x"], ay=p["y"], bx=q["x"], by=q["y"])
    return bound(decode_line(deltas), lambda ps: F.transform(F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), lambda q, i: side(F.get(ps, i), q)))


def segment_grid(features: DataFrame, reach_m: float) -> DataFrame:
    """Each segment of `features` in each cell that a circle of `reach_m` around one of its points touches.

    A long segment is gone along in steps of a cell, so a diagonal one lies in the cells it crosses rather than in all of
    its box. A segment that two steps put into a cell is there twice, which no minimum minds.
    """
    sides = features.select("tile_id", "ordinal", "refs", "bbox", F.posexplode(_sides(F.col("deltas"))).alias("side", "s")).select("*", "s.*").drop("s")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = sides.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / SEGMENT_CELL)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x = [F.col("ax") + dx * (F.col("k") + i) / F.col("n") for i in (0, 1)]
    y = [F.col("ay") + dy * (F.col("k") + i) / F.col("n") for i in (0, 1)]
    east, north = _pads(reach_m, F.greatest(F.abs("ay"), F.abs("by")))
    return _in_cells(steps, F.least(*x) - east, F.least(*y) - north, F.greatest(*x) + east, F.greatest(*y) + north, SEGMENT_CELL).drop("n", "k")


def _in_box(lat: Column, lng: Column) -> Column:
    """Whether a point lies in a feature's box of whole coordinates, widened by BOX_M."""
    scaled = lambda c: F.floor(c * COORDINATE_SCALE + 0.5)
    pad_y = F.ceil(F.lit(BOX_M / M_PER_LAT * COORDINATE_SCALE))
    pad_x = F.ceil(BOX_M / F.greatest(F.lit(20_000.0), M_PER_LNG * F.cos(F.radians(lat))) * COORDINATE_SCALE)
    box = lambda i: F.col("bbox")[i]
    return scaled(lng).between(box(0) - pad_x, box(2) + pad_x) & scaled(lat).between(box(1) - pad_y, box(3) + pad_y)


def _placed(points: DataFrame, key: str, size: float) -> DataFrame:
    placed = points.select(key, "lat", "lng", tile_id(F.col("lat"), F.col("lng")).alias("tile_id")).where("tile_id IS NOT NULL")
    return placed.withColumn("cx", _cell(F.col("lng"), size)).withColumn("cy", _cell(F.col("lat"), size))


def candidates(points: DataFrame, features: DataFrame, key: str, reach_m: float = RIVAL_M) -> DataFrame:
    """(key, lat, lng, tile_id, refs, ordinal, side, ax, ay, bx, by): each point with the segments of its tile that may
    be within `reach_m`, if the feature's box is near."""
    met = _placed(points, key, SEGMENT_CELL).join(segment_grid(features, reach_m), ["tile_id", "cx", "cy"])
    return met.where(_in_box(F.col("lat"), F.col("lng"))).drop("cx", "cy", "bbox")


def _by_ref(met: DataFrame, key: str) -> DataFrame:
    """(key, refs, m): the nearest segment of each name."""
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    measured = met.withColumn("metres", segment_distance(F.col("lng"), F.col("lat"), *ends)).withColumn("bearing", segment_bearing(F.col("lat"), *ends))
    return measured.groupBy(key, "refs").agg(F.min_by(F.struct("metres", "bearing", "ordinal", "side"), F.struct("metres", "ordinal", "side")).alias("m"))


def _ranked(by_ref: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("m.metres", "m.ordinal", "m.side")
    ranked = by_ref.withColumn("turn", F.row_number().over(order)).withColumn("other_m", F.lead("m.metres").over(order)).withColumn("other_ref", F.lead("refs").over(order))
    return ranked.where("turn = 1").select(key, F.col("refs").alias("ref"), F.col("m.metres").alias("metres"), F.col("m.bearing").alias("bearing"), "other_ref", "other_m")


def nearest_in_reach(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """`nearest_two` among the segments within RIVAL_M alone, which is all that a match asks."""
    return _ranked(_by_ref(candidates(points, features, key), key).where(F.col("m.metres") <= RIVAL_M), key)


def nearest_two(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """For each point with a road in reach: ref, metres and bearing of the nearest, and the metres of the nearest other.

    `features` has (tile_id, ordinal, refs, bbox of whole coordinates, deltas). A road is in reach if it has a feature in
    the point's own tile whose box, widened by BOX_M, holds the point; all its segments count then, however far. Ties go to
    the earlier feature and segment. Points meet segments in cells of a hundredth of a degree; only a point that finds
    fewer than two names within RIVAL_M there meets the boxes of whole features. Either way the number of roads in a tile does not matter.
    """
    near = nearest_in_reach(points, features, key)
    both = near.where("other_m IS NOT NULL")
    rest = _placed(points, key, FEATURE_CELL).join(both.select(key), key, "left_anti")
    scale = lambda i: F.col("bbox")[i] / COORDINATE_SCALE
    # The pad of the box test is at most 45 m by 20,000 m a degree, and one coordinate.
    east = north = F.lit(BOX_M / 20_000 + 2 / COORDINATE_SCALE)
    boxed = _in_cells(features, scale(0) - east, scale(1) - north, scale(2) + east, scale(3) + north, FEATURE_CELL)
    met = rest.join(boxed, ["tile_id", "cx", "cy"]).where(_in_box(F.col("lat"), F.col("lng")))
    sides = met.select(key, "lat", "lng", "refs", "ordinal", F.posexplode(_sides(F.col("deltas"))).alias("side", "s")).select("*", "s.*")
    return both.unionByName(_ranked(_by_ref(sides, key), key))


def match_highway(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, ref, metres, uncertain) for points on or near a highway, by accuracy, runner-up and direction of travel.

    Points have lat, lng, gps_accuracy, heading, speed. Too far, or travelling across the road, is no match. A match is
    within 45 m and its rival within its accuracy of 30 m more, so no road beyond RIVAL_M is asked.
    """
    near = points.join(nearest_in_reach(points, features, key), key)
    good = F.coalesce(finite(F.col("gps_accuracy")) & F.col("gps_accuracy").between(0, 30), F.lit(False))
    rival = F.coalesce(F.col("other_m") <= F.col("metres") + F.greatest(F.lit(6.0), F.col("gps_accuracy")), F.lit(False))
    moving = F.coalesce(finite(F.col("heading")) & finite(F.col("speed")) & (F.col("speed") >= 2), F.lit(False))
    across = moving & (heading_difference(F.col("heading"), F.col("bearing"), directed=False) > 55)
    uncertain = ~good | rival
    return near.where(F.col("metres") <= match_threshold(F.col("gps_accuracy"))).where(uncertain | ~across).select(key, "ref", "metres", uncertain.alias("uncertain"))
