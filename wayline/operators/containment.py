"""Points in regions, and the authority that a point is routed to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.decide import accuracy_gate
from wayline.functions.geo import M_PER_LAT, M_PER_LNG, bounds, finite, in_box, in_sides, named, segments, sides_distance
from wayline.sources.shared import stored

#: A region is covered by cells of a power of two of degrees, about so many along its longer side; whole ones are merged so often.
ACROSS, MERGES = 16, 3
#: Degrees beyond a side that still may count as on it, and metres that are more than that.
TOLERANCE, LEAST_REACH_M = 2e-6, 0.5
#: Fixed value: the accuracy in metres beyond which no position is taken for sure.
MOST_ACCURACY_M = 30.0


def _range(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def _in_rays(x: Column, y: Column, rays: Column) -> Column:
    """Whether a point lies in some polygon's outer ring and in none of its holes, by the rings (part, ring, sides) that its row meets."""
    inside = lambda r: in_sides(x, y, r["sides"])
    hole = lambda o: F.exists(rays, lambda h: (h["part"] == o["part"]) & (h["ring"] > 0) & inside(h))
    return F.coalesce(F.exists(rays, lambda o: (o["ring"] == 0) & inside(o) & ~hole(o)), F.lit(False))


def cover(regions: DataFrame, reach_m: float = 0.0) -> DataFrame:
    """(region_id, size, cx, cy, whole, rays, near): cells that cover each region, and what lies within `reach_m` of its sides.

    A cell that no side comes near is whole: it lies in the region with all its points, and needs no geometry. Four whole cells of a
    square are made one, again and again. Any other cell has the sides that decide about its points: `rays`, by ring, those of
    its row from its western edge on, and `near` those within reach.
    """
    reach = max(reach_m, LEAST_REACH_M)
    boxed = regions.select("region_id", "geometry", bounds(F.col("geometry")).alias("box")).where("box.west IS NOT NULL")
    longer = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"), F.lit(1e-4))
    shapes = boxed.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(longer / ACROSS)).cast("double")))
    rings = shapes.select("region_id", "size", F.posexplode("geometry").alias("part", "rings")).select("region_id", "size", "part", F.posexplode("rings").alias("ring", "points"))
    sides = rings.select("region_id", "size", "part", "ring", F.explode(segments(F.col("points"))).alias("s"))
    # Sides of each row of cells, by ring.
    low, high = F.least("s.ay", "s.by") - TOLERANCE, F.greatest("s.ay", "s.by") + TOLERANCE
    rowed = sides.withColumn("cy", F.explode(_range(low, high, F.col("size"))))
    by_ring = rowed.groupBy("region_id", "size", "cy", "part", "ring").agg(F.collect_list("s").alias("sides"))
    rows = by_ring.groupBy("region_id", "size", "cy").agg(F.collect_list(F.struct("part", "ring", "sides")).alias("rays"))
    # Cells that a side, or what is in reach of it, touches; a long side is gone along in steps of a cell.
    dx, dy = F.col("s.bx") - F.col("s.ax"), F.col("s.by") - F.col("s.ay")
    steps = sides.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / F.col("size"))).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x = [F.col("s.ax") + dx * (F.col("k") + i) / F.col("n") for i in (0, 1)]
    y = [F.col("s.ay") + dy * (F.col("k") + i) / F.col("n") for i in (0, 1)]
    north = F.lit(reach / M_PER_LAT)
    east = reach / (M_PER_LNG * F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("s.ay"), F.abs("s.by")) + north))))
    touched = steps.withColumn("cx", F.explode(_range(F.least(*x) - east, F.greatest(*x) + east, F.col("size"))))
    touched = touched.withColumn("cy", F.explode(_range(F.least(*y) - north, F.greatest(*y) + north, F.col("size"))))
    edge = touched.groupBy("region_id", "size", "cx", "cy").agg(F.collect_set("s").alias("near"))
    right = F.transform("rays", lambda r: named(part=r["part"], ring=r["ring"], sides=F.filter(r["sides"], lambda s: F.greatest(s["ax"], s["bx"]) >= F.col("cx") * F.col("size") - TOLERANCE)))
    edges = edge.join(rows, ["region_id", "size", "cy"], "left").withColumn("rays", right)
    # The other cells of the box lie wholly inside or outside, as their middles do.
    every = shapes.select("region_id", "size", F.explode(_range(F.col("box.west"), F.col("box.east"), F.col("size"))).alias("cx"), "box").withColumn("cy", F.explode(_range(F.col("box.south"), F.col("box.north"), F.col("size"))))
    clear = every.drop("box").join(edge, ["region_id", "size", "cx", "cy"], "left_anti").join(rows, ["region_id", "size", "cy"])
    middle = lambda c: (F.col(c) + 0.5) * F.col("size")
    whole = clear.where(_in_rays(middle("cx"), middle("cy"), F.col("rays"))).select("region_id", "size", "cx", "cy")
    level = F.lit(0)
    for k in range(1, MERGES + 1):  # a square of 2^k by 2^k cells, all whole
        square = Window.partitionBy("region_id", F.shiftright("cx", k), F.shiftright("cy", k))
        whole = whole.withColumn(f"n{k}", F.count("*").over(square))
    for k in range(1, MERGES + 1):
        level = F.when(F.col(f"n{k}") == 4**k, F.lit(k)).otherwise(level)
    merged = whole.withColumn("k", level).select("region_id", (F.col("size") * F.pow(F.lit(2.0), F.col("k"))).alias("size"), F.expr("shiftright(cx, k)").alias("cx"), F.expr("shiftright(cy, k)").alias("cy")).distinct()
    columns = ["region_id", "size", "cx", "cy", "whole", "rays", "near"]
    return edges.withColumn("whole", F.lit(False)).select(*columns).unionByName(merged.withColumn("whole", F.lit(True)), allowMissingColumns=True).select(*columns)


def near_regions(points: DataFrame, regions: DataFrame, reach_m: float = 0.0) -> DataFrame:
    """Each point with each region that it lies in, or that has a side within `reach_m`: the columns of both but the
    geometry, `inside`, and `edge_m`, the metres to the nearest side if that is within reach.

    Points meet regions (region_id, geometry, ...) in the cells of `cover`: in a whole cell the answer is known, in another the sides at hand decide.
    """
    cells = stored(cover(regions, reach_m), "cover")
    sizes = [r["size"] for r in cells.select("size").distinct().collect()]  # powers of two: some twenty at most
    x, y = F.col("lng"), F.col("lat")
    cell = lambda s: named(size=F.lit(s), cx=F.floor(x / s).cast("int"), cy=F.floor(y / s).cast("int"))
    placed = points.where(finite(y) & finite(x)).withColumn("_cell", F.explode(F.array(*[cell(s) for s in sizes])) if sizes else F.lit(None).cast("struct<size:double,cx:int,cy:int>"))
    shape = cells.select("region_id", F.struct("size", "cx", "cy").alias("_cell"), "whole", "rays", "near")
    met = placed.join(shape, "_cell").drop("_cell")
    told = met.withColumn("inside", F.col("whole") | _in_rays(x, y, F.col("rays"))).withColumn("edge_m", sides_distance(x, y, F.col("near")))
    told = told.withColumn("edge_m", F.when(F.col("edge_m") <= reach_m, F.col("edge_m"))).drop("whole", "rays", "near")
    return told.where("inside OR edge_m IS NOT NULL").join(regions.drop("geometry"), "region_id")


def containing(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Each point with each region that contains it, edges included."""
    return near_regions(points, regions).where("inside").drop("inside", "edge_m")


def exclusive_region(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """The one region of each point: reason `covered`, `outside` for none, `location_uncertain` for several."""
    found = containing(points, regions).groupBy(key).agg(F.count("*").alias("n"), F.min("region_id").alias("region_id"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 1, "covered").when(n == 0, "outside").otherwise("location_uncertain")
    return points.join(found, key, "left").withColumn("reason", reason).withColumn("region_id", F.when(n == 1, F.col("region_id"))).drop("n")


def box_geometry(south: str, north: str, west: str, east: str) -> Column:
    """A box as a polygon of one ring."""
    corner = lambda x, y: named(x=F.col(x), y=F.col(y))
    return F.array(F.array(F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))))


def exclusions_near(points: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """(key, _region, excluded, edge): for each point and each region with an exclusion box near it, whether the point lies
    in such a box, and whether the edge of one is within the point's accuracy."""
    boxes = exclusions.select(F.col("region_id").alias("_region"), F.monotonically_increasing_id().cast("string").alias("region_id"), box_geometry("south", "north", "west", "east").alias("geometry"))
    met = near_regions(points.select(key, "lat", "lng", "gps_accuracy"), boxes, MOST_ACCURACY_M)
    edge = F.coalesce(F.col("edge_m") <= F.col("gps_accuracy"), F.lit(False))
    return met.groupBy(key, "_region").agg(F.max("inside").alias("excluded"), F.max(edge).alias("edge"))


def route(points: DataFrame, regions: DataFrame, exclusions: DataFrame, highways: DataFrame, key: str, envelope: tuple[float, float, float, float] | None = None, enforce: bool = True) -> DataFrame:
    """The responsible body of each point, in order of precedence.

    Without a position no_location; on a sure national highway that; on an uncertain one location_uncertain; outside the
    envelope (south, north, west, east) of the regions outside_area. Within it a position must be precise to 30 m, if
    that is enforced, and neither the boundary of any region nor the edge of any exclusion box may be within its
    accuracy; an excluded region counts neither way. Then the only region that contains the point has it: several are
    uncertain, none is outside_area, and a region without an authority is jurisdiction_unavailable.

    Points have lat, lng, gps_accuracy; regions region_id, authority_id, geometry; exclusions region_id and a box;
    `highways` (key, ref, uncertain) for points near one.
    """
    met = near_regions(points.select(key, "lat", "lng", "gps_accuracy"), regions, MOST_ACCURACY_M)
    edge = F.coalesce(F.col("edge_m") <= F.col("gps_accuracy"), F.lit(False))
    near = met.select(key, F.col("region_id").alias("_region"), "authority_id", "inside", edge.alias("touches"))
    both = near.join(exclusions_near(points, exclusions, key), [key, "_region"], "full")
    open_ = ~F.coalesce("excluded", F.lit(False)) & F.col("inside").isNotNull()
    found = both.groupBy(key).agg(
        F.count_if(open_ & F.col("inside")).alias("n"),
        F.min_by("authority_id", F.when(open_ & F.col("inside"), F.col("_region"))).alias("authority"),
        F.max(F.coalesce("edge", F.lit(False)) | (open_ & F.col("touches"))).alias("touches"),
    )
    joined = points.join(highways.select(key, "ref", "uncertain"), key, "left").join(found, key, "left")
    here = F.coalesce(finite(F.col("lat")) & finite(F.col("lng")), F.lit(False))
    within = F.lit(True) if envelope is None else in_box(F.col("lat"), F.col("lng"), *map(F.lit, envelope))
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when(~here, "no_location")
        .when(F.col("ref").isNotNull() & ~F.col("uncertain"), "national_highway")
        .when(F.col("ref").isNotNull(), "location_uncertain")
        .when(~within, "outside_area")
        .when(~accuracy_gate(F.col("gps_accuracy"), F.lit(enforce), MOST_ACCURACY_M), "location_uncertain")
        .when(F.coalesce("touches", F.lit(False)) | (n > 1), "location_uncertain")
        .when(n == 0, "outside_area")
        .when(F.col("authority").isNull(), "jurisdiction_unavailable")
        .otherwise("municipal")
    )
    routed = joined.withColumn("reason", reason)
    authority = F.when(F.col("reason") == "national_highway", F.lit("in-national-highway")).when(F.col("reason") == "municipal", F.col("authority"))
    return routed.withColumn("authority_id", authority).withColumn("covered", F.col("authority_id").isNotNull()).drop("n", "authority", "touches", "uncertain")


def jurisdiction(points: DataFrame, key: str, highways: DataFrame, towns: DataFrame, villages: DataFrame) -> DataFrame:
    """(key, kind, name, type, lgd): who a point of the state belongs to, the first of these that holds.

    `road_class_unknown` if the layer of towns or of highways gave no answer, or that of villages where it is asked;
    `national_highway` on a polygon of `highways`; `town` in one of `towns` (name, type, lgd); `rural` in one of `villages`
    with a name; else `outside_state`. Layers have region_id and geometry; of several shapes the first region_id counts. Points have
    lat, lng and, optionally, towns_answered, highways_answered and villages_answered (else true); without a position nothing answers.
    """
    layers = {"highways": highways, "towns": towns, "villages": villages}
    asked = points.select("*", *[F.lit(True).alias(f"{n}_answered") for n in layers if f"{n}_answered" not in points.columns])
    shapes = None
    for rank, layer in enumerate(layers.values()):
        given = [F.col(c).cast("string").alias(c) if c in layer.columns else F.lit(None).cast("string").alias(c) for c in ("name", "type", "lgd")]
        own = layer.select(F.concat(F.lit(f"{rank}:"), F.col("region_id").cast("string")).alias("region_id"), "geometry", *given)
        shapes = own if shapes is None else shapes.unionByName(own)
    held = containing(asked.select(key, "lat", "lng"), shapes).withColumn("rank", F.substring("region_id", 1, 1).cast("int"))
    first = held.groupBy(key).agg(*[F.min(F.when(F.col("rank") == n, F.struct("region_id", "name", "type", "lgd"))).alias(layer) for n, layer in enumerate(layers)])
    told = asked.join(first, key, "left")
    here = F.coalesce(finite(F.col("lat")) & finite(F.col("lng")), F.lit(False))
    answered = lambda *names: here & F.coalesce(F.expr(" AND ".join(f"{n}_answered" for n in names)), F.lit(False))
    trimmed = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    kind = (
        F.when(~answered("towns", "highways"), "road_class_unknown")
        .when(F.col("highways").isNotNull(), "national_highway")
        .when(F.col("towns").isNotNull(), "town")
        .when(~answered("villages"), "road_class_unknown")
        .when(trimmed("villages.name").isNotNull(), "rural")
        .otherwise("outside_state")
    )
    named_ = F.when(F.col("kind") == "national_highway", trimmed("highways.name")).when(F.col("kind") == "town", F.col("towns.name")).when(F.col("kind") == "rural", trimmed("villages.name"))
    in_town = F.col("kind") == "town"
    return told.withColumn("kind", kind).select(
        key, "kind", named_.alias("name"), F.when(in_town, F.upper(F.trim(F.coalesce("towns.type", F.lit(""))))).alias("type"), F.when(in_town, F.coalesce("towns.lgd", F.lit(""))).alias("lgd")
    )
