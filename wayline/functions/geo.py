"""Spatial Column expressions over WGS-84 degrees. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius, metres of a degree along each axis, and the tolerance of an edge.
EARTH_M = 6_371_000.0
EARTH_KM = 6371.0088
M_PER_LNG, M_PER_LAT = 111_320.0, 110_540.0
EDGE = 1e-10
COORDINATE_SCALE = 100_000
TILE_DEGREES = 2
TILE_BUFFER_M = 60


def named(**fields: Column) -> Column:
    """A struct whose field names hold inside nested functions too, where those of aliases come too late."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where `use` reads it inside the function of a transform."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite(c: Column) -> Column:
    """Whether a number is there, and neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_M * F.asin(F.sqrt(chord))


def heading_difference(a: Column, b: Column, directed: bool = True) -> Column:
    """Degrees between two headings; undirected ones differ by at most 90."""
    turn = 360 if directed else 180
    d = F.abs(a - b) % turn
    return F.least(d, turn - d)


def _local(lng: Column, lat: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return (x - lng) * M_PER_LNG * F.cos(F.radians(lat)), (y - lat) * M_PER_LAT


def segment_distance(lng: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres from a point to a segment, on a plane that touches at the point."""
    (px, py), (qx, qy) = _local(lng, lat, ax, ay), _local(lng, lat, bx, by)
    dx, dy = qx - px, qy - py
    square = dx * dx + dy * dy
    along = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / F.when(square > 0, square)))).otherwise(F.lit(0.0))
    return F.hypot(px + along * dx, py + along * dy)


def segment_bearing(lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Compass bearing of a segment in degrees, 0 to 360."""
    dx, dy = (bx - ax) * M_PER_LNG * F.cos(F.radians(lat)), (by - ay) * M_PER_LAT
    return (F.degrees(F.atan2(dx, dy)) + 360) % 360


def in_box(lat: Column, lng: Column, south: float | Column, north: float | Column, west: float | Column, east: float | Column) -> Column:
    """Whether a point lies in a box, edges included."""
    return lat.between(south, north) & lng.between(west, east)


def segments(ring: Column) -> Column:
    """The sides of a ring of (x, y), as (ax, ay, bx, by); an open ring is closed."""

    def closed(ring: Column) -> Column:
        first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
        return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))

    def sides(ring: Column) -> Column:
        side = lambda p, q: named(ax=p["x"], ay=p["y"], bx=q["x"], by=q["y"])
        return F.transform(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: side(p, F.get(ring, i + 1)))

    return bound(ring, lambda r: bound(closed(r), sides))


def on_side(x: Column, y: Column, s: Column) -> Column:
    """Whether a point lies on a side, within the tolerance."""
    cross = (x - s["ax"]) * (s["by"] - s["ay"]) - (y - s["ay"]) * (s["bx"] - s["ax"])
    within = lambda v, a, b: (v >= F.least(a, b) - EDGE) & (v <= F.greatest(a, b) + EDGE)
    return (F.abs(cross) <= EDGE) & within(x, s["ax"], s["bx"]) & within(y, s["ay"], s["by"])


def in_sides(x: Column, y: Column, sides: Column) -> Column:
    """Whether a point lies in the ring of which these are the sides; its edge counts as inside. Sides that neither reach
    the point's height nor stand to its right can be left out."""
    crosses = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"])
    odd = F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return F.exists(sides, lambda s: on_side(x, y, s)) | odd


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring; its edge counts as inside."""
    return in_sides(x, y, segments(ring))


def in_multipolygon(x: Column, y: Column, polygons: Column) -> Column:
    """Whether a point lies in some polygon's outer ring and in none of its holes; the edge of a hole is outside."""
    holes = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    return F.exists(polygons, lambda p: in_ring(x, y, F.get(p, F.lit(0))) & ~F.exists(holes(p), lambda h: in_ring(x, y, h)))


def boundary_distance(x: Column, y: Column, polygons: Column) -> Column:
    """Metres from a point to the nearest side of any ring."""
    return sides_distance(x, y, F.flatten(F.transform(F.flatten(polygons), segments)))


def sides_distance(x: Column, y: Column, sides: Column) -> Column:
    """Metres from a point to the nearest of some sides; null without any."""
    return F.array_min(F.transform(sides, lambda s: segment_distance(x, y, s["ax"], s["ay"], s["bx"], s["by"])))


def bounds(polygons: Column) -> Column:
    """The box of a geometry: west, south, east, north."""
    points = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def ring_area_km2(ring: Column) -> Column:
    """Area on a plane at the ring's mean latitude, over its points as given."""
    lat = F.aggregate(ring, F.lit(0.0), lambda t, p: t + p["y"]) / F.size(ring)
    doubled = F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + s["ax"] * s["by"] - s["bx"] * s["ay"])
    return F.abs(doubled) / 2 * F.pow(F.radians(F.lit(1.0)) * EARTH_KM, 2) * F.cos(F.radians(lat))


def line_metres(points: Column) -> Column:
    """Length of a line of (x, y)."""

    def step(p: Column, q: Column) -> Column:
        return F.hypot((q["x"] - p["x"]) * M_PER_LNG * F.cos(F.radians((p["y"] + q["y"]) / 2)), (q["y"] - p["y"]) * M_PER_LAT)

    steps = lambda ps: F.transform(F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), lambda q, i: step(F.get(ps, i), q))
    return F.aggregate(bound(points, steps), F.lit(0.0), lambda t, m: t + m)


def tile_id(lat: Column, lng: Column) -> Column:
    """Name of the two-degree tile of a point; null outside 0 to 100 degrees."""
    corner = lambda v: (F.floor(v / TILE_DEGREES) * TILE_DEGREES).cast("int")
    ok = finite(lat) & finite(lng) & (lat >= 0) & (lng >= 0) & (lat < 100) & (lng < 100)
    return F.when(ok, F.format_string("e%03dn%02d", corner(lng), corner(lat)))


def tiles_over(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Names of all tiles that a box touches once it is widened by the buffer."""
    pad = TILE_BUFFER_M / M_PER_LAT
    corners = lambda low, high: F.sequence((F.floor((low - pad) / TILE_DEGREES) * TILE_DEGREES).cast("int"), (F.floor((high + pad) / TILE_DEGREES) * TILE_DEGREES).cast("int"), F.lit(TILE_DEGREES))
    return F.flatten(F.transform(corners(west, east), lambda x: F.transform(corners(south, north), lambda y: F.format_string("e%03dn%02d", x, y))))


def encode_line(points: Column) -> Column:
    """Whole coordinates: the first point, then the steps; points equal to the one before are left out; null under two."""
    whole = F.transform(points, lambda p: named(x=F.bround(p["x"] * COORDINATE_SCALE).cast("long"), y=F.bround(p["y"] * COORDINATE_SCALE).cast("long")))

    def steps(moved: Column) -> Column:
        before = lambda i: F.get(moved, i - 1)
        pair = lambda p, i: F.when(i == 0, F.array(p["x"], p["y"])).otherwise(F.array(p["x"] - before(i)["x"], p["y"] - before(i)["y"]))
        return F.when(F.size(moved) >= 2, F.flatten(F.transform(moved, pair)))

    return bound(without_repeats(whole), steps)


def without_repeats(points: Column) -> Column:
    """An array without elements that equal the one before."""
    return bound(points, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))


def decode_line(deltas: Column) -> Column:
    """The points (x, y) of an encoded line, in degrees."""
    axis = lambda k: F.filter(deltas, lambda v, i: i % 2 == k)
    steps = F.arrays_zip(axis(0).alias("dx"), axis(1).alias("dy"))
    start = F.array().cast("array<struct<x:bigint,y:bigint>>")
    here = lambda t: F.coalesce(F.element_at(F.concat(F.array(named(x=F.lit(0).cast("long"), y=F.lit(0).cast("long"))), t), -1))
    whole = F.aggregate(steps, start, lambda t, s: F.concat(t, F.array(named(x=here(t)["x"] + s["dx"], y=here(t)["y"] + s["dy"]))))
    return F.transform(whole, lambda p: named(x=p["x"] / COORDINATE_SCALE, y=p["y"] / COORDINATE_SCALE))


def rounded_rings(polygons: Column, places: int = 7) -> Column:
    """A geometry with its coordinates rounded half to even."""
    point = lambda p: named(x=F.bround(p["x"], places), y=F.bround(p["y"], places))
    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def match_threshold(accuracy: Column, most_accuracy: float = 30, least: float = 15, most: float = 45, margin: float = 8) -> Column:
    """Metres within which a road is a match, by the accuracy of the position."""
    good = finite(accuracy) & accuracy.between(0, most_accuracy)
    return F.when(good, F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), accuracy + margin))).otherwise(F.lit(float(least)))


def valid_ring(ring: Column) -> Column:
    """Whether a ring has four points or more, is closed and lies within the globe."""
    ends = (F.get(ring, F.lit(0))["x"] == F.element_at(ring, -1)["x"]) & (F.get(ring, F.lit(0))["y"] == F.element_at(ring, -1)["y"])
    ranges = F.forall(ring, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    return F.coalesce((F.size(ring) >= 4) & ends & ranges, F.lit(False))


def sides_meet(s: Column, t: Column) -> Column:
    """Whether two sides touch or cross."""
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    sign = lambda v: F.when(v > EDGE, 1).when(v < -EDGE, -1).otherwise(0)
    a, b = sign(turn(s["ax"], s["ay"], s["bx"], s["by"], t["ax"], t["ay"])), sign(turn(s["ax"], s["ay"], s["bx"], s["by"], t["bx"], t["by"]))
    c, d = sign(turn(t["ax"], t["ay"], t["bx"], t["by"], s["ax"], s["ay"])), sign(turn(t["ax"], t["ay"], t["bx"], t["by"], s["bx"], s["by"]))
    touches = on_side(t["ax"], t["ay"], s) | on_side(t["bx"], t["by"], s) | on_side(s["ax"], s["ay"], t) | on_side(s["bx"], s["by"], t)
    return (a * b < 0) & (c * d < 0) | touches


def apart(i: Column, j: Column, n: Column) -> Column:
    """Whether sides i < j of a ring of n sides are no neighbours."""
    return (j > i + 1) & ~((i == 0) & (j == n - 1))


def self_intersects(ring: Column) -> Column:
    """Whether two sides of a ring that are no neighbours touch or cross: all pairs, for small rings."""

    def any_pair(sides: Column) -> Column:
        each = F.transform(sides, lambda s, i: F.exists(F.transform(sides, lambda t, j: apart(i, j, F.size(sides)) & sides_meet(s, t)), lambda hit: hit))
        return F.exists(each, lambda hit: hit)

    return bound(segments(ring), any_pair)
