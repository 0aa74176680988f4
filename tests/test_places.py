"""Roads and regions by cells, against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import nearest

ROADS = "tile_id string, ordinal int, refs string, bbox array<long>, deltas array<long>"


def made_roads(seed: int, n: int, spread: int) -> list[tuple]:
    """Roads of up to 40 km in one tile, some diagonal, some tiny, several of a name; whole coordinates."""
    r, out = random.Random(seed), []
    for i in range(n):
        points = [(r.randrange(7_400_000, 7_400_000 + spread), r.randrange(1_200_000, 1_200_000 + spread))]
        size = r.choice([30, 800, 15_000])
        for _ in range(r.randint(1, 4)):
            x, y = points[-1]
            points.append((min(max(x + r.randint(-size, size), 7_400_000), 7_599_999), min(max(y + r.randint(-size, size), 1_200_000), 1_399_999)))
        deltas = [*points[0], *(d for a, b in zip(points, points[1:]) for d in (b[0] - a[0], b[1] - a[1]))]
        xs, ys = zip(*points)
        out.append(("e074n12", i, f"NH-{r.randrange(max(2, n // 3))}", [min(xs), min(ys), max(xs), max(ys)], deltas))
    return out


def by_hand(lat: float, lng: float, roads: list[tuple]) -> list[tuple[float, int, int, str]]:
    """(metres, ordinal, side, ref) of the nearest segment of each name, nearest first."""
    best: dict[str, tuple[float, int, int, str]] = {}
    ix, iy = math.floor(lng * 1e5 + 0.5), math.floor(lat * 1e5 + 0.5)
    east, north = math.ceil(45 / max(20_000, 111_320 * math.cos(math.radians(lat))) * 1e5), math.ceil(45 / 110_540 * 1e5)
    for _, ordinal, ref, (w, s, e, n), deltas in roads:
        if not (w - east <= ix <= e + east and s - north <= iy <= n + north):
            continue
        x, y, points = 0, 0, []
        for dx, dy in zip(deltas[::2], deltas[1::2]):
            x, y = x + dx, y + dy
            points.append((x / 1e5, y / 1e5))
        for side, (p, q) in enumerate(zip(points, points[1:])):
            (ax, ay), (bx, by) = [((u - lng) * 111_320 * math.cos(math.radians(lat)), (v - lat) * 110_540) for u, v in (p, q)]
            square = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / square)) if square else 0.0
            found = (math.hypot(ax + t * (bx - ax), ay + t * (by - ay)), ordinal, side, ref)
            best[ref] = min(best.get(ref, found), found)
    return sorted(best.values())


@pytest.mark.parametrize("spread", [4000, 190_000])
def test_nearest_two_against_all_segments(spark: SparkSession, spread: int) -> None:
    roads = made_roads(spread, 60 if spread < 10_000 else 600, spread)
    r = random.Random(3)
    points = [(i, 12 + r.uniform(0, spread / 1e5), 74 + r.uniform(0, spread / 1e5)) for i in range(300)] + [(900, None, 74.0), (901, 12.0, float("nan")), (902, 50.0, 3.0)]
    got = {x["id"]: x for x in nearest.nearest_two(spark.createDataFrame(points, "id int, lat double, lng double"), spark.createDataFrame(roads, ROADS), "id").collect()}
    want = {i: found for i, lat, lng in points[:300] if (found := by_hand(lat, lng, roads))}
    assert set(got) == set(want) and sum(len(w) > 1 for w in want.values()) > 30
    for i, found in want.items():
        assert got[i]["ref"] == found[0][3] and got[i]["metres"] == pytest.approx(found[0][0], abs=1e-6)
        assert got[i]["other_ref"] == (found[1][3] if len(found) > 1 else None)
        assert len(found) < 2 or got[i]["other_m"] == pytest.approx(found[1][0], abs=1e-6)


def test_candidates_do_not_grow_with_the_roads_of_a_tile(spark: SparkSession) -> None:
    """Ten times the roads in the tile, as many around the points: a point meets as many segments as before."""
    r = random.Random(4)
    points = spark.createDataFrame([(i, 12 + r.uniform(0, 0.03), 74 + r.uniform(0, 0.03)) for i in range(200)], "id int, lat double, lng double")
    near = [("e074n12", i, f"NH-{i}", [7_400_000, 1_200_000 + 50 * i, 7_403_000, 1_200_000 + 50 * i], [7_400_000, 1_200_000 + 50 * i, 3000, 0]) for i in range(61)]
    far = [("e074n12", 1000 + i, f"NH-{i}", [7_450_000, 1_250_000 + i, 7_453_000, 1_250_000 + i], [7_450_000, 1_250_000 + i, 3000, 0]) for i in range(600)]
    met = [nearest.candidates(points, spark.createDataFrame(roads, ROADS), "id").count() for roads in (near, near + far)]
    assert met[0] == met[1] and met[0] / 200 < 12
    assert nearest.nearest_in_reach(points, spark.createDataFrame(near + far, ROADS), "id").count() == 200


def ring(*points: tuple[float, float]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in (*points, points[0])]


def blob(r: random.Random, x: float, y: float, size: float, n: int) -> list[dict]:
    """A star of n corners around a point."""
    return ring(*[(x + size * r.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + size * r.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])


SHAPES = "region_id string, authority_id string, geometry array<array<array<struct<x:double,y:double>>>>"


def made_regions(spark: SparkSession) -> DataFrame:
    """Stars of all sizes, with holes and several parts, some that overlap; boxes on whole cells, a sliver, an empty one."""
    r, rows = random.Random(6), []
    for i in range(25):
        x, y, size = 77 + r.random(), -0.5 + r.random(), 10 ** r.uniform(-3, -0.3)
        parts = [[blob(r, x, y, size, r.choice([3, 9, 120]))] + ([blob(r, x, y, size / 4, 7)] if i % 3 == 0 else [])]
        parts += [[blob(r, x + 2 * size, y, size / 2, 5)]] if i % 4 == 0 else []
        rows.append((f"s{i}", "a", parts))
    rows += [("box", "b", [[ring((77.0, 0.0), (77.5, 0.0), (77.5, 0.25), (77.0, 0.25))]]), ("sliver", "c", [[ring((77.2, -0.4), (77.9, 0.4), (77.9, 0.4001))]]), ("none", "d", [])]
    return spark.createDataFrame(rows, SHAPES)


def test_cells_of_regions_against_whole_geometry(spark: SparkSession) -> None:
    """Every point with every region, by its whole geometry: inside or not, and the metres to the boundary where it is near."""
    from wayline.functions.geo import boundary_distance, in_multipolygon
    from wayline.operators.containment import cover, near_regions

    r, regions = random.Random(7), made_regions(spark)
    corners = [(p["y"], p["x"]) for x in regions.collect() for part in x["geometry"] for rg in part for p in rg]
    points = [(-0.6 + 1.2 * r.random(), 76.9 + 1.2 * r.random()) for _ in range(600)] + r.sample(corners, 150)
    points += [(a + r.uniform(-2e-4, 2e-4), b + r.uniform(-2e-4, 2e-4)) for a, b in r.sample(corners, 250)]
    points += [(k / 8, 77 + j / 8) for k in range(-2, 3) for j in range(5)] + [(float("nan"), 77.0), (None, 77.0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lng double")
    got = {(x["id"], x["region_id"]): (x["inside"], x["edge_m"]) for x in near_regions(table, regions, 30.0).collect()}
    pairs = table.where("lat IS NOT NULL AND NOT isnan(lat)").crossJoin(regions.where("size(geometry) > 0"))
    x, y, shape = F.col("lng"), F.col("lat"), F.col("geometry")
    want = {}
    for p in pairs.select("id", "region_id", in_multipolygon(x, y, shape).alias("inside"), boundary_distance(x, y, shape).alias("m")).collect():
        if p["inside"] or p["m"] <= 30:
            want[p["id"], p["region_id"]] = (p["inside"], p["m"] if p["m"] <= 30 else None)
    assert set(got) == set(want) and len(want) > 500
    for k, (inside, metres) in want.items():
        assert got[k][0] == inside and (got[k][1] is None) == (metres is None) and (metres is None or got[k][1] == pytest.approx(metres, abs=1e-6))
    # Whole cells are disjoint from the others and cover the inner part: most points inside need no geometry.
    cells = cover(regions.where("region_id = 'box'")).collect()
    area = sum(c["size"] ** 2 for c in cells if c["whole"])
    assert area > 0.6 * 0.125 and len({c["size"] for c in cells}) > 1 and all((c["near"] is None) == c["whole"] for c in cells)


def test_jurisdiction_asks_highways_then_towns_then_villages(spark: SparkSession) -> None:
    from wayline.operators.containment import jurisdiction

    square = lambda x, y, size: [[ring((x, y), (x + size, y), (x + size, y + size), (x, y + size))]]
    shape = "geometry array<array<array<struct<x:double,y:double>>>>"
    highways = spark.createDataFrame([(1, " NH 48 ", square(77.4, 12.0, 0.2)), (2, " ", square(77.9, 12.9, 0.05))], f"region_id int, name string, {shape}")
    towns = spark.createDataFrame([(5, "Town B", "cmc ", None, square(77.0, 12.0, 0.6)), (4, "Town A", " tmc", "802", square(77.5, 12.0, 0.5))], f"region_id int, name string, type string, lgd string, {shape}")
    villages = spark.createDataFrame([("v1", "Gram", square(77.0, 12.0, 1.5)), ("v2", "  ", square(79.0, 12.0, 0.5))], f"region_id string, name string, {shape}")
    points = [
        (1, 12.1, 77.1, True, True, True, ("town", "Town B", "CMC", "")), (2, 12.1, 77.55, True, True, None, ("national_highway", "NH 48", None, None)),
        (3, 12.3, 77.55, True, True, False, ("town", "Town A", "TMC", "802")), (4, 13.0, 78.2, True, True, True, ("rural", "Gram", None, None)), (5, 13.0, 78.2, True, True, False, ("road_class_unknown", None, None, None)),
        (6, 13.0, 78.2, False, True, True, ("road_class_unknown", None, None, None)), (7, 12.1, 77.55, True, None, True, ("road_class_unknown", None, None, None)), (8, 40.0, 10.0, True, True, True, ("outside_state", None, None, None)),
        (9, None, 77.0, True, True, True, ("road_class_unknown", None, None, None)), (10, 12.2, 79.2, True, True, True, ("outside_state", None, None, None)), (11, 12.91, 77.91, True, True, True, ("national_highway", None, None, None)),
    ]
    table = spark.createDataFrame([p[:6] for p in points], "id int, lat double, lng double, towns_answered boolean, highways_answered boolean, villages_answered boolean")
    got = {x["id"]: (x["kind"], x["name"], x["type"], x["lgd"]) for x in jurisdiction(table, "id", highways, towns, villages).collect()}
    assert got == {p[0]: p[-1] for p in points}
    plain = {x["id"]: x["kind"] for x in jurisdiction(table.select("id", "lat", "lng"), "id", highways, towns, villages).collect()}
    assert plain[5] == "rural" and plain[7] == "national_highway" and plain[9] == "road_class_unknown"


def test_crossings_against_all_pairs(spark: SparkSession) -> None:
    """Stars, random rings, touching and overlapping sides, repeated points, sides of very unlike lengths, open and tiny rings."""
    from wayline.functions.geo import self_intersects
    from wayline.operators.rings import self_crossing

    r, rows = random.Random(12), []
    for i in range(60):
        n = r.choice([3, 5, 12, 40])
        points = [(70 + r.uniform(0, 10 ** r.uniform(-4, 0)), 20 + r.uniform(0, 10 ** r.uniform(-4, 0))) for _ in range(n)]
        rows.append(points if i % 2 else [(p["x"], p["y"]) for p in blob(r, 75, 20, 10 ** r.uniform(-4, 0), n)])
    rows += [[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], [(0, 0), (4, 0), (2, 0), (2, 2)], [(0, 0), (1, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 1)], [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0)]]
    table = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(rows)] + [(900, None), (901, [])], "id int, ring array<struct<x:double,y:double>>")
    want = {x["id"]: bool(x["hit"]) for x in table.select("id", self_intersects(F.col("ring")).alias("hit")).collect()}
    got = {x["id"]: x["crossings"] > 0 for x in self_crossing(table, "id", "ring").collect()}
    assert got == want and 10 < sum(want.values()) < 60


def test_a_ring_of_200_000_points(spark: SparkSession) -> None:
    from wayline.operators.rings import crossings

    corner = "named_struct('x', 75 + (1 + 0.1 * sin(id * 0.01)) * cos(2 * pi() * id / 200000), 'y', 20 + (1 + 0.1 * sin(id * 0.01)) * sin(2 * pi() * id / 200000))"
    points = spark.range(200_000).selectExpr("id", f"{corner} AS p").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]).alias("ring"))
    moved = F.transform("ring", lambda p, i: F.when(i == 150_000, F.struct((p["x"] + 0.002).alias("x"), p["y"].alias("y"))).otherwise(p))
    both = points.select(F.lit("plain").alias("id"), "ring").unionByName(points.select(F.lit("moved").alias("id"), moved.alias("ring")))
    found = crossings(both, "id", "ring").groupBy("id").count().collect()
    assert [x["id"] for x in found] == ["moved"] and found[0]["count"] >= 2
