"""Queries over positions, regions, roads and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import geo, text
from wayline.operators import containment, highways, nearest, rings
from wayline.plans.define import FIXES_SQL, Book, Tables, fixes

book = Book()

RING = "array<struct<x:double,y:double>>"
#: A grid of 250 regions over the city of `fixes`: every third is so wide that it overlaps its neighbour, every seventh
#: has a hole, every eleventh no authority, and every fifth an exclusion box at its south-western corner.
ROWS, COLUMNS = 25, 10


def _boxes() -> list[dict]:
    out = []
    for i in range(ROWS * COLUMNS):
        west, south = 77.6 + (i % COLUMNS) * 0.001, 12.9 + (i // COLUMNS) * 0.004
        east, north = west + (0.0013 if i % 3 == 2 else 0.0009), south + 0.0037
        out.append({"i": i, "region_id": f"r{i:03d}", "authority_id": None if i % 11 == 0 else f"a{i % 5}", "box": (west, south, east, north)})
    return out


def _ring(west: float, south: float, east: float, north: float) -> list[tuple[float, float]]:
    return [(west, south), (east, south), (east, north), (west, north), (west, south)]


def _third(box: tuple[float, float, float, float], middle: bool) -> tuple[float, float, float, float]:
    """The middle third of a box, or the third at its south-western corner."""
    west, south, east, north = box
    x, y = (east - west) / 3, (north - south) / 3
    return (west + x, south + y, east - x, north - y) if middle else (west, south, west + x, south + y)


def _rings(b: dict) -> list[list[tuple[float, float]]]:
    return [_ring(*b["box"])] + ([_ring(*_third(b["box"], True))] if b["i"] % 7 == 0 else [])


def regions(spark: SparkSession) -> DataFrame:
    shape = lambda b: [[[{"x": x, "y": y} for x, y in ring] for ring in _rings(b)]]
    return spark.createDataFrame([(b["region_id"], b["authority_id"], shape(b)) for b in _boxes()], f"region_id string, authority_id string, geometry array<array<{RING}>>")


def exclusion_boxes(spark: SparkSession) -> DataFrame:
    rows = [(b["region_id"], *_third(b["box"], False)) for b in _boxes() if b["i"] % 5 == 0]
    return spark.createDataFrame(rows, "region_id string, west double, south double, east double, north double")


def _values(rows: list[tuple]) -> str:
    """Rows as SQL; numbers with a fraction as doubles."""
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _sides(boxes: list[dict]) -> list[tuple]:
    return [(b["region_id"], part, *map(float, a), *map(float, c)) for b in boxes for part, ring in enumerate(_rings(b)) for a, c in zip(ring, ring[1:])]


INSIDE_SQL = f"""{FIXES_SQL},
regions(region_id, authority_id, west, south, east, north) AS (VALUES {_values([(b["region_id"], b["authority_id"], *map(float, b["box"])) for b in _boxes()])}),
sides(region_id, part, x1, y1, x2, y2) AS (VALUES {_values(_sides(_boxes()))}),
near AS (SELECT f.event_id, f.lat, f.lng, r.region_id FROM fixes f JOIN regions r ON f.lng BETWEEN r.west - 0.0005 AND r.east + 0.0005 AND f.lat BETWEEN r.south - 0.0005 AND r.north + 0.0005),
tested AS (
  SELECT f.event_id, s.region_id, s.part,
    bool_or(abs((f.lng - x1) * (y2 - y1) - (f.lat - y1) * (x2 - x1)) <= 1e-10 AND f.lng BETWEEN least(x1, x2) - 1e-10 AND greatest(x1, x2) + 1e-10
            AND f.lat BETWEEN least(y1, y2) - 1e-10 AND greatest(y1, y2) + 1e-10)
    OR count(*) FILTER ((y1 > f.lat) <> (y2 > f.lat) AND f.lng < (x2 - x1) * (f.lat - y1) / CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END + x1) % 2 = 1 AS inside
  FROM near f JOIN sides s ON f.region_id = s.region_id GROUP BY f.event_id, s.region_id, s.part),
held AS (SELECT event_id, region_id FROM tested GROUP BY event_id, region_id HAVING bool_or(inside AND part = 0) AND NOT bool_or(inside AND part = 1))"""


@book.query(f"WITH {INSIDE_SQL} SELECT event_id, region_id FROM held")
def points_in_regions(table: Tables) -> DataFrame:
    points = fixes(table)
    return containment.containing(points, regions(points.sparkSession)).select("event_id", "region_id")


@book.query(f"""WITH {INSIDE_SQL}, n AS (SELECT event_id, count(*) AS n, min(region_id) AS region_id FROM held GROUP BY event_id)
SELECT f.event_id, CASE WHEN n.n = 1 THEN n.region_id END AS region_id, CASE WHEN n.n = 1 THEN 'covered' WHEN n.n IS NULL THEN 'outside' ELSE 'location_uncertain' END AS reason
FROM fixes f LEFT JOIN n ON f.event_id = n.event_id""")
def exclusive_regions(table: Tables) -> DataFrame:
    points = fixes(table)
    return containment.exclusive_region(points, regions(points.sparkSession), "event_id").select("event_id", "region_id", "reason")


def distances_sql(source: str, columns: str) -> str:
    """A select of `columns` and the metres from (lng, lat) to the side (x1, y1, x2, y2) of each row of a source."""
    return f"""
  SELECT {columns}, sqrt(pow(px + t * (qx - px), 2) + pow(py + t * (qy - py), 2)) AS metres FROM (
    SELECT *, CASE WHEN sq > 0 THEN greatest(0.0, least(1.0, -(px * (qx - px) + py * (qy - py)) / sq)) ELSE 0.0 END AS t FROM (
      SELECT *, (qx - px) * (qx - px) + (qy - py) * (qy - py) AS sq FROM (
        SELECT *, (x1 - lng) * 111320.0 * cos(radians(lat)) AS px, (y1 - lat) * 110540.0 AS py, (x2 - lng) * 111320.0 * cos(radians(lat)) AS qx, (y2 - lat) * 110540.0 AS qy FROM ({source}))))"""


@book.query(f"WITH {INSIDE_SQL}, d AS ({distances_sql('SELECT f.*, s.* FROM fixes f, sides s WHERE s.region_id = ' + chr(39) + 'r007' + chr(39), 'event_id')}) SELECT event_id, round(min(metres), 3) AS edge_m FROM d GROUP BY event_id")
def boundary_distances(table: Tables) -> DataFrame:
    ring = lambda r: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r])
    shape = F.array(F.array(*map(ring, _rings(_boxes()[7]))))
    return fixes(table).select("event_id", F.round(geo.boundary_distance(F.col("lng"), F.col("lat"), shape), 3).alias("edge_m"))


SPREAD = "event_id, user_id, CAST(event_id % 3600 AS DOUBLE) / 100 AS lat, 60 + CAST(user_id % 40 AS DOUBLE) AS lng"


@book.query(f"""WITH p AS (SELECT {SPREAD} FROM events)
SELECT 'e' || lpad(CAST(CAST(floor(lng / 2) * 2 AS INTEGER) AS VARCHAR), 3, '0') || 'n' || lpad(CAST(CAST(floor(lat / 2) * 2 AS INTEGER) AS VARCHAR), 2, '0') AS tile_id,
  count(*) AS features, count(DISTINCT user_id) AS refs, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM p GROUP BY 1""")
def tile_stats(table: Tables) -> DataFrame:
    placed = table("events").selectExpr("event_id", "user_id", "CAST(event_id % 3600 AS DOUBLE) / 100 AS lat", "60 + CAST(user_id % 40 AS DOUBLE) AS lng")
    box = [F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north")]
    return placed.groupBy(geo.tile_id(F.col("lat"), F.col("lng")).alias("tile_id")).agg(F.count("*").alias("features"), F.countDistinct("user_id").alias("refs"), *box)


@book.query(f"""WITH p AS (SELECT {SPREAD} FROM events), x AS (SELECT event_id, lat, unnest(generate_series(CAST(floor((lng - 60 / 110540.0::DOUBLE) / 2) * 2 AS BIGINT), CAST(floor((lng + 60 / 110540.0::DOUBLE) / 2) * 2 AS BIGINT), 2)) AS tx FROM p),
y AS (SELECT event_id, tx, unnest(generate_series(CAST(floor((lat - 60 / 110540.0::DOUBLE) / 2) * 2 AS BIGINT), CAST(floor((lat + 60 / 110540.0::DOUBLE) / 2) * 2 AS BIGINT), 2)) AS ty FROM x)
SELECT event_id, printf('e%03dn%02d', tx, ty) AS tile_id FROM y WHERE ty >= 0""")
def tiles_covered(table: Tables) -> DataFrame:
    placed = table("events").selectExpr("event_id", "CAST(event_id % 3600 AS DOUBLE) / 100 AS lat", "60 + CAST(user_id % 40 AS DOUBLE) AS lng")
    lat, lng = F.col("lat"), F.col("lng")
    return placed.select("event_id", F.explode(geo.tiles_over(lng, lat, lng, lat)).alias("tile_id")).where(~F.contains("tile_id", F.lit("n-")))


def _roads() -> list[tuple[str, int, str, list[int]]]:
    """Some 650 roads (tile, ordinal, ref, deltas of three points) on 50 tiles and more: meridians and parallels from 10 to
    30 degrees north and 70 to 80 east, and denser ones through the city of `fixes`."""
    lines = []
    for k in range(40):
        lines += [(f"NH-{k + 1}", 7_000_000 + 25_000 * k, 1_000_000 + 200_000 * t, 5, 200_000) for t in range(10)]
        lines += [(f"NE-{k + 1}", 7_000_000 + 200_000 * t, 1_000_000 + 50_000 * k, 200_000, 5) for t in range(5)]
    lines += [(f"NH-{200 + k}", 7_759_500, 1_290_500 + 1000 * k, 2000, 5) for k in range(10)]
    lines += [(f"NH-{300 + k % 3}", 7_760_150 + 200 * k, 1_289_000, 5, 12_000) for k in range(5)]
    made, count = [], {}
    for ref, x, y, dx, dy in lines:
        tile = f"e{x // 200_000 * 2:03d}n{y // 200_000 * 2:02d}"
        count[tile] = count.get(tile, -1) + 1
        made.append((tile, count[tile], ref, [x, y, dx // 2 + 7 * (dx < dy), dy // 2 + 7 * (dy < dx), dx - dx // 2 - 7 * (dx < dy), dy - dy // 2 - 7 * (dy < dx)]))
    return made


def _points(deltas: list[int]) -> list[tuple[int, int]]:
    x, y, out = 0, 0, []
    for dx, dy in zip(deltas[::2], deltas[1::2]):
        x, y = x + dx, y + dy
        out.append((x, y))
    return out


def _bbox(deltas: list[int]) -> list[int]:
    xs, ys = zip(*_points(deltas))
    return [min(xs), min(ys), max(xs), max(ys)]


def roads(spark: SparkSession) -> DataFrame:
    rows = [(tile, ordinal, ref, _bbox(deltas), deltas) for tile, ordinal, ref, deltas in _roads()]
    return spark.createDataFrame(rows, "tile_id string, ordinal int, refs string, bbox array<long>, deltas array<long>")


_SPREAD_LAT, _SPREAD_LNG = "10 + event_id % 399 * 0.05{d} + event_id % 7 * 0.0001{d}", "70 + user_id % 39 * 0.25{d} + event_id * 7 % 11 * 0.00005{d}"


def road_points(table: Tables) -> DataFrame:
    """Half of the fixes in their city, half near the grid of roads; every 41st without an accuracy."""
    away = F.col("event_id") % 2 == 0
    return fixes(table).select(
        "event_id", F.when(away, F.expr(_SPREAD_LAT.format(d="D"))).otherwise(F.col("lat")).alias("lat"), F.when(away, F.expr(_SPREAD_LNG.format(d="D"))).otherwise(F.col("lng")).alias("lng"),
        F.when(F.col("event_id") % 41 != 0, (F.col("event_id") % 40).cast("double")).alias("gps_accuracy"), (F.col("event_id") % 360).cast("double").alias("heading"), (F.col("value") % 10).alias("speed"),
    )


def _road_sides() -> list[tuple]:
    out = []
    for tile, ordinal, ref, deltas in _roads():
        points = [(x / 100_000, y / 100_000) for x, y in _points(deltas)]
        out += [(tile, ordinal, ref, k, *_bbox(deltas), *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(points, points[1:]))]
    return out


ROAD_SQL = f"""{FIXES_SQL},
spots AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_SPREAD_LAT.format(d="::DOUBLE")} ELSE lat END AS lat, CASE WHEN event_id % 2 = 0 THEN {_SPREAD_LNG.format(d="::DOUBLE")} ELSE lng END AS lng,
         CASE WHEN event_id % 41 <> 0 THEN CAST(event_id % 40 AS DOUBLE) END AS gps_accuracy, CAST(event_id % 360 AS DOUBLE) AS heading, value % 10 AS speed FROM fixes),
road_sides(tile_id, ordinal, ref, side, west, south, east, north, x1, y1, x2, y2) AS (VALUES {_values(_road_sides())}),
tiled AS (SELECT *, printf('e%03dn%02d', CAST(floor(lng / 2) * 2 AS INTEGER), CAST(floor(lat / 2) * 2 AS INTEGER)) AS tile_id, floor(lng * 100000 + 0.5) AS ix, floor(lat * 100000 + 0.5) AS iy,
  ceil(45.0::DOUBLE / greatest(20000.0::DOUBLE, 111320.0::DOUBLE * cos(radians(lat))) * 100000) AS pad_x, ceil(45.0::DOUBLE / 110540.0::DOUBLE * 100000) AS pad_y FROM spots),
met AS (SELECT p.event_id, p.lat, p.lng, r.ordinal, r.ref, r.side, r.x1, r.y1, r.x2, r.y2 FROM tiled p JOIN road_sides r ON p.tile_id = r.tile_id AND p.ix BETWEEN r.west - pad_x AND r.east + pad_x AND p.iy BETWEEN r.south - pad_y AND r.north + pad_y),
road_d AS ({distances_sql("SELECT * FROM met", "event_id, lat, ref, ordinal, side, x1, y1, x2, y2")}),
best AS (SELECT event_id, ref, arg_min((metres, ordinal, side, lat, x1, y1, x2, y2), (metres, ordinal, side)) AS b FROM road_d GROUP BY event_id, ref),
ranked AS (SELECT event_id, ref, b[1] AS metres, (degrees(atan2((b[7] - b[5]) * 111320.0::DOUBLE * cos(radians(b[4])), (b[8] - b[6]) * 110540.0::DOUBLE)) + 360) % 360 AS bearing,
  row_number() OVER w AS n, lead(b[1]) OVER w AS other_m, lead(ref) OVER w AS other_ref FROM best WINDOW w AS (PARTITION BY event_id ORDER BY b[1], b[2], b[3])),
matched AS (
  SELECT r.event_id, r.ref, r.metres, NOT coalesce(gps_accuracy BETWEEN 0 AND 30, false) OR coalesce(r.other_m <= r.metres + greatest(6.0, coalesce(gps_accuracy, 6.0)), false) AS uncertain,
    coalesce(speed >= 2, false) AND least(abs(heading - bearing) % 180, 180 - abs(heading - bearing) % 180) > 55 AS across
  FROM ranked r JOIN spots p ON r.event_id = p.event_id
  WHERE r.n = 1 AND r.metres <= CASE WHEN coalesce(gps_accuracy BETWEEN 0 AND 30, false) THEN least(45.0, greatest(15.0, gps_accuracy + 8)) ELSE 15.0 END),
matches AS (SELECT event_id, ref, metres, uncertain FROM matched WHERE uncertain OR NOT across)"""


@book.query(f"WITH {ROAD_SQL} SELECT event_id, ref, round(metres, 3) AS metres, other_ref, round(other_m, 3) AS other_m FROM ranked WHERE n = 1 AND metres <= 40")
def nearest_roads(table: Tables) -> DataFrame:
    points = road_points(table)
    near = nearest.nearest_two(points, roads(points.sparkSession), "event_id")
    return near.where("metres <= 40").select("event_id", "ref", F.round("metres", 3).alias("metres"), "other_ref", F.round("other_m", 3).alias("other_m"))


@book.query(f"WITH {ROAD_SQL} SELECT event_id, ref, round(metres, 3) AS metres, uncertain FROM matches")
def highway_matches(table: Tables) -> DataFrame:
    points = road_points(table)
    return nearest.match_highway(points, roads(points.sparkSession), "event_id").withColumn("metres", F.round("metres", 3))


@book.query(f"""WITH {INSIDE_SQL}, {ROAD_SQL.replace(FIXES_SQL + ",", "")},
boxes(region_id, bw, bs, be, bn) AS (VALUES {_values([(b["region_id"], *map(float, _third(b["box"], False))) for b in _boxes() if b["i"] % 5 == 0])}),
box_sides AS (SELECT region_id, bw, bs, be, bn, unnest([bw, be, be, bw]) AS x1, unnest([bs, bs, bn, bn]) AS y1, unnest([be, be, bw, bw]) AS x2, unnest([bs, bn, bn, bs]) AS y2 FROM boxes),
city AS (SELECT f.event_id, f.lat, f.lng, s.gps_accuracy, s.lat = f.lat AND s.lng = f.lng AS here FROM fixes f JOIN spots s ON f.event_id = s.event_id),
acc AS (SELECT event_id, lat, lng, gps_accuracy FROM spots),
near_box AS (SELECT a.*, b.region_id, b.x1, b.y1, b.x2, b.y2, a.lng BETWEEN bw AND be AND a.lat BETWEEN bs AND bn AS inside FROM acc a JOIN box_sides b ON a.lng BETWEEN bw - 0.0005 AND be + 0.0005 AND a.lat BETWEEN bs - 0.0005 AND bn + 0.0005),
box_m AS ({distances_sql("SELECT * FROM near_box", "event_id, region_id, gps_accuracy, inside")}),
shut AS (SELECT event_id, region_id, bool_or(inside) AS excluded, coalesce(min(metres) <= any_value(gps_accuracy), false) AS edge FROM box_m GROUP BY event_id, region_id),
near_side AS (SELECT a.*, s.region_id, s.x1, s.y1, s.x2, s.y2 FROM acc a JOIN regions r ON a.lng BETWEEN r.west - 0.0005 AND r.east + 0.0005 AND a.lat BETWEEN r.south - 0.0005 AND r.north + 0.0005 JOIN sides s ON s.region_id = r.region_id),
side_m AS ({distances_sql("SELECT * FROM near_side", "event_id, region_id, gps_accuracy")}),
touched AS (SELECT event_id, region_id, coalesce(min(metres) <= any_value(gps_accuracy), false) AS touches FROM side_m GROUP BY event_id, region_id),
judged AS (SELECT t.event_id, t.region_id, t.touches, h.region_id IS NOT NULL AS inside FROM touched t LEFT JOIN (SELECT h.* FROM held h JOIN city c ON c.event_id = h.event_id WHERE c.here) h ON t.event_id = h.event_id AND t.region_id = h.region_id
  LEFT JOIN shut x ON t.event_id = x.event_id AND t.region_id = x.region_id WHERE NOT coalesce(x.excluded, false)),
found AS (SELECT event_id, bool_or(touches) AS touches, count(*) FILTER (inside) AS n, min(region_id) FILTER (inside) AS region_id FROM judged GROUP BY event_id),
edges AS (SELECT event_id, bool_or(edge) AS edge FROM shut GROUP BY event_id),
reasons AS (
  SELECT a.event_id, m.ref, r.authority_id, CASE
    WHEN m.ref IS NOT NULL AND NOT m.uncertain THEN 'national_highway' WHEN m.ref IS NOT NULL THEN 'location_uncertain'
    WHEN NOT (a.lat BETWEEN 12.5 AND 13.5 AND a.lng BETWEEN 77 AND 78) THEN 'outside_area'
    WHEN NOT coalesce(a.gps_accuracy BETWEEN 0 AND 30, false) THEN 'location_uncertain'
    WHEN coalesce(f.touches, false) OR coalesce(e.edge, false) OR coalesce(f.n, 0) > 1 THEN 'location_uncertain'
    WHEN coalesce(f.n, 0) = 0 THEN 'outside_area' WHEN r.authority_id IS NULL THEN 'jurisdiction_unavailable' ELSE 'municipal' END AS reason
  FROM acc a LEFT JOIN matches m ON a.event_id = m.event_id LEFT JOIN found f ON a.event_id = f.event_id LEFT JOIN edges e ON a.event_id = e.event_id LEFT JOIN regions r ON r.region_id = f.region_id)
SELECT event_id, reason, CASE reason WHEN 'national_highway' THEN 'in-national-highway' WHEN 'municipal' THEN authority_id END AS authority_id, reason IN ('national_highway', 'municipal') AS covered FROM reasons""")
def route_precedence(table: Tables) -> DataFrame:
    points = road_points(table)
    spark = points.sparkSession
    on_road = nearest.match_highway(points, roads(spark), "event_id")
    routed = containment.route(points, regions(spark), exclusion_boxes(spark), on_road, "event_id", (12.5, 13.5, 77.0, 78.0))
    return routed.select("event_id", "reason", "authority_id", "covered")


#: Layers of the state that the city of `fixes` lies in, as (id, name, type, lgd, west, south, east, north); no fix lies on an edge.
LAYERS = {
    "highways": [(k, f" NH-{k} " if k % 3 else "", None, None, 77.60055 + 0.002 * k, 12.90005, 77.60085 + 0.002 * k, 12.99005) for k in range(5)],
    "towns": [(k, f"Town {k}", " cmc" if k % 2 else None, f"80{k}" if k % 3 else None, 77.59005, 12.90005 + 0.012 * k, 77.61005, 12.91505 + 0.012 * k) for k in range(5)],
    "villages": [(k, f"Village {k}" if k % 3 else " ", None, None, 77.59005 + 0.005 * k, 12.90005, 77.59405 + 0.005 * k, 12.98005) for k in range(4)],
}
ANSWERED = {"towns": 17, "highways": 19, "villages": 23}


def _layer(spark: SparkSession, name: str) -> DataFrame:
    shape = lambda box: [[[{"x": x, "y": y} for x, y in _ring(*box)]]]
    return spark.createDataFrame([(*r[:4], shape(r[4:])) for r in LAYERS[name]], f"region_id int, name string, type string, lgd string, geometry array<array<{RING}>>")


@book.query(f"""WITH {FIXES_SQL},
{", ".join(f"{n}(id, name, type, lgd, w, s, e, n) AS (VALUES {_values(rows)})" for n, rows in LAYERS.items())},
{", ".join(f"in_{n} AS (SELECT event_id, arg_min((name, type, lgd), l.id) AS x FROM fixes f JOIN {n} l ON f.lng BETWEEN w AND e AND f.lat BETWEEN s AND n GROUP BY event_id)" for n in LAYERS)},
told AS (
  SELECT f.event_id, h.x AS h, t.x AS t, v.x AS v, CASE WHEN f.event_id % 17 = 0 OR f.event_id % 19 = 0 THEN 'road_class_unknown' WHEN h.event_id IS NOT NULL THEN 'national_highway'
    WHEN t.event_id IS NOT NULL THEN 'town' WHEN f.event_id % 23 = 0 THEN 'road_class_unknown' WHEN trim(v.x[1]) <> '' THEN 'rural' ELSE 'outside_state' END AS kind
  FROM fixes f LEFT JOIN in_highways h ON f.event_id = h.event_id LEFT JOIN in_towns t ON f.event_id = t.event_id LEFT JOIN in_villages v ON f.event_id = v.event_id)
SELECT event_id, kind, CASE kind WHEN 'national_highway' THEN nullif(trim(h[1]), '') WHEN 'town' THEN t[1] WHEN 'rural' THEN trim(v[1]) END AS name,
  CASE WHEN kind = 'town' THEN upper(trim(coalesce(t[2], ''))) END AS type, CASE WHEN kind = 'town' THEN coalesce(t[3], '') END AS lgd FROM told""")
def jurisdictions(table: Tables) -> DataFrame:
    points = fixes(table).select("event_id", "lat", "lng", *[(F.col("event_id") % n != 0).alias(f"{layer}_answered") for layer, n in ANSWERED.items()])
    layers = {name: _layer(points.sparkSession, name) for name in LAYERS}
    return containment.jurisdiction(points, "event_id", layers["highways"], layers["towns"], layers["villages"])


@book.query("""
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'K/E Ward, Andheri' WHEN 1 THEN 'Ward G-N' WHEN 2 THEN 'Dadar, F South Ward' WHEN 3 THEN 'ward z' WHEN 4 THEN 'R  Central   ward' END AS name FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'K/E' WHEN 1 THEN 'G/N' WHEN 2 THEN 'F/S' WHEN 4 THEN 'R/C' END AS ward FROM t""")
def ward_codes(table: Tables) -> DataFrame:
    names = F.expr("CASE event_id % 6 WHEN 0 THEN 'K/E Ward, Andheri' WHEN 1 THEN 'Ward G-N' WHEN 2 THEN 'Dadar, F South Ward' WHEN 3 THEN 'ward z' WHEN 4 THEN 'R  Central   ward' END")
    return table("events").select("event_id", text.ward_code(names).alias("ward"))


@book.query("""
WITH p AS (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'lane' END, nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE 'ward' || (user_id % 3) END, ''),
  CASE WHEN user_id % 2 = 0 THEN event_type END], lambda x: x IS NOT NULL) AS parts FROM events)
SELECT event_id, nullif(array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ', '), '') AS address FROM p""")
def addresses(table: Tables) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    slots = [[F.when(i % 2 == 0, kind), F.when(i % 3 == 0, "lane")], [F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("ward"), F.col("user_id") % 3))], [F.when(F.col("user_id") % 2 == 0, kind)]]
    return table("events").select("event_id", text.address(slots).alias("address"))


@book.query("""
WITH r AS (SELECT p_partkey, p_partkey % 10000 AS n, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'NH-' || n WHEN 1 THEN 'NH-4A / NE-' || n WHEN 2 THEN 'NH-' || n ELSE '' END AS refs FROM r""")
def highway_refs(table: Tables) -> DataFrame:
    ref = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'nh ' || lpad(p_partkey % 10000, 4, '0') WHEN 1 THEN 'NE' || p_partkey % 10000 || '; NH-04A;NH4a' WHEN 2 THEN ' ' || p_partkey % 10000 ELSE 'SH ' || p_partkey END")
    refs = F.array_join(text.highway_refs(ref, F.expr("CASE WHEN p_partkey % 4 = 2 THEN 'in:nh' END")), " / ")
    return table("part").select("p_partkey", refs.alias("refs"))  # a ref has four digits at most


def _lines(table: Tables) -> DataFrame:
    """Vectors as zigzag lines of the allowed box."""
    place = F.transform("embedding", lambda v, i: F.array(70 + i.cast("double") / 1000, 20 + v.cast("double") / 1000))
    return table("embeddings").select(
        F.col("vec_id").alias("line_id"), F.when(F.col("vec_id") % 9 == 0, "residential").otherwise("trunk").alias("highway"), F.concat(F.lit("NH"), F.col("label") + 1).alias("ref"),
        F.lit(None).cast("string").alias("network"), F.lit("LineString").alias("geometry_type"), place.alias("coordinates"),
    )


@book.query("""
WITH s AS (SELECT vec_id, label, unnest(range(1, len(embedding))) AS i, embedding FROM embeddings WHERE vec_id % 9 <> 0),
m AS (SELECT vec_id, label, i, sqrt(pow((CAST(i AS DOUBLE) / 1000 - CAST(i - 1 AS DOUBLE) / 1000) * 111320.0 * cos(radians(20 + (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 1] AS DOUBLE)) / 2000)), 2)
   + pow((CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) / 1000 * 110540.0, 2)) AS step FROM s)
SELECT 'NH-' || (label + 1) AS ref, count(DISTINCT vec_id) AS lines, round(sum(step) / 1000, 3) AS km FROM m GROUP BY label""")
def highway_stats(table: Tables) -> DataFrame:
    return highways.highway_stats(highways.accepted_lines(_lines(table))).withColumn("km", F.round("km", 3))


@book.query()
def highway_tiles(table: Tables) -> DataFrame:
    return highways.tile_manifest(highways.tiled_features(highways.simplified_parts(highways.accepted_lines(_lines(table)))))


@book.query("""
WITH b AS (SELECT c_custkey AS region_id, 70 + CAST(c_custkey % 100 AS DOUBLE) / 20 AS west, 10 + CAST(c_nationkey AS DOUBLE) / 2 AS south,
  0.01 + CAST(c_custkey % 7 AS DOUBLE) / 300 AS wide, 0.02 + CAST(c_nationkey AS DOUBLE) / 1000 AS high FROM customer)
SELECT region_id, round(wide * high / 2 * pow(radians(1) * 6371.0088::DOUBLE, 2) * cos(radians((4 * south + high) / 4)), 6) AS km2 FROM b""")
def region_areas(table: Tables) -> DataFrame:
    """A triangle for each customer."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    west, south, wide, high = 70 + i % 100 / 20, 10 + n / 2, 0.01 + i % 7 / 300, 0.02 + n / 1000
    ring = F.array(geo.named(x=west, y=south), geo.named(x=west + wide, y=south), geo.named(x=west, y=south + high), geo.named(x=west, y=south))
    return table("customer").select(i.alias("region_id"), F.round(geo.ring_area_km2(ring), 6).alias("km2"))


@book.query(f"""
WITH {FIXES_SQL}, p AS (SELECT event_id, CAST(round_even(lng * 100000, 0) AS BIGINT) AS x, CAST(round_even(lat * 100000, 0) AS BIGINT) AS y FROM fixes)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN x || ',' || y || ',250,-30' ELSE x || ',' || y || ',0,7,250,-37' END AS deltas FROM p""")
def encoded_lines(table: Tables) -> DataFrame:
    step = lambda dx, dy: geo.named(x=(F.bround(F.col("lng") * 100_000) + dx) / 100_000, y=(F.bround(F.col("lat") * 100_000) + dy) / 100_000)
    here, there = step(0, 0), step(250, -30)
    line = F.when(F.col("event_id") % 3 == 0, F.array(here, here)).when(F.col("event_id") % 3 == 1, F.array(here, here, there, there)).otherwise(F.array(here, step(0, 7), there))
    return fixes(table).select("event_id", F.array_join(geo.encode_line(line).cast("array<string>"), ",").alias("deltas"))


@book.query("""
WITH p AS (SELECT vec_id, unnest(range(16)) AS i, embedding FROM embeddings),
q AS (SELECT vec_id, i, (2 + CAST(embedding[i + 1] AS DOUBLE)) * cos(pi() * i / 8) AS x, (2 + CAST(embedding[i + 1] AS DOUBLE)) * sin(pi() * i / 8) AS y FROM p),
m AS (SELECT vec_id, i, CASE WHEN vec_id % 2 = 1 AND i = vec_id % 16 THEN -x ELSE x END AS x, y FROM q),
s AS (SELECT a.vec_id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM m a JOIN m b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 16),
t AS (SELECT s.vec_id, (s.bx - s.ax) * (t.ay - s.ay) - (s.by - s.ay) * (t.ax - s.ax) AS a, (s.bx - s.ax) * (t.by - s.ay) - (s.by - s.ay) * (t.bx - s.ax) AS b,
       (t.bx - t.ax) * (s.ay - t.ay) - (t.by - t.ay) * (s.ax - t.ax) AS c, (t.bx - t.ax) * (s.by - t.ay) - (t.by - t.ay) * (s.bx - t.ax) AS d
  FROM s JOIN s t ON s.vec_id = t.vec_id AND t.i > s.i + 1 AND NOT (s.i = 0 AND t.i = 15))
SELECT v.vec_id, coalesce(n, 0) AS crossings FROM embeddings v LEFT JOIN (SELECT vec_id, count(*) AS n FROM t WHERE sign(a) * sign(b) < 0 AND sign(c) * sign(d) < 0 GROUP BY vec_id) n ON v.vec_id = n.vec_id""")
def self_crossing_rings(table: Tables) -> DataFrame:
    """A vector's first components as the radii of a ring; of every second vector a corner is moved, so that sides may cross."""
    radius = lambda i: 2 + F.get("embedding", i).cast("double")
    flip = lambda i: F.when((F.col("vec_id") % 2 == 1) & (F.col("vec_id") % 16 == i), -1.0).otherwise(1.0)
    point = lambda i: geo.named(x=flip(i) * radius(i) * F.cos(F.pi() * i / 8), y=radius(i) * F.sin(F.pi() * i / 8))
    made = table("embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), point).alias("ring"))
    return rings.self_crossing(made, "vec_id", "ring")


@book.query("""
WITH s AS (SELECT vec_id, unnest(range(1, len(embedding))) AS i, embedding FROM embeddings WHERE vec_id % 9 <> 0),
m AS (SELECT vec_id, sum(sqrt(pow(0.001 * 111320.0 * cos(radians(20 + (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 1] AS DOUBLE)) / 2000)), 2)
   + pow((CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) / 1000 * 110540.0, 2))) AS metres, any_value(len(embedding)) AS points FROM s GROUP BY vec_id)
SELECT vec_id AS line_id, round(metres, 3) AS metres, points, 0 AS gaps, 0 AS too_long, true AS is_greedy FROM m""")
def line_parts(table: Tables) -> DataFrame:
    """Lines cut at 900 m and 7 points: parts add up to the line, share their ends, keep to the limits, and none could be one step longer."""
    lines = highways.accepted_lines(_lines(table))
    parts = highways.simplified_parts(lines, None, 900, 7).withColumn("metres", geo.line_metres(F.col("points")))
    order = Window.partitionBy("line_id").orderBy("part")
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    longer = geo.line_metres(F.concat("points", F.slice(F.lead("points").over(order), 2, 1)))
    marked = parts.select("line_id", "metres", F.size("points").alias("n"), (F.lag(last).over(order) != first).alias("gap"), ((F.size("points") == 7) | (longer > 900) | longer.isNull()).alias("full"))
    limits = F.count_if(((F.col("metres") > 900 + 1e-6) & (F.col("n") > 2)) | (F.col("n") > 7))
    return marked.groupBy("line_id").agg(
        F.round(F.sum("metres"), 3).alias("metres"), (F.sum(F.col("n") - 1) + 1).alias("points"), F.count_if("gap").cast("int").alias("gaps"), limits.cast("int").alias("too_long"), F.bool_and("full").alias("is_greedy")
    )
