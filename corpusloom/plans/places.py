"""Queries on districts of any shape and nearest places; points are derived from `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import geo
from corpusloom.operators import nearby, screening
from corpusloom.plans.common import BOXES_SQL, POINTS_SQL, boxes, points, t
from corpusloom.plans.numbers import HAVERSINE, MX, MY
from corpusloom.plans.registry import query

#: Name, and rings of corners; the second has a hole, the third two parts, the fourth is a triangle that overlaps the first.
SHAPES = [
    ("west", [[(0.0, 51.0), (0.45, 51.0), (0.45, 52.0), (0.0, 52.0)]]),
    ("east", [[(0.5, 51.0), (0.9, 51.0), (0.9, 51.9), (0.5, 51.9)], [(0.6, 51.2), (0.7, 51.2), (0.7, 51.4), (0.6, 51.4)]]),
    ("isles", [[(0.61, 51.25), (0.65, 51.25), (0.65, 51.3), (0.61, 51.3)], [(2.0, 53.0), (2.5, 53.0), (2.5, 53.5)]]),
    ("tip", [[(0.2, 51.1), (0.55, 51.5), (0.2, 51.9)]]),
]
#: The same by conditions on a point, as DuckDB has no spatial types here: strictly inside, on an edge, and the centroid's parts.
INSIDE = {
    "west": "lng > 0 AND lng < 0.45 AND lat > 51 AND lat < 52",
    "east": "lng > 0.5 AND lng < 0.9 AND lat > 51 AND lat < 51.9 AND NOT (lng BETWEEN 0.6 AND 0.7 AND lat BETWEEN 51.2 AND 51.4)",
    "isles": "(lng > 0.61 AND lng < 0.65 AND lat > 51.25 AND lat < 51.3) OR (lng < 2.5 AND lat > 53 AND lat - 53 < lng - 2)",
    "tip": "lng > 0.2 AND (lat - 51.1) * 0.35 > (lng - 0.2) * 0.4 AND (51.9 - lat) * 0.35 > (lng - 0.2) * 0.4",
}
TOUCHED = {
    "west": "lng BETWEEN 0 AND 0.45 AND lat BETWEEN 51 AND 52",
    "east": "lng BETWEEN 0.5 AND 0.9 AND lat BETWEEN 51 AND 51.9 AND NOT (lng > 0.6 AND lng < 0.7 AND lat > 51.2 AND lat < 51.4)",
    "isles": "(lng BETWEEN 0.61 AND 0.65 AND lat BETWEEN 51.25 AND 51.3) OR (lng <= 2.5 AND lat >= 53 AND lat - 53 <= lng - 2)",
    "tip": "lng >= 0.2 AND (lat - 51.1) * 0.35 >= (lng - 0.2) * 0.4 AND (51.9 - lat) * 0.35 >= (lng - 0.2) * 0.4",
}
#: Points with a half step, so that none lies on a slanting edge by rounding alone.
GRID_SQL = "(SELECT page_id, CASE WHEN page_id % 41 = 0 THEN NULL ELSE 51 + (page_id % 97) / 100.0::DOUBLE + 0.001953125 END AS lat, (page_id % 89) / 100.0::DOUBLE + 0.0009765625 AS lng FROM pages)"
RINGS_SQL = "(VALUES " + ", ".join(f"({o}, '{n}', {r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for o, (n, rings) in enumerate(SHAPES) for r, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]])) + ") v(ord, name, ring, i, x, y)"
CENTRES_SQL = f"(SELECT ord, name, sum((mx + nx) * c) / (3 * sum(c)) AS cx, sum((my + ny) * c) / (3 * sum(c)) AS cy FROM (SELECT *, mx * ny - nx * my AS c FROM (SELECT ord, name, mx, my, lead(mx) OVER w AS nx, lead(my) OVER w AS ny FROM (SELECT ord, name, ring, i, {MX.format('x')} AS mx, {MY.format('y')} AS my FROM {RINGS_SQL}) WINDOW w AS (PARTITION BY ord, ring ORDER BY i)) WHERE nx IS NOT NULL) GROUP BY ord, name)"


def grid(spark, d):
    p = t(spark, d, "pages")
    lat = F.when(F.col("page_id") % 41 != 0, 51 + (F.col("page_id") % 97) / F.lit(100.0) + 0.001953125)
    return p.select("page_id", lat.alias("lat"), ((F.col("page_id") % 89) / F.lit(100.0) + 0.0009765625).alias("lng"))


def districts(spark):
    rows = [(o, n, [[{"x": x, "y": y} for x, y in [*ring, ring[0]]] for ring in rings]) for o, (n, rings) in enumerate(SHAPES)]
    return spark.createDataFrame(rows, "ord int, name string, rings array<array<struct<x:double,y:double>>>")


LOCATED = f"""(WITH p AS (SELECT * FROM {GRID_SQL}), c AS (SELECT * FROM {CENTRES_SQL}), x AS (SELECT page_id, c.name, c.ord, pow({MX.format('lng')} - cx, 2) + pow({MY.format('lat')} - cy, 2) AS away, CASE c.name {' '.join(f"WHEN '{n}' THEN {r}" for n, r in INSIDE.items())} END AS inside FROM p, c WHERE lat IS NOT NULL AND lat <> 0 AND lng <> 0)
SELECT page_id, name AS district, CASE WHEN inside THEN 'exact' ELSE 'nearest' END AS match_type FROM x QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY inside DESC, away, ord) = 1 UNION ALL SELECT page_id, 'Not Specified', 'no_coords' FROM p WHERE lat IS NULL OR lat = 0 OR lng = 0)"""


@query("j02_point_in_polygon", f"SELECT * FROM {LOCATED}")
def j02(spark, d):
    return nearby.locate(grid(spark, d), districts(spark), "page_id")


FIRST = f"""(SELECT page_id, name FROM (SELECT page_id, name, ord, CASE name {' '.join(f"WHEN '{n}' THEN {r}" for n, r in TOUCHED.items())} END AS hit FROM {GRID_SQL}, (SELECT DISTINCT ord, name FROM {RINGS_SQL}) WHERE lat IS NOT NULL) WHERE hit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) = 1)"""


@query("j03_first_ring", f"SELECT * FROM {FIRST}")
def j03(spark, d):
    return nearby.first_containing(grid(spark, d).filter("lat IS NOT NULL"), districts(spark), "page_id").select("page_id", "name")


@query("a28_membership", f"WITH h AS (SELECT * FROM {FIRST}) SELECT (SELECT count(*) FROM {GRID_SQL} WHERE lat IS NOT NULL) AS n_points, {len(SHAPES)}::BIGINT AS n_districts, (SELECT count(DISTINCT name) FROM h) AS n_hit, (SELECT count(*) FROM {GRID_SQL} WHERE lat IS NOT NULL) - (SELECT count(*) FROM h) AS n_outside, (SELECT count(DISTINCT name) FROM h) = 3 AS matches_report")
def a28(spark, d):
    n = grid(spark, d).filter("lat IS NOT NULL").agg(F.count("*").alias("n_points"))
    hits = j03(spark, d).agg(F.countDistinct("name").alias("n_hit"), F.count("*").alias("in_any"))
    one = n.crossJoin(F.broadcast(hits))  # a row each
    return one.select("n_points", F.lit(len(SHAPES)).cast("long").alias("n_districts"), "n_hit", (F.col("n_points") - F.col("in_any")).alias("n_outside"), (F.col("n_hit") == 3).alias("matches_report"))


CITY_POINTS = "(SELECT page_id, page_id % 4 AS city, 51 + (page_id % 97) / 100.0::DOUBLE + (page_id % 4) * 0.5 + (page_id % 23 = 0)::INT * 0.9 AS lat, (page_id % 89) / 100.0::DOUBLE AS lng FROM pages)"
CITY_BOXES = "(VALUES (0, 0.0, 51.0, 0.9, 51.9), (1, 0.0, 51.5, 0.9, 52.4), (2, 0.1, 52.0, 0.8, 52.9), (3, 0.0, 52.5, 0.9, 53.4)) b(city, min_lng, min_lat, max_lng, max_lat)"


@query("j19_other_city", f"WITH p AS (SELECT * FROM {CITY_POINTS}), o AS (SELECT p.* FROM p JOIN {CITY_BOXES} ON b.city = p.city WHERE NOT (lng BETWEEN min_lng AND max_lng AND lat BETWEEN min_lat AND max_lat)) SELECT o.page_id, o.city, min(b.city)::BIGINT AS inside_of FROM o LEFT JOIN {CITY_BOXES} ON b.city <> o.city AND lng BETWEEN min_lng AND max_lng AND lat BETWEEN min_lat AND max_lat GROUP BY ALL")
def j19(spark, d):
    """Points outside their own city's box, and the first other city whose box holds them."""
    n = F.col("page_id")
    p = t(spark, d, "pages").select("page_id", (n % 4).alias("city"), (51 + (n % 97) / F.lit(100.0) + (n % 4) * F.lit(0.5) + F.when(n % 23 == 0, 0.9).otherwise(0.0)).alias("lat"), ((n % 89) / F.lit(100.0)).alias("lng"))
    b = spark.createDataFrame([(0, 0.0, 51.0, 0.9, 51.9), (1, 0.0, 51.5, 0.9, 52.4), (2, 0.1, 52.0, 0.8, 52.9), (3, 0.0, 52.5, 0.9, 53.4)], "c long, min_lng double, min_lat double, max_lng double, max_lat double")
    return screening.outside_own_box(p, b, "page_id", "city")


@query("j17_nearest_other", f"WITH p AS (SELECT DISTINCT lat, lng FROM {POINTS_SQL} WHERE lat IS NOT NULL) SELECT a.lat, a.lng, round(min({HAVERSINE.format('a', 'b')}), 4) AS metres FROM p a JOIN p b ON (a.lat, a.lng) <> (b.lat, b.lng) GROUP BY ALL")
def j17(spark, d):
    p = points(spark, d).filter("lat IS NOT NULL").select("lat", "lng").distinct()
    key = F.struct("lat", "lng")
    near = nearby.nearest_on_globe(p.select(key.alias("id"), "lat", "lng"), p.select(key.alias("place"), "lat", "lng"))
    return near.select("id.lat", "id.lng", F.round("metres", 4).alias("metres"))


@query("a27_nn_distance", f"WITH p AS (SELECT DISTINCT lat, lng FROM {POINTS_SQL} WHERE lat IS NOT NULL), n AS (SELECT a.lat, a.lng, round(min({HAVERSINE.format('a', 'b')}), 4) AS m FROM p a JOIN p b ON (a.lat, a.lng) <> (b.lat, b.lng) GROUP BY ALL) SELECT round(median(m), 4) AS mid, round(quantile_cont(m, 0.25), 4) AS low, round(quantile_cont(m, 0.75), 4) AS high FROM n")
def a27(spark, d):
    return j17(spark, d).agg(F.round(F.percentile("metres", 0.5), 4).alias("mid"), F.round(F.percentile("metres", 0.25), 4).alias("low"), F.round(F.percentile("metres", 0.75), 4).alias("high"))


@query("x33_centroid_distance", f"SELECT page_id, name, round(sqrt(pow({MX.format('lng')} - cx, 2) + pow({MY.format('lat')} - cy, 2)), 3) AS metres FROM {GRID_SQL}, {CENTRES_SQL} WHERE lat IS NOT NULL")
def x33(spark, d):
    """How far each page's point lies from each district's centroid, in web mercator."""
    return nearby.centroid_distances(grid(spark, d).filter("lat IS NOT NULL"), districts(spark), "page_id").withColumn("metres", F.round("metres", 3))


REASONED = "(SELECT page_id, (page_id * 7 % 200 - 100)::DOUBLE / CASE WHEN page_id % 5 = 0 THEN 200 ELSE 1 END AS lat, (page_id * 13 % 400 - 200)::DOUBLE / CASE WHEN page_id % 5 = 0 THEN 400 ELSE 1 END AS lng FROM pages)"


@query("x35_coarse_reasoning", f"""SELECT page_id, CASE WHEN abs(lat) > 90 OR abs(lng) > 180 THEN 'coordinate value(s) out of valid range for lat/lon' WHEN abs(lat) < 1 AND abs(lng) < 1 THEN '~(0,0): Gulf of Guinea, off the coast of West Africa -- classic null-island artifact' ELSE printf('%.2f deg %s, %.2f deg %s -- %s latitude band, %s', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lng), CASE WHEN lng >= 0 THEN 'E' ELSE 'W' END,
CASE WHEN abs(lat) > 66.5 THEN 'polar' WHEN abs(lat) > 50 THEN 'high-latitude' WHEN abs(lat) > 35 THEN 'temperate' WHEN abs(lat) > 23.5 THEN 'sub-tropical' ELSE 'tropical' END, CASE WHEN lng BETWEEN -25 AND 60 THEN 'Europe/North Africa/Middle East longitudes' WHEN lng < -25 THEN 'Americas longitudes' ELSE 'Asia-Pacific longitudes' END) END AS reasoning FROM {REASONED}""")
def x35(spark, d):
    n = F.col("page_id")
    by = lambda k: F.when(n % 5 == 0, k).otherwise(1)
    p = t(spark, d, "pages").select("page_id", ((n * 7 % 200 - 100).cast("double") / by(200)).alias("lat"), ((n * 13 % 400 - 200).cast("double") / by(400)).alias("lng"))
    return p.select("page_id", geo.coarse_reasoning(F.col("lat"), F.col("lng")).alias("reasoning"))


@query("a25_ground_resolution", "WITH r AS (SELECT page_id % 3 AS city, unnest([CASE WHEN page_id % 3 = 0 THEN '51.5' ELSE '51.' || (page_id % 900 + 100) END, '0.' || (page_id % 90 + 10)]) AS raw, 50.0 + page_id % 3 AS lat FROM pages), n AS (SELECT city, length(regexp_extract(raw, '[.](.*)$', 1)) AS dp, count(*) AS n, avg(lat) AS lat FROM r GROUP BY ALL), s AS (SELECT city, arg_max(dp, n * 100 - dp) AS dp, max(n) AS top, sum(n) AS total, any_value(lat) AS lat FROM n GROUP BY city) SELECT city, dp::BIGINT AS dp, round(100.0::DOUBLE * top / total, 1) AS pct, round(pow(10, -dp) * 111320.0, 1) AS lat_metres, round(pow(10, -dp) * 111320.0 * cos(radians(lat)), 1) AS lng_metres FROM s")
def a25(spark, d):
    """The most frequent number of decimal places of a city's coordinates (the smaller of equals) and what it means on the ground."""
    n = F.col("page_id")
    raw = F.explode(F.array(F.when(n % 3 == 0, "51.5").otherwise(F.concat(F.lit("51."), n % 900 + 100)), F.concat(F.lit("0."), n % 90 + 10)))
    p = t(spark, d, "pages").select((n % 3).alias("city"), (50.0 + n % 3).alias("lat"), raw.alias("raw"))
    return geo.ground_resolution(p, "city", "raw", "lat")
