"""Nearest places and districts of any shape, by cells of a grid, so that no place is held against all others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import geo
from corpusloom.operators.claims import in_ring
from corpusloom.operators.ordered import discard, written

METRES_A_DEGREE = 111_194.926
#: Districts up to this many ring points are sent to all tasks; more are met by cells.
MOST_SENT = 500_000
#: Centroids up to this number are compared with a point in one pass; more are met by cells.
MOST_CENTRES = 1_000


def _cells(x: Column, y: Column, size: float, around: bool, wrap: float | None) -> Column:
    """The cells of a point, or the nine about it; wrap: the width after which x begins anew."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    columns = max(1, int(wrap // size)) if wrap else None
    at = lambda dx: F.pmod(cx + dx, F.lit(columns)) if columns else cx + dx
    steps = (-1, 0, 1) if around else (0,)
    return F.array_distinct(F.array(*[F.struct(at(dx).alias("cx"), (cy + dy).alias("cy")) for dx in steps for dy in steps]))


def _nearest(asked: DataFrame, places: DataFrame, cell: float, distance: Callable, surely: Callable, wrap: float | None, widest: float) -> DataFrame:
    """id, place and distance of the nearest of places (place, x, y) to each of asked (id, x, y), but for itself; ties to the least place.

    A round meets each point with the places in the nine cells about it. What it finds within
    surely(point, cell size), the reach that the nine cells cover for certain, is settled; the
    rest go on with cells twice as wide.
    """
    left, out, size = asked, None, cell
    while True:
        here = places.select("place", F.col("x").alias("_px"), F.col("y").alias("_py"), F.explode(_cells(F.col("x"), F.col("y"), size, False, wrap)).alias("c"))
        about = left.withColumn("c", F.explode(_cells(F.col("x"), F.col("y"), size, True, wrap)))
        pairs = about.join(here, "c").filter(~F.col("id").eqNullSafe(F.col("place")))
        d = distance(F.col("x"), F.col("y"), F.col("_px"), F.col("_py"))
        best = pairs.groupBy("id", "x", "y").agg(F.min(F.struct(d.alias("distance"), "place")).alias("b"))
        settled = size >= widest
        done = written(best.filter(F.lit(settled) | (F.col("b.distance") <= surely(F.col("x"), F.col("y"), size))).select("id", "b.place", "b.distance"), "nearest")
        out = done if out is None else out.union(done)
        if settled:
            return out
        last, left = left, written(left.join(done.select("id"), "id", "left_anti"), "unsettled")
        if last is not asked:
            discard(last)
        if left.isEmpty():
            return out
        size *= 2


def nearest_on_globe(asked: DataFrame, places: DataFrame, cell: float = 0.01) -> DataFrame:
    """id, place and metres of the nearest place (place, lat, lng) to each point (id, lat, lng); cell: the first cells, in degrees."""
    xy = lambda df, key: df.select(key, F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    reach = lambda x, y, size: size * METRES_A_DEGREE * F.cos(F.radians(F.least(F.abs(y) + size, F.lit(90.0))))
    metres = lambda x, y, px, py: geo.haversine_m(y, x, py, px)
    found = _nearest(xy(asked, "id"), xy(places, "place"), cell, metres, reach, 360.0, 360.0)
    return found.withColumnRenamed("distance", "metres")


def nearest_in_plane(asked: DataFrame, places: DataFrame, cell: float, widest: float) -> DataFrame:
    """id, place and distance (squared) in the plane of points (id, x, y) and places (place, x, y); widest: all lies within so much."""
    squared = lambda x, y, px, py: F.pow(x - px, F.lit(2)) + F.pow(y - py, F.lit(2))
    return _nearest(asked.select("id", "x", "y"), places.select("place", "x", "y"), cell, squared, lambda x, y, size: F.lit(size * size), None, widest)


def _shaped(districts: DataFrame) -> DataFrame:
    """districts (ord, name, rings: array of rings of (x, y), closed) with bounds and the centroid of all in web mercator."""
    flat = F.flatten("rings")
    bound = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    mx, my = (lambda p: geo.mercator_x(p["x"])), (lambda p: geo.mercator_y(p["y"]))

    def sums(ring: Column) -> Column:
        """struct(a, sx, sy): twice the signed area of a ring, and its moments."""
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        edges = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: F.struct((mx(p) * my(q) - mx(q) * my(p)).alias("c"), (mx(p) + mx(q)).alias("x"), (my(p) + my(q)).alias("y")))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
        return F.aggregate(edges, zero, lambda s, e: F.struct((s["a"] + e["c"]).alias("a"), (s["sx"] + e["x"] * e["c"]).alias("sx"), (s["sy"] + e["y"] * e["c"]).alias("sy")))

    total = F.aggregate(F.transform("rings", sums), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy")), lambda s, r: F.struct((s["a"] + r["a"]).alias("a"), (s["sx"] + r["sx"]).alias("sx"), (s["sy"] + r["sy"]).alias("sy")))
    out = districts.withColumns({"min_x": bound(F.array_min, "x"), "max_x": bound(F.array_max, "x"), "min_y": bound(F.array_min, "y"), "max_y": bound(F.array_max, "y"), "_t": total})
    return out.withColumns({"cx": F.col("_t.sx") / (3 * F.col("_t.a")), "cy": F.col("_t.sy") / (3 * F.col("_t.a"))}).drop("_t")


def _on_edge(x: Column, y: Column, ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = lambda v, p, q: (v >= F.least(p, q)) & (v <= F.greatest(p, q))
    on = lambda e: ((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) == (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])) & between(x, e["a"]["x"], e["b"]["x"]) & between(y, e["a"]["y"], e["b"]["y"])
    return F.exists(edges, on)


def inside(x: Column, y: Column, rings: Column, edge: bool) -> Column:
    """Whether a point lies in an odd number of the rings (so holes and several parts count); points on an edge count if edge, else not."""
    odd = F.size(F.filter(rings, lambda r: in_ring(x, y, r))) % 2 == 1
    on = F.exists(rings, lambda r: _on_edge(x, y, r))
    return odd | on if edge else odd & ~on


def containing(points: DataFrame, districts: DataFrame, key: str, edge: bool, cell: float = 0.05) -> DataFrame:
    """key and ord, name, cx, cy of every district that contains a point (key, lat, lng).

    Few districts are sent to all tasks; many meet the points by the cells that their bounds touch.
    """
    shaped = _shaped(districts)
    x, y = F.col("lng"), F.col("lat")
    near = x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))
    if (shaped.agg(F.sum(F.size(F.flatten("rings")))).first()[0] or 0) <= MOST_SENT:
        met = points.join(F.broadcast(shaped), near)
    else:
        at = lambda c: F.floor(c / cell)
        spread = shaped.withColumn("_x", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x"))))).withColumn("_y", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))))
        met = points.withColumns({"_x": at(x), "_y": at(y)}).join(spread, ["_x", "_y"]).filter(near)
    return met.filter(inside(x, y, F.col("rings"), edge)).select(key, "lat", "lng", "ord", "name", "cx", "cy")


def centroid_distances(points: DataFrame, districts: DataFrame, key: str) -> DataFrame:
    """key, name and metres (in web mercator) from each point (key, lat, lng) to each district's centroid; districts are checked to be few."""
    if districts.count() > MOST_CENTRES:
        raise ValueError(f"over {MOST_CENTRES} districts")
    held = F.broadcast(_shaped(districts).agg(F.collect_list(F.struct("name", "cx", "cy")).alias("_centres")))  # a row
    each = points.crossJoin(held).select(key, "lat", "lng", F.explode("_centres").alias("c"))
    away = F.sqrt(F.pow(geo.mercator_x(F.col("lng")) - F.col("c.cx"), F.lit(2)) + F.pow(geo.mercator_y(F.col("lat")) - F.col("c.cy"), F.lit(2)))
    return each.select(key, F.col("c.name").alias("name"), away.alias("metres"))


def first_containing(points: DataFrame, districts: DataFrame, key: str) -> DataFrame:
    """key and name of the first district (by ord) that contains a point or has it on its edge; points in none are left out."""
    return containing(points, districts, key, True).groupBy(key).agg(F.min_by("name", "ord").alias("name"))


def locate(points: DataFrame, districts: DataFrame, key: str, cell: float = 20_000.0) -> DataFrame:
    """key, district and match_type of every point: the containing district of the nearest centroid (`exact`), else the one of
    the nearest centroid of all (`nearest`); without coordinates `Not Specified` and `no_coords`. Ties go to the least ord;
    key must tell points apart."""
    lost = geo.missing(F.col("lat"), F.col("lng"))
    known = points.filter(~lost).select(key, "lat", "lng")
    away = F.pow(geo.mercator_x(F.col("lng")) - F.col("cx"), F.lit(2)) + F.pow(geo.mercator_y(F.col("lat")) - F.col("cy"), F.lit(2))
    exact = containing(known, districts, key, False).groupBy(key).agg(F.min(F.struct(away.alias("away"), "ord", "name")).alias("b"))
    none = points.filter(lost).select(key, F.lit("Not Specified").alias("district"), F.lit("no_coords").alias("match_type"))
    if districts.count() <= MOST_CENTRES:
        centre = F.struct(F.col("ord"), F.col("name"), F.col("cx"), F.col("cy"))
        held = F.broadcast(_shaped(districts).agg(F.sort_array(F.collect_list(centre)).alias("_centres")))  # a row
        to = F.transform("_centres", lambda c: F.struct((F.pow(geo.mercator_x(F.col("lng")) - c["cx"], F.lit(2)) + F.pow(geo.mercator_y(F.col("lat")) - c["cy"], F.lit(2))).alias("away"), c["ord"].alias("ord"), c["name"].alias("name")))
        found = known.crossJoin(held).withColumn("_near", F.array_min(to)["name"]).join(exact.select(key, F.col("b.name").alias("_in")), key, "left")
        return found.select(key, F.coalesce("_in", "_near").alias("district"), F.when(F.col("_in").isNotNull(), "exact").otherwise("nearest").alias("match_type")).unionByName(none)
    exact = written(exact.select(key, F.col("b.name").alias("district"), F.lit("exact").alias("match_type")), "exact")
    rest = known.join(exact, key, "left_anti").select(F.col(key).alias("id"), geo.mercator_x(F.col("lng")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    centres = _shaped(districts).select(F.struct("ord", "name").alias("place"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    # A point is no place, so ids and places are told apart by their types.
    tagged = rest.select(F.struct(F.lit(None).cast("long").alias("ord"), F.col("id").cast("string").alias("name")).alias("id"), F.col("id").alias("_key"), "x", "y")
    centres = centres.select(F.struct(F.col("place.ord").cast("long").alias("ord"), F.col("place.name").alias("name")).alias("place"), "x", "y")
    near = nearest_in_plane(tagged, centres, cell, 2.0 * 40_075_017.0)
    near = near.join(tagged.select("id", "_key"), "id").select(F.col("_key").alias(key), F.col("place.name").alias("district"), F.lit("nearest").alias("match_type"))
    return exact.unionByName(near).unionByName(none)
