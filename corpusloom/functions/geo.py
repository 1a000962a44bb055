"""Distances and areas on the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls

EARTH_M, MERCATOR_M, METRES_A_DEGREE_LAT = 6_371_008.8, 6_378_137.0, 111_320.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def mercator_x(lng: Column) -> Column:
    return MERCATOR_M * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_M * F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483))


def in_box(lat: Column, lng: Column, box) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lng.between(box["min_lng"], box["max_lng"])


def missing(lat: Column, lng: Column) -> Column:
    """Coordinates count as missing if either is null or zero."""
    return F.coalesce((lat == 0) | (lng == 0), F.lit(True))


def latitude_band(lat: Column) -> Column:
    return F.when(F.abs(lat) < 23.5, "tropical").when(F.abs(lat) < 66.5, "temperate").otherwise("polar")


def coarse_reasoning(lat: Column, lng: Column) -> Column:
    """A sentence on where a coordinate lies, from its size alone: hemisphere, latitude band, region of longitudes."""
    far = (F.abs(lat) > 90) | (F.abs(lng) > 180)
    band = F.when(F.abs(lat) > 66.5, "polar").when(F.abs(lat) > 50, "high-latitude").when(F.abs(lat) > 35, "temperate").when(F.abs(lat) > 23.5, "sub-tropical").otherwise("tropical")
    region = F.when(lng.between(-25, 60), "Europe/North Africa/Middle East longitudes").when(lng < -25, "Americas longitudes").otherwise("Asia-Pacific longitudes")
    placed = F.format_string("%.2f deg %s, %.2f deg %s -- %s latitude band, %s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lng), F.when(lng >= 0, "E").otherwise("W"), band, region)
    null_island = (F.abs(lat) < 1) & (F.abs(lng) < 1)
    return F.when(far, "coordinate value(s) out of valid range for lat/lon").when(null_island, "~(0,0): Gulf of Guinea, off the coast of West Africa -- classic null-island artifact").otherwise(placed)


def ground_resolution(df: DataFrame, by: str, raw: str, lat: str) -> DataFrame:
    """by, dp (the most frequent number of decimal places, the smaller of equals), pct of all, and the metres of its last place each way."""
    n = df.groupBy(by, urls.decimal_places(F.col(raw)).alias("dp")).agg(F.count("*").alias("n"), F.sum(lat).alias("lats"))
    top = n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "dp")).alias("t"), F.sum("n").alias("total"), F.sum("lats").alias("lats"))
    step = F.pow(F.lit(10.0), -F.col("t.dp")) * METRES_A_DEGREE_LAT
    return top.select(by, F.col("t.dp").alias("dp"), F.round(-100.0 * F.col("t.n") / F.col("total"), 1).alias("pct"), F.round(step, 1).alias("lat_metres"), F.round(step * F.cos(F.radians(F.col("lats") / F.col("total"))), 1).alias("lng_metres"))
