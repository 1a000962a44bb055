"""Tables and derived inputs that several queries read, in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rectangles that stand for districts; two overlap, and some points lie in none.
BOXES = [("north", 0.0, 51.5, 0.5, 52.0), ("south", 0.0, 51.0, 0.5, 51.4), ("east", 0.4, 51.2, 0.9, 51.8), ("far", 2.0, 53.0, 2.5, 53.5)]
BOXES_SQL = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in BOXES) + ") AS b(name, min_lng, min_lat, max_lng, max_lat)"


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "name string, min_lng double, min_lat double, max_lng double, max_lat double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages")
    lat = F.when(F.col("page_id") % 41 == 0, F.lit(None)).otherwise(51 + (F.col("page_id") % 97) / F.lit(100.0))
    return p.select("page_id", lat.cast("double").alias("lat"), ((F.col("page_id") % 89) / F.lit(100.0)).alias("lng"))


POINTS_SQL = "(SELECT page_id, CASE WHEN page_id % 41 = 0 THEN NULL ELSE 51 + (page_id % 97) / 100.0::DOUBLE END AS lat, (page_id % 89) / 100.0::DOUBLE AS lng FROM pages)"


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses with variants of themselves, in an order."""
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    forms = F.array(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/"))), F.when(F.col("page_id") % 5 == 0, F.replace(F.col("url"), F.lit("http://"), F.lit("https://"))), F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?://", "")), F.when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "^https?:", "")))
    return p.select("page_id", F.posexplode(forms).alias("form", "url")).filter("url is not null").select((F.col("form") * 100000000 + F.col("page_id")).alias("ord"), "url")


URLS_SQL = """(SELECT page_id AS ord, url FROM pages UNION ALL SELECT 100000000 + page_id, url FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT 200000000 + page_id, url || '/' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 300000000 + page_id, replace(url, 'http://', 'https://') FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 400000000 + page_id, regexp_replace(url, '^https?://', '') FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT 500000000 + page_id, regexp_replace(url, '^https?:', '') FROM pages WHERE page_id % 11 = 0)"""
PARTS = r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"
HOST, PATH, QUERY = (f"regexp_extract(trim({{0}}), {PARTS}, {k})" for k in (1, 2, 3))
DOMAIN = rf"regexp_replace(lower({HOST}), '^www\.', '')"
DEDUP_KEY = f"replace({HOST.format('lower({0})')}, 'www.', '') || regexp_replace({PATH.format('lower({0})')}, '/+$', '')"
WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
TOKENS = r"list_filter(string_split_regex(coalesce({0}, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
