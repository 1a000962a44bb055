"""Readers with explicit schemas. Coordinates stay as written beside their numbers."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.geo import MERCATOR_M

RECORD = """url string, title string, text string, description string, author string,
images array<struct<source_url:string,local_path:string,width:int,height:int,caption:string>>,
geo struct<lat:double,lng:double,source:string,coords_approx:boolean,query:string>,
city string, district string, scraped_at double, error string"""
ENRICHED = """url string, title string, text string,
location struct<country:string,city:string,district_name:string,district_code:string,match_type:string,lat:double,lng:double,coords_approx:boolean>,
fsi_type string, operational_level string,
popularity struct<popularity_level:string,popularity_score:bigint,popularity_signals:struct<max_quantity:bigint,high_keywords:bigint,medium_keywords:bigint,low_keywords:bigint,text_length:bigint,has_numbers:boolean>>,
images array<struct<source_url:string,local_path:string,width:int,height:int,caption:string>>,
description string, scraped_at string, error string, phase int"""


def url_csv(spark: SparkSession, path: str) -> DataFrame:
    """url, lat_raw, lng_raw, lat, lng, coords_approx of an address list in any of its three layouts.

    Columns Lat with Lng or Lon, one column of "lat,lng", or none; header names are trimmed,
    blank addresses go, and what is no number becomes null in lat and lng.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    names = {c.lower(): c for c in raw.columns}
    text = lambda c: F.trim(F.coalesce(F.col(f"`{names[c]}`"), F.lit("")))
    if "lat" in names:
        lat, lng = text("lat"), text("lng" if "lng" in names else "lon")
    elif "coordinates" in names:
        pair = F.split(text("coordinates"), ",")
        lat, lng = F.trim(F.coalesce(F.get(pair, F.lit(0)), F.lit(""))), F.trim(F.coalesce(F.get(pair, F.lit(1)), F.lit("")))
    else:
        lat = lng = F.lit("")
    approx = F.lower(text("coords_approx")) == "true" if "coords_approx" in names else F.lit(False)
    out = raw.select(text("url").alias("url"), lat.alias("lat_raw"), lng.alias("lng_raw"), approx.alias("coords_approx")).filter("url <> ''")
    return out.withColumns({"lat": F.col("lat_raw").try_cast("double"), "lng": F.col("lng_raw").try_cast("double")})


def records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One JSON record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def key_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """id and the fields of `value` (a struct's DDL) from files that hold one JSON object by id each."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "v"))
    return parsed.select("id", "v.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file, with the folders that a partitioned sink made) and text of every file; pages and merged documents come this way."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.element_at(parts, -2)
    name = F.when(F.contains(folder, F.lit("name=")), F.substring_index(folder, "=", -1)).otherwise(F.element_at(parts, -1))
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank."""
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").alias("n"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, data by key) and edges (source, target, data by key) of a GraphML file."""
    data = "array<struct<_key:string,_VALUE:string>>"
    by_key = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda x: F.struct(x["_key"].alias("key"), x["_VALUE"].alias("value"))))
    read = lambda tag, ids: spark.read.format("xml").option("rowTag", tag).schema(f"{ids}, data {data}").load(path)
    unquote = lambda c: F.regexp_replace(c, '^"|"$', "")
    nodes = read("node", "_id string").select(unquote("_id").alias("id"), by_key.alias("data"))
    edges = read("edge", "_source string, _target string").select(unquote("_source").alias("source"), unquote("_target").alias("target"), by_key.alias("data"))
    return nodes, edges


def geojson(spark: SparkSession, path: str, source_crs: str = "EPSG:4326") -> DataFrame:
    """ord, name and rings (arrays of x, y in degrees) of the Polygon and MultiPolygon features of a file, in its order.

    Parts of a MultiPolygon and holes are rings alike; a point inside an odd number of them is
    inside. Coordinates in web mercator (source_crs EPSG:3857, in metres) are brought to degrees.
    """
    if source_crs not in ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"no conversion from {source_crs}")
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("ord", "f"))
    ring, held = "array<array<double>>", F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.from_json(held, f"array<{ring}>")).when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(held, f"array<array<{ring}>>")))
    degrees = (lambda p: (p[0], p[1])) if source_crs == "EPSG:4326" else (lambda p: (F.degrees(p[0] / MERCATOR_M), F.degrees(2 * F.atan(F.exp(p[1] / MERCATOR_M))) - 90))
    point = lambda p: F.struct(degrees(p)[0].alias("x"), degrees(p)[1].alias("y"))
    return rows.withColumn("parts", parts).filter("parts IS NOT NULL").select("ord", F.col("f.properties")["name"].alias("name"), F.transform("parts", lambda r: F.transform(r, point)).alias("rings"))


def strings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose cells all stay strings: no number and no null is read into annotations; an empty cell is an empty string."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows, columns, types (as read with inference) and modified of CSV files; paths is a report's list of files."""
    found = None
    for path in paths:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        at = spark.read.text(path).agg(F.max("_metadata.file_modification_time").alias("modified"))
        row = df.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(at))  # a row each
        row = row.select(F.lit(path).alias("path"), "rows", F.lit(", ".join(df.columns)).alias("columns"), F.lit(", ".join(t for _, t in df.dtypes)).alias("types"), "modified")
        found = row if found is None else found.union(row)
    return found


class _Cells(HTMLParser):
    """The cells of the rows of the tables' bodies."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "tr"):
            self.handle_endtag(tag)
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "tr", "table") and self.cell is not None:
            self.rows[-1].append(" ".join(" ".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(pages: pd.Series) -> pd.Series:
    """The cells of every table row of a page that has <td> cells; headings have none."""

    def one(page):
        parser = _Cells()
        parser.feed(page or "")
        parser.close()
        return [r for r in parser.rows if r]

    return pd.Series([one(p) for p in pages], index=pages.index, dtype=object)


def ledger(pages: DataFrame, key: str, html: str, columns: tuple[str, ...] = ("row_id", "url", "decision", "reason")) -> DataFrame:
    """key and the named cells of the ledger tables of pages; a row with fewer cells has null for the rest."""
    rows = pages.select(key, F.explode(table_rows(F.col(html))).alias("r"))
    return rows.select(key, *[F.get("r", k).alias(c) for k, c in enumerate(columns)])


def known_names(districts: DataFrame) -> DataFrame:
    """name, distinct, with n (its length): the longest is to be looked for first."""
    return districts.select(F.trim("name").alias("name")).filter("name <> ''").distinct().withColumn("n", F.length("name").cast("long"))


# How an extraction prompt writes an entity: name, type, description.
ENTITY = r'\("entity"<\|>"?([^"<]+)"?<\|>"?([^"<]+)"?<\|>"?([^")]*)"?\)'


def template_entities(prompts: DataFrame, key: str, body: str) -> DataFrame:
    """key, name, type and description of the entities that prompts write out, read as text."""
    part = lambda k: F.regexp_extract_all(F.col(body), F.lit(ENTITY), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("name"), part(2).alias("type"), part(3).alias("description"))
    return prompts.select(key, F.explode(zipped).alias("e")).select(key, "e.name", "e.type", "e.description")


def block_prose(blocks: DataFrame, doc: str, place: str, body: str) -> DataFrame:
    """doc, place, heading and text of the blocks of laid-out pages: a block of at most eight words without a closing sign heads those after it."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(body), F.lit("")), r"\s+"), lambda x: x != ""))
    is_heading = (words > 0) & (words <= 8) & ~F.col(body).rlike(r"[.!?:;,]\s*$")
    w = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    headed = blocks.withColumn("_h", is_heading).withColumn("heading", F.coalesce(F.last(F.when(F.col("_h"), F.trim(body)), ignorenulls=True).over(w), F.lit("")))
    return headed.filter(~F.col("_h") & (words > 0)).select(doc, place, "heading", F.col(body).alias("text"))


def words_in_bands(words: DataFrame, anchors: DataFrame, columns: list[float], foot: float = 1e9) -> DataFrame:
    """doc, row and c0, c1, ...: the words (doc, x, y, word) of laid-out pages by the band of their row and the column of their x.

    anchors: doc, row, y of each row's first line; a band goes to the next anchor. columns: where
    each begins. Words above the first anchor are left out.
    """
    bands = anchors.withColumn("_end", F.coalesce(F.lead("y").over(Window.partitionBy("doc").orderBy("y", "row")), F.lit(foot))).select("doc", "row", F.col("y").alias("_from"), "_end")
    met = words.join(bands, "doc").filter((F.col("y") >= F.col("_from")) & (F.col("y") < F.col("_end")))
    column = sum((F.col("x") >= c).cast("int") for c in columns) - 1
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == k, F.struct("y", "x", "word")))), lambda s: s["word"]), " ").alias(f"c{k}")
    return met.withColumn("_c", column).groupBy("doc", "row").agg(*[text(k) for k in range(len(columns))])


#: Tables that stand for what the network gives; live calls are inputs.
FETCHES = "url string, status int, error_class string, html string"
PLACES = "query string, lat double, lng double"
ANSWERS = "args_hash string, response string"


def boundary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fetched pages, places or model answers as stored (FETCHES, PLACES or ANSWERS), one JSON object a line."""
    return spark.read.schema(schema).json(path)


def config(path: str) -> dict:
    """A city's settings from JSON, or YAML where that library is there, with its derived paths; a missing file names those beside it."""
    at = Path(path)
    if not at.exists():
        raise FileNotFoundError(f"{path}: not among {sorted(p.name for p in at.parent.glob('*')) if at.parent.exists() else []}")
    if at.suffix == ".json":
        held = json.loads(at.read_text(encoding="utf-8"))
    else:
        import yaml

        held = yaml.safe_load(at.read_text(encoding="utf-8"))
    if not held.get("city"):
        raise ValueError(f"{path}: no city")
    base = held.get("data_dir") or f"data/{held['city'].lower().replace(' ', '_')}"
    return {**held, "data_dir": base, "raw_dir": f"{base}/raw", "output_dir": f"{base}/output", "graph_dir": f"{base}/graphrag", "records": f"{base}/output/fsi_records.jsonl", "enriched": f"{base}/output/fsi_enriched.jsonl"}
