"""Queries that write a table by a sink, or in a source's form, and read it back; folders lie below spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import claims
from corpusloom.operators.ordered import scratch
from corpusloom.plans.common import t
from corpusloom.plans.registry import query
from corpusloom.plans.reports_audit import HTML, PROSE, prose
from corpusloom.plans.screening import FETCHED, fetched
from corpusloom.sources import readers, writers


def as_csv(df, name, *columns):
    """df as a CSV with header in a scratch folder, columns renamed."""
    path = scratch(df.sparkSession, name)
    df.toDF(*columns).write.option("header", True).csv(path)
    return path


LISTED = "(SELECT page_id, CASE WHEN page_id % 6 = 5 THEN '' ELSE url END AS url, CASE WHEN page_id % 4 = 0 THEN 'n/a' ELSE '51.' || page_id END AS lat, ' 0.' || page_id || ' ' AS lng FROM pages)"


def listed(spark, d):
    p = F.col("page_id").cast("string")
    return t(spark, d, "pages").select(F.when(F.col("page_id") % 6 == 5, "").otherwise(F.concat(F.lit(" "), "url", F.lit(" "))).alias("url"), F.when(F.col("page_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit("51."), p)).alias("lat"), F.concat(F.lit(" 0."), p, F.lit(" ")).alias("lng"))


@query("s01_url_csv_layouts", f"SELECT 'two' AS layout, url, lat AS lat_raw, try_cast(lat AS DOUBLE) AS lat, trim(lng) AS lng_raw, false AS coords_approx FROM {LISTED} WHERE url <> '' UNION ALL SELECT 'pair', url, lat, try_cast(lat AS DOUBLE), trim(lng), false FROM {LISTED} WHERE url <> '' UNION ALL SELECT 'none', url, '', NULL, '', false FROM {LISTED} WHERE url <> ''")
def s01(spark, d):
    rows = listed(spark, d)
    layouts = {"two": as_csv(rows, "two", "URL ", "Lat", " Lng"), "pair": as_csv(rows.select("url", F.concat_ws(",", "lat", "lng")), "pair", "URL", "coordinates"), "none": as_csv(rows.select("url"), "none", " URL")}
    read = [readers.url_csv(spark, p).select(F.lit(k).alias("layout"), "url", "lat_raw", "lat", "lng_raw", "coords_approx") for k, p in layouts.items()]
    return read[0].union(read[1]).union(read[2])


@query("s02_renamed_columns", f"SELECT url, try_cast(trim(lng) AS DOUBLE) AS lng FROM {LISTED} WHERE url <> ''")
def s02(spark, d):
    """Lon is read as Lng."""
    return readers.url_csv(spark, as_csv(listed(spark, d), "lon", "URL", "Lat", "Lon")).select("url", "lng")


@query("s03_cleaned_urls", f"SELECT url, page_id % 2 = 0 AS coords_approx FROM {LISTED} WHERE url <> ''")
def s03(spark, d):
    p = t(spark, d, "pages").select(F.when(F.col("page_id") % 6 == 5, "").otherwise(F.col("url")).alias("url"), F.lit("1"), F.lit("2"), F.when(F.col("page_id") % 2 == 0, "True").otherwise("False"))
    return readers.url_csv(spark, as_csv(p, "cleaned", "URL", "Lat", "Lng", "coords_approx")).select("url", "coords_approx")


@query("s04_string_coordinates", f"SELECT url, lat AS lat_raw, try_cast(lat AS DOUBLE) AS lat FROM {LISTED} WHERE url <> ''")
def s04(spark, d):
    return readers.url_csv(spark, as_csv(listed(spark, d), "raw", "URL", "Lat", "Lng")).select("url", "lat_raw", "lat")


@query("s22_trimmed_headers", f"SELECT url, trim(lng) AS lng_raw FROM {LISTED} WHERE url <> ''")
def s22(spark, d):
    return readers.url_csv(spark, as_csv(listed(spark, d), "heads", "  URL", " Lat ", "Lng  ")).select("url", "lng_raw")


@query("f01_blank_urls", f"SELECT url, count(*) AS n FROM {LISTED} WHERE url <> '' GROUP BY url")
def f01(spark, d):
    return readers.url_csv(spark, as_csv(listed(spark, d), "blank", "URL", "Lat", "Lng")).groupBy("url").agg(F.count("*").alias("n"))


@query("f02_trimmed_cells", f"SELECT DISTINCT url, length(trim(lng))::INT AS n FROM {LISTED} WHERE url <> ''")
def f02(spark, d):
    return readers.url_csv(spark, as_csv(listed(spark, d), "cells", " URL ", "Lat", "Lng")).select("url", F.length("lng_raw").alias("n")).distinct()


@query("f11_numeric_coercion", f"SELECT count(*) AS n, count(try_cast(lat AS DOUBLE)) AS numbers, round(sum(try_cast(lat AS DOUBLE)), 6) AS total FROM {LISTED} WHERE url <> ''")
def f11(spark, d):
    r = readers.url_csv(spark, as_csv(listed(spark, d), "numbers", "URL", "Lat", "Lng"))
    return r.agg(F.count("*").alias("n"), F.count("lat").alias("numbers"), F.round(F.sum("lat"), 6).alias("total"))


@query("s05_json_lines", "SELECT source AS city, count(*) AS n, count(text) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def s05(spark, d):
    path = scratch(spark, "records")
    writers.json_lines(t(spark, d, "documents").select(F.concat(F.lit("u"), "doc_id").alias("url"), "text", F.col("source").alias("city")), path)
    return readers.records(spark, path).groupBy("city").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("k02_json_lines", "SELECT doc_id, quality, toxic FROM labels")
def k02(spark, d):
    path = scratch(spark, "lines")
    writers.json_lines(t(spark, d, "labels"), path)
    return spark.read.schema("doc_id long, quality int, toxic int").json(path)


def one_file(df, name, column):
    """The one row of df as a text file that holds its column."""
    path = scratch(df.sparkSession, name)
    df.select(F.col(column).alias("value")).coalesce(1).write.text(path)
    return path


@query("s06_json_document", "SELECT r_regionkey AS key, r_name AS name FROM region")
def s06(spark, d):
    """A document over several lines."""
    whole = t(spark, d, "region").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))).alias("rows"))).alias("j")).select(F.regexp_replace("j", ",", ",\n  ").alias("j"))
    rows = readers.document(spark, one_file(whole, "document", "j"), "rows array<struct<key:int,name:string>>")
    return rows.select(F.explode("rows").alias("r")).select("r.*")


@query("s07_key_values", "SELECT 'chunk-' || n_nationkey AS id, n_name AS content, n_regionkey AS tokens FROM nation")
def s07(spark, d):
    entry = F.struct(F.concat(F.lit("chunk-"), "n_nationkey").alias("k"), F.struct(F.col("n_name").alias("content"), F.col("n_regionkey").alias("tokens")).alias("v"))
    whole = t(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("j"))
    return readers.key_values(spark, one_file(whole, "store", "j"), "struct<content:string,tokens:int>")


@query("s08_graphml", "SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, (n_nationkey + 0.5)::DOUBLE AS weight FROM nation")
def s08(spark, d):
    edge = F.format_string('<edge source="&quot;N%d&quot;" target="&quot;R%d&quot;"><data key="d4">%d.5</data></edge>', "n_nationkey", "n_regionkey", "n_nationkey")
    whole = t(spark, d, "nation").agg(F.concat(F.lit('<graphml><graph edgedefault="undirected"><node id="&quot;N0&quot;"><data key="d0">place</data></node>'), F.array_join(F.array_sort(F.collect_list(edge)), "\n"), F.lit("</graph></graphml>")).alias("j"))
    _, edges = readers.graphml(spark, one_file(whole, "graph", "j"))
    return edges.select("source", "target", F.col("data")["d4"].cast("double").alias("weight"))


#: A square for each nation with a square inside, by its key: a hole, or for each third nation a part of its own beside it.
SQUARES = "(SELECT n_nationkey AS k, n_name AS name, ring, i, n_nationkey * 10.0 - 125 + CASE WHEN ring = 0 THEN 0 WHEN n_nationkey % 3 = 0 THEN 9 ELSE 2 END + CASE WHEN ring = 0 THEN 8 ELSE 0.5 END * CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END AS x, n_regionkey * 10.0 - 20 + CASE WHEN ring = 0 THEN 0 ELSE 2 END + CASE WHEN ring = 0 THEN 8 ELSE 0.5 END * CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS y FROM nation, range(2) r(ring), range(5) c(i))"


@query("s09_geojson", f"SELECT name, ring::INT AS ring, i::INT AS i, x::DOUBLE AS x, y::DOUBLE AS y FROM {SQUARES}")
def s09(spark, d):
    """Polygons with holes, and some of several parts: a district of each nation, written as one document and read back."""
    k, third = F.col("n_nationkey"), F.col("n_nationkey") % 3 == 0

    def square(x, y, size):
        corner = lambda dx, dy: F.array(x + dx, y + dy)
        return F.array(corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0))

    x, y = k * 10.0 - 125, F.col("n_regionkey") * 10.0 - 20
    outer, inner = square(x, y, 8.0), square(x + F.when(third, 9.0).otherwise(2.0), y + 2.0, 0.5)
    shape = F.when(third, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(outer), F.array(inner)).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(outer, inner).alias("coordinates"))))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("n_name").alias("name"))), F.lit(',"geometry":'), shape, F.lit("}"))
    whole = t(spark, d, "nation").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(feature)), ","), F.lit("]}")).alias("j"))  # 25 nations
    path = one_file(whole, "districts", "j")
    rings = readers.geojson(spark, path).select("name", F.posexplode("rings").alias("ring", "r"))
    return rings.select("name", "ring", F.posexplode("r").alias("i", "p")).select("name", "ring", "i", "p.x", "p.y")


@query("k05_text_files", "SELECT printf('%03d', n_nationkey) || '_' || regexp_replace(n_name, '[^A-Za-z0-9_-]', '_', 'g') AS name, length(n_name || chr(10) || 'of ' || n_regionkey)::INT AS chars FROM nation")
def k05(spark, d):
    """A file a document, read back by name; the writer ends a file with a line feed."""
    path = scratch(spark, "documents")
    writers.text_files(t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_no"), F.col("n_name").alias("slug"), F.concat("n_name", F.lit("\nof "), "n_regionkey").alias("text")), path)
    return readers.texts(spark, path).select("name", F.length(F.regexp_replace("text", "\n$", "")).alias("chars"))


@query("s10_html_files", "SELECT printf('%03d', r_regionkey) || '_' || regexp_replace(r_name, '[^A-Za-z0-9_-]', '_', 'g') AS name, '<html>' || r_name || '</html>' AS html FROM region")
def s10(spark, d):
    path = scratch(spark, "raw")
    writers.text_files(t(spark, d, "region").select(F.col("r_regionkey").alias("doc_no"), F.col("r_name").alias("slug"), F.concat(F.lit("<html>"), "r_name", F.lit("</html>")).alias("text")), path)
    return readers.texts(spark, path).select("name", F.regexp_replace("text", "\n$", "").alias("html"))


@query("s11_text_file_count", "SELECT count(*) AS files, sum(length(n_name))::BIGINT AS chars FROM nation")
def s11(spark, d):
    path = scratch(spark, "texts")
    writers.text_files(t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_no"), F.col("n_name").alias("slug"), F.col("n_name").alias("text")), path)
    return readers.texts(spark, path).agg(F.count("*").alias("files"), F.sum(F.length(F.regexp_replace("text", "\n$", ""))).alias("chars"))


@query("s12_line_count", r"SELECT sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\r\n]+'), lambda x: trim(x) <> '')))::BIGINT AS n FROM documents")
def s12(spark, d):
    path = scratch(spark, "lines")
    t(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return readers.line_counts(spark, path)


@query("s15_word_bands", "SELECT page_id // 10 AS doc, page_id AS row, 'id' || page_id || ' more' AS c0, 'kept' AS c1 FROM pages")
def s15(spark, d):
    """Words of a laid-out ledger, by the bands of its rows and the columns they begin in."""
    p = t(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("doc"), F.col("page_id").alias("row"), (F.col("page_id") % 10 * 100.0 + 50).alias("y"))
    word = lambda x, dy, w: F.struct(F.lit(x).alias("x"), (F.col("y") + dy).alias("y"), w.alias("word"))
    words = p.select("doc", F.explode(F.array(word(80.0, 12.0, F.lit("more")), word(10.0, 0.0, F.concat(F.lit("id"), "row")), word(300.0, 1.0, F.lit("kept")))).alias("w")).select("doc", "w.*")
    above = p.select("doc", F.lit(1.0).alias("x"), F.lit(5.0).alias("y"), F.lit("heading").alias("word")).distinct()
    return readers.words_in_bands(words.union(above), p, [0.0, 200.0])


@query("s16_string_csv", "SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'NA' ELSE '' END AS label, lpad(toxic::VARCHAR, 3, '0') AS code FROM labels")
def s16(spark, d):
    """No cell becomes a number or a null."""
    rows = t(spark, d, "labels").select(F.col("doc_id").cast("string"), F.when(F.col("quality") == 0, "NA").otherwise(""), F.lpad(F.col("toxic").cast("string"), 3, "0"))
    return readers.strings_csv(spark, as_csv(rows, "annotations", "id", " label", "code"))


@query("s17_inventory", "SELECT count(*) AS rows, 'doc_id, quality, toxic' AS columns, 'int, int, int' AS types FROM labels")
def s17(spark, d):
    path = as_csv(t(spark, d, "labels"), "lineage", "doc_id", "quality", "toxic")
    return readers.inventory(spark, [path]).select("rows", "columns", "types")


@query("s18_fetch_boundary", f"SELECT status, error AS error_class, count(*) AS n FROM {FETCHED} GROUP BY ALL")
def s18(spark, d):
    """Fetches are an input: a table of addresses, status, errors and pages."""
    path = scratch(spark, "fetches")
    writers.json_lines(fetched(spark, d).select("url", "status", F.col("error").alias("error_class"), F.lit(None).cast("string").alias("html")), path)
    return readers.boundary(spark, path, readers.FETCHES).groupBy("status", "error_class").agg(F.count("*").alias("n"))


@query("s19_place_boundary", "SELECT s_suppkey, s_name AS query, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 181 - 90)::DOUBLE END AS lat, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 3 % 361 - 180)::DOUBLE END AS lng FROM supplier")
def s19(spark, d):
    """Places of all suppliers' names as a geocoder answered, every seventh without an answer; met by what was asked."""
    path, s = scratch(spark, "places"), t(spark, d, "supplier")
    known = s.filter("s_suppkey % 7 <> 0").select(F.col("s_name").alias("query"), (F.col("s_suppkey") % 181 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 3 % 361 - 180).cast("double").alias("lng"))
    writers.json_lines(known, path)
    asked = s.select("s_suppkey", F.col("s_name").alias("query"))
    return asked.join(readers.boundary(spark, path, readers.PLACES), "query", "left").select("s_suppkey", "query", "lat", "lng")


@query("s20_answer_boundary", "SELECT b.item_id, CASE WHEN item_id % 3 <> 0 THEN text END AS response FROM benchmark b")
def s20(spark, d):
    """Model answers are an input, found by the digest of what was asked."""
    b, path = t(spark, d, "benchmark"), scratch(spark, "answers")
    digest = F.sha2(F.to_json(F.struct(F.lit("m").alias("model"), "text")).cast("binary"), 256)
    writers.json_lines(b.filter("item_id % 3 <> 0").select(digest.alias("args_hash"), F.col("text").alias("response")).distinct(), path)
    held = readers.boundary(spark, path, readers.ANSWERS)
    return b.withColumn("args_hash", digest).join(held, "args_hash", "left").select("item_id", "response")


BLOCK = r"(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS b, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)"


@query("s23_block_prose", rf"WITH w AS (SELECT *, len(list_filter(string_split_regex(b, '\s+'), lambda x: x <> '')) AS n, regexp_matches(b, '[.!?:;,]\s*$') AS ends FROM {BLOCK}), h AS (SELECT *, n BETWEEN 1 AND 8 AND NOT ends AS head FROM w), f AS (SELECT *, coalesce(last_value(CASE WHEN head THEN trim(b) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS heading FROM h) SELECT doc_id, (i - 1)::INT AS place, heading, md5(b) AS text_md5 FROM f WHERE NOT head AND n > 0")
def s23(spark, d):
    """Blocks of laid-out pages under their headings; blocks come from the lines of documents here."""
    blocks = t(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "block"))
    return readers.block_prose(blocks, "doc_id", "place", "block").select("doc_id", "place", "heading", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("s24_report_sentences", f"SELECT city, condition, rep, section, 'First part' AS heading, a || ' groups were found, ' || (a % 90) || '.5% of them open.' AS sentence FROM {PROSE} UNION ALL SELECT city, condition, rep, section, 'First part', 'They hold ' || b || ' words' || CASE WHEN rep = 3 AND section = 's2' THEN ' and no more' ELSE '' END || '.' FROM {PROSE} UNION ALL SELECT city, condition, rep, section, 'First part', 'Two & more' FROM {PROSE} UNION ALL SELECT city, condition, rep, section, 'Second', city FROM {PROSE}")
def s24(spark, d):
    """Sentences under their headings of a report in HTML."""
    s = prose(spark, d).select("city", "condition", "rep", "section", F.explode(claims.sections(F.expr(HTML))).alias("s"))
    return s.select("city", "condition", "rep", "section", "s.heading", F.explode(claims.sentences(F.col("s.para"))).alias("sentence"))


@query("s26_template_entities", "SELECT item_id, 'NAME ' || item_id AS name, 'person' AS type, 'a man of ' || item_id AS description FROM benchmark UNION ALL SELECT item_id, 'PLACE', 'location', 'where it is' FROM benchmark")
def s26(spark, d):
    body = F.concat(F.lit('Output:\n("entity"<|>"NAME '), "item_id", F.lit('"<|>"person"<|>"a man of '), "item_id", F.lit('")##\n("entity"<|>PLACE<|>location<|>where it is)##\n("relationship"<|>"x"<|>"y"<|>"z")'))
    return readers.template_entities(t(spark, d, "benchmark").select("item_id", body.alias("b")), "item_id", "b")


@query("s27_annotation_loads", "SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, count(*) AS n FROM labels GROUP BY ALL")
def s27(spark, d):
    path = as_csv(t(spark, d, "labels"), "key", "doc_id", "quality", "toxic")
    return readers.strings_csv(spark, path).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("k01_cleaned_csv", f"SELECT url, lat AS lat_raw, trim(lng) AS lng_raw, false AS coords_approx FROM {LISTED} WHERE url <> ''")
def k01(spark, d):
    path = scratch(spark, "cleaned")
    writers.cleaned_csv(readers.url_csv(spark, as_csv(listed(spark, d), "in", "URL", "Lat", "Lng")), path)
    return readers.url_csv(spark, path).select("url", "lat_raw", "lng_raw", "coords_approx")


@query("k03_annotated_json", "SELECT count(*) AS total, count_if(quality = 1)::BIGINT AS good, (SELECT count(*) FROM labels) AS rows FROM labels")
def k03(spark, d):
    labels, path = t(spark, d, "labels"), scratch(spark, "annotated")
    writers.annotated_json(labels.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("good")), labels, path)
    rows = spark.read.schema("doc_id long").json(f"{path}/rows").agg(F.count("doc_id").alias("rows"))
    return spark.read.schema("total long, good long").json(f"{path}/stats").crossJoin(F.broadcast(rows))  # a row each


@query("k04_review_report", f"SELECT url, 'coordinates could not be found automatically' AS reason FROM {LISTED} WHERE url <> '' AND lat = 'n/a'")
def k04(spark, d):
    """Addresses to be looked up, as the report holds them."""
    path = scratch(spark, "review")
    r = readers.url_csv(spark, as_csv(listed(spark, d), "in", "URL", "Lat", "Lng")).select("url", F.when(F.col("lat").isNull(), "").otherwise(F.col("lat_raw")).alias("lat"), F.col("lat").isNull().alias("needs_review"))
    writers.review_report(r, path)
    return spark.read.schema("url string, reason string").json(f"{path}/needs_manual_review")


@query("k06_summary_json", "SELECT count(*) AS total, count(DISTINCT source) AS groups FROM documents")
def k06(spark, d):
    path = scratch(spark, "summary")
    stats = F.struct(F.struct(F.count("*").alias("total"), F.countDistinct("source").alias("groups")).alias("stats")).alias("city_overview")
    writers.json_document(t(spark, d, "documents").agg(stats), path)
    return readers.document(spark, path, "city_overview struct<stats:struct<total:long,groups:long>>").select("city_overview.stats.total", "city_overview.stats.groups")


@query("k07_appended_csv", "SELECT quality::VARCHAR AS quality, count(*) * 2 AS n FROM labels GROUP BY quality")
def k07(spark, d):
    labels, path = t(spark, d, "labels"), scratch(spark, "appended")
    writers.append_checked(labels, path)
    writers.append_checked(labels, path)
    return readers.strings_csv(spark, path).groupBy("quality").agg(F.count("*").alias("n"))


@query("k08_guarded_results", "SELECT doc_id::VARCHAR AS doc_id FROM labels WHERE toxic = 1")
def k08(spark, d):
    base = scratch(spark, "results")
    writers.results(t(spark, d, "labels").filter("toxic = 1").select("doc_id"), f"{base}/toxic", (base,))
    return readers.strings_csv(spark, f"{base}/toxic")


@query("k09_table_and_markdown", "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS markdown, count(*) AS rows FROM region")
def k09(spark, d):
    path = scratch(spark, "table")
    page = writers.table(t(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), path)
    return readers.strings_csv(spark, path).agg(F.count("*").alias("rows")).select(F.lit(page).alias("markdown"), "rows")


@query("k10_html_report", "SELECT string_agg('<h2>' || r_name || '</h2><p>Key ' || r_regionkey || '</p>', '' ORDER BY r_regionkey) AS body FROM region")
def k10(spark, d):
    page = writers.html_report("Regions", t(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("heading"), F.concat(F.lit("Key "), "r_regionkey").alias("body")))
    return spark.createDataFrame([(page,)], "page string").select(F.regexp_extract("page", "</h1>(.*)</body>", 1).alias("body"))
