"""Queries that put a report together; records and their images are derived from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import corpus, report
from corpusloom.operators.ordered import numbered
from corpusloom.plans.common import DOMAIN, t
from corpusloom.plans.registry import query

#: Every tenth record has a district of its own.
DISTRICT = "CASE WHEN doc_id % 10 = 3 THEN 'solo' || doc_id ELSE source END"
IMAGES = "(SELECT doc_id, k, 150 + (doc_id * 7 + k * 131) % 900 AS width, 140 + (doc_id * 5 + k * 97) % 700 AS height, CASE WHEN (doc_id + k) % 3 = 0 THEN 'c' ELSE '' END AS caption, CASE WHEN (doc_id + k) % 4 = 0 THEN 'data:' ELSE 'http://i/' END || k AS source_url, 'p' || (doc_id * 3 + k) % 97 AS local_path FROM documents, generate_series(0, 2) g(k) WHERE doc_id % 7 <> 0)"
SCORED = "(SELECT *, CASE WHEN width < 200 OR height < {0} THEN -1.0 ELSE (width > height)::INT * 2.0 + (CASE WHEN width >= 800 THEN 2.0 WHEN width >= 500 THEN 1.0 ELSE 0.0 END) + (source_url LIKE 'http%')::INT * 0.5 + {1} END::DOUBLE AS s FROM " + IMAGES + ")"
P4, P5 = SCORED.format(200, "(caption <> '')::INT"), SCORED.format(150, "0.0")
RECORDS = f"(SELECT doc_id, {DISTRICT} AS district, doc_id % 13 AS score, lang AS kind FROM documents)"


def records(spark, d):
    """doc_id, district, score, kind and images of every document."""
    n = F.col("doc_id")
    one = lambda k: F.struct((150 + (n * 7 + k * 131) % 900).alias("width"), (140 + (n * 5 + k * 97) % 700).alias("height"), F.when((n + k) % 3 == 0, "c").otherwise("").alias("caption"), F.concat(F.when((n + k) % 4 == 0, "data:").otherwise("http://i/"), F.lit(str(k))).alias("source_url"), F.concat(F.lit("p"), (n * 3 + k) % 97).alias("local_path"))
    images = F.when(n % 7 != 0, F.array(*map(one, range(3)))).otherwise(F.array().cast("array<struct<width:long,height:long,caption:string,source_url:string,local_path:string>>"))
    return t(spark, d, "documents").select("doc_id", F.expr(DISTRICT).alias("district"), (n % 13).alias("score"), F.col("lang").alias("kind"), images.alias("images"))


def by_score():
    return [F.desc("score"), "doc_id"]


@query("x48_image_scores", f"SELECT a.doc_id, a.k::INT AS k, a.s AS p4, b.s AS p5 FROM {P4} a JOIN {P5} b USING (doc_id, k)")
def x48(spark, d):
    i = records(spark, d).select("doc_id", F.posexplode("images").alias("k", "i"))
    return i.select("doc_id", "k", report.image_score(F.col("i")).alias("p4"), report.image_score(F.col("i"), least_height=150, captions=False).alias("p5"))


BEST = "(SELECT doc_id, arg_max(local_path, s * 10 - k) AS path, max(s) AS s FROM {0} WHERE s >= 0 GROUP BY doc_id)"


@query("t04_best_image", f"SELECT doc_id, path FROM {BEST.format(P4)}")
def t04(spark, d):
    best = records(spark, d).select("doc_id", report.best_image(F.col("images")).alias("i"))
    return best.filter("i IS NOT NULL").select("doc_id", F.col("i.local_path").alias("path"))


@query("t05_district_images", f"WITH b AS (SELECT doc_id, district, score, path FROM {RECORDS} JOIN {BEST.format(P4)} USING (doc_id)), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY district, path ORDER BY score DESC, doc_id) = 1) SELECT district, doc_id, path, row_number() OVER (PARTITION BY district ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 3")
def t05(spark, d):
    found = report.group_images(records(spark, d), "district", by_score())
    return found.select("district", "doc_id", F.col("image.local_path").alias("path"), "rank")


@query("t06_overview_images", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY score DESC, doc_id) AS rk FROM {RECORDS}), z AS (SELECT district, count(*) AS n, min(doc_id) AS f FROM r GROUP BY 1), b AS (SELECT district, arg_max(local_path, s * 100 - rk * 10 - k) AS path FROM r JOIN {P4} i USING (doc_id) WHERE rk <= 3 AND s >= 0 GROUP BY 1), u AS (SELECT district, path, n, f FROM b JOIN z USING (district) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, f) = 1) SELECT district, path, row_number() OVER (ORDER BY n DESC, f)::INT AS rank FROM u QUALIFY rank <= 5")
def t06(spark, d):
    return report.overview_images(records(spark, d), "district", by_score(), "doc_id").select("district", F.col("image.local_path").alias("path"), "rank")


@query("t07_report_images", f"WITH b AS (SELECT doc_id, score, path FROM {RECORDS} JOIN {BEST.format(P5)} USING (doc_id)), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, doc_id) = 1) SELECT doc_id, path, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 4")
def t07(spark, d):
    return report.report_images(records(spark, d), by_score()).select("doc_id", F.col("image.local_path").alias("path"), "rank")


SIZES = f"(SELECT district, count(*) AS n, min(doc_id) AS first_id FROM {RECORDS} GROUP BY 1)"


def sizes(spark, d):
    return records(spark, d).groupBy("district").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("t01_groups_by_count", f"SELECT district, n, row_number() OVER (ORDER BY n DESC, first_id) AS rank FROM {SIZES}")
def t01(spark, d):
    return numbered(sizes(spark, d), [F.desc("n"), "first_id"], "rank").select("district", "n", "rank")


@query("t03_first_singletons", f"SELECT district FROM {SIZES} WHERE n = 1 ORDER BY first_id LIMIT 3")
def t03(spark, d):
    return sizes(spark, d).filter("n = 1").orderBy("first_id").limit(3).select("district")


@query("j04_counts_on_groups", f"WITH c AS (SELECT source AS name, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), g AS (SELECT DISTINCT source AS name FROM documents UNION SELECT 'nowhere') SELECT name, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n > 20 THEN 'green' ELSE 'red' END AS category FROM g LEFT JOIN c USING (name)")
def j04(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    names = docs.select("name").distinct().union(spark.createDataFrame([("nowhere",)], "name string"))
    n = docs.filter("doc_id % 2 = 0").groupBy("name").agg(F.count("*").alias("n"))
    return report.counts_on(names, n.withColumn("category", F.when(F.col("n") > 20, "green").otherwise("red")), "name")


@query("a15_approx_coordinates", "SELECT source, count_if(doc_id % 9 = 0)::BIGINT AS n_approx, round(100.0::DOUBLE * count_if(doc_id % 9 = 0) / count(*), 1) AS pct FROM documents GROUP BY source")
def a15(spark, d):
    approx = F.count_if(F.col("doc_id") % 9 == 0)
    return t(spark, d, "documents").groupBy("source").agg(approx.alias("n_approx"), F.round(100.0 * approx / F.count("*"), 1).alias("pct"))


@query("a64_size_vs_findings", "WITH s AS (SELECT source, count(*) AS seeds, count_if(n_chars > 500)::BIGINT AS cleaned, count(DISTINCT lang) AS kinds FROM documents GROUP BY 1), r AS (SELECT source, count(*) AS reported FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, seeds, cleaned, kinds, reported, round(reported::DOUBLE / seeds, 3) AS ratio FROM s LEFT JOIN r USING (source)")
def a64(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    s = docs.groupBy("source").agg(F.count("*").alias("seeds"), F.count_if(F.col("n_chars") > 500).alias("cleaned"), F.countDistinct("lang").alias("kinds"))
    r = docs.join(t(spark, d, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("reported"))
    return s.join(r, "source", "left").withColumn("ratio", F.round(F.col("reported") / F.col("seeds"), 3))


@query("a65_documents_vs_initiatives", f"WITH n AS (SELECT page_id % 5 AS city, {DOMAIN.format('url')} AS domain, count(*) AS n FROM pages GROUP BY ALL) SELECT city, sum(n)::BIGINT AS urls, count_if(n > 1)::BIGINT AS domains_over_one, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS urls_on_them FROM n GROUP BY city")
def a65(spark, d):
    n = t(spark, d, "pages").groupBy((F.col("page_id") % 5).alias("city"), urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return n.groupBy("city").agg(F.sum("n").alias("urls"), F.count_if(F.col("n") > 1).alias("domains_over_one"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("urls_on_them"))


@query("a66_sampled_collapse", "WITH p AS (SELECT page_id, round(51 + (page_id % 37) / 100.0::DOUBLE, 6) AS lat, round((page_id % 29) / 100.0::DOUBLE, 6) AS lng FROM pages), shared AS (SELECT lat, lng FROM p GROUP BY ALL HAVING count(*) > 1) SELECT page_id, (lat, lng) IN (SELECT (lat, lng) FROM shared) AS on_shared FROM p WHERE page_id % 6 = 0")
def a66(spark, d):
    """Sampled places that stand on a coordinate which several rows share, at six decimal places."""
    p = t(spark, d, "pages").select("page_id", F.round(51 + (F.col("page_id") % 37) / F.lit(100.0), 6).alias("lat"), F.round((F.col("page_id") % 29) / F.lit(100.0), 6).alias("lng"))
    shared = p.groupBy("lat", "lng").agg(F.count("*").alias("n")).filter("n > 1").select("lat", "lng", F.lit(True).alias("s"))
    return p.filter("page_id % 6 = 0").join(shared, ["lat", "lng"], "left").select("page_id", F.coalesce("s", F.lit(False)).alias("on_shared"))


@query("a67_merge_summary", f"SELECT count(DISTINCT {DOMAIN.format('url')}) AS documents, count(*) AS records, (count(*) - count(DISTINCT {DOMAIN.format('url')}))::BIGINT AS merged FROM pages")
def a67(spark, d):
    return t(spark, d, "pages").agg(F.countDistinct(urls.domain(F.col("url"))).alias("documents"), F.count("*").alias("records")).withColumn("merged", F.col("records") - F.col("documents"))


@query("a79_cells_and_ratios", "WITH g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (VALUES (0), (1)) q(quality)), c AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT g.lang, g.quality, coalesce(n, 0) AS n, printf('%d/%d', coalesce(n, 0), (SELECT count(*) FROM documents JOIN labels USING (doc_id))) AS ratio FROM g LEFT JOIN c ON c.lang = g.lang AND c.quality = g.quality")
def a79(spark, d):
    """Cells of a fixed grid, 0 where no rows are, and their share as a text."""
    j = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    grid = t(spark, d, "documents").filter("lang IS NOT NULL").select("lang").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "quality int")))  # two values
    cells = grid.join(j.groupBy("lang", "quality").agg(F.count("*").alias("n")), ["lang", "quality"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return cells.crossJoin(F.broadcast(j.agg(F.count("*").alias("all")))).select("lang", "quality", "n", F.format_string("%d/%d", "n", "all").alias("ratio"))  # one row


@query("a81_phase_summaries", f"SELECT 'input' AS phase, 'records' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'scrape', 'ok', count_if(n_chars > 0)::BIGINT FROM documents UNION ALL SELECT 'locate', 'districts', count(DISTINCT district) FROM {RECORDS} UNION ALL SELECT 'classify', 'kinds', count(DISTINCT kind) FROM {RECORDS} UNION ALL (SELECT 'top', district, n FROM {SIZES} ORDER BY n DESC, first_id LIMIT 5)")
def a81(spark, d):
    docs = t(spark, d, "documents").agg(F.count("*").alias("a"), F.count_if(F.col("n_chars") > 0).alias("b"))
    r = records(spark, d).agg(F.countDistinct("district").alias("c"), F.countDistinct("kind").alias("e"))
    rows = docs.select(F.expr("stack(2, 'input', 'records', a, 'scrape', 'ok', b) AS (phase, metric, n)")).union(r.select(F.expr("stack(2, 'locate', 'districts', c, 'classify', 'kinds', e) AS (phase, metric, n)")))
    top = sizes(spark, d).orderBy(F.desc("n"), "first_id").limit(5)  # the five that are printed
    return rows.union(top.select(F.lit("top").alias("phase"), F.col("district").alias("metric"), "n"))


#: Rules with words that the invented texts hold, as many and in the same fields as a report's.
TYPE_RULES = [("licence", ["licensed under"]), ("secret", ["token ="]), ("shout", ["!!"]), ("contact", ["@"]), ("english", [" the "]), ("german", [" der "]), ("spanish", [" los "])]
LEVEL_RULES = [("public", ["src1"]), ("council", ["###"]), ("charity", ["that "]), ("community", [" und "]), ("trade", [" de "])]


def _rules_sql(rules, hay):
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({hay}, {w!r})' for w in words)} THEN '{k}'" for k, words in rules) + " END"


TYPE_SQL = _rules_sql(TYPE_RULES, "lower(concat_ws(' ', 'http://s/' || doc_id, 'T' || doc_id, source, left(coalesce(text, ''), 500)))")
LEVEL_SQL = _rules_sql(LEVEL_RULES, "lower(concat_ws(' ', 'T' || doc_id, source, left(coalesce(text, ''), 800)))")


def fallbacks(spark, d):
    title, url = F.concat(F.lit("T"), "doc_id"), F.concat(F.lit("http://s/"), "doc_id")
    return t(spark, d, "documents").select("doc_id", "lang", "text", report.keyword_class(url, title, F.col("source"), F.col("text"), TYPE_RULES, 500).alias("kind"), report.keyword_class(None, title, F.col("source"), F.col("text"), LEVEL_RULES, 800).alias("level"))


@query("x12_keyword_fallback", f"SELECT doc_id, {TYPE_SQL} AS kind, {LEVEL_SQL} AS level FROM documents")
def x12(spark, d):
    return fallbacks(spark, d).select("doc_id", "kind", "level")


@query("x13_resolved_class", f"SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'unknown' WHEN doc_id % 4 = 0 THEN 'food_bank' ELSE coalesce({TYPE_SQL}, 'unknown') END AS kind FROM documents")
def x13(spark, d):
    n = F.col("doc_id")
    answer = F.when(n % 4 == 0, "food_bank").when(n % 4 == 1, "unknown")
    return fallbacks(spark, d).select("doc_id", report.resolved(answer, F.col("kind"), n % 17 == 0).alias("kind"))


@query("x49_enriched_record", "SELECT doc_id, 'Ireland' AS country, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE source END AS district_name, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'exact' END AS match_type, CASE WHEN doc_id % 5 <> 0 THEN 51.5 END::DOUBLE AS lat, doc_id % 5 = 1 AS coords_approx, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'unknown') AS fsi_type, '' AS description, 2 AS phase FROM documents")
def x49(spark, d):
    n = F.col("doc_id")
    district = F.when(n % 3 != 0, F.struct(F.col("source").alias("district_name"), F.lit(None).cast("string").alias("district_code"), F.lit("exact").alias("match_type")))
    geo = F.when(n % 5 != 0, F.struct(F.lit(51.5).alias("lat"), F.lit(0.1).alias("lng"), (n % 5 == 1).alias("coords_approx")))
    record = F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"), F.col("text"), district.alias("district"), geo.alias("geo"), F.when(n % 2 == 0, F.col("lang")).alias("fsi_type"), F.lit(None).cast("string").alias("operational_level"), F.lit(None).cast("string").alias("description"))
    e = t(spark, d, "documents").select("doc_id", report.enriched(record, "Ireland", "Dublin").alias("e"))
    return e.select("doc_id", "e.location.country", "e.location.district_name", "e.location.match_type", "e.location.lat", "e.location.coords_approx", "e.fsi_type", "e.description", "e.phase")


ASKED = ["geographic_distribution", "fsi_types", "operational_levels", "popularity", "notable_initiatives", "district_summaries"]


@query("x50_summary_schema", "WITH f(field, name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in report.SUMMARY_FIELDS.items()) + f"), s AS (SELECT DISTINCT source FROM documents) SELECT source, field, CASE WHEN name IN ({', '.join(map(repr, ASKED))}) THEN name || ' of ' || source ELSE '' END AS answer FROM s, f")
def x50(spark, d):
    """Answers to six questions as they come, in JSON; the summary's other fields are empty."""
    answers = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{q}": {{"query": "q", "mode": "global", "answer": "{q} of '), "source", F.lit('"}')) for q in ASKED]), F.lit("}"))
    s = t(spark, d, "documents").select("source").distinct().select("source", F.from_json(answers, "map<string,struct<query:string,mode:string,answer:string,error:string>>").alias("a"))
    return s.select("source", F.explode(report.summary_answers(F.col("a"))).alias("field", "answer"))


@query("x52_record_construction", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, url, substring(md5(url), 1, 12) || '.jpg' AS image, CASE WHEN page_id % 5 = 0 THEN 'bot_block' END AS error, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS n_images FROM pages")
def x52(spark, d):
    blocked = F.col("page_id") % 5 == 0
    image = F.struct(F.col("url").alias("source_url"), F.concat(F.substring(F.md5(F.col("url").cast("binary")), 1, 12), F.lit(".jpg")).alias("local_path"))
    record = F.struct(F.col("url"), text.title(F.col("html")).alias("title"), text.main_text(F.col("html")).alias("text"), F.lit("").alias("description"), F.lit(None).cast("string").alias("author"), F.when(blocked, F.array().cast("array<struct<source_url:string,local_path:string>>")).otherwise(F.array(image)).alias("images"), F.when(blocked, "bot_block").alias("error"), image.alias("first"))
    r = t(spark, d, "pages").select("page_id", record.alias("r"))
    return r.select("page_id", "r.title", "r.url", F.col("r.first.local_path").alias("image"), "r.error", F.size("r.images").alias("n_images"))


FACTS = ["n", "longest", "kinds"]
SECTIONS = {"geographic": ("Describe where the groups are.", ["n"]), "types": ("Describe their kinds.", ["kinds", "n"]), "operational": ("Describe who runs them.", ["n"]), "reach": ("Describe their reach.", ["longest"]), "digital": ("", ["n", "longest"]), "notable": ("Name what stands out.", FACTS)}


@query("x43_section_prompts", "WITH f AS (SELECT source, count(*) AS n, max(n_chars) AS longest, count(DISTINCT lang) AS kinds FROM documents GROUP BY 1) " + " UNION ALL ".join(f"SELECT source, '{name}' AS section, {w} AS ablated, {repr(i) + ' || chr(10) || ' if not w else ''}" + " || chr(10) || ".join(f"'- {c}: ' || {c}" for c in cs) + " AS prompt FROM f" for name, (i, cs) in SECTIONS.items() for w in (False, True)))
def x43(spark, d):
    f = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("kinds"))
    full, bare = (report.section_prompts(f, "source", SECTIONS, w).withColumn("ablated", F.lit(not w)) for w in (True, False))
    return full.union(bare)


NOTES = {"en": "Write in British English.", "de": "Schreibe auf Deutsch.", "es": "Escribe en español."}


@query("x44_language_note", "SELECT lang, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTES.items()) + " ELSE '' END AS note, count(*) AS n FROM documents GROUP BY ALL")
def x44(spark, d):
    notes = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.coalesce(notes[F.col("lang")], F.lit("")).alias("note"), "n")


@query("t08_previews", "SELECT doc_id, " + ", ".join(f"md5(left(coalesce(text, ''), {n})) AS first_{n}" for n in (200, 500, 600, 800, 1000)) + " FROM documents")
def t08(spark, d):
    cut = lambda n: F.md5(F.substring(F.coalesce("text", F.lit("")), 1, n).cast("binary")).alias(f"first_{n}")
    return t(spark, d, "documents").select("doc_id", *map(cut, (200, 500, 600, 800, 1000)))


@query("k12_chart_tables", f"SELECT 'bar' AS chart, kind AS label, count(*) AS value FROM {RECORDS} GROUP BY kind UNION ALL SELECT 'donut', (score // 5)::VARCHAR, count(*) FROM {RECORDS} GROUP BY score // 5 UNION ALL SELECT 'choropleth', district, n FROM {SIZES}")
def k12(spark, d):
    """The tables behind a report's charts: bars by kind, a ring by score class, a map by district."""
    r = records(spark, d)
    n = lambda chart, label: r.groupBy(label.cast("string").alias("label")).agg(F.count("*").alias("value")).select(F.lit(chart).alias("chart"), "label", "value")
    return n("bar", F.col("kind")).union(n("donut", F.floor(F.col("score") / 5))).union(n("choropleth", F.col("district")))


@query("k14_anomalies", "SELECT 'labels' AS section, 'quality equals toxic' AS summary, count(*) AS evidence FROM labels WHERE quality = toxic HAVING count(*) > 0 UNION ALL SELECT 'documents', 'no text', count(*) FROM documents WHERE coalesce(text, '') = '' HAVING count(*) > 0 UNION ALL SELECT 'pages', 'address twice', count(*) FROM (SELECT url FROM pages GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def k14(spark, d):
    """Anomalies gathered by section; checks that find nothing leave no row."""
    def found(section, summary, rows):
        return rows.agg(F.count("*").alias("evidence")).filter("evidence > 0").select(F.lit(section).alias("section"), F.lit(summary).alias("summary"), "evidence")

    twice = t(spark, d, "pages").groupBy("url").agg(F.count("*").alias("n")).filter("n > 1")
    return found("labels", "quality equals toxic", t(spark, d, "labels").filter("quality = toxic")).unionByName(found("documents", "no text", t(spark, d, "documents").filter("coalesce(text, '') = ''"))).unionByName(found("pages", "address twice", twice))


@query("k15_sample_manifest", "WITH s AS (SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':k15'), doc_id) AS rn FROM documents) WHERE rn <= 5) SELECT source, count(*) AS n, 'k15' AS seed, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids_sha256 FROM s GROUP BY source")
def k15(spark, d):
    s = corpus.hash_sample(t(spark, d, "documents").select("source", "doc_id"), "doc_id", ["source"], 5, "k15")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return s.groupBy("source").agg(F.count("*").alias("n"), ids.alias("ids")).select("source", "n", F.lit("k15").alias("seed"), "ids", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"))


@query("k16_replicate_plan", "SELECT source, condition, replicate::INT AS replicate FROM (SELECT DISTINCT source FROM documents), (VALUES ('full'), ('b1')) c(condition), generate_series(1, 3) r(replicate) WHERE NOT (length(source) % 2 = 0 AND condition = 'full' AND replicate < 3)")
def k16(spark, d):
    """The grid of groups, conditions and replicates, without the runs that exist."""
    cities = t(spark, d, "documents").select("source").distinct()
    runs = spark.createDataFrame([(c, r) for c in ("full", "b1") for r in (1, 2, 3)], "condition string, replicate int")
    grid = cities.crossJoin(F.broadcast(runs))  # six rows
    done = grid.filter((F.length("source") % 2 == 0) & (F.col("condition") == "full") & (F.col("replicate") < 3))
    return grid.join(done, ["source", "condition", "replicate"], "left_anti")


@query("u03_bag_union", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT lang FROM documents WHERE doc_id % 6 = 0) GROUP BY lang")
def u03(spark, d):
    part = lambda cond: t(spark, d, "documents").filter(cond).select("lang")
    return part("doc_id % 2 = 0").unionByName(part("doc_id % 2 = 1")).unionByName(part("doc_id % 6 = 0")).groupBy("lang").agg(F.count("*").alias("n"))


@query("u07_expected_files", "WITH e AS (SELECT source || '_' || lang AS name FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), c AS (SELECT DISTINCT source || '_' || lang AS name FROM documents WHERE doc_id % 5 = 0 UNION SELECT 'extra') (SELECT name, 'missing' AS what FROM (SELECT name FROM e EXCEPT SELECT name FROM c WHERE name IS NOT NULL)) UNION ALL (SELECT name, 'unexpected' FROM (SELECT name FROM c WHERE name IS NOT NULL EXCEPT SELECT name FROM e))")
def u07(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    langs = docs.select("lang").filter("lang IS NOT NULL").distinct()
    expected = docs.select("source").distinct().crossJoin(F.broadcast(langs)).select(F.concat_ws("_", "source", "lang").alias("name"))  # a few languages
    made = docs.filter("doc_id % 5 = 0 AND lang IS NOT NULL").select(F.concat_ws("_", "source", "lang").alias("name")).union(spark.createDataFrame([("extra",)], "name string"))
    return expected.subtract(made).withColumn("what", F.lit("missing")).union(made.subtract(expected).withColumn("what", F.lit("unexpected")))
