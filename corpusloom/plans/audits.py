"""Queries on sentences, stated numbers, disagreement, unions and record texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import claims, report
from corpusloom.plans.common import POINTS_SQL, points, t
from corpusloom.plans.documents import JUDGED, TURNS, a51, judged
from corpusloom.plans.registry import query

FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query("x18_sentences", rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({FLAT}, '([.!?])\s+([A-Z"“(‘’])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, unnest(generate_series(0, len(s) - 1))::INT AS pos, md5(unnest(s)) AS sentence_md5 FROM s WHERE len(s) > 0""")
def x18(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.posexplode(claims.sentences(F.col("text"))).alias("pos", "s"))
    return s.select("doc_id", "pos", F.md5(F.col("s").cast("binary")).alias("sentence_md5"))


COUNTS = "(SELECT k, n, total, n * 100 // total + n % 3 AS p FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1), (SELECT count(*) AS total FROM orders))"


def stated(spark, d):
    """Sentences that state the orders of a priority in all shapes, some wrongly: k, total, n, p, body."""
    o = t(spark, d, "orders")
    by = o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))
    by = by.withColumn("p", F.expr("n * 100 div total + n % 3"))
    return by.withColumn("body", F.expr("concat(n, ' of ', total, ' kept orders (', p, '%) came first. ', n, ' of the ', total, ' orders, or ', p, '%, came late. ', n, ' orders (', p, '%) shipped.')"))


@query("x23_count_percent", f"SELECT k, shape, n::DOUBLE AS n, total::DOUBLE AS whole, p::DOUBLE AS stated, round(100 * n::DOUBLE / total, 6) AS actual FROM {COUNTS}, (VALUES ('of_whole_in_brackets'), ('of_whole_after_comma'), ('of_total')) s(shape) WHERE abs(p - 100 * n::DOUBLE / total) > 0.55")
def x23(spark, d):
    """The SQL computes from the numbers that the sentences were made of."""
    return claims.count_percent_mismatches(stated(spark, d), "k", "body", "total").withColumn("actual", F.round("actual", 6))


PHRASES = "CASE WHEN n % 3 = 0 THEN {0} || ' sharing groups were found' WHEN n % 3 = 1 THEN 'Screening outcome: ' || {0} || ' of ' || total || ' URLs retained.' ELSE 'Screening outcome: ' || {0} || ' of the ' || total || ' input URLs were retained.' END"


@query("x27_stated_total", f"SELECT k, n AS stated FROM {COUNTS}")
def x27(spark, d):
    return stated(spark, d).withColumn("body", F.expr(PHRASES.format("format_number(n, 0)"))).select("k", claims.stated_total(F.col("body"), "sharing groups").alias("stated"))


@query("x57_stated_outcome", f"SELECT k, CASE WHEN n % 3 <> 0 THEN n END AS retained, CASE WHEN n % 3 <> 0 THEN total END AS total FROM {COUNTS}")
def x57(spark, d):
    found = stated(spark, d).withColumn("body", F.expr(PHRASES.format("n"))).select("k", claims.stated_outcome(F.col("body")).alias("o"))
    return found.select("k", "o.retained", "o.total")


#: The box of each fifteenth of the pages, by their points.
PAGE_BOXES = f"(SELECT page_id % 15 AS name, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) * (1 + page_id % 15 / 10.0::DOUBLE) AS max_lng, max(lat) AS max_lat FROM {POINTS_SQL} WHERE lat IS NOT NULL GROUP BY page_id % 15)"


@query("x34_box_accept", f"""SELECT a.name AS a, b.name AS b, round(((b.max_lng - b.min_lng) * (b.max_lat - b.min_lat)) / ((a.max_lng - a.min_lng) * (a.max_lat - a.min_lat)), 6) AS ratio FROM {PAGE_BOXES} a JOIN {PAGE_BOXES} b ON a.name <> b.name AND a.min_lng <= b.max_lng AND b.min_lng <= a.max_lng AND a.min_lat <= b.max_lat AND b.min_lat <= a.max_lat
WHERE ((b.max_lng - b.min_lng) * (b.max_lat - b.min_lat)) / ((a.max_lng - a.min_lng) * (a.max_lat - a.min_lat)) BETWEEN 0.8 AND 1.5""")
def x34(spark, d):
    """Boxes that another would replace: they meet, and their areas are of one order. Fifteen boxes, made of the points of all pages."""
    p = points(spark, d).filter("lat IS NOT NULL").groupBy((F.col("page_id") % 15).alias("name"))
    held = p.agg(F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))
    held = held.withColumn("max_lng", F.col("max_lng") * (1 + F.col("name") / 10))
    a, b = held.alias("a"), F.broadcast(held).alias("b")
    ratio = F.expr("(b.max_lng - b.min_lng) * (b.max_lat - b.min_lat) / ((a.max_lng - a.min_lng) * (a.max_lat - a.min_lat))")
    meet = F.expr("a.name <> b.name AND a.min_lng <= b.max_lng AND b.min_lng <= a.max_lng AND a.min_lat <= b.max_lat AND b.min_lat <= a.max_lat")
    return a.join(b, meet).filter(ratio.between(0.8, 1.5)).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.round(ratio, 6).alias("ratio"))


@query("x41_prompt", r"SELECT doc_id, md5('Classify this FSI:' || chr(10) || chr(10) || 'T' || doc_id || chr(10) || left(regexp_replace(left(CASE WHEN doc_id % 3 = 0 THEN '' ELSE repeat(source || ' ', 60) END, 200) || chr(10) || left(coalesce(text, ''), 800), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), 1000)) AS prompt_md5 FROM documents")
def x41(spark, d):
    """A record's title, the starts of its description and text, and no more than a thousand characters of both."""
    description = F.when(F.col("doc_id") % 3 != 0, F.repeat(F.concat("source", F.lit(" ")), F.lit(60)))
    prompt = report.classification_prompt(F.concat(F.lit("T"), "doc_id"), description, F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query("x42_record_text", "SELECT doc_id, md5(concat_ws(chr(10), '# ' || source, 'Language: ' || lang, 'Length: ' || n_chars, '', 'Full text:', coalesce(text, ''))) AS record_md5 FROM documents")
def x42(spark, d):
    head = lambda k, c: F.concat(F.lit(k), c)
    record = F.concat_ws("\n", head("# ", F.col("source")), head("Language: ", F.col("lang")), head("Length: ", F.col("n_chars")), F.lit(""), F.lit("Full text:"), F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", F.md5(record.cast("binary")).alias("record_md5"))


NUMBER = "([0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?%?)"


@query("x45_number_form", f"SELECT DISTINCT raw, regexp_replace(replace(replace(raw, ',', ''), '%', ''), '[.]0$', '') AS plain FROM (SELECT unnest(regexp_extract_all(text, '{NUMBER}')) AS raw FROM documents)")
def x45(spark, d):
    raw = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1))).alias("raw")).distinct()
    return raw.select("raw", F.regexp_replace(F.regexp_replace("raw", "[,%]", ""), "[.]0$", "").alias("plain"))


@query("u05_numbers_not_allowed", f"SELECT DISTINCT raw FROM (SELECT unnest(regexp_extract_all(text, '{NUMBER}')) AS raw FROM documents) WHERE raw NOT IN (SELECT n_nationkey::VARCHAR FROM nation)")
def u05(spark, d):
    raw = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1))).alias("raw")).distinct()
    return raw.join(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("raw")), "raw", "left_anti")


@query("u02_in_all_turns", f"WITH s AS (SELECT * FROM {TURNS}), n AS (SELECT role, count(DISTINCT turn) AS k FROM s GROUP BY role) SELECT s.role, word FROM s JOIN n USING (role) GROUP BY s.role, word, k HAVING count(DISTINCT turn) = k")
def u02(spark, d):
    return a51(spark, d).filter("note = 'stable'").select("role", "word")


@query("u04_aligned_union", "SELECT 'summary' AS kind, lang, count(*) AS n, NULL::BIGINT AS doc_id FROM documents GROUP BY lang UNION ALL SELECT 'row', NULL, NULL, doc_id FROM labels WHERE quality = toxic")
def u04(spark, d):
    summary = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("kind", F.lit("summary"))
    rows = t(spark, d, "labels").filter("quality = toxic").select(F.lit("row").alias("kind"), "doc_id")
    return summary.unionByName(rows, allowMissingColumns=True)


@query("u06_symmetric_difference", "(SELECT doc_id, 'documents' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def u06(spark, d):
    a, b = t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("only_in", F.lit("documents")).union(b.join(a, "doc_id", "left_anti").withColumn("only_in", F.lit("labels")))


@query("u08_ordered_distinct", r"WITH w AS (SELECT doc_id, p.w, p.i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), unnest(ws) WITH ORDINALITY AS p(w, i)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5 FROM f GROUP BY doc_id")
def u08(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return t(spark, d, "documents").select("doc_id", words.alias("w")).filter("size(w) > 0").select("doc_id", F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@query("a34_confusion_pairs", f"SELECT source, quality, rule, count(*) AS n FROM {JUDGED} GROUP BY ALL")
def a34(spark, d):
    return judged(spark, d).groupBy("source", "quality", "rule").agg(F.count("*").alias("n"))


@query("a39_directionality", f"WITH c AS (SELECT source, count_if(quality = 1 AND rule = 0)::BIGINT AS kept_only, count_if(quality = 0 AND rule = 1)::BIGINT AS dropped_only FROM {JUDGED} GROUP BY source) SELECT *, CASE WHEN kept_only + dropped_only > 0 THEN round(100.0::DOUBLE * kept_only / (kept_only + dropped_only), 1) END AS pct FROM c")
def a39(spark, d):
    kept, dropped = F.count_if((F.col("quality") == 1) & (F.col("rule") == 0)), F.count_if((F.col("quality") == 0) & (F.col("rule") == 1))
    c = judged(spark, d).groupBy("source").agg(kept.alias("kept_only"), dropped.alias("dropped_only"))
    n = F.col("kept_only") + F.col("dropped_only")
    return c.withColumn("pct", F.when(n > 0, F.round(100.0 * F.col("kept_only") / n, 1)))


@query("a40_coverage", f"SELECT coalesce(source, 'pooled') AS source, count(*) AS n, sum(quality)::BIGINT AS kept, round(100.0::DOUBLE * sum(quality) / count(*), 1) AS pct FROM {JUDGED} GROUP BY ROLLUP (source)")
def a40(spark, d):
    kept = F.sum("quality")
    return judged(spark, d).rollup("source").agg(F.count("*").alias("n"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 1).alias("pct")).withColumn("source", F.coalesce("source", F.lit("pooled")))


@query("a49_numeric_summary", "SELECT CASE WHEN grouping(source) = 1 THEN 'pooled' ELSE source END AS source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY GROUPING SETS ((source, lang), (lang))")
def a49(spark, d):
    sets = t(spark, d, "documents").groupingSets([["source", "lang"], ["lang"]], "source", "lang").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return sets.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col("source")).alias("source"), "lang", "n", "mean", "low", "high")
