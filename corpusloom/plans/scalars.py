"""Queries on single functions: addresses, words, numbers, popularity, similarity, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import geo, text, urls
from corpusloom.operators import claims, corpus, languages
from corpusloom.operators.ordered import order_statistics, written
from corpusloom.plans.audits import COUNTS, stated
from corpusloom.plans.common import DOMAIN, HOST, PATH, POINTS_SQL, URLS_SQL, points, t, url_list
from corpusloom.plans.documents import HINT_SQL, HINTS
from corpusloom.plans.numbers import CLAIMS, EVIDENCE, x21
from corpusloom.plans.registry import query
from corpusloom.plans.web import a17


@query("a04_thresholds", "SELECT source, list_sort(list(n_chars))[(floor(0.25 * count(*)) + 1)::INT] AS low, list_sort(list(n_chars))[(floor(0.75 * count(*)) + 1)::INT] AS high FROM documents GROUP BY source")
def a04(spark, d):
    return order_statistics(t(spark, d, "documents"), "n_chars", {"low": 0.25, "high": 0.75}, ["source"])


@query("a20_pooled_row", f"SELECT 'ALL_POOLED' AS grp, count(*) AS n_rows, count(DISTINCT url) AS n_urls, count(DISTINCT {DOMAIN.format('url')}) AS n_domains FROM pages")
def a20(spark, d):
    """The row of all groups, recomputed on their rows together."""
    return a17(spark, d).filter("grp = 'ALL_POOLED'").select("grp", "n_rows", "n_urls", "n_domains")


@query("w01_first_occurrence", f"SELECT {DOMAIN.format('url')} AS domain, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def w01(spark, d):
    p = t(spark, d, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"))
    return corpus.first_per_key(p, F.col("domain"), "page_id").select("domain", "page_id", "url")


@query("x03_host_and_path", f"SELECT ord, {HOST.format('url')} AS host, {PATH.format('url')} AS path FROM {URLS_SQL}")
def x03(spark, d):
    return url_list(spark, d).select("ord", urls.netloc(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


@query("x05_path_depth", f"SELECT ord, len(list_filter(string_split({PATH.format('url')}, '/'), lambda x: x <> ''))::BIGINT AS depth FROM {URLS_SQL}")
def x05(spark, d):
    return url_list(spark, d).select("ord", urls.path_depth(F.col("url")).alias("depth"))


NAMED_FILE = "url || CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/x.tar.gz/' WHEN 3 THEN '/end.' ELSE '' END"


@query("x06_extension", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 2 THEN '.gz' WHEN 4 THEN CASE WHEN regexp_matches(url, '[.]html([?#]|$)') THEN '.html' ELSE '' END ELSE '' END AS ext FROM pages")
def x06(spark, d):
    plain = F.regexp_replace("url", "[?#].*$", "")
    return t(spark, d, "pages").withColumn("url", plain).select("page_id", urls.extension(F.expr(NAMED_FILE)).alias("ext"))


@query("x07_decimal_places", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN length(doc_id::VARCHAR) ELSE 3 END::BIGINT AS places FROM documents")
def x07(spark, d):
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, " ").when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, F.concat(F.lit("1."), n)).otherwise(" -0.250 ")
    return t(spark, d, "documents").select("doc_id", urls.decimal_places(raw).alias("places"))


@query("x08_keyword_rule", r"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '\bthat\b') AS one_word, contains(lower(coalesce(text, '')), 'licensed under') AS phrase FROM documents")
def x08(spark, d):
    return t(spark, d, "documents").select("doc_id", text.keyword_present(F.col("text"), "that").alias("one_word"), text.keyword_present(F.col("text"), "licensed under").alias("phrase"))


HIGH, MEDIUM, LOW = ["the", "licensed under"], ["that", "token"], ["is"]
AMOUNTS = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' 250 meals and 12 people' WHEN 1 THEN ' 40 KG' WHEN 2 THEN ' 7 people' ELSE '' END"
HAS = lambda ws: " + ".join((f"contains(l, '{w}')" if " " in w else f"regexp_matches(l, '\\b{w}\\b')") + "::BIGINT" for w in ws)


@query("x09_popularity_score", f"WITH b AS (SELECT doc_id, {AMOUNTS} AS b, lower({AMOUNTS}) AS l FROM documents), s AS (SELECT doc_id, {HAS(HIGH)} AS high, {HAS(MEDIUM)} AS medium, {HAS(LOW)} AS low, length(b)::BIGINT AS text_length, coalesce(list_max(list_transform(regexp_extract_all(b, '(?i)\\b(\\d{{2,6}})\\s*(?:people|members|volunteers|families|meals|kg|tonnes)', 1), lambda x: x::BIGINT)), 0) AS max_quantity FROM b) SELECT doc_id, max_quantity, high, medium, low, text_length, max_quantity > 0 AS has_numbers, (3 * high + medium - low + 2 * (max_quantity > 100)::INT + (max_quantity > 10)::INT + (text_length > 1000)::INT)::BIGINT AS score FROM s")
def x09(spark, d):
    p = t(spark, d, "documents").select("doc_id", corpus.popularity(F.expr(AMOUNTS), HIGH, MEDIUM, LOW).alias("p"))
    return p.select("doc_id", "p.*")


@query("x11_keyword_count", "SELECT doc_id, (contains(lower(coalesce(text, '')), 'the ')::INT + contains(lower(coalesce(text, '')), 'token')::INT + contains(lower(coalesce(text, '')), '@')::INT)::BIGINT AS n, contains(lower(coalesce(text, '')), 'the ') OR contains(lower(coalesce(text, '')), 'token') OR contains(lower(coalesce(text, '')), '@') AS any_of FROM documents")
def x11(spark, d):
    words = ["the ", "token", "@"]
    return t(spark, d, "documents").select("doc_id", text.distinct_keywords(F.col("text"), words).alias("n"), text.any_keyword(F.col("text"), words).alias("any_of"))


SAID = "(SELECT k, 'Of ' || total || ', ' || n || ' are (' || p || '.5%) 7th' AS body, total, n, p FROM " + COUNTS + ")"


@query("x16_number_tokens", f"SELECT k, unnest([total::VARCHAR, n::VARCHAR, p || '.5%']) AS raw, unnest([total, n, p + 0.5])::DOUBLE AS value, unnest([false, false, true]) AS is_pct, unnest([3, 5 + length(total::VARCHAR), 11 + length(total::VARCHAR) + length(n::VARCHAR)])::BIGINT AS start FROM {SAID}")
def x16(spark, d):
    """Numbers with value and place; the SQL computes the places from the numbers' lengths."""
    s = stated(spark, d).select("k", F.concat(F.lit("Of "), "total", F.lit(", "), "n", F.lit(" are ("), "p", F.lit(".5%) 7th")).alias("body"))
    return s.select("k", F.explode(claims.number_tokens(F.col("body"))).alias("x")).select("k", "x.raw", "x.value", "x.is_pct", "x.start")


@query("x22_claim_labels", f"WITH e AS ({EVIDENCE}), c AS (SELECT DISTINCT round(v) AS v FROM {CLAIMS}) SELECT v, CASE WHEN v IN (SELECT e.v FROM e WHERE kind = 'value') THEN 'DIRECT' WHEN v IN (SELECT round(e.v, 6) FROM e WHERE kind = 'sum') THEN 'DERIVED' ELSE 'NOT_MACHINE_AUDITABLE' END AS label FROM c")
def x22(spark, d):
    """Labels of plain numbers, each once."""
    c = t(spark, d, "lineitem").select(F.round(F.col("l_quantity") * (1 + F.col("l_orderkey") % 40)).alias("v")).distinct()
    claims_ = c.select(F.col("v").alias("claim_id"), "v", F.lit(False).alias("is_pct"))
    return corpus.label_claims(claims_, x21(spark, d)).select(F.col("claim_id").alias("v"), "label")


@query("x29_text_similarity", "SELECT DISTINCT source, round(2.0::DOUBLE * length(source) / (2 * length(source) + 3), 4) AS longer, 1.0::DOUBLE AS same FROM documents")
def x29(spark, d):
    """The ratio of a name with itself and with three more characters, which SQL can tell; others are tested."""
    s = t(spark, d, "documents").select("source").distinct().withColumn("more", F.concat("source", F.lit("xyz")))
    return s.select("source", claims.similarity("source", "more").alias("longer"), claims.similarity("source", "source").alias("same"))


@query("x32_haversine", f"SELECT page_id, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(53.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(53.0)) * pow(sin(radians(-6.0 - lng) / 2), 2))), 3) AS metres FROM {POINTS_SQL} WHERE lat IS NOT NULL")
def x32(spark, d):
    p = points(spark, d).filter("lat IS NOT NULL")
    return p.select("page_id", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(53.0), F.lit(-6.0)), 3).alias("metres"))


@query("x51_detected_language", f"SELECT doc_id, CASE WHEN doc_id % 8 = 0 OR length(coalesce(text, '')) < 20 THEN 'unknown' ELSE hint END AS language FROM documents JOIN {HINT_SQL} USING (doc_id)")
def x51(spark, d):
    """The hint of a page's text; unknown for pages that can't be reached or have next to no text."""
    body = F.coalesce("text", F.lit(""))
    reached = (F.col("doc_id") % 8 != 0) & (F.length(body) >= 20)
    return t(spark, d, "documents").select("doc_id", F.when(reached, text.language_hint(F.col("text"), HINTS)).otherwise("unknown").alias("language"))


@query("x58_stored_length", "SELECT doc_id, length(coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, ''))::BIGINT AS n FROM documents")
def x58(spark, d):
    body = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.length(F.coalesce(body, F.lit(""))).cast("long").alias("n"))


#: Rows whose language is learnt from, and all rows, of which some can't be reached.
LEARNT = "(SELECT lang, text FROM documents WHERE doc_id % 5 <> 0)"
REACHED = "(SELECT doc_id AS key, CASE WHEN doc_id % 17 <> 0 THEN text END AS text FROM documents)"


def detected(spark, d, of="true"):
    """The language of the documents that `of` holds for, by profiles of four fifths of all documents."""
    docs = t(spark, d, "documents")
    table = written(languages.profiles(docs.filter("doc_id % 5 <> 0")), "profiles")
    return languages.detect(docs.filter(of), table, "doc_id", reachable=F.col("doc_id") % 17 != 0)


@query("x51_language_profiles", f"WITH {languages.sql(LEARNT, REACHED)} SELECT key AS doc_id, language, margin FROM detected")
def x51_profiles(spark, d):
    """The language of all documents by trigram profiles of four fifths of them; unreachable ones are unknown."""
    return detected(spark, d)


@query("x51_held_out_agreement", f"WITH {languages.sql(LEARNT, REACHED)} SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count_if(language = lang)::BIGINT AS agreed, count_if(language = 'unknown')::BIGINT AS unknown FROM detected JOIN documents ON doc_id = key WHERE doc_id % 5 = 0 GROUP BY 1")
def x51_agreement(spark, d):
    held = t(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id", "lang").join(detected(spark, d, "doc_id % 5 = 0"), "doc_id")
    return held.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("agreed"), F.count_if(F.col("language") == languages.UNKNOWN).alias("unknown"))
