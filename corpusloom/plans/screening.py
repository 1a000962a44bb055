"""Queries on fetched pages, their coordinates, addresses in texts, subpages and images; the fetches are derived from `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import main_text, screening
from corpusloom.plans.common import DOMAIN, HOST, PATH, t
from corpusloom.plans.registry import query
from corpusloom.sources import readers

FETCHED = "(SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 > 5 THEN 200 END AS status, CASE page_id % 10 WHEN 1 THEN 'ssl' WHEN 2 THEN 'dns' WHEN 3 THEN 'refused' WHEN 4 THEN 'timeout' WHEN 5 THEN 'other' END AS error FROM pages)"


def fetched(spark, d):
    k = F.col("page_id") % 10
    return t(spark, d, "pages").select("page_id", "url", F.when(k == 0, 404).when(k > 5, 200).alias("status"), F.when(k == 1, "ssl").when(k == 2, "dns").when(k == 3, "refused").when(k == 4, "timeout").when(k == 5, "other").alias("error"))


@query("f06_liveness", f"SELECT page_id, url FROM {FETCHED} WHERE NOT coalesce(status = 404 OR error IN ('ssl', 'dns', 'refused'), false)")
def f06(spark, d):
    return fetched(spark, d).filter(screening.alive(F.col("status"), F.col("error"))).select("page_id", "url")


LISTED = "(SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE '51.' || page_id END AS lat, CASE WHEN page_id % 7 = 0 THEN '' ELSE '-0.' || page_id END AS lng FROM pages)"
FLAGGED = f"(SELECT page_id, url, CASE WHEN m THEN '' ELSE lat END AS lat, CASE WHEN m THEN '' ELSE lng END AS lng, CASE WHEN m THEN 'not_specified' ELSE 'provided' END AS coord_source, m AS needs_review FROM (SELECT *, coalesce(trim(lat) = '', true) OR coalesce(trim(lng) = '', true) AS m FROM {LISTED}))"


def listed(spark, d):
    k, p = F.col("page_id") % 6, F.col("page_id").cast("string")
    lat = F.when(k == 0, "").when(k == 1, F.lit(None)).when(k == 2, " ").otherwise(F.concat(F.lit("51."), p))
    return t(spark, d, "pages").select("page_id", "url", lat.alias("lat"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("-0."), p)).alias("lng"))


@query("f09_missing_coordinates", f"SELECT * FROM {FLAGGED}")
def f09(spark, d):
    return screening.flag_coordinates(listed(spark, d))


@query("a03_review_report", f"SELECT page_id // 1000 AS part, (count_if(lat = '') + count_if(needs_review))::BIGINT AS total_missing, 0::BIGINT AS resolved, count_if(needs_review)::BIGINT AS unresolved, md5(string_agg(CASE WHEN needs_review THEN url END, chr(10) ORDER BY page_id)) AS urls_md5 FROM {FLAGGED} GROUP BY 1")
def a03(spark, d):
    """A report's part for each thousand pages, as no task holds all its addresses. Rows for review count twice in total_missing,
    once as blank and once as unresolved, as the report counts them."""
    review = F.count_if("needs_review")
    listed_urls = F.transform(F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.struct("page_id", "url")))), lambda x: x["url"])
    return f09(spark, d).groupBy(F.floor(F.col("page_id") / 1000).alias("part")).agg((F.count_if(F.col("lat") == "") + review).alias("total_missing"), F.lit(0).cast("long").alias("resolved"), review.alias("unresolved"), F.when(review > 0, F.md5(F.array_join(listed_urls, "\n").cast("binary"))).alias("urls_md5"))


POSTCODE = r"\bD\d{1,2}[A-Z]?\s?[A-Z0-9]{4}\b"
SAID = "CASE page_id % 5 WHEN 0 THEN 'Write to D02 X285, please' WHEN 1 THEN 'We meet in the old Dublin market hall on Sundays' || repeat('.', 80) WHEN 2 THEN 'Nowhere' WHEN 3 THEN 'near D8 ' || page_id ELSE repeat('a', 70) || ' north of Dublin' END"
PLACES = [("D02 X285", 53.34, -6.25), ("We meet in the old Dublin market hall on Sundays............................", 53.36, -6.27), ("12 Green Street", 51.5, 0.1), ("Newtown", 52.0, 0.2), ("D02 X285 ", 0.0, 0.0)]
PLACES_SQL = "(VALUES " + ", ".join(f"('{q}', {a}::DOUBLE, {b}::DOUBLE)" for q, a, b in PLACES) + ") AS p(query, p_lat, p_lng)"


def places(spark):
    return spark.createDataFrame(PLACES, "query string, p_lat double, p_lng double")


@query("f10_fill_coordinates", rf"""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 50.0 + page_id % 7 END::DOUBLE AS lat, CASE WHEN page_id % 3 = 0 THEN 1.0 END::DOUBLE AS lng, {SAID} AS body FROM pages),
a AS (SELECT *, CASE WHEN lat IS NULL THEN coalesce(nullif(regexp_extract(body, '{POSTCODE}'), ''), nullif(trim(regexp_extract(body, '(.{{0,60}}(?:Dublin).{{0,60}})', 1)), '')) END AS address FROM s)
SELECT page_id, coalesce(lat, p_lat, 53.3498) AS lat, CASE WHEN lat IS NULL THEN coalesce(p_lng, -6.2603) ELSE lng END AS lng, lat IS NULL AND p_lat IS NULL AS coords_approx FROM a LEFT JOIN {PLACES_SQL} ON address = query""")
def f10(spark, d):
    known = F.col("page_id") % 3 == 0
    s = t(spark, d, "pages").select("page_id", F.when(known, 50.0 + F.col("page_id") % 7).cast("double").alias("lat"), F.when(known, F.lit(1.0)).alias("lng"), F.expr(SAID).alias("body"))
    return screening.fill_coordinates(s, places(spark), "body", POSTCODE, ["Dublin"], (53.3498, -6.2603)).select("page_id", "lat", "lng", "coords_approx")


LINKS = "(SELECT a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id IN (a.page_id + 1, a.page_id + 2))"


@query("f13_crawl", f"WITH s AS (SELECT url, min(page_id) AS seed FROM pages WHERE page_id % 7 = 0 GROUP BY 1), one AS (SELECT dst AS url, min(seed) AS seed FROM s JOIN {LINKS} ON src = s.url WHERE dst NOT IN (SELECT url FROM s) GROUP BY 1), two AS (SELECT dst AS url, min(seed) AS seed FROM one JOIN {LINKS} ON src = one.url WHERE dst NOT IN (SELECT url FROM s) AND dst NOT IN (SELECT url FROM one) GROUP BY 1) SELECT url, seed, 0 AS depth FROM s UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two")
def f13(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    to = p.select(F.explode(F.array(F.col("page_id") - 1, F.col("page_id") - 2)).alias("page_id"), F.col("url").alias("dst"))
    links = p.join(to, "page_id").select(F.col("url").alias("src"), "dst")
    return screening.crawl(p.filter("page_id % 7 = 0").select("url", F.col("page_id").alias("ord")), links, 2)


@query("f15_blog_payload", "SELECT page_id, (page_id % 4 = 0) AS is_blog, CASE WHEN page_id % 5 <> 3 THEN CASE WHEN page_id % 5 = 1 THEN 'About us' ELSE 'Post ' || page_id END END AS title, CASE WHEN page_id % 5 = 3 THEN NULL WHEN page_id % 5 = 1 THEN 'Only & text' || chr(10) || chr(10) || 'About us' ELSE 'Post ' || page_id || chr(10) || chr(10) || 'Only & text' || chr(10) || chr(10) || 'About us' END AS html, CASE WHEN page_id % 5 <> 3 THEN 1 END AS n_images FROM pages".replace("Only & text", "Only and text"))
def f15(spark, d):
    post = F.when(F.col("page_id") % 5 == 3, "{}").otherwise(F.concat(F.lit('{"posts": [{"title": "'), F.when(F.col("page_id") % 5 == 1, "").otherwise(F.concat(F.lit("<b>Post "), "page_id", F.lit("</b>"))), F.lit('", "content": "<p>Only and</p> text", "featured_image": "http://a/i.png"}], "pages": [{"title": "About us", "content": null, "featured_image": ""}]}')))
    host = F.when(F.col("page_id") % 4 == 0, "https://x.WordPress.com/a").otherwise("https://wordpress.com.example.org/")
    p = t(spark, d, "pages").select("page_id", F.endswith(F.lower(urls.netloc(host)), F.lit(".wordpress.com")).alias("is_blog"), screening.blog_payload(post).alias("b"))
    return p.select("page_id", "is_blog", "b.title", "b.html", F.when(F.col("b").isNotNull(), F.size("b.images")).alias("n_images"))


@query("f16_merge_subpages", "WITH p AS (SELECT page_id // 3 AS seed, page_id, url, CASE WHEN page_id % 4 = 0 OR page_id // 3 % 5 = 0 THEN NULL ELSE html END AS html, ['i' || page_id % 4, 'j' || page_id % 3] AS images FROM pages) SELECT seed, arg_min(url, page_id) AS url, md5(string_agg(html, chr(10) ORDER BY page_id)) AS html_md5, array_to_string(list_sort(list_distinct(flatten(list(images)))), ' ') AS images FROM p GROUP BY seed")
def f16(spark, d):
    seed = F.floor(F.col("page_id") / 3)
    html = F.when((F.col("page_id") % 4 == 0) | (seed % 5 == 0), F.lit(None)).otherwise(F.col("html"))
    p = t(spark, d, "pages").select(seed.alias("seed"), "page_id", "url", html.alias("html"), F.array(F.concat(F.lit("i"), F.col("page_id") % 4), F.concat(F.lit("j"), F.col("page_id") % 3)).alias("images"))
    return screening.merge_subpages(p, "seed", "page_id").select("seed", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"), F.array_join("images", " ").alias("images"))


BARE = r"trim(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("f20_rough_text", f"SELECT page_id, md5(left({BARE}, 2000)) AS text_md5 FROM pages")
def f20(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.rough_text(F.col("html")).cast("binary")).alias("text_md5"))


VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query("f18_main_text", rf"""WITH m AS (SELECT page_id, {VISIBLE.format("coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), ''), '')")} AS main, {VISIBLE.format('html')} AS whole, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)
SELECT page_id, title, md5(CASE WHEN length(main) < 100 AND length(whole) > length(main) THEN whole ELSE main END) AS text_md5 FROM m""")
def f18(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", text.title(F.col("html")).alias("title"), F.md5(text.main_text(F.col("html")).cast("binary")).alias("text_md5"))


#: Pages as they come, and bare of their articles' tags, so that only blocks tell what is main text.
BARE_PAGES = "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE regexp_replace(html, '</?article[^>]*>', '', 'g') END AS html FROM pages)"


def bare_pages(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "</?article[^>]*>", ""))
    return t(spark, d, "pages").select("page_id", html.alias("html"))


@query("f18_page_blocks", f"WITH {main_text.sql(BARE_PAGES)} SELECT page_id, block::BIGINT AS block, md5(text) AS text_md5, words::INT AS words, round(linked, 9) AS linked, heading, off, round(smoothed, 9) AS smoothed, kept FROM kept_blocks")
def f18_blocks(spark, d):
    """The blocks of all pages with their words, links and place, and whether they are main text."""
    found = main_text.kept(main_text.blocks(bare_pages(spark, d)))
    return found.select("page_id", "block", F.md5(F.col("text").cast("binary")).alias("text_md5"), "words", F.round("linked", 9).alias("linked"), "heading", "off", F.round("smoothed", 9).alias("smoothed"), "kept")


@query("f18_block_text", f"WITH {main_text.sql(BARE_PAGES)}, b AS (SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY block) FILTER (kept), '') AS main, string_agg(text, chr(10) ORDER BY block) AS whole FROM kept_blocks GROUP BY page_id) SELECT page_id, coalesce(CASE WHEN length(main) < {main_text.SHORT} AND length(whole) > length(main) THEN whole ELSE main END, '') AS text FROM pages LEFT JOIN b USING (page_id)")
def f18_block_text(spark, d):
    """The main text of all pages by the densities of their blocks."""
    return main_text.main_texts(bare_pages(spark, d))


ADDRESSED = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' 12 Green Street, based in Newtown. D02 X285 and Via Roma 7' WHEN 1 THEN ' in the Old Harbour area BN1 4GH, BN1 4GH, 08012' ELSE '' END"


def addressed(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", F.expr(ADDRESSED).alias("body"))


def _all_sql(forms) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(body, '{p}', {g})" for p, g in forms) + ")"


LISTED_CANDIDATES = f"(SELECT doc_id, i, c FROM (SELECT doc_id, c, min(i) AS i FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_all_sql(screening.ADDRESS_FORMS)} AS l FROM (SELECT doc_id, {ADDRESSED} AS body FROM documents))) GROUP BY ALL))"
FIRST_FIVE = f"(SELECT doc_id, c AS query, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM {LISTED_CANDIDATES} QUALIFY pos <= 5)"


@query("f21_address_candidates", f"SELECT doc_id, query, pos FROM {FIRST_FIVE}")
def f21(spark, d):
    c = addressed(spark, d).select("doc_id", F.posexplode(screening.address_candidates(F.col("body"))).alias("pos", "query"))
    return c.select("doc_id", "query", (F.col("pos") + 1).cast("long").alias("pos"))


@query("f22_geocode_priority", f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '51.5' WHEN doc_id % 3 = 1 THEN '' END AS lat, '0.25' AS lng FROM documents), h AS (SELECT doc_id, arg_min(p_lat, pos) AS lat, arg_min(p_lng, pos) AS lng, arg_min(query, pos) AS query FROM {FIRST_FIVE} JOIN {PLACES_SQL} USING (query) GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(g.lat, '') <> '' THEN try_cast(g.lat AS DOUBLE) ELSE h.lat END AS lat, CASE WHEN coalesce(g.lat, '') <> '' THEN 0.25::DOUBLE ELSE h.lng END AS lng, CASE WHEN coalesce(g.lat, '') <> '' THEN 'provided' WHEN h.lat IS NOT NULL THEN 'text_extracted' END AS source, CASE WHEN coalesce(g.lat, '') = '' THEN query END AS query FROM g LEFT JOIN h USING (doc_id)""")
def f22(spark, d):
    """Listed coordinates, else the first candidate in the text that the geocoder knows, else none."""
    a = addressed(spark, d).select("doc_id", screening.address_candidates(F.col("body")).alias("c"), F.when(F.col("doc_id") % 3 == 0, "51.5").when(F.col("doc_id") % 3 == 1, "").alias("own_lat"), F.lit("0.25").alias("own_lng"))
    hits = screening.first_answer(a, "doc_id", "c", places(spark).toDF("query", "lat", "lng"))
    given = (F.coalesce("own_lat", F.lit("")) != "") & (F.coalesce("own_lng", F.lit("")) != "")
    pick = lambda own, found: F.when(given, own).otherwise(found)
    j = a.join(hits, "doc_id", "left")
    return j.select("doc_id", pick(F.col("own_lat").try_cast("double"), F.col("lat")).alias("lat"), pick(F.col("own_lng").try_cast("double"), F.col("lng")).alias("lng"), pick(F.lit("provided"), F.when(F.col("lat").isNotNull(), "text_extracted")).alias("source"), pick(F.lit(None), F.col("query")).alias("query"))


@query("f26_coordinate_override", "SELECT p.page_id, CASE WHEN c.lat IS NOT NULL THEN c.lat ELSE 51.0 END AS lat, CASE WHEN c.lat IS NOT NULL THEN c.lng ELSE 0.5 END AS lng, CASE WHEN c.lat IS NOT NULL THEN 'csv' ELSE 'page' END AS origin FROM pages p LEFT JOIN (SELECT url, arg_max(page_id, page_id)::DOUBLE / 100 AS lat, -1.0::DOUBLE AS lng FROM pages WHERE page_id % 4 = 0 GROUP BY url) c USING (url)")
def f26(spark, d):
    """Curated coordinates replace those of the page as a whole; the last curated row of an address wins."""
    p = t(spark, d, "pages").select("page_id", "url")
    own = F.struct(F.lit(51.0).alias("lat"), F.lit(0.5).alias("lng"), F.lit("page").alias("origin"))
    curated = p.filter("page_id % 4 = 0").groupBy("url").agg((F.max("page_id").cast("double") / 100).alias("lat"))
    c = curated.select("url", F.struct("lat", F.lit(-1.0).alias("lng"), F.lit("csv").alias("origin")).alias("c"))
    return p.join(c, "url", "left").select("page_id", F.coalesce("c", own).alias("g")).select("page_id", "g.*")


COARSE = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN 51.5 WHEN 1 THEN 51.53 WHEN 2 THEN 51.531 WHEN 3 THEN NULL ELSE 51.0 END::DOUBLE AS lat, CASE WHEN page_id % 2 = 0 THEN -0.12 ELSE -0.1234 END::DOUBLE AS lng, 'old' AS source, page_id % 3 AS n FROM pages)"
COARSE_RULE = "coalesce(page_id % 5 IN (0, 1, 4) AND page_id % 2 = 0, false)"


def coarse(spark, d):
    k = F.col("page_id") % 5
    lat = F.when(k == 0, 51.5).when(k == 1, 51.53).when(k == 2, 51.531).when(k == 3, F.lit(None)).otherwise(51.0)
    return t(spark, d, "pages").select("page_id", lat.cast("double").alias("lat"), F.when(F.col("page_id") % 2 == 0, -0.12).otherwise(-0.1234).alias("lng"), F.lit("old").alias("source"), (F.col("page_id") % 3).alias("n"))


@query("f27_low_precision", f"SELECT page_id, {COARSE_RULE} AS low FROM {COARSE}")
def f27(spark, d):
    return coarse(spark, d).select("page_id", screening.low_precision(F.col("lat"), F.col("lng")).alias("low"))


def regeocode(spark, d):
    title = F.when(F.col("doc_id") % 5 == 0, "Newtown").when(F.col("doc_id") % 5 == 1, "Old Mill").otherwise(F.lit(None))
    country = F.when(F.col("doc_id") % 2 == 0, "Ireland").otherwise("United Kingdom")
    return addressed(spark, d).select("doc_id", screening.regeocode_candidates(F.col("body"), title, country).alias("c"))


RE_FORMS = f"""(SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 OR contains(whole, 'Dublin') THEN regexp_extract_all(whole, '{screening.EIRCODE}', 1) ELSE regexp_extract_all(whole, '{screening.UK_POSTCODE}', 1) END, regexp_extract_all(whole, '{screening.STREET}', 1), CASE WHEN doc_id % 5 = 1 THEN ['Old Mill'] ELSE [] END) AS l FROM (SELECT doc_id, coalesce(CASE doc_id % 5 WHEN 0 THEN 'Newtown' WHEN 1 THEN 'Old Mill' END, '') || chr(10) || {ADDRESSED} AS whole FROM documents))"""
RE_SIX = f"(SELECT doc_id, query, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (SELECT doc_id, query, min(i) AS i FROM (SELECT doc_id, unnest(l) AS query, generate_subscripts(l, 1) AS i FROM {RE_FORMS}) GROUP BY ALL) QUALIFY pos <= 6)"


@query("f28_regeocode_candidates", f"SELECT doc_id, query, pos FROM {RE_SIX}")
def f28(spark, d):
    c = regeocode(spark, d).select("doc_id", F.posexplode("c").alias("pos", "query"))
    return c.select("doc_id", "query", (F.col("pos") + 1).cast("long").alias("pos"))


@query("x56_first_answer", f"SELECT doc_id, arg_min(query, pos) AS query, arg_min(p_lat, pos) AS lat, arg_min(p_lng, pos) AS lng FROM {RE_SIX} JOIN {PLACES_SQL} USING (query) GROUP BY doc_id")
def x56(spark, d):
    return screening.first_answer(regeocode(spark, d), "doc_id", "c", places(spark).toDF("query", "lat", "lng"))


@query("f29_geo_merge", f"SELECT page_id, CASE WHEN {COARSE_RULE} THEN 52.125 ELSE lat END AS lat, CASE WHEN {COARSE_RULE} THEN 0.0625 ELSE lng END AS lng, CASE WHEN {COARSE_RULE} THEN 'text_extracted' ELSE source END AS source, n FROM {COARSE}")
def f29(spark, d):
    """Fields of an improved result over the old ones; fields that it lacks stay."""
    old = F.struct("lat", "lng", "source", "n")
    better = old.withField("lat", F.lit(52.125)).withField("lng", F.lit(0.0625)).withField("source", F.lit("text_extracted"))
    return coarse(spark, d).select("page_id", F.when(screening.low_precision(F.col("lat"), F.col("lng")), better).otherwise(old).alias("g")).select("page_id", "g.*")


@query("f23_usable_images", "WITH i AS (SELECT page_id, k, CASE WHEN (page_id + k) % 9 = 0 THEN 'data:x' ELSE 'http://h/' || page_id || '/' || k END AS url, 120 + (page_id * 7 + k * 31) % 300 AS width, 150 + (page_id * 5 + k * 17) % 200 AS height FROM pages, generate_series(0, 39) g(k)), g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM i WHERE k < 30 AND url LIKE 'http%' AND width >= 200 AND height >= 200) SELECT page_id, url, width, height FROM g WHERE rn <= 10")
def f23(spark, d):
    p = t(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    i = p.select("page_id", "k", F.when((F.col("page_id") + F.col("k")) % 9 == 0, "data:x").otherwise(F.concat(F.lit("http://h/"), "page_id", F.lit("/"), "k")).alias("url"), (120 + (F.col("page_id") * 7 + F.col("k") * 31) % 300).alias("width"), (150 + (F.col("page_id") * 5 + F.col("k") * 17) % 200).alias("height"))
    return screening.usable_images(i, "page_id", "k").select("page_id", "url", "width", "height")


@query("f24_image_near_dup", """WITH RECURSIVE i AS (SELECT page_id, page_id % 5 AS city, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS rn, (page_id * 2654435761) % 4096 AS bits FROM pages),
k AS (SELECT city, rn, [bits] AS kept, [page_id] AS ids FROM i WHERE rn = 1 UNION ALL SELECT i.city, i.rn, CASE WHEN list_bool_or(list_transform(kept, lambda b: bit_count(xor(b, i.bits)) < 4)) THEN kept ELSE list_append(kept, i.bits) END, CASE WHEN list_bool_or(list_transform(kept, lambda b: bit_count(xor(b, i.bits)) < 4)) THEN ids ELSE list_append(ids, i.page_id) END FROM k JOIN i ON i.city = k.city AND i.rn = k.rn + 1)
SELECT city, unnest(arg_max(ids, rn)) AS page_id FROM k GROUP BY city""")
def f24(spark, d):
    """Hashes of 12 bits here, so that they meet on small tables; fewer than 4 differing bits."""
    i = t(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("city"), (F.col("page_id") * F.lit(2654435761) % 4096).alias("bits"))
    return screening.drop_alike(i, "page_id", "bits", 4, ["city"], width=12).select("city", "page_id")


@query("f30_margin_box", "WITH p AS (SELECT page_id % 4 AS city, 51 + (page_id % 97) / 100.0::DOUBLE AS lat, (page_id % 89) / 100.0::DOUBLE AS lng FROM pages) SELECT city, round(min(lng) - 0.25 * (max(lng) - min(lng)), 9) AS min_lng, round(min(lat) - 0.25 * (max(lat) - min(lat)), 9) AS min_lat, round(max(lng) + 0.25 * (max(lng) - min(lng)), 9) AS max_lng, round(max(lat) + 0.25 * (max(lat) - min(lat)), 9) AS max_lat FROM p GROUP BY city")
def f30(spark, d):
    p = t(spark, d, "pages").select((F.col("page_id") % 4).alias("city"), (51 + (F.col("page_id") % 97) / F.lit(100.0)).alias("lat"), ((F.col("page_id") % 89) / F.lit(100.0)).alias("lng"))
    b = screening.margin_box(p, ["city"])
    return b.select("city", *[F.round(c, 9).alias(c) for c in b.columns[1:]])


ODD = "CASE page_id % 6 WHEN 0 THEN 'https://www.facebook.com/' || page_id WHEN 1 THEN 'http://a.org/x/y.PDF' WHEN 2 THEN 'http://a.org' WHEN 3 THEN 'http://a.org/' ELSE url END"


@query("f31_address_kinds", f"WITH u AS (SELECT page_id, {ODD} AS url FROM pages) SELECT page_id, regexp_extract({DOMAIN.format('url')}, '([^.]+[.][^.]+)$', 1) IN ({', '.join(map(repr, screening.SOCIAL_DOMAINS))}) AS social, regexp_extract(regexp_extract(lower({PATH.format('url')}), '([^/]+)/*$', 1), '^.+([.][^.]+)$', 1) IN ({', '.join(map(repr, screening.NON_HTML))}) AS non_html, replace({PATH.format('url')}, '/', '') = '' AS homepage FROM u")
def f31(spark, d):
    u = t(spark, d, "pages").select("page_id", F.expr(ODD).alias("url"))
    return u.select("page_id", urls.registrable_domain(F.col("url")).isin(*screening.SOCIAL_DOMAINS).alias("social"), urls.extension(F.col("url")).isin(*screening.NON_HTML).alias("non_html"), (urls.path_depth(F.col("url")) == 0).alias("homepage"))


LEDGER = "(SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Retained' ELSE 'Discarded' END AS decision, CASE page_id % 8 WHEN 1 THEN 'Page inaccessible' WHEN 2 THEN 'Server ERROR 500' WHEN 4 THEN 'policy page' WHEN 5 THEN NULL WHEN 7 THEN 'No readable text' ELSE 'duplicate of 1' END AS reason FROM pages)"


def ledger(spark, d):
    k = F.col("page_id") % 8
    reason = F.when(k == 1, "Page inaccessible").when(k == 2, "Server ERROR 500").when(k == 4, "policy page").when(k == 5, F.lit(None)).when(k == 7, "No readable text").otherwise("duplicate of 1")
    return t(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "Retained").otherwise("Discarded").alias("decision"), reason.alias("reason"))


@query("f32_access_failure", f"SELECT page_id, coalesce(regexp_matches(reason, '(?i){'|'.join(screening.ACCESS_FAILURES)}'), false) AS failed FROM {LEDGER}")
def f32(spark, d):
    return ledger(spark, d).select("page_id", screening.access_failure(F.col("reason")).alias("failed"))


SCRAPED = rf"(SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '/', '_', 'g') || '.html' AS name, {VISIBLE.format('html')} AS shown, {HOST.format('url')} AS host FROM pages WHERE page_id % 4 <> 1)"
ELIGIBLE = f"(SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '/', '_', 'g') || '.html' AS name, {HOST.format('url')} AS host FROM {LEDGER} WHERE decision = 'Discarded' AND coalesce(regexp_matches(reason, '(?i){'|'.join(screening.ACCESS_FAILURES)}'), false))"


def scraped(spark, d):
    return t(spark, d, "pages").filter("page_id % 4 <> 1").select(urls.raw_file(F.col("url")).alias("name"), F.length(text.visible_text(F.col("html"))).alias("chars"), urls.netloc(F.col("url")).alias("host"))


@query("j12_discarded_files", f"SELECT e.page_id, e.name, s.name IS NOT NULL AS found, length(s.shown)::INT AS chars FROM {ELIGIBLE} e LEFT JOIN {SCRAPED} s USING (name)")
def j12(spark, d):
    lost = ledger(spark, d).filter((F.col("decision") == "Discarded") & screening.access_failure(F.col("reason"))).withColumn("name", urls.raw_file(F.col("url")))
    files = scraped(spark, d).select("name", "chars", F.lit(True).alias("found"))
    return lost.join(files, "name", "left").select("page_id", "name", F.coalesce("found", F.lit(False)).alias("found"), "chars")


@query("a42_recall_check", f"WITH j AS (SELECT e.page_id, s.name IS NOT NULL AS found, length(s.shown) > 500 AS over, (SELECT count(*) FROM {SCRAPED} o WHERE o.host = e.host) - (s.name IS NOT NULL)::INT AS others FROM {ELIGIBLE} e LEFT JOIN {SCRAPED} s USING (name)) SELECT count(*) AS n, count_if(found)::BIGINT AS n_found, count_if(over)::BIGINT AS n_over, sum(others)::BIGINT AS same_host, round(100.0::DOUBLE * count_if(over) / count(*), 1) AS pct_over FROM j")
def a42(spark, d):
    """Discarded pages that were in fact captured: file there, more than 500 characters, other pages of the host."""
    j = j12(spark, d).join(t(spark, d, "pages").select("page_id", urls.netloc(F.col("url")).alias("host")), "page_id")
    hosts = scraped(spark, d).groupBy("host").agg(F.count("*").alias("n_host"))
    j = j.join(hosts, "host", "left").withColumn("others", F.coalesce("n_host", F.lit(0)) - F.col("found").cast("int"))
    over = F.count_if(F.col("chars") > 500)
    return j.agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), over.alias("n_over"), F.sum("others").alias("same_host"), F.round(100.0 * over / F.count("*"), 1).alias("pct_over"))


PAGE_OF = "'<table><thead><tr><th>id</th><th>url</th></tr></thead><tbody><tr><td>' || page_id || '</td><td><a href=\"x\">' || url || '</a></td><td> ' || decision || '\n</td><td>' || coalesce(replace(reason, ' ', ' <i>x</i> '), '') || '</td></tr><tr><td>short</td></tr></tbody></table>'"


def ledger_pages(spark, d):
    return ledger(spark, d).withColumn("html", F.expr(PAGE_OF))


@query("s14_ledger_table", f"SELECT page_id, page_id::VARCHAR AS row_id, replace(url, '&', '&') AS url, decision, coalesce(replace(reason, ' ', ' x '), '') AS reason FROM {LEDGER} UNION ALL SELECT page_id, 'short', NULL, NULL, NULL FROM pages")
def s14(spark, d):
    return readers.ledger(ledger_pages(spark, d), "page_id", "html")


@query("s25_ledger_subsets", f"SELECT decision, count(*) AS n, count(DISTINCT url) AS urls FROM {LEDGER} GROUP BY decision")
def s25(spark, d):
    """Addresses and decisions alone, as some audits read a ledger."""
    rows = readers.ledger(ledger_pages(spark, d), "page_id", "html").select("url", "decision").filter("decision IS NOT NULL")
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


@query("s21_known_names", "SELECT DISTINCT trim(source || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END) AS name, length(trim(source))::BIGINT AS n FROM documents")
def s21(spark, d):
    return readers.known_names(t(spark, d, "documents").select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, " ").otherwise("")).alias("name")))


#: Reasons for leaving an address out, by patterns in this order.
REASONS = [("duplicate", "duplicate"), ("outside_city_or_region", "outside .*(city|region)|regional service"), ("archival_or_ended", "archival|explicitly ended|one-off"), ("inaccessible_or_directory_generic", "(?s)inaccessible.*directory, policy, campaign, commercial"), ("inaccessible_only", "inaccessible"), ("directory_policy_only", "directory|umbrella|policy|campaign")]


@query("x37_discard_reasons", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(reason, ''), '(?i){p}') THEN '{k}'" for k, p in REASONS) + f" ELSE 'other_or_unclassified' END AS bucket FROM {LEDGER}")
def x37(spark, d):
    reason = F.coalesce("reason", F.lit(""))
    return ledger(spark, d).select("page_id", text.first_match([(k, reason.rlike(f"(?i){p}")) for k, p in REASONS], "other_or_unclassified").alias("bucket"))


@query("x36_page_features", "SELECT page_id, len(regexp_extract_all(html, '(?i)<img[ >]'))::BIGINT AS images, len(regexp_extract_all(html, '(?i)<figure[ >]'))::BIGINT AS figures, len(regexp_extract_all(html, '(?i)<a [^>]*href'))::BIGINT AS links, regexp_matches(html, '(?i)class=\"?[^\">]*(map-box|charts-row)') AS has_map_or_charts, contains(html, '</table>') AS has_table FROM pages")
def x36(spark, d):
    h = F.col("html")
    n = lambda p: F.coalesce(F.regexp_count(h, F.lit(p)), F.lit(0)).cast("long")
    return t(spark, d, "pages").select("page_id", n("(?i)<img[ >]").alias("images"), n("(?i)<figure[ >]").alias("figures"), n("(?i)<a [^>]*href").alias("links"), h.rlike('(?i)class="?[^">]*(map-box|charts-row)').alias("has_map_or_charts"), F.contains(h, F.lit("</table>")).alias("has_table"))


@query("a63_multimodal_audit", "SELECT coalesce(city::VARCHAR, 'pooled') AS city, sum(links)::BIGINT AS links, sum(tables)::BIGINT AS tables, count_if(links > 5)::BIGINT AS rich FROM (SELECT page_id % 5 AS city, len(regexp_extract_all(html, '(?i)<a [^>]*href')) AS links, contains(html, '</table>')::INT AS tables FROM pages) GROUP BY ROLLUP (city)")
def a63(spark, d):
    f = x36(spark, d).select((F.col("page_id") % 5).cast("string").alias("city"), "links", F.col("has_table").cast("int").alias("tables"))
    out = f.rollup("city").agg(F.sum("links").alias("links"), F.sum("tables").alias("tables"), F.count_if(F.col("links") > 5).alias("rich"))
    return out.withColumn("city", F.coalesce("city", F.lit("pooled")))


@query("x39_answer_repair", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'garden' WHEN 2 THEN 'swap' ELSE 'unknown' END AS kind, 2 AS n FROM pages")
def x39(spark, d):
    """Answers in fences, after words, as one object, or as none: the first array, else the first object, else the default."""
    k = F.col("page_id") % 4
    said = F.when(k == 0, '```json\n[{"fsi_type": "bank"}, {"fsi_type": "late"}]\n```').when(k == 1, 'Sure: {"fsi_type": "garden"} as asked').when(k == 2, ' {"fsi_type": "swap"}').otherwise("I cannot tell")
    a = t(spark, d, "pages").select("page_id", text.repaired_answers(said, "fsi_type string", 2).alias("a"))
    return a.select("page_id", F.coalesce(F.get("a", 0)["fsi_type"], F.lit("unknown")).alias("kind"), F.size("a").alias("n"))
