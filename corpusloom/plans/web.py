"""Queries on address lists and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import corpus
from corpusloom.operators.ordered import running
from corpusloom.plans.common import DEDUP_KEY, DOMAIN, HOST, PATH, QUERY, URLS_SQL, t, url_list
from corpusloom.plans.registry import query

key, dom, host, path = DEDUP_KEY.format("url"), DOMAIN.format("url"), HOST.format("url"), PATH.format("url")
BLOCKED = "m\\.|blog.example.com|example.net/es"
RULES = (("host", r"^(m|blog)\."), ("query", r"\?"), ("anchor", "#"))


@query("f03_url_dedup_exact", f"SELECT ord, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM {URLS_SQL}) WHERE rn = 1")
def f03(spark, d):
    return corpus.first_per_key(url_list(spark, d), F.col("url"), "ord")


@query("f05_near_dup_flag", f"""WITH k AS (SELECT ord, url, {key} AS k FROM {URLS_SQL}), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn, first(url) OVER (PARTITION BY k ORDER BY ord) AS f FROM k)
SELECT ord, url, rn > 1 AS is_duplicate, CASE WHEN rn > 1 THEN f END AS duplicate_of FROM w""")
def f05(spark, d):
    return corpus.flag_near_duplicates(url_list(spark, d), "url", "ord")


@query("f04_blocklist", rf"SELECT page_id, url FROM pages WHERE NOT coalesce(regexp_matches(url, '(?i)m\.|blog.example.com|example.net/es'), false)")
def f04(spark, d):
    return t(spark, d, "pages").select("page_id", "url").filter(~F.coalesce(F.col("url").rlike(f"(?i){BLOCKED}"), F.lit(False)))


@query("f07_url_rules", f"""SELECT page_id, CASE WHEN regexp_matches({host}, '^(m|blog)\\.') THEN 'host' WHEN regexp_matches(url, '\\?') THEN 'query' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'ok' END AS reason FROM pages""")
def f07(spark, d):
    rules = [(n, (urls.netloc(F.col("url")) if n == "host" else F.col("url")).rlike(p)) for n, p in RULES]
    return t(spark, d, "pages").select("page_id", text.first_match(rules, "ok").alias("reason"))


@query("f08_text_signals", """WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, contains(lower(html), 'the ')::INT + contains(lower(html), 'que ')::INT + contains(lower(html), '&amp;')::INT AS score FROM pages)
SELECT page_id, title, score::BIGINT AS score, CASE WHEN score >= 2 THEN 'high' WHEN score = 1 THEN 'low' ELSE 'ok' END AS confidence FROM p""")
def f08(spark, d):
    score = text.distinct_keywords(F.col("html"), ["the ", "que ", "&amp;"])
    return t(spark, d, "pages").select("page_id", text.title(F.col("html")).alias("title"), score.alias("score"), F.when(score >= 2, "high").when(score == 1, "low").otherwise("ok").alias("confidence"))


#: The pages' links, which are paths, and some that are absolute, of other hosts, of the page itself, repeated, or no address.
LINKED = "'<a href=\"' || url || '\"><a href=\"' || regexp_extract(url, '^[a-z]+://[^/]*') || '/sub/#top\"><a href=\"//other.example.org/x\"><a href=\"mailto:a@b.c\"><a href=\"/sub\"><a href=\"#top\">' || html"
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("f12_internal_links", f"""WITH h AS (SELECT page_id, url, regexp_extract_all({LINKED}, 'href="([^"]*)"', 1) AS l FROM pages), l AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM h),
r AS (SELECT page_id, url, pos, regexp_replace(regexp_replace(CASE WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)') || href WHEN href LIKE '/%' THEN {ORIGIN} || href WHEN href LIKE '#%' THEN url WHEN href LIKE 'http%' THEN href END, '#.*$', ''), '/+$', '') AS href FROM l),
f AS (SELECT page_id, href, min(pos) AS pos FROM r WHERE starts_with(href || '/', {ORIGIN} || '/') AND href <> regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') GROUP BY page_id, href) SELECT page_id, href, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f) WHERE rn <= 5""")
def f12(spark, d):
    """The first five links on the page's host, resolved, without fragments, closing slashes and the page itself."""
    pages = t(spark, d, "pages").select("page_id", "url", F.expr(LINKED.replace("'^[a-z]+://[^/]*')", "'^[a-z]+://[^/]*', 0)")).alias("html"))
    links = pages.select("page_id", F.slice(urls.internal_links(F.col("url"), text.hrefs(F.col("html"))), 1, 5).alias("l"))
    return links.select("page_id", F.posexplode("l").alias("pos", "href")).select("page_id", "href", (F.col("pos") + 1).cast("long").alias("pos"))


#: Pages with a signal at the start, and in a title that comes late.
CHALLENGED = "CASE WHEN page_id % 9 = 0 THEN repeat(' ', 600) || '<title>Just a Moment...</title>' || html WHEN page_id % 9 = 1 THEN '<p>PLEASE WAIT</p>' || html WHEN page_id % 9 = 2 THEN repeat('x', 500) || 'captcha' || html ELSE html END"
SIGNALS = lambda c: " OR ".join(f"contains(lower({c}), '{w}')" for w in text.CHALLENGES)


@query("f14_bot_challenge", f"SELECT page_id, ({SIGNALS('left(h, 500)')}) OR ({SIGNALS('title')}) AS blocked FROM (SELECT page_id, h, regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM (SELECT page_id, {CHALLENGED} AS h FROM pages))")
def f14(spark, d):
    pages = t(spark, d, "pages").select("page_id", F.expr(CHALLENGED).alias("h"))
    return pages.select("page_id", text.challenged(F.col("h")).alias("blocked"))


@query("f17_file_slug", "SELECT page_id, substring(replace(regexp_replace(url, '^https?://', ''), '/', '_'), 1, 80) AS slug FROM pages")
def f17(spark, d):
    return t(spark, d, "pages").select("page_id", urls.file_slug(F.col("url")).alias("slug"))


@query("f19_visible_text_len", r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')))::BIGINT AS chars FROM pages""")
def f19(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(text.visible_text(F.col("html"))).cast("long").alias("chars"))


@query("f25_image_name", "SELECT page_id, substring(md5(url), 1, 12) AS name FROM pages")
def f25(spark, d):
    return t(spark, d, "pages").select("page_id", F.substring(F.md5(F.col("url").cast("binary")), 1, 12).alias("name"))


@query("x01_url_parts", f"""SELECT page_id, {host} AS host, {dom} AS domain, {key} AS dedup_key, regexp_extract({host}, '\\.([A-Za-z]+)$', 1) AS tld, len(list_filter(string_split({path}, '/'), lambda x: x <> ''))::BIGINT AS depth, regexp_extract(regexp_extract(lower({path}), '([^/]+)/*$', 1), '^.+(\\.[^.]+)$', 1) AS ext FROM pages""")
def x01(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", urls.netloc(u).alias("host"), urls.domain(u).alias("domain"), urls.dedup_key(u).alias("dedup_key"), urls.tld(u).alias("tld"), urls.path_depth(u).alias("depth"), urls.extension(u).alias("ext"))


LOW_PATH, LOW_QUERY = PATH.format("lower(url)"), QUERY.format("lower(url)")
CORPUS_KEY = f"regexp_replace({HOST.format('lower(url)')}, '^www\\.', '') || CASE WHEN length({LOW_PATH}) > 1 AND {LOW_PATH} LIKE '%/' THEN left({LOW_PATH}, length({LOW_PATH}) - 1) ELSE {LOW_PATH} END || CASE WHEN {LOW_QUERY} <> '' THEN '?' || {LOW_QUERY} ELSE '' END"


@query("x02_corpus_key", f"SELECT ord, {CORPUS_KEY} AS corpus_key FROM {URLS_SQL}")
def x02(spark, d):
    return url_list(spark, d).select("ord", urls.corpus_key(F.col("url")).alias("corpus_key"))


IN_UK = "CASE WHEN page_id % 3 = 0 THEN replace(url, '.example.', '.example.co.') ELSE url END"


@query("x04_registrable_domain", f"WITH d AS (SELECT page_id, {DOMAIN.format(IN_UK)} AS d FROM (SELECT page_id, regexp_replace(url, '[.](com|org|net)(/|$)', '.uk\\2') AS url FROM pages)), e AS (SELECT page_id, d, regexp_extract(d, '([^.]+\\.[^.]+)$', 1) AS two, regexp_extract(d, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS three FROM d) SELECT page_id, CASE WHEN two IN ({', '.join(map(repr, urls.DOUBLE_SUFFIXES))}) AND three <> '' THEN three WHEN two <> '' THEN two ELSE d END AS registrable FROM e")
def x04(spark, d):
    """Suffixes of one and of two labels, on the pages' addresses moved below .uk and .co.uk."""
    moved = t(spark, d, "pages").select("page_id", F.regexp_replace("url", "[.](com|org|net)(/|$)", ".uk$2").alias("url"))
    return moved.select("page_id", urls.registrable_domain(F.expr(IN_UK)).alias("registrable"))


#: Rules of public suffixes with a wildcard and an exception, and ends that the pages' hosts are moved to, one meeting no rule.
SUFFIXES = ["// a comment", "com", "net", "uk", "co.uk", "ck", "*.ck", "!www.ck", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "jp", "blog.uk"]
ENDS = ["co.uk", "b.ck", "www.ck", "city.kobe.jp", "x.kobe.jp", "blog.uk", "nowhere", "com"]
MOVED = f"(SELECT page_id, regexp_replace({DOMAIN.format('url')}, '[.][a-z]+$', '') || '.' || {ENDS!r}[page_id % {len(ENDS)} + 1] AS host FROM pages)"


@query("x04_suffix_rules", f"""WITH r AS (SELECT DISTINCT regexp_replace(rule, '^(\\*\\.|!)', '') AS key, CASE rule[1] WHEN '*' THEN 1 WHEN '!' THEN -1 ELSE 0 END AS extra FROM (SELECT unnest({SUFFIXES!r}) AS rule) WHERE rule[1:2] <> '//'),
h AS (SELECT page_id, host, string_split(host, '.') AS l FROM {MOVED}), e AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS depth, l FROM h),
m AS (SELECT page_id, max(struct_pack(exception := extra = -1, suffix := depth + extra)) AS best FROM e JOIN r ON r.key = array_to_string(l[len(l) - depth + 1:], '.') WHERE depth + extra <= len(l) GROUP BY page_id)
SELECT h.page_id, host, CASE WHEN best IS NULL THEN l[-1] WHEN best.suffix = len(l) THEN '.' || host ELSE array_to_string(l[len(l) - best.suffix:], '.') END AS registrable FROM h LEFT JOIN m USING (page_id)""")
def x04_rules(spark, d):
    """Registrable domains by a table of rules, the longest first, with wildcards and exceptions."""
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("page_id") % len(ENDS)).cast("int"))
    hosts = t(spark, d, "pages").select("page_id", F.concat_ws(".", F.regexp_replace(urls.domain(F.col("url")), "[.][a-z]+$", ""), end).alias("host"))
    return urls.registrable_domains(hosts, "host", spark.createDataFrame([(r,) for r in SUFFIXES], "rule string"))


@query("a17_corpus_stats", f"""WITH p AS (SELECT regexp_extract({host}, '\\.([A-Za-z]+)$', 1) AS tld, url, {key} AS k, {dom} AS dom, len(list_filter(string_split({path}, '/'), lambda x: x <> '')) AS depth FROM pages)
SELECT coalesce(tld, 'ALL_POOLED') AS grp, count(*) AS n_rows, count(DISTINCT url) AS n_urls, count(DISTINCT k) AS n_keys, count(DISTINCT dom) AS n_domains, median(depth)::DOUBLE AS median_depth FROM p GROUP BY GROUPING SETS ((tld), ())""")
def a17(spark, d):
    u = F.col("url")
    p = t(spark, d, "pages").select(urls.tld(u).alias("tld"), "url", urls.dedup_key(u).alias("k"), urls.domain(u).alias("dom"), urls.path_depth(u).alias("depth"))
    return p.rollup("tld").agg(F.count("*").alias("n_rows"), F.countDistinct("url").alias("n_urls"), F.countDistinct("k").alias("n_keys"), F.countDistinct("dom").alias("n_domains"), F.percentile("depth", 0.5).alias("median_depth")).select(F.coalesce("tld", F.lit("ALL_POOLED")).alias("grp"), "n_rows", "n_urls", "n_keys", "n_domains", "median_depth")


@query("a18_herfindahl", f"WITH n AS (SELECT {dom} AS k, count(*) AS n FROM pages GROUP BY 1) SELECT round(sum(n::DOUBLE * n) / pow(sum(n), 2), 6) AS hhi, count(*) AS n_keys, count_if(n = 1)::BIGINT AS n_single FROM n")
def a18(spark, d):
    return corpus.herfindahl(t(spark, d, "pages"), urls.domain(F.col("url"))).withColumn("hhi", F.round("hhi", 6))


@query("a22_tld_distribution", f"WITH n AS (SELECT regexp_extract({host}, '\\.([A-Za-z]+)$', 1) AS tld, count(*) AS n FROM pages GROUP BY 1) SELECT tld, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share, CASE WHEN tld IN ('com', 'org', 'net') THEN 'generic' ELSE 'other' END AS kind FROM n")
def a22(spark, d):
    n = t(spark, d, "pages").groupBy(urls.tld(F.col("url")).alias("tld")).agg(F.count("*").alias("n"))
    return n.select("tld", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"), F.when(F.col("tld").isin("com", "org", "net"), "generic").otherwise("other").alias("kind"))


@query("a23_path_depth", f"WITH n AS (SELECT len(list_filter(string_split({path}, '/'), lambda x: x <> ''))::BIGINT AS depth, count(*) AS n FROM pages GROUP BY 1) SELECT depth, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM n")
def a23(spark, d):
    n = t(spark, d, "pages").groupBy(urls.path_depth(F.col("url")).alias("depth")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("w04_domain_curve", f"WITH n AS (SELECT {dom} AS domain, count(*) AS n FROM pages GROUP BY 1) SELECT domain, n, row_number() OVER w AS rank, round(sum(n) OVER w / sum(n) OVER (), 6)::DOUBLE AS cum_share FROM n WINDOW w AS (ORDER BY n DESC, domain ROWS UNBOUNDED PRECEDING)")
def w04(spark, d):
    n = t(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    curve = running(n, [F.desc("n"), "domain"], {"rank": F.lit(1), "upto": F.col("n")})
    total = n.agg(F.sum("n").alias("total"))
    return curve.crossJoin(F.broadcast(total)).select("domain", "n", "rank", F.round(F.col("upto") / F.col("total"), 6).alias("cum_share"))  # one row


@query("a19_top_share", f"WITH n AS (SELECT {dom} AS domain, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS rk FROM n) SELECT round(sum(CASE WHEN rk <= 1 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS top1, round(sum(CASE WHEN rk <= 3 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS top3, round(sum(CASE WHEN rk <= 10 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS top10 FROM r")
def a19(spark, d):
    n = t(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    tops = n.orderBy(F.desc("n"), "domain").limit(10)  # the report's top ten
    ranked = tops.select("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "domain")).alias("rk"))
    total = n.agg(F.sum("n").alias("total"))
    share = lambda k: F.round(F.sum(F.when(F.col("rk") <= k, F.col("n")).otherwise(0)) / F.first("total"), 6).alias(f"top{k}")
    return ranked.crossJoin(F.broadcast(total)).agg(share(1), share(3), share(10))


@query("a29_cross_group_domains", f"SELECT domain, count(*) AS n_groups, string_agg(g, ';' ORDER BY g) AS groups FROM (SELECT DISTINCT {dom} AS domain, 'g' || (page_id % 5) AS g FROM pages) GROUP BY 1 HAVING count(*) > 1")
def a29(spark, d):
    p = t(spark, d, "pages").select(urls.domain(F.col("url")).alias("domain"), F.concat(F.lit("g"), F.col("page_id") % 5).alias("g"))
    return p.groupBy("domain").agg(F.countDistinct("g").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("g")), ";").alias("groups")).filter("n_groups > 1")


@query("a01_screening_stats", f"WITH k AS (SELECT ord, {key} AS k, url FROM {URLS_SQL}), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM k) SELECT count(*) AS total, count_if(rn > 1)::BIGINT AS duplicates, count_if(url LIKE 'https%')::BIGINT AS secure, count_if(url LIKE '%?%')::BIGINT AS with_query FROM w")
def a01(spark, d):
    f = corpus.flag_near_duplicates(url_list(spark, d), "url", "ord")
    return f.agg(F.count("*").alias("total"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("url").startswith("https")).alias("secure"), F.count_if(F.col("url").contains("?")).alias("with_query"))


@query("j07_exact_or_normal_join", f"WITH l AS (SELECT ord, url, {key} AS k FROM {URLS_SQL}), r AS (SELECT url, {key} AS k FROM pages WHERE page_id % 2 = 0) SELECT ord, url IN (SELECT url FROM r) AS exact, k IN (SELECT k FROM r) AS normal FROM l")
def j07(spark, d):
    left = url_list(spark, d).withColumn("k", urls.dedup_key(F.col("url")))
    right = t(spark, d, "pages").filter("page_id % 2 = 0").select("url", urls.dedup_key(F.col("url")).alias("k"))
    flags = lambda c: right.select(c).distinct().withColumn(f"_{c}", F.lit(True))
    return left.join(flags("url"), "url", "left").join(flags("k"), "k", "left").select("ord", F.coalesce("_url", F.lit(False)).alias("exact"), F.coalesce("_k", F.lit(False)).alias("normal"))


@query("j08_manifest_diff", """WITH b AS (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 7 <> 0), a AS (SELECT page_id, sha256(CASE WHEN page_id % 5 = 0 THEN html || 'x' ELSE html END) AS h FROM pages WHERE page_id % 11 <> 0)
SELECT page_id, CASE WHEN b.h IS NULL THEN 'NEW' WHEN a.h IS NULL THEN 'DISAPPEARED' ELSE 'CHANGED' END AS change FROM b FULL JOIN a USING (page_id) WHERE a.h IS DISTINCT FROM b.h""")
def j08(spark, d):
    p = t(spark, d, "pages")
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    return corpus.manifest_diff(p.filter("page_id % 7 <> 0").select("page_id", sha(F.col("html"))), p.filter("page_id % 11 <> 0").select("page_id", sha(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))), "page_id", "h")


@query("t05_topk_images", f"""WITH i AS (SELECT page_id, {dom} AS district, page_id % 13 AS score, 'img' || (page_id % 60) AS p FROM pages), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district, p ORDER BY score DESC, page_id) AS rn FROM i) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY score DESC, page_id) AS rank FROM f) SELECT district, rank, p AS image FROM r WHERE rank <= 3""")
def t05(spark, d):
    i = t(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("district"), (F.col("page_id") % 13).alias("score"), F.concat(F.lit("img"), F.col("page_id") % 60).alias("p"))
    order = [F.desc("score"), "page_id"]
    f = i.withColumn("rn", F.row_number().over(Window.partitionBy("district", "p").orderBy(*order))).filter("rn = 1")
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("district").orderBy(*order)).cast("long")).filter("rank <= 3").select("district", "rank", F.col("p").alias("image"))
