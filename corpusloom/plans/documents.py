"""Queries on documents, their labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus
from corpusloom.operators.ordered import numbered
from corpusloom.plans.common import TOKENS, WORDS, t
from corpusloom.plans.registry import query

DIMENSIONS = {"license": ["licensed under", "copyright"], "contact": ["@", "http"], "credential": ["token", "password"], "article": ["the ", "der ", "los "], "percent": ["%"]}
# Function words of each language, in the order that ties are settled.
HINTS = {
    "en": ["the", "and", "is", "are", "we", "our", "for", "with"],
    "fr": ["le", "la", "les", "et", "est", "nous", "pour", "avec"],
    "de": ["der", "die", "das", "und", "ist", "wir", "für", "mit"],
    "es": ["el", "la", "los", "y", "es", "nosotros", "para", "con"],
    "ga": ["an", "na", "agus", "le", "do", "ar", "faoi"],
}
any_sql = lambda ws: "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + ")"


@query("a09_keyword_dimensions", "WITH a AS (SELECT source, count(*) AS n, " + ", ".join(f"count_if({any_sql(w)}) AS {k}" for k, w in DIMENSIONS.items()) + " FROM documents GROUP BY source) " + " UNION ALL ".join(f"SELECT source, '{k}' AS dimension, {k}::BIGINT AS n_docs, round(100.0::DOUBLE * {k} / n, 1) AS pct FROM a" for k in DIMENSIONS))
def a09(spark, d):
    return corpus.keyword_dimensions(t(spark, d, "documents"), "text", DIMENSIONS, ["source"])


@query("a13_facts_keyword_counts", "SELECT lang, " + ", ".join(f"count_if({any_sql(w)})::BIGINT AS n_{k}" for k, w in DIMENSIONS.items()) + " FROM documents GROUP BY lang")
def a13(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(*[F.count_if(text.any_keyword(F.col("text"), w)).alias(f"n_{k}") for k, w in DIMENSIONS.items()])


@query("a10_overlap_arithmetic", f"WITH a AS (SELECT count(*) AS n, count_if({any_sql(DIMENSIONS['article'])}) AS x, count_if({any_sql(DIMENSIONS['percent'])}) AS y FROM documents) SELECT x::BIGINT AS urban, y::BIGINT AS periurban, (n - x - y)::BIGINT AS unclassified FROM a")
def a10(spark, d):
    a = t(spark, d, "documents").agg(F.count("*").alias("n"), *[F.count_if(text.any_keyword(F.col("text"), DIMENSIONS[k])).alias(c) for k, c in (("article", "urban"), ("percent", "periurban"))])
    return a.select("urban", "periurban", (F.col("n") - F.col("urban") - F.col("periurban")).alias("unclassified"))


LEVEL = "CASE WHEN {0} >= hi THEN 'high' WHEN {0} > lo THEN 'medium' ELSE 'low' END"
LIMITS = "list_sort(list({0}))[(floor(0.25 * count(*)) + 1)::INT] AS lo, list_sort(list({0}))[(floor(0.75 * count(*)) + 1)::INT] AS hi"


@query("a07_density_category", f"WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), l AS (SELECT {LIMITS.format('n')} FROM n) SELECT lang, source, n, {LEVEL.format('n')} AS level FROM n, l")
def a07(spark, d):
    return corpus.levels(t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "n")


@query("w02_popularity_level", f"WITH s AS (SELECT doc_id, source, (3 * contains(lower(text), 'the ')::INT + contains(lower(text), 'that')::INT - contains(lower(text), '###')::INT + (length(text) > 1000)::INT)::BIGINT AS score FROM documents), l AS (SELECT source, {LIMITS.format('score')} FROM s GROUP BY source) SELECT doc_id, score, {LEVEL.format('score')} AS level FROM s JOIN l USING (source)")
def w02(spark, d):
    b = lambda w: text.any_keyword(F.col("text"), [w]).cast("long")
    s = t(spark, d, "documents").select("doc_id", "source", (3 * b("the ") + b("that") - b("###") + (F.length("text") > 1000).cast("long")).alias("score"))
    return corpus.levels(s, "score", ["source"]).select("doc_id", "score", "level")


SCORES = {k: f"len(list_intersect({WORDS.format('text')}, {v}))" for k, v in HINTS.items()}


HINT_SQL = "(WITH s AS (SELECT doc_id, " + ", ".join(f"{e} AS s_{k}" for k, e in SCORES.items()) + " FROM documents), m AS (SELECT *, greatest(" + ", ".join(f"s_{k}" for k in HINTS) + ") AS top FROM s) SELECT doc_id, CASE " + " ".join(f"WHEN s_{k} = top THEN '{k}'" for k in HINTS) + " END AS hint FROM m)"


@query("x10_language_hint", f"SELECT doc_id, hint FROM {HINT_SQL}")
def x10(spark, d):
    return t(spark, d, "documents").select("doc_id", text.language_hint(F.col("text"), HINTS).alias("hint"))


@query("a11_hint_distribution", f"SELECT hint, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM {HINT_SQL} GROUP BY hint")
def a11(spark, d):
    n = x10(spark, d).groupBy("hint").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("hint", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))  # one row


@query("a02_language_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a02(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


RULES = (("licence", "licensed under"), ("secret", "token"), ("shout", "!!"), ("english", "the "))
#: The first rule that holds in the first 500 characters, as the rule of x12 reads, and in whole texts.
START_CLASS, CLASS = ("CASE " + " ".join(f"WHEN contains({low}, '{w}') THEN '{k}'" for k, w in RULES) + " ELSE 'other' END" for low in ("lower(substring(coalesce({0}, ''), 1, 500))", "lower(coalesce({0}, ''))"))


def classify(body):
    return text.first_match([(k, text.any_keyword(body, [w])) for k, w in RULES], "other")


@query("x12_first_match_class", f"SELECT doc_id, {START_CLASS.format('text')} AS class FROM documents")
def x12(spark, d):
    return t(spark, d, "documents").select("doc_id", classify(F.substring("text", 1, 500)).alias("class"))


@query("x14_word_count", f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_words, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents")
def x14(spark, d):
    return t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@query("x15_numbers", "WITH n AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '" + text.NUMBER + "')) AS raw FROM documents) SELECT doc_id, raw, count(*) AS n, try_cast(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE) AS value, raw LIKE '%\\%' ESCAPE '\\' AS is_pct FROM n GROUP BY ALL")
def x15(spark, d):
    n = t(spark, d, "documents").select("doc_id", F.explode(text.numbers(F.col("text"))).alias("raw"))
    return n.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).withColumns({"value": text.number_value(F.col("raw")), "is_pct": F.col("raw").endswith("%")})


@query("a14_quantities", "WITH n AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '([0-9]{2,6})', 1))::BIGINT AS n FROM documents) SELECT coalesce(sum(n), 0)::BIGINT AS total, coalesce(max(n), 0)::BIGINT AS largest FROM n")
def a14(spark, d):
    n = t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]{2,6})"), F.lit(1))).alias("n")).select(F.col("n").cast("long"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@query("x26_forbidden_basis", "SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)licensed under|per capita|apache license|token = ')) AS phrase FROM documents")
def x26(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?i)(licensed under|per capita|apache license|token = )"), F.lit(1))).alias("phrase"))


@query("x30_shingle_leak", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9:]+') AS w FROM documents), v AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9:]+') AS w FROM benchmark),
a AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, len(w) - 4)) AS g(i)), b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM v, unnest(generate_series(1, len(w) - 4)) AS g(i))
SELECT doc_id, item_id, count(*) AS n_shared FROM a JOIN b USING (s) GROUP BY ALL""")
def x30(spark, d):
    return corpus.shingle_leaks(t(spark, d, "documents"), "doc_id", "text", t(spark, d, "benchmark"), "item_id", "text")


@query("a16_domain_merge", "WITH r AS (SELECT source, doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS rk, first(doc_id) OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS p FROM documents) SELECT source, ((rk - 1) // 20)::BIGINT AS part, any_value(p) AS \"primary\", count(*) AS n_merged, md5(string_agg(t, chr(10) || chr(10) ORDER BY rk)) AS merged_md5 FROM r GROUP BY ALL")
def a16(spark, d):
    """Parts of 20 documents here, so that parts are met on small tables."""
    return corpus.merge_by(t(spark, d, "documents"), "source", "text", "doc_id", 20).select("source", "part", "primary", "n_merged", F.md5(F.col("merged").cast("binary")).alias("merged_md5"))


@query("g02_chunks", f"WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 180) / 160.0))::INT)) AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, chunk::INT AS chunk, md5(array_to_string(w[chunk * 160 + 1:chunk * 160 + 180], ' ')) AS text_md5 FROM c")
def g02(spark, d):
    return corpus.chunks(t(spark, d, "documents"), "doc_id", "text", 180, 20).select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("a05_group_rollup", """WITH j AS (SELECT source, lang, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents JOIN labels USING (doc_id)), l AS (SELECT source, 'lang' AS dim, lang AS value FROM j UNION ALL SELECT source, 'quality', quality FROM j UNION ALL SELECT source, 'toxic', toxic FROM j) SELECT source, dim, value, count(*) AS n FROM l GROUP BY ALL""")
def a05(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source", "lang").join(t(spark, d, "labels"), "doc_id")
    long = j.select("source", F.expr("stack(3, 'lang', lang, 'quality', string(quality), 'toxic', string(toxic)) AS (dim, value)"))
    return long.groupBy("source", "dim", "value").agg(F.count("*").alias("n"))


@query("a08_city_stats", "SELECT count(*) AS total, count(DISTINCT source) AS n_groups, count(DISTINCT lang) AS n_langs, max(n_chars) AS longest FROM documents")
def a08(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("total"), F.countDistinct("source").alias("n_groups"), F.countDistinct("lang").alias("n_langs"), F.max("n_chars").alias("longest"))


@query("a06_last_code_wins", "SELECT source, arg_max(lang, doc_id) AS code FROM documents GROUP BY source")
def a06(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.max_by("lang", "doc_id").alias("code"))


@query("w03_rank_in_group", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def w03(spark, d):
    return numbered(t(spark, d, "documents").select("source", "doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], "rank", ["source"]).select("source", "doc_id", "rank")


@query("t02_top_groups", "SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source ORDER BY n DESC, first_id LIMIT 3")
def t02(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(3)


JUDGED = f"(SELECT doc_id, source, quality, toxic, CASE WHEN {CLASS.format('text')} IN ('licence', 'english') THEN 1 ELSE 0 END AS rule FROM documents JOIN labels USING (doc_id))"


def judged(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source", "text").join(t(spark, d, "labels"), "doc_id")
    return j.select("doc_id", "source", "quality", "toxic", F.when(classify(F.col("text")).isin("licence", "english"), 1).otherwise(0).alias("rule"))


@query("a32_confusion", f"SELECT a.x AS quality, b.x AS rule, count(j.doc_id) AS n FROM (VALUES (0), (1)) a(x) CROSS JOIN (VALUES (0), (1)) b(x) LEFT JOIN {JUDGED} j ON j.quality = a.x AND j.rule = b.x GROUP BY ALL")
def a32(spark, d):
    return corpus.confusion(judged(spark, d), "quality", "rule", [0, 1])


KAPPA = "WITH p AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS total, sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n)::DOUBLE AS po FROM p), e AS (SELECT sum(x.n::DOUBLE * y.n) AS c FROM (SELECT a AS c, sum(n) AS n FROM p GROUP BY 1) x JOIN (SELECT b AS c, sum(n) AS n FROM p GROUP BY 1) y USING (c)) SELECT total::BIGINT AS n, round(po, 6) AS agreement, round((po - c / (total * total)) / (1 - c / (total * total)), 6) AS kappa FROM t, e"


@query("a37_kappa", KAPPA.format(a="quality", b="rule", t=JUDGED))
def a37(spark, d):
    return corpus.kappa(judged(spark, d), "quality", "rule")


@query("a38_kappa_multiclass", KAPPA.format(a="lang", b="hint", t="(SELECT lang, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' de ') THEN 'fr' WHEN contains(text, ' der ') THEN 'de' ELSE 'es' END AS hint FROM documents)"))
def a38(spark, d):
    hint = F.when(F.contains("text", F.lit(" the ")), "en").when(F.contains("text", F.lit(" de ")), "fr").when(F.contains("text", F.lit(" der ")), "de").otherwise("es")
    return corpus.kappa(t(spark, d, "documents").select("lang", hint.alias("hint")), "lang", "hint")


@query("a35_agreement", f"SELECT source, count(*) AS n, count_if(quality = rule)::BIGINT AS same, count_if(quality <> rule)::BIGINT AS differ, round(100.0::DOUBLE * count_if(quality = rule) / count(*), 1) AS pct FROM {JUDGED} GROUP BY source")
def a35(spark, d):
    same = F.count_if(F.col("quality") == F.col("rule"))
    return judged(spark, d).groupBy("source").agg(F.count("*").alias("n"), same.alias("same"), F.count_if(F.col("quality") != F.col("rule")).alias("differ"), F.round(100.0 * same / F.count("*"), 1).alias("pct"))


@query("a36_joint_agreement", f"SELECT count_if(quality = rule AND toxic = 0)::BIGINT AS both_agree, count_if(quality = rule AND toxic <> 0)::BIGINT AS first_only, count_if(quality <> rule AND toxic = 0)::BIGINT AS second_only, count_if(quality <> rule AND toxic <> 0)::BIGINT AS neither FROM {JUDGED}")
def a36(spark, d):
    a, b = F.col("quality") == F.col("rule"), F.col("toxic") == 0
    return judged(spark, d).agg(F.count_if(a & b).alias("both_agree"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


@query("a57_grouping_sets", "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'quality' END AS grp, coalesce(lang, quality::VARCHAR) AS value, count(*) AS n, count_if(toxic = 1)::BIGINT AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (quality))")
def a57(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    sets = j.groupingSets([["lang"], ["quality"]], "lang", "quality").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return sets.select(F.when(F.col("g") == 0, "lang").otherwise("quality").alias("grp"), F.coalesce("lang", F.col("quality").cast("string")).alias("value"), "n", "n_toxic")


@query("a62_flag_matrix", "SELECT source, count_if(lang = 'en')::BIGINT AS en, count_if(lang = 'fr')::BIGINT AS fr, count_if(lang = 'de')::BIGINT AS de, count_if(lang = 'es')::BIGINT AS es FROM documents GROUP BY source")
def a62(spark, d):
    return t(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count("source")).na.fill(0)


@query("a47_pearson", "SELECT source, CASE WHEN count(*) >= 3 THEN round(corr(n_chars, doc_id), 6) END AS r FROM documents GROUP BY source")
def a47(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.when(F.count("*") >= 3, F.round(F.corr(F.col("n_chars").cast("double"), F.col("doc_id").cast("double")), 6)).alias("r"))


@query("a48_distribution_stats", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang")
def a48(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("p01_uniform_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':s'), doc_id) AS rn FROM documents) WHERE rn <= 4")
def p01(spark, d):
    return corpus.hash_sample(t(spark, d, "documents").select("source", "doc_id"), "doc_id", ["source"], 4)


@query("p05_stratified", "SELECT quality, toxic, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id || ':p5'), doc_id) AS rn FROM labels) WHERE rn <= 8")
def p05(spark, d):
    return corpus.hash_sample(t(spark, d, "labels").select("quality", "toxic", "doc_id"), "doc_id", ["quality", "toxic"], 8, "p5")


@query("w10_sequential_ids", "SELECT doc_id, 'A' || printf('%06d', row_number() OVER (ORDER BY doc_id)) AS item FROM labels")
def w10(spark, d):
    return numbered(t(spark, d, "labels").select("doc_id"), ["doc_id"], "n").select("doc_id", F.format_string("A%06d", "n").alias("item"))


TURNS = r"(SELECT DISTINCT role, turn, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM conversations)"


def turns(spark, d):
    return t(spark, d, "conversations").select("role", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).distinct()


@query("u01_claim_overlap", f"WITH s AS (SELECT word, bool_or(role = 'user') AS a, bool_or(role = 'assistant') AS b FROM {TURNS} WHERE role IN ('user', 'assistant') GROUP BY word) SELECT count_if(NOT b)::BIGINT AS only_a, count_if(NOT a)::BIGINT AS only_b, count_if(a AND b)::BIGINT AS both_sides, count(*) AS either_side, round(100.0::DOUBLE * count_if(a AND b) / count(*), 1) AS pct FROM s")
def u01(spark, d):
    return corpus.set_overlap(turns(spark, d), "word", "role", "user", "assistant")


@query("a51_presence_stability", f"WITH s AS (SELECT * FROM {TURNS}), n AS (SELECT role, count(DISTINCT turn) AS turns FROM s GROUP BY role), p AS (SELECT role, word, count(DISTINCT turn) AS presence FROM s GROUP BY ALL) SELECT role, word, presence, CASE WHEN presence = turns THEN 'stable' ELSE 'partial' END AS note FROM p JOIN n USING (role)")
def a51(spark, d):
    """A word is stable if it is said in every turn that its role has."""
    s = turns(spark, d)
    n = s.groupBy("role").agg(F.countDistinct("turn").alias("turns"))
    p = s.groupBy("role", "word").agg(F.count("*").alias("presence")).join(F.broadcast(n), "role")  # a row a role
    return p.select("role", "word", "presence", F.when(F.col("presence") == F.col("turns"), "stable").otherwise("partial").alias("note"))


@query("j16_replicate_pairs", f"WITH s AS (SELECT coalesce(role, '') AS role, turn, word FROM {TURNS}), n AS (SELECT role, turn, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.role, a.turn AS x, b.turn AS y, count(*) AS k FROM s a JOIN s b ON a.role = b.role AND a.word = b.word AND a.turn < b.turn GROUP BY ALL) SELECT p.role, p.turn AS turn_a, q.turn AS turn_b, coalesce(k, 0) AS shared, round(100.0::DOUBLE * coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)), 1) AS pct FROM n p JOIN n q ON p.role = q.role AND p.turn < q.turn LEFT JOIN i ON i.role = p.role AND i.x = p.turn AND i.y = q.turn")
def j16(spark, d):
    s = turns(spark, d).select(F.coalesce("role", F.lit("")).alias("role"), "turn", "word")
    return corpus.replicate_pairs(s, "turn", "word", ["role"]).withColumnRenamed("a", "turn_a").withColumnRenamed("b", "turn_b")


@query("j10_cache_lookup", "WITH c AS (SELECT sha256(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1) SELECT b.item_id, c.item_id IS NOT NULL AS hit FROM benchmark b LEFT JOIN c ON c.h = sha256(CASE WHEN b.item_id % 3 = 0 THEN b.text || '.' ELSE b.text END)")
def j10(spark, d):
    b = t(spark, d, "benchmark")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    cache = b.groupBy(sha(F.col("text")).alias("h")).agg(F.min("item_id").alias("cached"))
    asked = b.select("item_id", sha(F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("h"))
    return asked.join(cache, "h", "left").select("item_id", F.col("cached").isNotNull().alias("hit"))


@query("j11_semi_anti", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def j11(spark, d):
    docs, labels = t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id")
    yes = docs.join(labels, "doc_id", "left_semi").withColumn("labelled", F.lit(True))
    return yes.union(docs.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("x40_strip_thoughts", r"SELECT doc_id, md5(regexp_replace(regexp_replace('<think>' || coalesce(text, '') || '</think>' || coalesce(text, '') || '<think>' || chr(10) || lang || '</think> ' || lang || chr(10), '(?s)<think>.*?</think>', '', 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS answer_md5 FROM documents")
def x40(spark, d):
    """Whole texts as the thought and as the answer, with a second block and line ends after it."""
    body = F.coalesce("text", F.lit(""))
    said = F.concat(F.lit("<think>"), body, F.lit("</think>"), body, F.lit("<think>\n"), "lang", F.lit("</think> "), "lang", F.lit("\n"))
    return t(spark, d, "documents").select("doc_id", F.md5(text.without_thoughts(said).cast("binary")).alias("answer_md5"))


@query("x38_slugify", "SELECT DISTINCT source || ' Of ' || lang AS raw, replace(lower(trim(source || ' Of ' || lang)), ' ', '_') AS slug FROM documents")
def x38(spark, d):
    raw = F.concat_ws(" Of ", "source", "lang")
    return t(spark, d, "documents").select(raw.alias("raw"), text.slug(raw).alias("slug")).distinct()


@query("f34_multi_label", "WITH l AS (SELECT doc_id, unnest([CASE WHEN length(text) < 300 THEN 'short' END, CASE WHEN contains(text, '###') THEN 'junk' END, CASE WHEN contains(text, '@') THEN 'contact' END]) AS label FROM documents) SELECT doc_id, label FROM l WHERE label IS NOT NULL")
def f34(spark, d):
    labels = F.array_compact(F.array(F.when(F.length("text") < 300, "short"), F.when(F.contains("text", F.lit("###")), "junk"), F.when(F.contains("text", F.lit("@")), "contact")))
    return t(spark, d, "documents").select("doc_id", F.explode(labels).alias("label"))


@query("f35_validators", "SELECT 'bad_quality' AS rule, count(*) AS n FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'no_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def f35(spark, d):
    labels, docs = t(spark, d, "labels"), t(spark, d, "documents").select("doc_id")
    count = lambda rule, bad: bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return count("bad_quality", labels.filter(~F.col("quality").isin(0, 1))).union(count("duplicate_id", labels.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1"))).union(count("no_document", labels.join(docs, "doc_id", "left_anti")))


@query("k13_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def k13(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
