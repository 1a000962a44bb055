"""Queries on allocation, samples, joins with diagnostics and audit summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus
from corpusloom.plans.common import t
from corpusloom.plans.documents import CLASS, JUDGED, TOKENS, classify, judged
from corpusloom.plans.registry import query

DRAW = "md5(doc_id || ':{0}')"


def draw(salt):
    return F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{salt}")).cast("binary"))


@query("p03_forced_first", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (lang = 'de') DESC NULLS LAST, {DRAW.format('p3')}, doc_id) AS rn FROM documents) WHERE rn <= 3")
def p03(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last(F.col("lang") == "de"), draw("p3"), "doc_id")
    return t(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("rn")).filter("rn <= 3").select("source", "doc_id")


@query("p04_equal_allocation", """WITH c AS (SELECT source, lang, count(*) AS cap FROM documents GROUP BY ALL), l AS (SELECT max(v) AS level FROM (SELECT v, (SELECT sum(least(cap, v)) FROM c) AS used FROM range(0, 64) r(v)) WHERE used <= 63), r AS (SELECT 63 - sum(least(cap, level)) AS rest FROM c, l),
o AS (SELECT source, lang, row_number() OVER (ORDER BY md5(concat_ws(':', source, lang)), source, lang) AS rn FROM c, l WHERE cap > level) SELECT c.source, c.lang, cap, (least(cap, level) + coalesce((rn <= rest)::INT, 0))::BIGINT AS alloc FROM c CROSS JOIN l CROSS JOIN r LEFT JOIN o ON o.source = c.source AND o.lang IS NOT DISTINCT FROM c.lang""")
def p04(spark, d):
    """63 rows in equal shares over strata of at most their size; what is left over goes one each by hash."""
    caps = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("cap"))
    return corpus.equal_allocation(caps, ["source", "lang"], "cap", 63)


@query("p07_preferred_then_rest", f"SELECT source, doc_id, quality FROM (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY quality DESC, {DRAW.format('p7')}, doc_id) AS rn FROM documents JOIN labels USING (doc_id)) WHERE rn <= 3")
def p07(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("quality"), draw("p7"), "doc_id")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("source", "doc_id", "quality")


@query("w05_share_of_group", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def w05(spark, d):
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("w09_first_stated", "SELECT source, arg_min(v, doc_id) AS first_value FROM (SELECT source, doc_id, nullif(regexp_extract(text, '([0-9]+)', 1), '') AS v FROM documents) WHERE v IS NOT NULL GROUP BY source")
def w09(spark, d):
    v = t(spark, d, "documents").select("source", "doc_id", F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit("")).alias("v")).filter("v IS NOT NULL")
    return v.groupBy("source").agg(F.min_by("v", "doc_id").alias("first_value"))


@query("j01_last_key_wins", "SELECT d.doc_id, k.turn FROM documents d LEFT JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) k ON k.conv_id = d.doc_id")
def j01(spark, d):
    last = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("turn"))
    return t(spark, d, "documents").select("doc_id").join(last, "doc_id", "left")


@query("j05_merge_indicator", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS merged FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN labels b ON a.doc_id = b.doc_id")
def j05(spark, d):
    a, b = t(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.lit(1).alias("l")), t(spark, d, "labels").select("doc_id", F.lit(1).alias("r"))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both").alias("merged"))


@query("a31_stage_increase", "WITH s AS (SELECT source, count(*) AS s1, count_if(length(text) > 500)::BIGINT AS s2, count_if(contains(text, 'a'))::BIGINT AS s3 FROM documents GROUP BY source) SELECT source, 'first-second' AS step, s1 AS before, s2 AS after FROM s WHERE s2 > s1 UNION ALL SELECT source, 'second-third', s2, s3 FROM s WHERE s3 > s2")
def a31(spark, d):
    s = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("s1"), F.count_if(F.length("text") > 500).alias("s2"), F.count_if(F.contains("text", F.lit("a"))).alias("s3"))
    return s.select("source", F.expr("stack(2, 'first-second', s1, s2, 'second-third', s2, s3) AS (step, before, after)")).filter("after > before")


@query("a33_fixed_crosstab", f"SELECT lang, count_if(c = 'licence')::BIGINT AS licence, count_if(c = 'secret')::BIGINT AS secret, count_if(c = 'shout')::BIGINT AS shout, count_if(c = 'never')::BIGINT AS never FROM (SELECT lang, {CLASS.format('text')} AS c FROM documents) GROUP BY lang")
def a33(spark, d):
    c = t(spark, d, "documents").select("lang", classify(F.col("text")).alias("c"))
    return c.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(k) for k in ("licence", "secret", "shout", "never")])


@query("a41_reasons_pooled", f"WITH r AS (SELECT source, {CLASS.format('text')} AS reason FROM documents) SELECT source, reason, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'pooled', reason, count(*) FROM r GROUP BY reason")
def a41(spark, d):
    n = t(spark, d, "documents").groupBy("source", classify(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))
    return n.union(n.groupBy("reason").agg(F.sum("n").alias("n")).select(F.lit("pooled").alias("source"), "reason", "n"))


@query("a53_label_summary", f"SELECT source, count(*) AS n, count_if(quality = 1)::BIGINT AS direct, count_if(quality = 0 AND rule = 1)::BIGINT AS derived, round(count_if(quality = 1 OR rule = 1) / count(*), 4) AS rate FROM {JUDGED} GROUP BY source")
def a53(spark, d):
    q, r = F.col("quality") == 1, F.col("rule") == 1
    return judged(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(q).alias("direct"), F.count_if(~q & r).alias("derived"), F.round(F.count_if(q | r) / F.count("*"), 4).alias("rate"))


@query("a54_flags_per_words", f"WITH w AS (SELECT source, len({TOKENS.format('text')})::BIGINT AS words, contains(coalesce(text, ''), '!!') AS shout, contains(coalesce(text, ''), '###') AS junk FROM documents) SELECT source, sum(words)::BIGINT AS words, count_if(shout)::BIGINT AS shouts, count_if(junk)::BIGINT AS junks, CASE WHEN sum(words) > 0 THEN round(1000.0::DOUBLE * (count_if(shout) + count_if(junk)) / sum(words), 4) END AS per_1000 FROM w GROUP BY source")
def a54(spark, d):
    has = lambda x: F.count_if(F.contains(F.coalesce("text", F.lit("")), F.lit(x)))
    s = t(spark, d, "documents").groupBy("source").agg(F.sum(text.word_count(F.col("text"))).alias("words"), has("!!").alias("shouts"), has("###").alias("junks"))
    return s.withColumn("per_1000", F.when(F.col("words") > 0, F.round(1000.0 * (F.col("shouts") + F.col("junks")) / F.col("words"), 4)))


@query("a56_label_diagnostic", "SELECT source, count_if(lang IN ('en', 'de'))::BIGINT AS specific, count_if(lang IS NULL)::BIGINT AS unknown, count_if(lang NOT IN ('en', 'de'))::BIGINT AS outside, coalesce(string_agg(DISTINCT lang, ';' ORDER BY lang) FILTER (lang NOT IN ('en', 'de')), '') AS outside_values FROM documents GROUP BY source")
def a56(spark, d):
    known = F.col("lang").isin("en", "de")
    outside = F.array_join(F.array_sort(F.collect_set(F.when(~known, F.col("lang")))), ";")
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(known).alias("specific"), F.count_if(F.col("lang").isNull()).alias("unknown"), F.count_if(~known).alias("outside"), outside.alias("outside_values"))
