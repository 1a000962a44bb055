"""Queries on annotated samples, their validation and intervals; annotations are derived from `documents` and `labels`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import corpus, intervals, samples
from corpusloom.plans.common import DEDUP_KEY, URLS_SQL, t, url_list
from corpusloom.plans.documents import JUDGED, judged
from corpusloom.plans.registry import query

#: A row a labelled document: group, status, and types and levels as a person and a model gave them.
ANNOTATED = """(SELECT doc_id, source AS city, CASE WHEN doc_id % 2 = 0 THEN 'core' ELSE 'stress' END AS grp, CASE doc_id % 5 WHEN 0 THEN 'not_an_fsi' WHEN 1 THEN 'insufficient_evidence' ELSE 'genuine_fsi' END AS status, CASE WHEN quality = 1 THEN 'bank' ELSE 'garden' END AS human_type, CASE WHEN toxic = 1 THEN 'bank' WHEN doc_id % 7 = 0 THEN 'service' WHEN doc_id % 11 = 0 THEN 'unknown' ELSE 'garden' END AS model_type, CASE WHEN doc_id % 3 = 0 THEN 'ngo' ELSE 'council' END AS human_level, CASE WHEN doc_id % 6 = 0 THEN 'ngo' ELSE 'council' END AS model_level, 'r' || doc_id % 4 AS reason FROM documents JOIN labels USING (doc_id))"""
TYPES = ["bank", "garden"]


def annotated(spark, d):
    n = F.col("doc_id")
    j = t(spark, d, "documents").select("doc_id", F.col("source").alias("city")).join(t(spark, d, "labels"), "doc_id")
    status = F.when(n % 5 == 0, "not_an_fsi").when(n % 5 == 1, "insufficient_evidence").otherwise("genuine_fsi")
    model = F.when(F.col("toxic") == 1, "bank").when(n % 7 == 0, "service").when(n % 11 == 0, "unknown").otherwise("garden")
    level = lambda k: F.when(n % k == 0, "ngo").otherwise("council")
    return j.select("doc_id", "city", F.when(n % 2 == 0, "core").otherwise("stress").alias("grp"), status.alias("status"), F.when(F.col("quality") == 1, "bank").otherwise("garden").alias("human_type"), model.alias("model_type"), level(3).alias("human_level"), level(6).alias("model_level"), F.concat(F.lit("r"), n % 4).alias("reason"))


EVALUABLE = "grp = 'core' AND status = 'genuine_fsi'"


def matches():
    return F.col("human_type") == F.col("model_type"), F.col("human_level") == F.col("model_level")


@query("f33_evaluable", f"SELECT doc_id FROM {ANNOTATED} WHERE {EVALUABLE}")
def f33(spark, d):
    return annotated(spark, d).filter(EVALUABLE).select("doc_id")


@query("a71_disagreements", f"SELECT doc_id, city, human_type, model_type, human_type = model_type AS type_match, human_level = model_level AS level_match FROM {ANNOTATED} WHERE {EVALUABLE} AND NOT (human_type = model_type AND human_level = model_level)")
def a71(spark, d):
    same, level = matches()
    return annotated(spark, d).filter(EVALUABLE).filter(~(same & level)).select("doc_id", "city", "human_type", "model_type", same.alias("type_match"), level.alias("level_match"))


@query("a72_status_diagnostics", f"SELECT doc_id, status, model_type, model_type NOT IN ('', 'unknown') AS specific, model_type NOT IN ('bank', 'garden', 'unknown') AS outside FROM {ANNOTATED} WHERE grp = 'core' AND status <> 'genuine_fsi'")
def a72(spark, d):
    rows = annotated(spark, d).filter("grp = 'core' AND status <> 'genuine_fsi'")
    return rows.select("doc_id", "status", "model_type", (~F.col("model_type").isin("", "unknown")).alias("specific"), (~F.col("model_type").isin(*TYPES, "unknown")).alias("outside"))


@query("a73_stress_diagnostics", f"SELECT doc_id, reason, status, CASE WHEN status = 'genuine_fsi' THEN human_type ELSE '' END AS human_type, model_type, CASE WHEN status = 'genuine_fsi' THEN human_type = model_type END AS type_match FROM {ANNOTATED} WHERE grp = 'stress'")
def a73(spark, d):
    genuine = F.col("status") == "genuine_fsi"
    rows = annotated(spark, d).filter("grp = 'stress'")
    return rows.select("doc_id", "reason", "status", F.when(genuine, F.col("human_type")).otherwise("").alias("human_type"), "model_type", F.when(genuine, matches()[0]).alias("type_match"))


@query("f37_sentinels", f"SELECT doc_id, model_type, CASE WHEN status = 'genuine_fsi' THEN human_type = model_type END AS type_match, CASE WHEN status = 'genuine_fsi' THEN human_level = model_level END AS level_match FROM {ANNOTATED} WHERE model_type NOT IN ('bank', 'garden', 'unknown')")
def f37(spark, d):
    genuine = F.col("status") == "genuine_fsi"
    rows = annotated(spark, d).filter(~F.col("model_type").isin(*TYPES, "unknown"))
    return rows.select("doc_id", "model_type", *[F.when(genuine, m).alias(c) for m, c in zip(matches(), ("type_match", "level_match"), strict=True)])


KEPT = f"(SELECT * FROM {ANNOTATED} WHERE status <> 'insufficient_evidence' AND city <> 'src3')"
CELLS = f"(SELECT count_if(h AND m)::DOUBLE AS a, count_if(h AND NOT m)::DOUBLE AS b, count_if(NOT h AND m)::DOUBLE AS c, count_if(NOT h AND NOT m)::DOUBLE AS e, city FROM (SELECT city, status = 'genuine_fsi' AS h, model_type <> 'unknown' AS m FROM {KEPT}) GROUP BY GROUPING SETS ((city), ()))"


@query("a75_screening_metrics", f"SELECT coalesce(city, 'pooled') AS city, a::BIGINT AS kept_both, b::BIGINT AS human_only, c::BIGINT AS model_only, e::BIGINT AS neither, round(100 * (a + e) / (a + b + c + e), 1) AS pct, CASE WHEN (a + b) * (a + c) + (c + e) * (b + e) <> (a + b + c + e) * (a + b + c + e) THEN round(((a + e) / (a + b + c + e) - ((a + b) * (a + c) + (c + e) * (b + e)) / pow(a + b + c + e, 2)) / (1 - ((a + b) * (a + c) + (c + e) * (b + e)) / pow(a + b + c + e, 2)), 6) END AS kappa FROM {CELLS}")
def a75(spark, d):
    """A person's against a model's screening, without the excluded statuses and cities: cells, agreement and kappa, by city and pooled."""
    rows = annotated(spark, d).filter("status <> 'insufficient_evidence' AND city <> 'src3'").select("city", (F.col("status") == "genuine_fsi").alias("h"), (F.col("model_type") != "unknown").alias("m"))
    h, m = F.col("h"), F.col("m")
    cells = rows.groupingSets([["city"], []], "city").agg(F.count_if(h & m).alias("kept_both"), F.count_if(h & ~m).alias("human_only"), F.count_if(~h & m).alias("model_only"), F.count_if(~h & ~m).alias("neither"))
    return corpus.two_raters(cells, "kept_both", "human_only", "model_only", "neither").withColumn("city", F.coalesce("city", F.lit("pooled")))


LEDGERS = "(SELECT 'first' AS ledger, source AS city, doc_id % 3 <> 0 AS kept FROM documents UNION ALL SELECT 'second', source, doc_id % 4 <> 0 FROM documents)"


@query("a76_coverage_of_ledgers", f"SELECT ledger, coalesce(city, 'pooled') AS city, count(*) AS n, count_if(kept)::BIGINT AS kept, round(100.0::DOUBLE * count_if(kept) / count(*), 1) AS pct FROM {LEDGERS} GROUP BY GROUPING SETS ((ledger, city), (ledger))")
def a76(spark, d):
    docs = t(spark, d, "documents")
    both = docs.select(F.lit("first").alias("ledger"), F.col("source").alias("city"), (F.col("doc_id") % 3 != 0).alias("kept")).union(docs.select(F.lit("second"), "source", F.col("doc_id") % 4 != 0))
    kept = F.count_if("kept")
    sets = both.groupingSets([["ledger", "city"], ["ledger"]], "ledger", "city").agg(F.count("*").alias("n"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 1).alias("pct"))
    return sets.withColumn("city", F.coalesce("city", F.lit("pooled")))


@query("a80_recomputed", "WITH n AS (SELECT source AS city, count(*) AS n FROM documents GROUP BY 1) SELECT city, n + (length(city) % 5 = 0)::INT AS stored, n AS recomputed FROM n WHERE length(city) % 5 = 0")
def a80(spark, d):
    """Stored figures that differ from the recomputed ones; none if all agree."""
    n = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("recomputed"))
    stored = n.select("city", (F.col("recomputed") + (F.length("city") % 5 == 0).cast("int")).alias("stored"))
    return stored.join(n, "city").filter("stored <> recomputed").select("city", "stored", "recomputed")


@query("f39_required_artefacts", "WITH need AS (SELECT source || '/' || f AS path FROM (SELECT DISTINCT source FROM documents), (VALUES ('facts.json'), ('graph.xml')) v(f)), have AS (SELECT DISTINCT source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'facts.json' ELSE 'graph.xml' END AS path FROM documents WHERE doc_id % 30 < 20) SELECT path, 'missing' AS error FROM need WHERE path NOT IN (SELECT path FROM have)")
def f39(spark, d):
    """Artefacts that are not there, as error rows; a missing file is never a zero."""
    docs = t(spark, d, "documents")
    files = spark.createDataFrame([("facts.json",), ("graph.xml",)], "f string")
    need = docs.select("source").distinct().crossJoin(F.broadcast(files)).select(F.concat_ws("/", "source", "f").alias("path"))  # two files
    have = docs.filter("doc_id % 30 < 20").select(F.concat_ws("/", "source", F.when(F.col("doc_id") % 2 == 0, "facts.json").otherwise("graph.xml")).alias("path"))
    return need.join(have, "path", "left_anti").withColumn("error", F.lit("missing"))


FROZEN, KEYED = "(SELECT doc_id FROM labels WHERE doc_id % 9 <> 0)", "(SELECT doc_id, quality FROM labels WHERE doc_id % 8 <> 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 21 = 1)"


@query("j06_one_to_one", f"WITH l AS (SELECT doc_id, count(*) AS l FROM {FROZEN} GROUP BY 1), r AS (SELECT doc_id, count(*) AS r FROM {KEYED} GROUP BY 1) SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' ELSE 'repeated' END AS problem FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE r IS NULL OR l IS NULL OR l > 1 OR r > 1")
def j06(spark, d):
    labels = t(spark, d, "labels")
    right = labels.filter("doc_id % 8 <> 0").union(labels.filter("doc_id % 21 = 1")).select("doc_id", "quality")
    return samples.one_to_one(labels.filter("doc_id % 9 <> 0").select("doc_id"), right, "doc_id")[1]


KEY = DEDUP_KEY.format("url")


@query("j09_exact_else_normal", f"WITH q AS (SELECT ord, url, {KEY} AS k FROM {URLS_SQL}), l AS (SELECT url, {KEY} AS k, 'Kept' || page_id % 3 AS decision FROM pages WHERE page_id % 4 <> 0), e AS (SELECT url, count(*) AS n, min(decision) AS v FROM l GROUP BY 1), m AS (SELECT k, count(*) AS n, min(decision) AS v FROM l GROUP BY 1) SELECT ord, CASE WHEN coalesce(e.n, m.n, 0) = 1 THEN coalesce(e.v, m.v) END AS decision, CASE WHEN coalesce(e.n, m.n, 0) = 1 THEN CASE WHEN e.n IS NULL THEN 'normalised' ELSE 'exact' END END AS match_type, CASE WHEN coalesce(e.n, m.n, 0) = 0 THEN 'none' WHEN coalesce(e.n, m.n) > 1 THEN 'several' END AS problem FROM q LEFT JOIN e ON e.url = q.url LEFT JOIN m ON m.k = q.k")
def j09(spark, d):
    ledger = t(spark, d, "pages").filter("page_id % 4 <> 0").select("url", urls.dedup_key(F.col("url")).alias("k"), F.concat(F.lit("Kept"), F.col("page_id") % 3).alias("decision"))
    asked = url_list(spark, d).withColumn("k", urls.dedup_key(F.col("url")))
    return samples.exact_else_normal(asked, ledger, "url", "k", "decision").select("ord", "decision", "match_type", "problem")


@query("j24_equal_totals", "WITH a AS (SELECT source AS city, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source AS city, sum(1 + (doc_id % 50 = 7)::INT)::BIGINT AS n FROM documents GROUP BY 1) SELECT a.city, a.n AS attrition, b.n AS ledger, a.n = b.n AS agrees FROM a JOIN b USING (city)")
def j24(spark, d):
    docs = t(spark, d, "documents").select(F.col("source").alias("city"), "doc_id")
    a = docs.groupBy("city").agg(F.count("*").alias("attrition"))
    b = docs.groupBy("city").agg(F.sum(1 + (F.col("doc_id") % 50 == 7).cast("int")).alias("ledger"))
    return a.join(b, "city").withColumn("agrees", F.col("attrition") == F.col("ledger"))


@query("a58_audit_precision", "WITH v AS (SELECT source AS city, n_chars, CASE doc_id % 6 WHEN 0 THEN 'UNCLEAR' WHEN 1 THEN 'FP' WHEN 2 THEN 'FP' ELSE 'TP' END AS verdict FROM documents) SELECT coalesce(city, 'pooled') AS city, count_if(verdict = 'TP')::BIGINT AS tp, count_if(verdict = 'FP')::BIGINT AS fp, count_if(verdict = 'UNCLEAR')::BIGINT AS unclear, round(count_if(verdict = 'TP') / count(*), 4) AS with_unclear, CASE WHEN count_if(verdict <> 'UNCLEAR') > 0 THEN round(count_if(verdict = 'TP') / count_if(verdict <> 'UNCLEAR'), 4) END AS without_unclear, CASE WHEN sum(n_chars) > 0 THEN round(1000.0::DOUBLE * count_if(verdict = 'TP') / sum(n_chars), 4) END AS per_1000 FROM v GROUP BY ROLLUP (city)")
def a58(spark, d):
    k = F.col("doc_id") % 6
    v = t(spark, d, "documents").select(F.col("source").alias("city"), "n_chars", F.when(k == 0, "UNCLEAR").when(k.isin(1, 2), "FP").otherwise("TP").alias("verdict"))
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    tp, judged_, chars = is_("TP"), F.count_if(F.col("verdict") != "UNCLEAR"), F.sum("n_chars")
    out = v.rollup("city").agg(tp.alias("tp"), is_("FP").alias("fp"), is_("UNCLEAR").alias("unclear"), F.round(tp / F.count("*"), 4).alias("with_unclear"), F.when(judged_ > 0, F.round(tp / judged_, 4)).alias("without_unclear"), F.when(chars > 0, F.round(1000.0 * tp / chars, 4)).alias("per_1000"))
    return out.withColumn("city", F.coalesce("city", F.lit("pooled")))


@query("a59_misattribution", "WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '>1' END AS candidates, CASE doc_id % 7 WHEN 0 THEN 'WRONG_SLOT' WHEN 1 THEN 'UNCLEAR' ELSE 'CORRECT_SLOT' END AS label FROM documents) SELECT coalesce(candidates, 'all') AS candidates, count(*) AS n, count_if(label = 'WRONG_SLOT')::BIGINT AS wrong, round(100.0::DOUBLE * count_if(label = 'WRONG_SLOT') / count(*), 1) AS pct FROM c GROUP BY ROLLUP (candidates)")
def a59(spark, d):
    n = F.col("doc_id")
    c = t(spark, d, "documents").select(F.when(n % 3 == 0, "1").otherwise(">1").alias("candidates"), (n % 7 == 0).alias("wrong"))
    wrong = F.count_if("wrong")
    return c.rollup("candidates").agg(F.count("*").alias("n"), wrong.alias("wrong"), F.round(100.0 * wrong / F.count("*"), 1).alias("pct")).withColumn("candidates", F.coalesce("candidates", F.lit("all")))


@query("a43_bootstrap_ratio")
def a43(spark, d):
    """The interval of the pooled share of good documents, over resampled sources; rows only, as it is drawn."""
    sums = judged(spark, d).groupBy("source").agg(F.sum("quality").alias("part"), F.count("*").alias("whole"))
    return intervals.bootstrap(sums, ["part", "whole"], intervals.ratio)


@query("a44_bootstrap_kappa")
def a44(spark, d):
    """The interval of pooled kappa, over resampled sources' cells; rows only, as it is drawn."""
    q, r = F.col("quality") == 1, F.col("rule") == 1
    cells = judged(spark, d).groupBy("source").agg(F.count_if(q & r).alias("a"), F.count_if(q & ~r).alias("b"), F.count_if(~q & r).alias("c"), F.count_if(~q & ~r).alias("e"))
    return intervals.bootstrap(cells, ["a", "b", "c", "e"], intervals.kappa_of_cells)


@query("a45_binomial_interval", f"WITH g AS (SELECT source, count(*) AS n FROM {JUDGED} GROUP BY 1) SELECT source, k, n, round(CASE WHEN k = 0 THEN 0 ELSE pow(0.025, 1.0 / n) END, 6) AS low, round(CASE WHEN k = 0 THEN 1 - pow(0.025, 1.0 / n) ELSE 1 END, 6) AS high FROM (SELECT source, n, unnest([0, n]) AS k FROM g)")
def a45(spark, d):
    """Shares of none and of all, where the exact interval has a closed form that SQL can give; others are tested."""
    g = judged(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", "n", F.explode(F.array(F.lit(0).cast("long"), "n")).alias("k"))
    i = g.withColumn("i", intervals.binomial_interval("k", "n"))
    return i.select("source", "k", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("a46_poisson_interval", "SELECT source, 0::BIGINT AS k, round(-ln(0.025) / (count(*) / 1000.0::DOUBLE), 6) AS high, 0.0::DOUBLE AS low FROM documents GROUP BY source")
def a46(spark, d):
    """Rates without events, where the exact interval has a closed form that SQL can give; others are tested."""
    g = t(spark, d, "documents").groupBy("source").agg((F.count("*") / F.lit(1000.0)).alias("e")).withColumn("k", F.lit(0).cast("long"))
    i = g.withColumn("i", intervals.poisson_interval("k", "e"))
    return i.select("source", "k", F.round("i.high", 6).alias("high"), F.col("i.low").alias("low"))


def _halved(cases: str, state: str, most: str, tail_low: str, tail_high: str) -> str:
    """SQL steps up to `ends` (low, high): where the upper tail at `low` and the lower one at `high` are 0.025, by 45 halvings of [0, most]."""
    mid = lambda c: f"((lo_{c} + hi_{c}) / 2)"
    low, high = tail_low.replace("X", mid("l")), tail_high.replace("X", mid("u"))
    return f"""c AS (SELECT * FROM {cases}),
halved AS (SELECT {state}, 0 AS step, 0.0::DOUBLE AS lo_l, ({most})::DOUBLE AS hi_l, 0.0::DOUBLE AS lo_u, ({most})::DOUBLE AS hi_u FROM c
  UNION ALL SELECT {state}, step + 1, CASE WHEN {low} < 0.025 THEN {mid('l')} ELSE lo_l END, CASE WHEN {low} < 0.025 THEN hi_l ELSE {mid('l')} END, CASE WHEN {high} > 0.025 THEN {mid('u')} ELSE lo_u END, CASE WHEN {high} > 0.025 THEN hi_u ELSE {mid('u')} END FROM halved WHERE step < 45),
ends AS (SELECT {state}, {mid('l')} AS low, {mid('u')} AS high FROM halved WHERE step = 45)"""


TALLIES = "(SELECT source, count_if(toxic = 1)::BIGINT AS k, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)"
_BINOMIAL = "list_sum(list_transform(range({0}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(X) + (n - i) * ln(1 - X))))"
_POISSON = "list_sum(list_transform(range(0, {0}), lambda i: exp(i * ln(X) - X - lgamma(i + 1))))"


def tallies(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))


@query("a45_any_share", f"WITH RECURSIVE {_halved(TALLIES, 'source, k, n', '1', _BINOMIAL.format('k, n + 1'), _BINOMIAL.format('0, k + 1'))} SELECT source, k, n, round(CASE WHEN k = 0 THEN 0 ELSE low END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE high END, 6) AS high FROM ends")
def a45_any(spark, d):
    """The exact interval of the share of toxic documents of each source; the SQL halves the range until the tails are even."""
    i = tallies(spark, d).withColumn("i", intervals.binomial_interval("k", "n"))
    return i.select("source", "k", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("a46_any_rate", f"WITH RECURSIVE {_halved(TALLIES, 'source, k, n', '4 * k + 20', '(1 - ' + _POISSON.format('k') + ')', _POISSON.format('k + 1'))} SELECT source, k, round(CASE WHEN k = 0 THEN 0 ELSE low END / (n / 100.0::DOUBLE), 6) AS low, round(high / (n / 100.0::DOUBLE), 6) AS high FROM ends")
def a46_any(spark, d):
    """The exact interval of toxic documents a hundred of each source."""
    i = tallies(spark, d).withColumn("i", intervals.poisson_interval("k", F.col("n") / F.lit(100.0)))
    return i.select("source", "k", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


STRESS = ["short", "junk", "contact"]


@query("p02_stress_round_robin")
def p02(spark, d):
    """Five documents a source, in turn from three pools; rows only, as each pick removes a row from all pools."""
    has = lambda c, k: F.when(c, k)
    pools = F.array_compact(F.array(has(F.length("text") < 300, "short"), has(F.contains("text", F.lit("###")), "junk"), has(F.contains("text", F.lit("@")), "contact")))
    docs = t(spark, d, "documents").select("doc_id", "source", F.coalesce(pools, F.array().cast("array<string>")).alias("pools"))
    return samples.round_robin(docs, "doc_id", "source", "pools", STRESS, 5, "p02")


@query("w06_round_positions", "WITH r AS (SELECT doc_id, source, coalesce(lang, '') AS lang, row_number() OVER (PARTITION BY source, coalesce(lang, '') ORDER BY md5(doc_id || ':w06'), doc_id) AS rd FROM documents) SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY rd, coalesce(nullif(list_position(['es', 'de', 'en'], lang), 0), 4), lang) AS pick FROM r")
def w06(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"))
    return samples.in_rounds(docs, "lang", [samples.draw("doc_id", "w06"), "doc_id"], ["es", "de", "en"], ["source"]).select("doc_id", "source", "pick")


@query("w07_row_bands", "SELECT page_id // 10 AS doc, page_id, (page_id * 37 % 1000)::DOUBLE AS low, coalesce(lead((page_id * 37 % 1000)::DOUBLE) OVER (PARTITION BY page_id // 10 ORDER BY page_id * 37 % 1000, page_id), 1000.0) AS high FROM pages")
def w07(spark, d):
    """The band of a row of a page: from its anchor to the next, the last to the page's foot."""
    y = (F.col("page_id") * 37 % 1000).cast("double")
    rows = t(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("doc"), "page_id", y.alias("low"))
    return rows.withColumn("high", F.coalesce(F.lead("low").over(Window.partitionBy("doc").orderBy("low", "page_id")), F.lit(1000.0)))


@query("p06_blinded", f"SELECT 'P2-' || printf('%03d', row_number() OVER (ORDER BY md5(doc_id || ':p06'), doc_id)) AS sample_id, city, '' AS verdict FROM {ANNOTATED}")
def p06(spark, d):
    """What an annotator sees: new ids in a random order, the answers left out."""
    return _numbered(spark, d).select("sample_id", "city", F.lit("").alias("verdict"))


@query("p06_hidden", f"SELECT 'P2-' || printf('%03d', row_number() OVER (ORDER BY md5(doc_id || ':p06'), doc_id)) AS sample_id, doc_id, model_type, model_level FROM {ANNOTATED}")
def p06_hidden(spark, d):
    return _numbered(spark, d).select("sample_id", "doc_id", "model_type", "model_level")


def _numbered(spark, d):
    rows = annotated(spark, d).withColumn("_d", samples.draw("doc_id", "p06"))
    return samples.sample_ids(rows, ["_d", "doc_id"], "P2-%03d")
