"""Queries that audit reports: sections, numbers by name, consistency, replicates, evidence; reports are made of counts over `documents`.

The SQL computes from the counts that the sentences were made of, so it does not share the patterns that read them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import claims, corpus
from corpusloom.plans.common import t
from corpusloom.plans.registry import query

#: A report is told by city, condition and replicate; it has six sections of two or three sentences.
PROSE = """(SELECT city, section, condition, rep, a, b, a || ' groups were found, ' || (a % 90) || '.5% of them open. They hold ' || b || ' words' || CASE WHEN rep = 3 AND section = 's2' THEN ' and no more' ELSE '' END || '.' AS body FROM (SELECT city, section, condition, rep, n + CASE WHEN condition = 'b1' AND section <> 's4' THEN rep ELSE rep // 3 * (section <> 's4')::INT END AS a, m AS b FROM (SELECT source AS city, 's' || doc_id % 6 AS section, count(*) AS n, 1000 + sum(n_chars) % 9000 AS m FROM documents GROUP BY ALL), (VALUES ('full'), ('b1')) c(condition), (VALUES (1), (2), (3)) r(rep)))"""
RAW = "unnest([a::VARCHAR, (a % 90) || '.5%', b::VARCHAR])"


def prose(spark, d):
    """city, section, condition, rep and body of every section of every report."""
    n = t(spark, d, "documents").groupBy(F.col("source").alias("city"), F.concat(F.lit("s"), F.col("doc_id") % 6).alias("section")).agg(F.count("*").alias("n"), (1000 + F.sum("n_chars") % 9000).alias("b"))
    grid = spark.createDataFrame([(c, r) for c in ("full", "b1") for r in (1, 2, 3)], "condition string, rep int")
    fixed = F.col("section") == "s4"
    more = F.when(fixed, 0).when(F.col("condition") == "b1", F.col("rep")).otherwise(F.floor(F.col("rep") / 3))
    p = n.crossJoin(F.broadcast(grid)).withColumn("a", (F.col("n") + more).cast("long"))  # six rows
    tail = F.when((F.col("rep") == 3) & (F.col("section") == "s2"), " and no more").otherwise("")
    return p.select("city", "section", "condition", "rep", "a", "b", F.concat("a", F.lit(" groups were found, "), F.col("a") % 90, F.lit(".5% of them open. They hold "), "b", F.lit(" words"), tail, F.lit(".")).alias("body"))


def stated_numbers(spark, d):
    return prose(spark, d).select("city", "section", "condition", "rep", F.explode(F.array_distinct(text.numbers(F.col("body")))).alias("raw"))


@query("x53_section_claims", f"SELECT DISTINCT city, condition, rep, section, {RAW} AS raw FROM {PROSE}")
def x53(spark, d):
    return stated_numbers(spark, d).select("city", "condition", "rep", "section", "raw").distinct()


@query("x55_section_sentences", f"SELECT city, condition, rep, section, 0 AS pos, a || ' groups were found, ' || (a % 90) || '.5% of them open.' AS sentence FROM {PROSE} UNION ALL SELECT city, condition, rep, section, 1, 'They hold ' || b || ' words' || CASE WHEN rep = 3 AND section = 's2' THEN ' and no more' ELSE '' END || '.' FROM {PROSE}")
def x55(spark, d):
    p = prose(spark, d).select("city", "condition", "rep", "section", F.posexplode(claims.sentences(F.col("body"))).alias("pos", "sentence"))
    return p


ORDER_OF = {"s3": 0, "s0": 1, "s1": 2, "s2": 3, "s5": 4, "s4": 5}
ORDER_SQL = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDER_OF.items()) + " END"


def whole_reports(spark, d):
    """city, condition, rep and body: the sections' texts joined in the fixed order."""
    place = F.create_map(*[x for k, v in ORDER_OF.items() for x in (F.lit(k), F.lit(v))])[F.col("section")]
    parts = F.array_sort(F.collect_list(F.struct(place.alias("o"), "body")))
    return prose(spark, d).groupBy("city", "condition", "rep").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("body"))


@query("x55_whole_text", f"SELECT city, condition, rep, md5(string_agg(body, chr(10) || chr(10) ORDER BY {ORDER_SQL})) AS body_md5 FROM {PROSE} GROUP BY ALL")
def x55_whole(spark, d):
    return whole_reports(spark, d).select("city", "condition", "rep", F.md5(F.col("body").cast("binary")).alias("body_md5"))


LEVELS = f"(SELECT DISTINCT city, 'section:' || section AS level, condition || rep AS run, {RAW} AS raw FROM {PROSE} UNION SELECT DISTINCT city, 'whole', condition || rep, section || ' ' || raw FROM (SELECT DISTINCT city, section, condition, rep, {RAW} AS raw FROM {PROSE}))"
OVERLAP = f"(WITH l AS (SELECT * FROM {LEVELS}), n AS (SELECT city, level, run, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT x.city, x.level, x.run AS a, y.run AS b, count(*) AS k FROM l x JOIN l y ON x.city = y.city AND x.level = y.level AND x.raw = y.raw AND x.run < y.run GROUP BY ALL) SELECT p.city, p.level, p.run AS a, q.run AS b, CASE WHEN left(p.run, 1) <> left(q.run, 1) THEN 'full_b1' WHEN left(p.run, 1) = 'f' THEN 'full_full' ELSE 'b1_b1' END AS kind, coalesce(k, 0) AS shared, round(100.0::DOUBLE * coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)), 1) AS pct FROM n p JOIN n q ON p.city = q.city AND p.level = q.level AND p.run < q.run LEFT JOIN k ON k.city = p.city AND k.level = p.level AND k.a = p.run AND k.b = q.run)"


@query("a68_numeric_overlap", f"SELECT * FROM {OVERLAP}")
def a68(spark, d):
    """All pairs of a city's runs, by section and for whole reports."""
    s = stated_numbers(spark, d).withColumn("run", F.concat("condition", "rep"))
    levels = s.select("city", F.concat(F.lit("section:"), "section").alias("level"), "run", F.col("raw").alias("claim")).union(s.select("city", F.lit("whole"), "run", F.concat_ws(" ", "section", "raw")).toDF("city", "level", "run", "claim"))
    pairs = corpus.replicate_pairs(levels.distinct(), "run", "claim", ["city", "level"])
    first = lambda c: F.substring(c, 1, 1)
    kind = F.when(first("a") != first("b"), "full_b1").when(first("a") == "f", "full_full").otherwise("b1_b1")
    return pairs.select("city", "level", "a", "b", kind.alias("kind"), "shared", "pct")


@query("a50_section_summary", f"SELECT level, kind, count(pct) AS n, round(avg(pct), 4) AS mean, median(pct)::DOUBLE AS median, min(pct) AS low, max(pct) AS high FROM {OVERLAP} WHERE level <> 'whole' GROUP BY level, kind")
def a50(spark, d):
    s = a68(spark, d).filter("level <> 'whole'").groupBy("level", "kind")
    return s.agg(F.count("pct").alias("n"), F.round(F.avg("pct"), 4).alias("mean"), F.median("pct").alias("median"), F.min("pct").alias("low"), F.max("pct").alias("high"))


@query("j23_systems_side_by_side", f"WITH s AS (SELECT city, condition, sum(a)::BIGINT AS stated FROM {PROSE} WHERE rep = 1 GROUP BY ALL) SELECT f.city, f.stated AS full_stated, b.stated AS b1_stated, (b.stated - f.stated)::BIGINT AS delta FROM s f JOIN s b ON f.city = b.city AND f.condition = 'full' AND b.condition = 'b1'")
def j23(spark, d):
    p = prose(spark, d).filter("rep = 1").groupBy("city").pivot("condition", ["full", "b1"]).agg(F.sum("a"))
    return p.select("city", F.col("full").alias("full_stated"), F.col("b1").alias("b1_stated"), (F.col("b1") - F.col("full")).alias("delta"))


@query("a52_same_prompt_control", f"WITH p AS (SELECT city, condition || rep AS run, trim(body) AS body FROM {PROSE} WHERE section = 's4'), q AS (SELECT x.city, (x.body = y.body)::INT AS same FROM p x JOIN p y ON x.city = y.city AND x.run < y.run) SELECT q.city, count(*) AS n_pairs, round(avg(same), 4) AS identity_rate, any_value(u.n) AS unique_texts, any_value(u.n) = 1 AS one_number_set FROM q JOIN (SELECT city, count(DISTINCT body) AS n FROM p GROUP BY 1) u ON u.city = q.city GROUP BY q.city")
def a52(spark, d):
    """The section that both conditions write from the same prompt: identical pairs, texts, sets of numbers."""
    p = prose(spark, d).filter("section = 's4'").select("city", F.concat("condition", "rep").alias("run"), F.trim("body").alias("body"))
    other = p.select("city", F.col("run").alias("run_b"), F.col("body").alias("body_b"))
    pairs = p.join(other, "city").filter("run < run_b").groupBy("city").agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("body") == F.col("body_b")).cast("int")), 4).alias("identity_rate"))
    sets = p.groupBy("city").agg(F.countDistinct("body").alias("unique_texts"), (F.countDistinct(F.array_sort(F.array_distinct(text.numbers(F.col("body"))))) == 1).alias("one_number_set"))
    return pairs.join(sets, "city")


@query("a69_text_similarity")
def a69(spark, d):
    """Ratcliff-Obershelp ratios of all pairs of a city's runs, by section; rows only, as SQL has no such ratio."""
    p = prose(spark, d).select("city", "section", F.concat("condition", "rep").alias("run"), "body")
    other = p.select("city", "section", F.col("run").alias("run_b"), F.col("body").alias("body_b"))
    return p.join(other, ["city", "section"]).filter("run < run_b").select("city", "section", F.col("run").alias("a"), F.col("run_b").alias("b"), claims.similarity("body", "body_b").alias("similarity"))


@query("a82_report_diff", f"WITH f AS (SELECT * FROM {PROSE} WHERE rep = 3 AND condition = 'full'), g AS (SELECT * FROM {PROSE} WHERE rep = 3 AND condition = 'b1') SELECT f.city, f.section, len(string_split(f.body, ' '))::BIGINT AS words_full, (len(string_split(g.body, ' ')) - len(string_split(f.body, ' ')))::BIGINT AS delta, f.body = g.body AS identical, array_to_string(list_sort(list_filter([f.a::VARCHAR, (f.a % 90) || '.5%', f.b::VARCHAR], lambda x: x NOT IN (g.a::VARCHAR, (g.a % 90) || '.5%', g.b::VARCHAR))), ' ') AS only_full FROM f JOIN g USING (city, section)")
def a82(spark, d):
    p = prose(spark, d).filter("rep = 3").groupBy("city", "section").pivot("condition", ["full", "b1"]).agg(F.first("body"))
    n = lambda c: F.array_distinct(text.numbers(F.col(c)))
    words = lambda c: text.word_count(F.col(c))
    return p.select("city", "section", words("full").alias("words_full"), (words("b1") - words("full")).alias("delta"), (F.col("full") == F.col("b1")).alias("identical"), F.array_join(F.array_sort(F.array_except(n("full"), n("b1"))), " ").alias("only_full"))


HTML = "'<html><body><p>Before</p><h2>First <b>part</b></h2><div>none</div><p>' || body || '</p><p>Two &amp; more</p><h2>Second</h2><div><p>inside</p></div><p>' || city || '</p></body></html>'"


@query("x19_sections", f"SELECT city, condition, rep, section, unnest([0, 1, 2]) AS pos, unnest(['First part', 'First part', 'Second']) AS heading, unnest([body, 'Two & more', city]) AS para FROM {PROSE}")
def x19(spark, d):
    p = prose(spark, d).select("city", "condition", "rep", "section", F.posexplode(claims.sections(F.expr(HTML))).alias("pos", "s"))
    return p.select("city", "condition", "rep", "section", "pos", "s.heading", "s.para")


FACTS_OF = "(SELECT source AS city, count(*) AS n, max(n_chars) AS longest, count_if(lang = 'en')::BIGINT AS en, count_if(lang = 'de')::BIGINT AS de, min(doc_id) AS first FROM documents GROUP BY 1)"
PATHS = f"(SELECT city, unnest(['total', 'kinds.en', 'kinds.de', 'top[0][1]', 'places[north].n', 'places[1]', 'deep.a.b']) AS path, unnest(['_scalar', 'kinds', 'kinds', 'top', 'places', 'places', 'deep']) AS grp, unnest([n, en, de, longest, en, 7, first])::DOUBLE AS value FROM {FACTS_OF})"


def facts(spark, d):
    lang = lambda x: F.count_if(F.col("lang") == x)
    f = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), lang("en").alias("en"), lang("de").alias("de"), F.min("doc_id").alias("first"))
    body = F.format_string('{"total": %d, "open": true, "kinds": {"en": %d, "de": %d}, "top": [["x", %d]], "places": [{"name": "north", "n": %d}, 7], "deep": {"a": {"b": %d}}, "note": "3"}', "n", "en", "de", "longest", "en", "first")
    return f.select("city", F.explode(claims.flat_facts(body)).alias("x")).select("city", "x.path", "x.grp", "x.value")


@query("x20_flat_facts", f"SELECT * FROM {PATHS}")
def x20(spark, d):
    return facts(spark, d)


@query("j20_fact_candidates", f"WITH c AS (SELECT source AS city, doc_id AS claim_id, (n_chars % 60)::DOUBLE AS value FROM documents), h AS (SELECT c.claim_id, list(path ORDER BY length(path), path) AS l FROM c JOIN {PATHS} f ON f.city = c.city AND f.value = c.value GROUP BY 1) SELECT claim_id, coalesce(len(l), 0)::BIGINT AS n_candidates, coalesce(array_to_string(l[1:2], ' | ') || CASE WHEN len(l) > 2 THEN '  (+' || (len(l) - 2) || ' more)' ELSE '' END, '') AS slots FROM c LEFT JOIN h USING (claim_id)")
def j20(spark, d):
    """Two paths at most here, so that lists are cut on small tables."""
    c = t(spark, d, "documents").select(F.col("source").alias("city"), F.col("doc_id").alias("claim_id"), (F.col("n_chars") % 60).cast("double").alias("value"))
    return claims.fact_candidates(c, facts(spark, d), ["city"], 2).select("claim_id", "n_candidates", "slots")


@query("t09_shortest_paths", f"WITH r AS (SELECT city, path, row_number() OVER (PARTITION BY city ORDER BY length(path), path) AS rk FROM {PATHS}) SELECT city, string_agg(path, ' | ' ORDER BY rk) || '  (+4 more)' AS slots FROM r WHERE rk <= 3 GROUP BY city")
def t09(spark, d):
    p = facts(spark, d).groupBy("city").agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path"))).alias("p"))
    shown = F.array_join(F.transform(F.slice("p", 1, 3), lambda x: x["path"]), " | ")
    return p.select("city", F.concat(shown, F.lit("  (+"), F.size("p") - 3, F.lit(" more)")).alias("slots"))


LEDGER_N = "(SELECT source AS city, count(*) AS total, count_if(n_chars > 800)::BIGINT AS retained, count_if(n_chars BETWEEN 201 AND 800)::BIGINT AS discarded, count_if(n_chars <= 200)::BIGINT AS unknown FROM documents GROUP BY 1)"


def ledger(spark, d):
    n = F.col("n_chars")
    return t(spark, d, "documents").select(F.col("source").alias("city"), F.when(n > 800, "Retained").when(n > 200, "Discarded").otherwise("UNKNOWN").alias("decision"), F.when((n <= 800) & (n > 200), F.concat(F.lit("reason"), n % 3)).alias("reason"))


@query("x54_ledger_numbers", f"SELECT city, unnest(['total', 'retained', 'discarded', 'unknown']) AS what, unnest([total, retained, discarded, nullif(unknown, 0)])::DOUBLE AS value FROM {LEDGER_N} UNION ALL SELECT source, 'reason' || n_chars % 3, count(*)::DOUBLE FROM documents WHERE n_chars BETWEEN 201 AND 800 GROUP BY ALL".replace("SELECT city, unnest", "SELECT * FROM (SELECT city, unnest", 1).replace(f"FROM {LEDGER_N} UNION", f"FROM {LEDGER_N}) WHERE value IS NOT NULL UNION", 1))
def x54(spark, d):
    """Evidence numbers of a screening ledger; the unknown count only where there are such rows."""
    rows = ledger(spark, d)
    is_ = lambda x: F.count_if(F.col("decision") == x)
    n = rows.groupBy("city").agg(F.count("*").alias("a"), is_("Retained").alias("b"), is_("Discarded").alias("c"), F.nullif(is_("UNKNOWN"), F.lit(0)).alias("e"))
    long = n.select("city", F.expr("stack(4, 'total', a, 'retained', b, 'discarded', c, 'unknown', e) AS (what, value)")).filter("value IS NOT NULL")
    reasons = rows.filter("decision = 'Discarded'").groupBy("city", F.col("reason").alias("what")).agg(F.count("*").alias("value"))
    return long.union(reasons).withColumn("value", F.col("value").cast("double"))


@query("a74_ledger_validation", f"WITH s AS (SELECT *, retained + (total % 2) AS stated FROM {LEDGER_N}) SELECT city, retained AS extracted, stated, retained = stated AS agrees, CASE WHEN retained = stated THEN discarded END AS used FROM s")
def a74(spark, d):
    """Extracted against stated outcomes; groups that don't agree are left out of what follows."""
    is_ = lambda x: F.count_if(F.col("decision") == x)
    n = ledger(spark, d).groupBy("city").agg(F.count("*").alias("total"), is_("Retained").alias("extracted"), is_("Discarded").alias("discarded"))
    said = F.concat(F.lit("Screening outcome: "), F.col("extracted") + F.col("total") % 2, F.lit(" of "), "total", F.lit(" URLs retained."))
    n = n.withColumn("stated", claims.stated_outcome(said)["retained"]).withColumn("agrees", F.col("extracted") == F.col("stated"))
    used = n.join(n.filter("agrees").select("city"), "city", "left_semi").select("city", F.col("discarded").alias("used"))
    return n.join(used, "city", "left").select("city", "extracted", "stated", "agrees", "used")


NAMES = ["Ward 1", "Ward 3", "Ward 12", "Old Harbour", "Gràcia", "Green Hill"]
NAMED = """(SELECT source AS city, n, m, 'Ward 12 (' || n || ' groups), Ward 1, 3 and 5 follow; Old Harbour, which hosts ' || m || ', is next. Rebost de Gràcia has ' || (n + 1) || '. Green Hill stands alone, whereas 77 came later.' AS body FROM (SELECT source, count(*) AS n, max(n_chars) % 900 + 100 AS m FROM documents GROUP BY 1))"""


def named(spark, d):
    n = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("n"), (F.max("n_chars") % 900 + 100).alias("m"))
    return n.withColumn("body", F.concat(F.lit("Ward 12 ("), "n", F.lit(" groups), Ward 1, 3 and 5 follow; Old Harbour, which hosts "), "m", F.lit(", is next. Rebost de Gràcia has "), F.col("n") + 1, F.lit(". Green Hill stands alone, whereas 77 came later.")))


@query("x17_numbers_outside_names", f"SELECT city, unnest([n::VARCHAR, m::VARCHAR, (n + 1)::VARCHAR, '77']) AS raw, unnest([0, 1, 2, 3]) AS pos FROM {NAMED}")
def x17(spark, d):
    p = named(spark, d).select("city", F.posexplode(claims.numbers_outside_names(NAMES)(F.col("body"))).alias("pos", "x"))
    return p.select("city", F.col("x.raw").alias("raw"), "pos")


@query("w08_numbers_by_name", f"SELECT city, 'Ward 12' AS name, n::VARCHAR AS raw FROM {NAMED} UNION ALL SELECT city, 'Ward 1', n::VARCHAR FROM {NAMED} UNION ALL SELECT city, 'Old Harbour', m::VARCHAR FROM {NAMED} UNION ALL SELECT city, 'Green Hill', (n + 1)::VARCHAR FROM {NAMED}")
def w08(spark, d):
    """The nearest number in its clause; an organisation's name and numbers beyond its end give none."""
    s = named(spark, d).select("city", F.explode(claims.numbers_by_name(NAMES)(F.col("body"))).alias("x"))
    return s.select("city", "x.name", "x.raw")


@query("f38_organisation_context", f"SELECT city, 'Gràcia' AS name, true AS organisation FROM {NAMED} UNION ALL SELECT city, 'Old Harbour', false FROM {NAMED}")
def f38(spark, d):
    names = F.explode(F.array(F.lit("Gràcia"), F.lit("Old Harbour"))).alias("name")
    return named(spark, d).select("city", "body", names).select("city", "name", F.expr(r"body RLIKE concat('(?i)\\b(?:de|di|del|della|du)\\s+', name)").alias("organisation"))


@query("x28_capitalised_candidates", f"SELECT city, unnest(['Ward 12', 'Old Harbour']) AS name FROM {NAMED}")
def x28(spark, d):
    return named(spark, d).select("city", F.explode(claims.capitalised_candidates(F.col("body"))).alias("name"))


SAID = "(SELECT source AS city, count(*) AS total, count_if(lang = 'en')::BIGINT AS en, count_if(lang = 'de')::BIGINT AS de, count_if(lang = 'es')::BIGINT AS es FROM documents GROUP BY 1)"


def said(spark, d):
    lang = lambda x: F.count_if(F.col("lang") == x).alias(x)
    s = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("total"), lang("en"), lang("de"), lang("es"))
    one = F.concat(F.lit("The majority, "), "en", F.lit(" groups, write English"))
    two = F.concat(F.lit("Ward 1 ("), "de", F.lit("), Ward 3 ("), "es", F.lit(") together account for "), F.floor(100 * (F.col("de") + F.col("es")) / F.col("total")) + F.length("city") % 2, F.lit("%"))
    three = F.lit("Per capita, no census data hold")
    return s.select("city", "total", F.explode(F.array(one, two, three)).alias("sentence"))


FLAGS = f"""SELECT city, 'majority' AS chk, 'majority: ' || en || ' is ' || printf('%.2f', 100 * en::DOUBLE / total) || '%' AS detail FROM {SAID} WHERE 100 * en::DOUBLE / total <= 50
UNION ALL SELECT city, 'sum', de || '+' || es || ' is ' || printf('%.2f', 100 * (de + es)::DOUBLE / total) || '%, not ' || ((100 * (de + es)) // total + length(city) % 2) || '%' FROM {SAID} WHERE abs(100 * (de + es)::DOUBLE / total - ((100 * (de + es)) // total + length(city) % 2)) > 0.55
UNION ALL SELECT city, 'basis', unnest(['Per capita', 'census data']) FROM {SAID}"""


@query("x24_consistency_checks", FLAGS)
def x24(spark, d):
    """Words for a large share, sums that shares don't fit, figures without a basis (also x25 and x26), over all sentences."""
    flags = said(spark, d).select("city", F.explode(claims.consistency_flags(NAMES)("sentence", "total")).alias("f"))
    return flags.select("city", F.col("f.check").alias("chk"), "f.detail")


@query("x25_account_for", f"SELECT * FROM ({FLAGS}) WHERE chk = 'sum'")
def x25(spark, d):
    only = {"sum": claims.sum_flags}
    return said(spark, d).select("city", F.explode(claims.consistency_flags(NAMES, only)("sentence", "total")).alias("f")).select("city", F.col("f.check").alias("chk"), "f.detail")


@query("a70_candidate_flags", f"SELECT city, chk, count(*) AS n, 'CANDIDATE' AS status, 'UNVERIFIED' AS verdict FROM ({FLAGS}) GROUP BY city, chk")
def a70(spark, d):
    n = x24(spark, d).groupBy("city", "chk").agg(F.count("*").alias("n"))
    return n.withColumns({"status": F.lit("CANDIDATE"), "verdict": F.lit("UNVERIFIED")})


@query("a61_old_and_new_flags", f"WITH n AS (SELECT city, chk, count(*) AS n FROM ({FLAGS}) GROUP BY ALL) SELECT city, coalesce(sum(n) FILTER (chk = 'basis'), 0)::BIGINT AS old_flags, sum(n)::BIGINT AS new_flags FROM n GROUP BY city")
def a61(spark, d):
    """Flags of the old rules (one check) beside those of the widened rules (all)."""
    old = said(spark, d).select("city", F.explode(claims.consistency_flags(NAMES, {"basis": claims.basis_flags})("sentence", "total"))).groupBy("city").agg(F.count("*").alias("old_flags"))
    new = x24(spark, d).groupBy("city").agg(F.count("*").alias("new_flags"))
    return new.join(old, "city", "left").select("city", F.coalesce("old_flags", F.lit(0).cast("long")).alias("old_flags"), "new_flags")


@query("x47_applicability", f"SELECT city, condition, rep, sum(len(string_split(body, ' ')))::BIGINT AS words, sum(length(body) - length(replace(body, '%', '')))::BIGINT AS percents, bool_or(contains(body, 'population') OR contains(body, 'capita')) AS has_basis FROM {PROSE} GROUP BY ALL")
def x47(spark, d):
    percents = F.length("body") - F.length(F.replace("body", F.lit("%"), F.lit("")))
    return prose(spark, d).groupBy("city", "condition", "rep").agg(F.sum(text.word_count(F.col("body"))).alias("words"), F.sum(percents).alias("percents"), F.max(F.col("body").rlike("population|capita")).alias("has_basis"))


@query("j14_stated_counts", "WITH c AS (SELECT source AS city, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT city, n + n % 3 - 1 AS stated FROM c WHERE length(city) % 2 = 0 UNION ALL SELECT 'nowhere', 4) SELECT s.city, stated, n AS recomputed, coalesce(stated = n, false) AS matches FROM s LEFT JOIN c USING (city)")
def j14(spark, d):
    c = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("recomputed"))
    s = c.filter(F.length("city") % 2 == 0).select("city", (F.col("recomputed") + F.col("recomputed") % 3 - 1).alias("stated")).union(spark.createDataFrame([("nowhere", 4)], "city string, stated long"))
    return s.join(c, "city", "left").select("city", "stated", "recomputed", F.coalesce(F.col("stated") == F.col("recomputed"), F.lit(False)).alias("matches"))


@query("a55_sum_vs_total", "WITH c AS (SELECT source AS city, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT city, sum(n)::BIGINT AS summed FROM c GROUP BY 1) SELECT city, summed, CASE WHEN summed % 3 <> 0 THEN summed + summed % 2 END AS total, CASE WHEN summed % 3 <> 0 THEN summed % 2 = 0 END AS equal FROM s")
def a55(spark, d):
    s = t(spark, d, "documents").groupBy(F.col("source").alias("city")).agg(F.count("*").alias("summed"))
    total = F.when(F.col("summed") % 3 != 0, F.col("summed") + F.col("summed") % 2)
    return s.withColumn("total", total).withColumn("equal", F.col("summed") == F.col("total"))


@query("j15_errors_and_flags", "WITH e AS (SELECT doc_id AS id, source AS city, lang AS section, [n_chars % 20, 900 + n_chars % 5] AS nums FROM documents WHERE lang IS NOT NULL), f AS (SELECT doc_id AS flag_id, source AS city, 'Part ' || upper(lang) || ' of it' AS heading, [n_chars % 25] AS nums FROM documents JOIN labels USING (doc_id)) SELECT e.id, min(flag_id) AS flag_id FROM e LEFT JOIN f ON f.city = e.city AND contains(lower(heading), section) AND list_has_any(f.nums, e.nums) GROUP BY e.id")
def j15(spark, d):
    docs, n = t(spark, d, "documents"), F.col("n_chars")
    e = docs.filter("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("city"), F.col("lang").alias("section"), F.array(n % 20, 900 + n % 5).alias("nums"))
    f = docs.join(t(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("flag_id"), F.col("source").alias("city"), F.concat(F.lit("Part "), F.upper("lang"), F.lit(" of it")).alias("heading"), F.array(n % 25).alias("flag_nums"))
    return claims.matched_errors(e, f, "city").select("id", "flag_id")


@query("f40_section_contains", f"SELECT city, section, contains(lower('The S1 and s2 part'), lower(trim(section))) AS inside FROM (SELECT DISTINCT city, section FROM {PROSE})")
def f40(spark, d):
    s = prose(spark, d).select("city", "section").distinct()
    return s.select("city", "section", F.contains(F.lower(F.lit("The S1 and s2 part")), F.lower(F.trim("section"))).alias("inside"))


@query("a77_claims_by_system", f"WITH e AS (SELECT city, value FROM {PATHS}), c AS (SELECT DISTINCT city, condition, rep, section, a::DOUBLE AS v FROM {PROSE}) SELECT c.condition AS system, c.city, count(*) AS n, count_if(EXISTS (SELECT 1 FROM e WHERE e.city = c.city AND e.value = c.v))::BIGINT AS direct FROM c GROUP BY ALL")
def a77(spark, d):
    """Claims of each condition against one table of evidence a city, which all replicates share (also a78)."""
    evidence = facts(spark, d).select("city", F.col("value").alias("v")).distinct().withColumn("hit", F.lit(True))
    c = prose(spark, d).select("city", "condition", "rep", "section", F.col("a").cast("double").alias("v")).distinct().join(evidence, ["city", "v"], "left")
    return c.groupBy(F.col("condition").alias("system"), "city").agg(F.count("*").alias("n"), F.count_if("hit").alias("direct"))


@query("a78_evidence_base", f"SELECT city, grp, count(*) AS n, sum(value) AS total FROM {PATHS} GROUP BY ALL")
def a78(spark, d):
    return facts(spark, d).groupBy("city", "grp").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
