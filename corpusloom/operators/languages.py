"""The language of texts by character trigrams: profiles counted in Spark, scores summed by a join with a bounded table (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import written

#: Trigrams a language's profile keeps, its most frequent; languages at most; units of a score to one of a natural logarithm.
PROFILE, MOST_LANGUAGES, UNITS = 2000, 256, 1000
UNKNOWN = "unknown"


def _words(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))


def _trigrams(word: Column) -> Column:
    """The trigrams of a word with a space at either side."""
    held = F.concat(F.lit(" "), word, F.lit(" "))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(held) - 2), lambda k: F.substring(held, k, F.lit(3))))


def profiles(labelled: DataFrame, text: str = "text", language: str = "lang", most: int = PROFILE) -> DataFrame:
    """gram, lang and score: for each trigram in some language's profile, what it tells for each language.

    All labelled rows count; rows without a language don't. A profile is the `most` most frequent
    trigrams of a language, the first of equals; a score is the logarithm of the trigram's
    share in the language, one added to each count of the profiles' trigrams, in whole
    thousandths. So sums of scores are whole numbers, and the table has at most `most` times
    the square of the number of languages rows.
    """
    words = labelled.filter(F.col(language).isNotNull()).select(F.col(language).alias("lang"), _words(F.col(text)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = words.select("lang", "n", _trigrams(F.col("word")).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "trigrams")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= most)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if totals.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    grams = ranked.select("gram").distinct()
    size = grams.agg(F.count("*").alias("size"))
    # Languages are few, and checked to be; the product has as many rows as the table that is returned.
    dense = grams.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(size)).join(ranked.select("gram", "lang", "n"), ["gram", "lang"], "left")
    share = (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("size"))
    return dense.select("gram", "lang", F.round(UNITS * F.log(share)).cast("long").alias("score"))


def detect(texts: DataFrame, table: DataFrame, key: str, text: str = "text", reachable: Column | None = None) -> DataFrame:
    """key, language and margin of each text: the language whose scores, summed over all trigrams of the whole text, are largest.

    table: see profiles; it is bounded and sent to all tasks. Of equal sums the first language
    wins. margin: the sum's lead over the next one a trigram, in units of a thousandth. A text that is
    not reachable, null, without letters, or without a trigram of the profiles is `unknown`.
    key must tell texts apart.
    """
    languages = sorted(r["lang"] for r in table.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    rows = texts.select(F.col(key), (reachable if reachable is not None else F.lit(True)).alias("_reachable"), F.col(text).alias("_text"))
    answers = rows.select(key)
    if not languages:
        return answers.select(key, F.lit(UNKNOWN).alias("language"), F.lit(None).cast("long").alias("margin"))
    wide = table.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, F.col("score"))).alias(f"s{k}") for k, x in enumerate(languages)])
    # The table of trigrams is bounded, so a text's trigrams are looked up where the text lies, and one row of it moves.
    scores = range(len(languages))
    grams = rows.filter("_reachable").select(key, _words(F.col("_text")).alias("_word")).select(key, _trigrams(F.col("_word")).alias("_gram"))
    sums = grams.join(F.broadcast(wide), F.col("_gram") == F.col("gram")).groupBy(key).agg(F.count("*").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in scores])
    order = F.array_sort(F.array(*[F.struct((-F.col(f"s{k}")).alias("less"), F.lit(x).alias("lang")) for k, x in enumerate(languages)]))
    best = sums.select(key, "n", order.alias("o")).select(F.col(key), F.col("o")[0]["lang"].alias("language"), F.floor((F.get("o", F.lit(1))["less"] - F.col("o")[0]["less"]) / F.col("n")).alias("margin"))
    return answers.join(best, key, "left").select(key, F.coalesce("language", F.lit(UNKNOWN)).alias("language"), "margin")


def sql(labelled: str, texts: str, most: int = PROFILE) -> str:
    """Steps of a WITH clause up to `detected` (key, language, margin); labelled (lang, text) and texts (key, text; reachable ones) are SQL tables."""
    words = r"unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+'))"
    grams = "unnest(list_transform(range(1, length(word) + 1), lambda k: substr(' ' || word || ' ', k, 3)))"
    return f"""spelled AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, {words} AS word FROM {labelled} WHERE lang IS NOT NULL) GROUP BY ALL),
counted AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, {grams} AS gram FROM spelled) GROUP BY ALL),
ranked AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {most}),
grams AS (SELECT DISTINCT gram FROM ranked),
totals AS (SELECT lang, sum(n) AS total FROM counted GROUP BY lang),
profiles AS MATERIALIZED (SELECT gram, lang, round({UNITS} * ln((coalesce(n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM grams))))::BIGINT AS score FROM grams CROSS JOIN totals LEFT JOIN ranked USING (gram, lang)),
used AS (SELECT key, gram, count(*) AS n FROM (SELECT key, {grams} AS gram FROM (SELECT key, {words} AS word FROM {texts})) GROUP BY ALL),
sums AS (SELECT key, lang, sum(used.n * score)::BIGINT AS score, sum(used.n) AS n FROM used JOIN profiles USING (gram) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM sums WINDOW w AS (PARTITION BY key ORDER BY score DESC, lang)),
detected AS (SELECT key, coalesce(lang, '{UNKNOWN}') AS language, floor((score - second)::DOUBLE / n)::BIGINT AS margin FROM (SELECT key FROM {texts}) LEFT JOIN (SELECT * FROM placed WHERE place = 1) USING (key))"""
