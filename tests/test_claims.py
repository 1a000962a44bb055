import re

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import claims


def test_sentences_and_numbers(spark):
    df = spark.createDataFrame([("We saw 14,896 and 44.3% of 50. Then more.",), (None,)], "t string")
    rows = df.select(claims.sentences(F.col("t")).alias("s"), claims.number_tokens(F.col("t")).alias("n")).collect()
    assert rows[0]["s"] == ["We saw 14,896 and 44.3% of 50.", "Then more."] and rows[1]["s"] == [] and rows[1]["n"] == []
    assert [(n["raw"], n["value"], n["is_pct"], n["start"]) for n in rows[0]["n"]] == [("14,896", 14896.0, False, 7), ("44.3%", 44.3, True, 18), ("50", 50.0, False, 27)]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(claims.similarity("a", "b")).collect()] == [0.75, None]


def test_numbers_end_where_no_word_goes_on(spark):
    texts = ["44.3rd", "1,234,5678 a5 5%x 7% 1,234.5%", "x_1 1_x (51.9%) of 62, 26.2%", "3.", "1,23"]
    rule = re.compile(r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?%?(?!\w)|\b\d+(?:\.\d+)?%?(?!\w)")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.orderBy("k").select(text.numbers(F.col("t")).alias("a"), claims.number_tokens(F.col("t")).alias("b")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert r["a"] == [n["raw"] for n in r["b"]] == rule.findall(t), t


def test_count_percent_shapes(spark):
    said = ["3 (50%) of them, 1 (25%)", "36 of the 51 (70.6%) came", "19 of 47 kept groups (50%)", "8 of 24 kept, or 40%, went", "others (62, 26.2%), then (49, 20.7%)", None]
    df = spark.createDataFrame([(k, t, 4 if k == 0 else 237) for k, t in enumerate(said)], "k int, t string, n int")
    found = {(r["k"], r["shape"], r["n"], r["whole"], r["stated"]) for r in claims.count_percent_mismatches(df, "k", "t", "n").collect()}
    assert found == {(0, "of_total", 3.0, 4.0, 50.0), (2, "of_whole_in_brackets", 19.0, 47.0, 50.0), (3, "of_whole_after_comma", 8.0, 24.0, 40.0)}


def test_bootstrap_covers_the_ratio(spark):
    df = spark.createDataFrame([(k % 50, k % 2, 1) for k in range(400)], "c int, p int, w int")
    low, high = claims.bootstrap_ratio(df, "c", "p", "w", 500)
    assert low <= 0.5 <= high and claims.bootstrap_ratio(df, "c", "p", "w", 500) == (low, high)


def test_in_ring(spark):
    square = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(claims.in_ring(F.col("x"), F.col("y"), square)).collect()] == [True, False]
