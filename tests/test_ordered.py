"""Numbers, running sums and order statistics over ranges, against Python's own."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, ordered


@pytest.mark.parametrize("by", [None, ["g"]])
def test_running_sums_cross_ranges(spark, by):
    rows = [(k, None if k % 7 == 0 else k % 3, (k * 37) % 101) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, g int, v long").repartition(7)
    got = {r["k"]: (r["rank"], r["upto"]) for r in ordered.running(df, [F.desc("v"), "k"], {"rank": F.lit(1), "upto": F.col("v")}, by).collect()}
    groups = {}
    for k, g, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        n, total = groups.get(g if by else 0, (0, 0))
        groups[g if by else 0] = n + 1, total + v
        assert got[k] == (n + 1, total + v)


def test_order_statistics_by_index(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9, 3)] + [("b", 2.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["low"], r["high"]) for r in ordered.order_statistics(df, "v", {"low": 0.25, "high": 0.75}, ["g"]).collect()}
    assert got == {"a": (1.0, 5.0), "b": (2.0, 2.0)}
    assert tuple(ordered.order_statistics(df, "v", {"low": 0.25, "high": 0.75}).first()) == (1.0, 5.0)


def test_merged_parts(spark):
    df = spark.createDataFrame([(1, "x", "aa"), (2, "x", "bbb"), (3, "x", None), (4, None, "c")], "i long, k string, t string")
    got = {(r["k"], r["part"]): (r["primary"], r["n_merged"], r["merged"]) for r in corpus.merge_by(df, "k", "t", "i", 2).collect()}
    assert got == {("x", 0): (2, 2, "bbb\n\naa"), ("x", 1): (2, 1, ""), (None, 0): (4, 1, "c")}


def test_equal_allocation_deals_out_the_rest(spark):
    df = spark.createDataFrame([("a", 2), ("b", 10), ("c", 10), ("d", 0)], "s string, cap long")
    got = {r["s"]: r["alloc"] for r in corpus.equal_allocation(df, ["s"], "cap", 13).collect()}
    assert got["a"] == 2 and got["d"] == 0 and sorted((got["b"], got["c"])) == [5, 6]
    assert sum(r["alloc"] for r in corpus.equal_allocation(df, ["s"], "cap", 99).collect()) == 22
