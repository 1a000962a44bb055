"""Operators on inputs that the queries' SQL leaves out."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import corpus
from corpusloom.streaming import fetched

SF = "/root/testdata/sf0.001"


def test_label_claims_keeps_rows_that_repeat_an_id(spark):
    found = spark.createDataFrame([("g", "a", 5.0, "value"), ("g", "a+b", 9.0, "sum"), ("g", "a", 40.0, "pct")], "g string, k string, v double, kind string")
    claims = spark.createDataFrame([(1, 5.0, False), (1, 9.0, False), (1, 9.0, False), (2, 40.3, True), (2, 40.3, False), (3, None, False)], "claim_id long, v double, is_pct boolean")
    assert sorted((r["claim_id"], r["label"]) for r in corpus.label_claims(claims, found).collect()) == [
        (1, "DERIVED"), (1, "DERIVED"), (1, "DIRECT"), (2, "DERIVED"), (2, "NOT_MACHINE_AUDITABLE"), (3, "NOT_MACHINE_AUDITABLE"),
    ]


def test_nearest_takes_any_query_set_in_blocks(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    odd = spark.createDataFrame([(9000, None), (9001, [0.0, 0.0]), (9020, [1.0])], "vec_id long, v array<double>")
    q = e.union(odd).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = {}
    for r in corpus.nearest(q, e.union(odd), query_block=8, vector_block=100).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["cosine"]))
    rows = sorted((r["vec_id"], r["v"]) for r in e.collect())
    ids, vs = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    unit = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    for i, got in found.items():
        c = np.round(unit @ unit[ids == i][0], 6)
        wanted = [k for k in np.lexsort((ids, -c)) if ids[k] != i][:10]
        assert [g[0] for g in got] == ids[wanted].tolist() and np.allclose([g[1] for g in got], c[wanted], atol=2e-6)


def test_thoughts_are_stripped_from_whole_texts(spark):
    texts = [x for (x,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    raw = [f"<think>{x}</think>\n\t {x}\r\n" for x in texts] + [f"{x}<think>\n</think> \u00a0<think>{x}</think>{x}\u2003" for x in texts[:20]]
    raw += ["a <think> b", "a </think> b", "<think>a<think>b</think>c</think>\n", "\n\x1c", "", "<think>" + "x\n" * 200_000 + "</think>" + " " * 200_000 + "y"]
    df = spark.createDataFrame(list(enumerate(raw)), "k long, t string")
    found = {r["k"]: r["a"] for r in df.select("k", text.without_thoughts(F.col("t")).alias("a")).collect()}
    assert [found[k] for k in range(len(raw))] == [re.sub("<think>.*?</think>", "", x, flags=re.DOTALL).strip() for x in raw]


def test_internal_links_are_resolved_before_they_are_counted(spark):
    page = """<link href="/css"><A class='x' HREF='/a'>1</a><a href="/a/"><a href="/a#x"><a href=b?p=1&amp;q=2><a href="//other.host/z"><a href="//Site.org/c">
    <a data-href="/no" href = "https://site.org/d"><a href="mailto:x@y"><a href="../up"><a href="#top"><a title="a > b href='/q'" href="http://[bad"><a href="/e">""" + f"<a {'x' * 50_000} {'z=1 ' * 200}href=/f><a title=\"open"
    df = spark.createDataFrame([("http://site.org/dir/page/", page), (None, page), ("http://site.org/", None)], "url string, html string")
    found = [r[0] for r in df.select(urls.internal_links(F.col("url"), text.hrefs(F.col("html")))).collect()]
    h = "http://site.org"
    assert found == [[f"{h}/a", f"{h}/dir/page/b?p=1&q=2", "http://Site.org/c", "https://site.org/d", f"{h}/dir/up", f"{h}/e", f"{h}/f"], [], []]


def test_challenges_in_late_titles_and_all_signals(spark):
    late = "<html>" + " " * 600 + "<title>Just a Moment...</title>"
    df = spark.createDataFrame([(late,), ("<p>Please wait</p>",), ("x" * 500 + " captcha",), (None,)], "html string").withColumn("url", F.lit("u"))
    assert [r["blocked"] for r in fetched.screened(df).collect()] == [True, True, False, False]
