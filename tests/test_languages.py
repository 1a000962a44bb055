"""Language by trigram profiles against plain Python, odd rows, and agreement on held-out documents."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import languages
from corpusloom.plans import scalars

LABELLED = [("en", "The cat sat on the mat, and the dog was there too."), ("en", "this thing that"), ("fr", "Le chat était là avec le chien, et la nuit"), ("de", "Der Hund und die Katze, über alles"), (None, "nothing to learn from"), ("de", None)]


def grams(text):
    return [w[k : k + 3] for x in re.findall(r"[^\W\d_]+", (text or "").lower()) for w in [f" {x} "] for k in range(len(w) - 2)]


def slow(labelled, texts, most):
    counts = {}
    for lang, text in labelled:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    counts = {k: c for k, c in counts.items() if c}
    top = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]) for k, c in counts.items()}
    known = set().union(*top.values())
    score = {k: {g: round(1000 * math.log((top[k].get(g, 0) + 1) / (sum(counts[k].values()) + len(known)))) for g in known} for k in top}
    out = {}
    for key, text in texts:
        used = [g for g in grams(text) if g in known]
        sums = sorted((-sum(s[g] for g in used), k) for k, s in score.items())
        out[key] = (sums[0][1], (sums[1][0] - sums[0][0]) // len(used)) if used else ("unknown", None)
    return out


@pytest.mark.parametrize("most", [12, 2000])
def test_detection_equals_plain_python(spark, most):
    texts = [(1, "The dog and the cat"), (2, "la nuit était là"), (3, "über die Katze"), (4, None), (5, "123 !"), (6, "ЖЖЖ"), (7, "a"), (8, "THE the " * 5000)]
    table = languages.profiles(spark.createDataFrame(LABELLED, "lang string, text string"), most=most)
    df = spark.createDataFrame(texts, "id long, text string").withColumns({"lang": F.lit("clash"), "score": F.lit(1), "gram": F.lit("the")})
    got = {r["id"]: (r["language"], r["margin"]) for r in languages.detect(df, table, "id").collect()}
    assert got == slow(LABELLED, texts, most)
    away = languages.detect(df, table, "id", reachable=F.col("id") > 1).filter("id = 1").first()
    assert (away["language"], away["margin"]) == ("unknown", None)


def test_nothing_to_learn_or_to_read(spark):
    none = languages.profiles(spark.createDataFrame([(None, "x")], "lang string, text string"))
    texts = spark.createDataFrame([(1, "some words")], "id long, text string")
    assert [tuple(r) for r in languages.detect(texts, none, "id").collect()] == [(1, "unknown", None)]
    assert languages.detect(texts.limit(0), languages.profiles(spark.createDataFrame(LABELLED, "lang string, text string")), "id").collect() == []


def test_agreement_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = languages.profiles(docs.filter("doc_id % 5 <> 0"))
    found = languages.detect(docs, table, "doc_id").join(docs.filter("doc_id % 5 = 0 AND lang IS NOT NULL AND length(text) > 0").select("doc_id", "lang"), "doc_id")
    n, right = found.count(), found.filter("language = lang").count()
    assert n > 100 and right / n > 0.95


def test_no_words_of_texts_are_written_and_one_row_a_text_moves(spark, monkeypatch):
    table = languages.profiles(spark.createDataFrame(LABELLED, "lang string, text string"))
    df = spark.createDataFrame([(k, "the cat and la nuit " * 50) for k in range(20)], "id long, text string").coalesce(1)
    monkeypatch.delattr(languages, "written")
    found = languages.detect(df, table, "id").collect()
    assert len(found) == 20 and len({(r["language"], r["margin"]) for r in found}) == 1


def test_agreement_detects_held_out_documents_only(spark, monkeypatch):
    asked = []
    detect = languages.detect
    monkeypatch.setattr(scalars.languages, "detect", lambda texts, *a, **k: asked.append(texts) or detect(texts, *a, **k))
    rows = scalars.x51_agreement(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["n"] for r in rows) == asked[0].count() and asked[0].filter("doc_id % 5 <> 0").count() == 0
