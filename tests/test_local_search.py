"""Local search on a small graph, by hand."""

import time

from pyspark.sql import functions as F

from corpusloom.operators import local_search


def test_texts_by_names_neighbours_and_budget(spark):
    names = {1: ["ANNA", "BERT"], 2: ["ANNA"], 3: ["BERT", "CARL"], 4: ["ANNA", "CARL", "BERT"], 5: ["DORA"]}
    mentions = spark.createDataFrame([(c, n) for c, ns in names.items() for n in [*ns, ns[0]]], "chunk long, name string")
    pairs = spark.createDataFrame([("ANNA", "BERT", 2.0), ("ANNA", "CARL", 1.0), ("BERT", "CARL", 2.0), ("DORA", "DORA", 1.0)], "a string, b string, weight double")
    chunks = spark.createDataFrame([(k, "w " * n) for k, n in {1: 10, 2: 5, 3: 10, 4: 20, 5: 1}.items()], "chunk long, text string").withColumn("words", local_search.word_count(F.col("text")))
    questions = spark.createDataFrame([(1, "What did Anna do with Carl and Anna?"), (2, "Nobody known"), (3, None), (4, "Dora and Bert")], "query_id long, text string")
    asked = local_search.seeds(questions, mentions.select("name").distinct())
    assert sorted(map(tuple, asked.collect())) == [(1, "ANNA", 1), (1, "CARL", 2), (4, "BERT", 2), (4, "DORA", 1)]
    got = local_search.local_texts(asked, mentions, pairs, chunks, 40)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(1, 1, 4, "ANNA", 2), (1, 2, 1, "ANNA", 1), (1, 3, 2, "ANNA", 0), (4, 1, 5, "DORA", 0), (4, 2, 4, "BERT", 2), (4, 3, 1, "BERT", 1)]
    assert sorted(tuple(r)[:3] for r in local_search.local_texts(asked, mentions, pairs, chunks, 30).collect() if r["query_id"] == 1) == [(1, 1, 4), (1, 2, 1)]
    relations = sorted(tuple(r)[:4] for r in local_search.local_relations(asked, pairs, 4).collect())
    assert relations[:2] == [(1, 1, "ANNA", "BERT"), (1, 2, "BERT", "CARL")] and len(relations) == 4
    out = {r["query_id"]: (r["n_texts"], r["context"], r["error"]) for r in local_search.answers(questions, got, chunks, 1).collect()}
    assert out[1] == (3, "w " * 20, None) and out[2] == (0, "", "no text for 2") and out[3][2] and out[4] == (3, "w ", None)
    none = local_search.local_texts(asked.limit(0), mentions, pairs, chunks)
    assert none.collect() == []


def test_a_name_of_many_texts_and_many_neighbours(spark):
    n = 40_000
    mentions = spark.range(n).selectExpr("id AS chunk", "explode(array('ANNA', concat('N', id), concat('N', (id + 1) % 40000))) AS name")
    pairs = spark.range(n).selectExpr("'ANNA' AS a", "concat('N', id) AS b", "1 AS weight")
    chunks = spark.range(n).selectExpr("id AS chunk", "1 AS words")
    asked = spark.createDataFrame([(1, "ANNA", 1)], "query_id long, name string, place int")
    start = time.time()
    got = sorted(tuple(r) for r in local_search.local_texts(asked, mentions, pairs, chunks, 5).collect())
    assert got == [(1, k + 1, k, "ANNA", 2, 1) for k in range(5)]
    # Its texts times its neighbours are 1.6 billion rows; what meets in a text is 240,000.
    assert time.time() - start < 60
