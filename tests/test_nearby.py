"""Nearest places and districts against brute force."""

import math
import random

from pyspark.sql import functions as F

from corpusloom.operators import nearby, screening


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def test_nearest_on_globe_across_the_date_line_and_far_off(spark):
    r = random.Random(4)
    places = {k: (r.uniform(50, 51), r.uniform(0, 1)) for k in range(60)} | {100: (10.0, 179.99), 101: (10.0, -179.99), 102: (-89.9, 20.0), 103: (0.0, 0.0), 104: (0.0, 0.0)}
    df = spark.createDataFrame([(k, *v) for k, v in places.items()], "id long, lat double, lng double")
    found = {x["id"]: (x["place"], x["metres"]) for x in nearby.nearest_on_globe(df, df.withColumnRenamed("id", "place")).collect()}
    assert len(found) == len(places)
    for k, at in places.items():
        best = min((metres(at, v), p) for p, v in places.items() if p != k)
        assert abs(found[k][1] - best[0]) < 1e-6 * max(1, best[0])
    assert found[100][0] == 101 and found[103] == (104, 0.0)


def test_districts_by_cells_equal_those_sent_to_all(spark, monkeypatch):
    ring = lambda x, y, s: [{"x": a, "y": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    rows = [(k, f"d{k}", [ring(k % 4 * 0.2, 51 + k // 4 * 0.2, 0.25)]) for k in range(12)]
    districts = spark.createDataFrame(rows, "ord int, name string, rings array<array<struct<x:double,y:double>>>")
    r = random.Random(1)
    points = spark.createDataFrame([(k, r.uniform(50.9, 51.8), r.uniform(-0.1, 1.1)) for k in range(150)] + [(900, None, 1.0), (901, 0.0, 1.0)], "id long, lat double, lng double")
    wide = sorted(nearby.locate(points, districts, "id").collect())
    monkeypatch.setattr(nearby, "MOST_SENT", 0)
    assert sorted(nearby.locate(points, districts, "id").collect()) == wide and len(wide) == 152
    assert {x["match_type"] for x in wide} == {"exact", "nearest", "no_coords"}


def test_the_greedy_pass_over_alike_images(spark):
    r = random.Random(8)
    rows = [(k, k % 2, r.getrandbits(4) | r.choice([0, 3 << 60, 1 << 40]) | r.choice([0, 7 << 20])) for k in range(120)]
    kept = {}
    for k, c, b in rows:
        if all((b ^ x).bit_count() >= 8 for _, x in kept.setdefault(c, [])):
            kept[c].append((k, b))
    df = spark.createDataFrame(rows, "k long, c int, b long")
    assert sorted(x["k"] for x in screening.drop_alike(df, "k", "b", 8, ["c"]).collect()) == sorted(k for v in kept.values() for k, _ in v)
    assert screening.drop_alike(df.limit(0), "k", "b").count() == 0


def test_low_precision(spark):
    df = spark.createDataFrame([(51.5, -0.12), (51.531, 0.1), (None, 0.1), (51.0, 7.0)], "a double, b double")
    assert [x[0] for x in df.select(screening.low_precision(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
