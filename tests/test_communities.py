"""Communities against the same rules in plain Python, and their modularity."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import communities, graph

EDGES = "a string, b string, weight double"


def slow_level(edges, rounds):
    around, k = defaultdict(float), defaultdict(float)
    for (a, b), w in edges.items():
        for v, u in ((a, b), (b, a)):
            around[v, u] += w
            k[v] += w
    total, c = sum(k.values()), {v: v for v in k}
    for t in range(rounds):
        all_, size, new = defaultdict(float), defaultdict(int), dict(c)
        for v in k:
            all_[c[v]] += k[v]
            size[c[v]] += 1
        for v in k:
            if (v >> t // 2 % 16) % 2 != t % 2:
                continue
            tied = defaultdict(float)
            for (x, u), w in around.items():
                if x == v != u:
                    tied[c[u]] += w
            gain = lambda x, w: total * w - k[v] * (all_[x] - (k[v] if x == c[v] else 0))  # noqa: B023, E731
            offers = [(gain(x, w), x == c[v], -x) for x, w in tied.items() if not (x > c[v] and size[x] == size[c[v]] == 1)]
            if offers and max(offers)[0] > gain(c[v], tied.get(c[v], 0.0)):
                new[v] = -max(offers)[2]
        c = new
    return c


def slow_communities(nodes, edges, levels=2, rounds=8):
    ids = {n: k + 1 for k, n in enumerate(sorted(nodes))}
    now = defaultdict(float)
    for a, b, w in edges:
        if w and w > 0 and a in ids and b in ids:
            now[tuple(sorted((ids[a], ids[b])))] += w
    place, found = dict(ids), []
    for _ in range(levels):
        c = slow_level(now, rounds)
        place = {n: c.get(v, v) for n, v in place.items()}
        found.append(dict(place))
        merged = defaultdict(float)
        for (a, b), w in now.items():
            merged[tuple(sorted((c[a], c[b])))] += w
        now = merged
    out, number = set(), 0
    for level in range(levels):
        groups = defaultdict(list)
        for n, x in found[levels - 1 - level].items():
            groups[x].append(n)
        for members in sorted(groups.values(), key=lambda m: (-len(m), min(m))):
            out |= {(n, level, number) for n in members}
            number += 1
    return out


def knots(r, groups, size, inside, between):
    names = [f"n{g}-{k:02d}" for g in range(groups) for k in range(size)]
    edges = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if r.random() < (inside if a.split("-")[0] == b.split("-")[0] else between):
                edges.append((a, b, float(r.randint(1, 5))))
    return names, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_equal_plain_python(spark, seed):
    r = random.Random(seed)
    names, edges = knots(r, 5, 8, 0.6, 0.03)
    edges += [(names[3], names[3], 4.0), (edges[0][1], edges[0][0], 2.0), (names[1], names[2], -1.0), (names[1], names[2], None), ("unknown", names[1], 5.0)]
    nodes = [*names, "alone", names[0]]
    got = communities.communities(spark.createDataFrame([(n, "x") for n in nodes], "node string, c0 string"), spark.createDataFrame(edges, EDGES)).collect()
    assert {tuple(x) for x in got} == slow_communities(set(nodes), edges)
    assert len(got) == 2 * len(set(nodes))


@pytest.mark.parametrize("rows", [20])
def test_communities_of_many_buckets_equal_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(communities, "MOST_ROWS", rows)
    names, edges = knots(random.Random(3), 4, 6, 0.7, 0.05)
    edges += [(names[0], b, 1.0) for b in names[1:]] + [(names[2], names[2], 3.0)]
    got = communities.communities(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(edges, EDGES)).collect()
    assert {tuple(x) for x in got} == slow_communities(set(names), edges) and len(got) == 2 * len(names)


def test_a_round_moves_neighbours_once(spark, monkeypatch):
    monkeypatch.setattr(communities, "MOST_ROWS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(k, k % 7 + 100, 1.0) for k in range(60)], "a long, b long, w double")
        near = communities._neighbours(edges, 5)
        nodes = spark.range(200).select(F.col("id").alias("v"), F.lit(1.0).alias("k"), F.col("id").alias("c"))
        plan = communities._moved(near, nodes, 120.0, 0, 5)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
        deep = lambda x: len(re.match(r"[\s:|+-]*", x).group())
        depth, above = deep(lines[scan]), []
        for x in reversed(lines[:scan]):
            if deep(x) < depth:
                depth = deep(x)
                above.append(x)
        # What stands over the neighbours: one shuffle to the nodes that may move; sums by node have none.
        assert sum("Exchange hashpartitioning" in x for x in above) == 1
        communities.discard(near)
        assert near._called not in [x.name for x in spark.catalog.listTables()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_knots_are_found_and_modularity_is_that_of_components_or_more(spark):
    names, edges = knots(random.Random(7), 6, 10, 0.8, 0.01)
    nodes, links = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(edges, EDGES)
    placed = communities.communities(nodes, links)
    q = {r["level"]: r for r in communities.modularity(links, placed).collect()}
    least = communities.modularity(links, graph.clusters(nodes, links)).first()["modularity"]
    assert q[0]["modularity"] >= q[1]["modularity"] - 1e-12 and q[0]["modularity"] > max(least, 0.6)
    m = sum(w for *_, w in edges)
    at = {r["node"]: r["cluster"] for r in placed.filter("level = 0").collect()}
    share = sum(w for a, b, w in edges if at[a] == at[b]) / m - sum((sum(w * ((at[a] == c) + (at[b] == c)) for a, b, w in edges) / (2 * m)) ** 2 for c in set(at.values()))
    assert q[0]["modularity"] == pytest.approx(share)


def test_no_nodes_and_no_edges(spark):
    none, nodes = spark.createDataFrame([], EDGES), spark.createDataFrame([("b",), ("a",)], "node string")
    assert communities.communities(nodes.limit(0), none).collect() == []
    assert {tuple(r) for r in communities.communities(nodes, none).collect()} == {("a", 0, 0), ("b", 0, 1), ("a", 1, 2), ("b", 1, 3)}


def test_report_rows_keep_the_budget(spark):
    nodes = spark.createDataFrame([(k, "one two three") for k in range(6)], "node long, description string")
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 9.0), (3, 4, 1.0)], "a long, b long, weight double")
    placed = spark.createDataFrame([(k, 0, 0 if k < 3 else 1) for k in range(6)], "node long, level int, cluster long")
    got = [(r["cluster"], r["place"], r["kind"], r["name"]) for r in communities.report_rows(placed, nodes, edges, 15).orderBy("cluster", "place").collect()]
    assert got == [(0, 1, "node", "1"), (0, 2, "node", "2"), (0, 3, "node", "0"), (0, 4, "edge", "1 - 2"), (1, 1, "node", "3"), (1, 2, "node", "4"), (1, 3, "node", "5"), (1, 4, "edge", "3 - 4")]


def test_hot_nodes_come_in_parts(spark):
    entities = spark.createDataFrame([("THE", "x" if k % 3 else "y", f"d{k % 5}", k) for k in range(100, 125)] + [("ONE", "z", None, 7), ("ONE", "z", None, 7)], "name string, type string, description string, source long")
    relations = spark.createDataFrame([("THE", "ONE", 1.0, k) for k in range(23)] + [("ONE", "THE", 2.0, 3)], "a string, b string, weight double, source long")
    nodes, edges = graph.build(entities, relations, per_part=10)
    got = {(r["name"], r["part"]): (r["type"], r["description"].split(graph.SEP), r["source_id"].split(graph.SEP)) for r in nodes.collect()}
    assert got == {("THE", 0): ("x", [f"d{k}" for k in range(5)], [str(k) for k in range(100, 110)]), ("THE", 1): ("x", [""], [str(k) for k in range(110, 120)]), ("THE", 2): ("x", [""], [str(k) for k in range(120, 125)]), ("ONE", 0): ("z", [""], ["7"])}
    parts = sorted((r["part"], r["weight"], len(r["source_id"].split(graph.SEP))) for r in edges.collect())
    assert parts == [(0, 25.0, 10), (1, 25.0, 10), (2, 25.0, 3)]


def test_names_close_by_are_found_in_one_shuffle(spark):
    r = random.Random(5)
    rows = [(c, p + (p > 6) * 2, r.choice("ABCDEFGH")) for c in range(40) for p in range(r.randint(0, 12))] + [(1, 3, "A"), (1, 3, "Z")]
    found = spark.createDataFrame(rows, "chunk long, pos int, name string")
    wanted = {(c, min(x, y), max(x, y)) for c, p, x in rows for d, q, y in rows if c == d and 1 <= p - q <= 3 and x != y}
    pairs = graph.co_occurrences(found)
    assert pairs._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    got = [tuple(x) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_pairs_of_lists_are_those_of_places_without_a_shuffle(spark):
    r = random.Random(8)
    rows = [(c, r.sample("ABCDEFGHIJ", r.randint(0, 9))) for c in range(30)] + [(99, None)]
    lists = spark.createDataFrame(rows, "chunk long, names array<string>")
    pairs = graph.pairs_in_lists(lists, "names")
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in pairs.collect()]
    wanted = {tuple(x) for x in graph.co_occurrences(lists.select("chunk", F.posexplode("names").alias("pos", "name"))).collect()}
    assert wanted and len(got) == len(set(got)) and set(got) == wanted


@pytest.mark.parametrize("large", [0, 10, 50_000])
def test_parts_are_alike_by_either_way(spark, monkeypatch, large):
    monkeypatch.setattr(graph, "LARGE_GROUP", large)
    r = random.Random(9)
    rows = [(r.choice(["A", "A", "A", "B", f"C{r.randint(0, 30)}"]), r.randint(0, 60)) for _ in range(400)] + [("A", None), ("N", None)]
    got = graph._in_parts(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", 7).collect()
    wanted = {}
    for k in {k for k, _ in rows}:
        values = sorted({str(v) for n, v in rows if n == k and v is not None})
        wanted |= {(k, at // 7): graph.SEP.join(values[at : at + 7]) for at in range(0, len(values), 7)}
    assert {(x["k"], x["part"]): x["v"] for x in got} == wanted and len(got) == len(wanted)
