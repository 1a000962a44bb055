"""Communities of a weighted graph in levels: rounds of moves by modularity, then contraction, on written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import bucketed, discard, numbered, written

#: Rounds of moves a level at most, and levels.
ROUNDS, LEVELS = 8, 2


#: Rows of neighbours in a bucket, at most about; small graphs have two buckets a core, of this many at least.
MOST_ROWS, LEAST_ROWS = 1_500_000, 50_000


def _parts(spark: SparkSession, rows: int) -> int:
    """Buckets of a graph's neighbours, and tasks that nodes are dealt to: few enough that what moves between any two is worth a block."""
    return max(1, -(-rows // MOST_ROWS), min(2 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def _neighbours(edges: DataFrame, parts: int) -> DataFrame:
    """(v, u, w) of the edges (a, b, w), each pair once, in both directions and without self loops: a written table in buckets of u.

    So a round brings the nodes to the neighbours that they are, and the neighbours stay where they lie.
    """
    apart = edges.filter("a <> b")
    near = apart.select(F.col("a").alias("v"), F.col("b").alias("u"), "w").union(apart.select(F.col("b").alias("v"), F.col("a").alias("u"), "w"))
    return bucketed(near, "u", parts, "neighbours")


def _moved(near: DataFrame, nodes: DataFrame, total: float, turn: int, parts: int) -> DataFrame:
    """nodes (v, k, c) after one round: half of them may join the community that raises modularity most.

    near: (v, u, w), without self loops. Which half is a bit of the node's number, another one
    each round, so most neighbours don't move at once; a node alone in its community joins
    another such node only if that one's number is less, so that two don't change places.
    Of equal gains the least community wins, and staying wins over moving. A neighbour's row moves
    once, to the node that may move, and bears what is known of its community.
    """
    sums = nodes.groupBy("c").agg(F.sum("k").alias("all"), F.count("*").alias("size"))
    state = nodes.join(sums, "c")
    own = state.select("v", "k", F.col("c").alias("own"), F.col("all").alias("own_all"), F.col("size").alias("own_size"))
    may = F.expr(f"shiftright(v, {turn // 2 % 16}) % 2 = {turn % 2}")
    # A bucket's nodes, and a task's, are a small table in memory: no side is sorted.
    around = near.filter(may).join(state.select(F.col("v").alias("u"), "c", "all", "size").hint("shuffle_hash"), "u").select("v", "c", "w", "all", "size")
    tied = around.repartition(parts, "v").groupBy("v", "c").agg(F.sum("w").alias("w"), F.max("all").alias("all"), F.max("size").alias("size"))
    offers = tied.join(own.filter(may).hint("shuffle_hash"), "v")
    here = F.col("c") == F.col("own")
    swaps = ~here & (F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("c") > F.col("own"))
    # The gain in modularity against standing alone, times the square of all weight.
    gain = F.lit(total) * F.col("w") - F.col("k") * (F.col("all") - F.when(here, F.col("k")).otherwise(0.0))
    best = offers.filter(~swaps).withColumn("gain", gain).groupBy("v").agg(F.max(F.struct("gain", here.alias("here"), (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(here, gain)).alias("held"))
    stay = F.coalesce("held", -F.col("k") * (F.col("own_all") - F.col("k")))
    go = F.coalesce(F.col("best.gain") > stay, F.lit(False))
    return own.join(best, "v", "left").select("v", "k", F.when(go, -F.col("best.c")).otherwise(F.col("own")).alias("c"))


def _level(edges: DataFrame, rounds: int) -> DataFrame:
    """(v, c) of the nodes of edges (a, b, w), a written table with each pair once: communities bear the number of one of their first members."""
    parts = _parts(edges.sparkSession, 2 * edges.count())
    near = _neighbours(edges, parts)
    # A self loop counts twice in a strength.
    ends = near.select(F.col("u").alias("v"), "w").union(edges.filter("a = b").select("a", 2 * F.col("w")))
    nodes = written(ends.groupBy("v").agg(F.sum("w").alias("k")).withColumn("c", F.col("v")), "communities")
    total = nodes.agg(F.sum("k")).first()[0]
    for turn in range(rounds):
        last, nodes = nodes, written(_moved(near, nodes, total, turn, parts), "communities")
        discard(last)
    discard(near)
    return nodes


def node_ids(nodes: DataFrame) -> DataFrame:
    """node and v, its number from 1 in the nodes' order, of nodes (node), a written table."""
    return written(numbered(nodes.select("node").distinct(), ["node"], "v"), "node-ids")


def communities(nodes: DataFrame, edges: DataFrame, weight: str = "weight", levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """node, level (0 the coarsest) and cluster of every node of nodes (node) under the undirected edges (a, b, weight).

    Nodes move to the neighbouring community that raises modularity most (Blondel et al., 2008),
    half of them at a time; the communities of a level are the nodes of the next. Clusters are
    numbered from the coarsest level on, larger ones first, then by their least node, and no
    number comes twice. A node without edges is a cluster of its own in each level. Edges
    whose weight isn't positive, or whose ends aren't nodes, are left out; repeated edges add up.
    A round is an equi-join and sums by key on written tables; no task holds a community.
    """
    ids = node_ids(nodes)
    at = lambda c, v: ids.select(F.col("node").alias(c), F.col("v").alias(v))
    pairs = edges.filter(F.col(weight) > 0).select("a", "b", F.col(weight).cast("double").alias("w")).join(at("a", "x"), "a").join(at("b", "y"), "b")
    now = written(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "graph")
    return numbered_communities(ids, now, levels, rounds).select("node", "level", "cluster")


def numbered_communities(ids: DataFrame, now: DataFrame, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """node, v, level and cluster, as communities gives them, of the nodes ids (node, v) under the edges now (a, b, w).

    Edges hold the nodes' numbers, a <= b, each pair once, with a positive weight; both are written tables.
    """
    given = now
    placed, found = ids, []
    for k in range(levels):
        level = _level(now, rounds)
        name = f"c{k}"
        last = "v" if k == 0 else f"c{k - 1}"
        moved = placed.join(level.select(F.col("v").alias(last), F.col("c").alias(name)), last, "left").withColumn(name, F.coalesce(name, last))
        placed = written(moved, "placed")
        found.append(name)
        c = lambda end, to: level.select(F.col("v").alias(end), F.col("c").alias(to))
        merged = now.join(c("a", "x"), "a").join(c("b", "y"), "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
        merged = written(merged, "graph")
        discard(level, *([] if now is given else [now]))
        now = merged
    rows = reduce(DataFrame.union, [placed.select("node", "v", F.lit(levels - 1 - k).alias("level"), F.col(name).alias("c")) for k, name in enumerate(found)])
    sizes = rows.groupBy("level", "c").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    ranked = numbered(sizes, ["level", F.desc("n"), "least"], "rank")
    return rows.join(ranked, ["level", "c"]).select("node", "v", "level", (F.col("rank") - 1).alias("cluster"))


def modularity(edges: DataFrame, placed: DataFrame, weight: str = "weight") -> DataFrame:
    """level, clusters and modularity of placed (node, level, cluster) under the undirected edges (a, b, weight).

    Of each cluster: the share of all weight that lies inside, less the square of its share of all ends.
    """
    ends = edges.select(F.col("a").alias("node"), F.col(weight).alias("w")).union(edges.select("b", weight))
    sums = placed.join(ends, "node", "left").groupBy("level", "cluster").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("ends"))
    side = lambda end, to: placed.select(F.col("node").alias(end), F.col("level").alias(f"level_{to}"), F.col("cluster").alias(to))
    inside = edges.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("level_x = level_y AND x = y")
    inside = inside.groupBy(F.col("level_x").alias("level"), F.col("x").alias("cluster")).agg(F.sum(weight).alias("inside"))
    total = edges.agg(F.sum(weight).alias("m"))
    rows = sums.join(inside, ["level", "cluster"], "left").crossJoin(F.broadcast(total))  # a row
    share = F.coalesce("inside", F.lit(0.0)) / F.col("m") - (F.col("ends") / (2 * F.col("m"))) ** 2
    return rows.groupBy("level").agg(F.count("*").alias("clusters"), F.sum(share).alias("modularity"))


def cluster_attribute(placed: DataFrame) -> DataFrame:
    """node and clusters: what a stored graph's node holds, such as [{"level":0,"cluster":3},{"level":1,"cluster":9}]."""
    held = F.array_sort(F.collect_list(F.struct("level", "cluster")))
    return placed.groupBy("node").agg(F.to_json(held).alias("clusters"))


def _sql_level(k: int, rounds: int) -> list[str]:
    """The rounds of level k over the table e{k} (a, b, w), each with the table of nodes of the round before."""
    steps = [
        f"d{k} AS MATERIALIZED (SELECT v, u, sum(w) AS w FROM (SELECT a AS v, b AS u, w FROM e{k} UNION ALL SELECT b, a, w FROM e{k}) GROUP BY ALL)",
        f"n{k}_0 AS MATERIALIZED (SELECT v, sum(w) AS k, v AS c FROM d{k} GROUP BY v)",
    ]
    for t in range(rounds):
        now = f"n{k}_{t}"
        gain = f"(SELECT sum(k) FROM {now}) * t.w - o.k * (s.total - CASE WHEN t.c = o.c THEN o.k ELSE 0 END)"
        steps += [
            f"s{k}_{t} AS MATERIALIZED (SELECT c, sum(k) AS total, count(*) AS n FROM {now} GROUP BY c)",
            f"o{k}_{t} AS MATERIALIZED (SELECT t.v, t.c, t.c = o.c AS here, {gain} AS gain FROM (SELECT d.v, x.c, sum(d.w) AS w FROM d{k} d JOIN {now} x ON x.v = d.u WHERE d.v <> d.u GROUP BY ALL) t JOIN {now} o ON o.v = t.v AND (o.v >> {t // 2 % 16}) % 2 = {t % 2} JOIN s{k}_{t} s ON s.c = t.c JOIN s{k}_{t} own ON own.c = o.c WHERE NOT (t.c > o.c AND own.n = 1 AND s.n = 1))",
            f"n{k}_{t + 1} AS MATERIALIZED (SELECT x.v, x.k, CASE WHEN b.best.gain > coalesce(b.held, -x.k * (s.total - x.k)) THEN -b.best.c ELSE x.c END AS c FROM {now} x JOIN s{k}_{t} s ON s.c = x.c LEFT JOIN (SELECT v, max(struct_pack(gain := gain, here := here, c := -c)) AS best, max(gain) FILTER (here) AS held FROM o{k}_{t} GROUP BY v) b ON b.v = x.v)",
        ]
    last = f"n{k}_{rounds}"
    steps.append(f"e{k + 1} AS MATERIALIZED (SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(w) AS w FROM e{k} JOIN {last} x ON x.v = a JOIN {last} y ON y.v = b GROUP BY ALL)")
    return steps


def sql(nodes: str, edges: str, levels: int = LEVELS, rounds: int = ROUNDS) -> str:
    """Steps of a WITH clause for the same clusters, up to `placed` (node, level, cluster); nodes (node) and edges (a, b, weight) are SQL tables."""
    steps = [
        f"ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS v FROM (SELECT DISTINCT node FROM {nodes}))",
        f"links AS MATERIALIZED (SELECT a, b, weight::DOUBLE AS weight FROM {edges})",
        "e0 AS MATERIALIZED (SELECT least(x.v, y.v) AS a, greatest(x.v, y.v) AS b, sum(weight) AS w FROM links JOIN ids x ON x.node = links.a JOIN ids y ON y.node = links.b WHERE weight > 0 GROUP BY ALL)",
    ]
    at = "ids"
    for k in range(levels):
        steps += _sql_level(k, rounds)
        steps.append(f"p{k} AS MATERIALIZED (SELECT p.*, coalesce(n.c, p.{'v' if k == 0 else f'c{k - 1}'}) AS c{k} FROM {at} p LEFT JOIN n{k}_{rounds} n ON n.v = p.{'v' if k == 0 else f'c{k - 1}'})")
        at = f"p{k}"
    rows = " UNION ALL ".join(f"SELECT node, {levels - 1 - k} AS level, c{k} AS c FROM {at}" for k in range(levels))
    steps += [
        f"placed_rows AS MATERIALIZED ({rows})",
        "ranked AS (SELECT level, c, row_number() OVER (ORDER BY level, n DESC, least) - 1 AS cluster FROM (SELECT level, c, count(*) AS n, min(node) AS least FROM placed_rows GROUP BY ALL))",
        "placed AS MATERIALIZED (SELECT node, level, cluster FROM placed_rows JOIN ranked USING (level, c))",
    ]
    return ", ".join(steps)


def report_rows(placed: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """level, cluster, place, kind (`node` or `edge`), name and words: what a report of a cluster is written from.

    Nodes (node, description) come first, those of most edge weight first, then the edges
    inside the cluster (a, b, weight), heaviest first; rows are taken while their words, added
    up, stay within the budget. Rows beyond the budget's number of each kind can't be taken, as each
    has a word at least, so a task keeps no more of a cluster.
    """
    count = F.greatest(F.size(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda x: x != "")), F.lit(1))
    strength = edges.select(F.col("a").alias("node"), "weight").union(edges.select("b", "weight")).groupBy("node").agg(F.sum("weight").alias("rank"))
    of_nodes = placed.join(nodes, "node").join(strength, "node", "left")
    of_nodes = of_nodes.select("level", "cluster", F.lit(0).alias("kind"), F.coalesce("rank", F.lit(0.0)).alias("rank"), F.col("node").cast("string").alias("name"), F.concat_ws(" ", F.col("node").cast("string"), "description").alias("body"))
    side = lambda end, to: placed.select(F.col("node").alias(end), F.col("level").alias(f"l{to}"), F.col("cluster").alias(to))
    inside = edges.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("lx = ly AND x = y")
    pair = F.concat_ws(" - ", F.col("a").cast("string"), F.col("b").cast("string"))
    of_edges = inside.select(F.col("lx").alias("level"), F.col("x").alias("cluster"), F.lit(1).alias("kind"), F.col("weight").alias("rank"), pair.alias("name"), pair.alias("body"))
    rows = of_nodes.union(of_edges).withColumn("words", count).drop("body")
    by = Window.partitionBy("level", "cluster", "kind").orderBy(F.desc("rank"), "name")
    rows = rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= budget)
    order = Window.partitionBy("level", "cluster").orderBy("kind", F.desc("rank"), "name")
    rows = rows.withColumns({"place": F.row_number().over(order), "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter(F.col("upto") <= budget).select("level", "cluster", "place", F.when(F.col("kind") == 0, "node").otherwise("edge").alias("kind"), "name", "words")
