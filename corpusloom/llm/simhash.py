"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and connected components.

`near_groups` links all fingerprints of 64 bits within a few bits, and loses none. Texts whose
shingle sets are alike to 0.8 differ in some ten of 64 bits, more than blocks of equal bits can
reach; `keep_one_a_group` takes 128 bits, meets fingerprints that agree in some sampled bits,
follows the trees' edges to a wide radius, and holds every link against the shingle sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import by_number, components, remove, save, scratch, table, unused
from corpusloom.llm.set_trees import linked_sets
from corpusloom.llm.shingles import SEED, _hashes, _least_labels, _shingles

SHINGLE_WORDS, RADIUS = 4, 4
#: Of near copies: words a shingle, the least Jaccard similarity of shingle sets, 64-bit words of a fingerprint, and the radius
#: that such texts are expected within (they differ in 19 of 128 bits, give or take 4; the sets are compared after).
NEAR_WORDS, SIMILARITY, LANES, NEAR_RADIUS = 5, 0.8, 2, 33
#: Tables of sampled bits are so many that two texts of the least similarity meet in one of them with this chance at least.
MEETING = 0.98
#: Bits of a key at least, further bits that crowded shards may be cut by, and nodes of a tree of wide fingerprints.
LEAST_BITS, MORE_BITS, NEAR_TREE_SIZE = 10, 24, 4096
#: Shards up to this number are sent to all tasks by name.
MOST_CROWDED = 1_000_000
#: Blocks that a fingerprint is cut into; of 6 blocks, 4 differing bits leave two equal.
BLOCKS = 6
#: Fingerprints of a BK-tree; larger shards are cut into so many trees that each holds about this number.
TREE_SIZE = 512
#: (query, node) pairs that are compared at once.
PAIRS_AT_ONCE = 1 << 18


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words_a_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words."""
    shingles = _shingles(text, words_a_shingle)
    return _majority(_hashes(shingles, SEED)) if shingles else 0


def fingerprints(words_a_shingle: int = SHINGLE_WORDS):
    """A Column function from text to the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        fps = np.array([fingerprint(t, words_a_shingle) for t in texts], dtype=np.uint64)
        return pd.Series(fps.view(np.int64), index=texts.index)

    return run


class BkForest:
    """BK-trees of many shards at once: `shard` and `fp` (nodes, 64-bit words) of the nodes, sorted by shard.

    The first fingerprint of a shard is its root; the rest are dealt to children by their
    distance to it, and so on, one level of all trees at a time.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, self.most = fp, 64 * fp.shape[1]
        self.edge = np.zeros(n, dtype=np.int64)
        self.parent = np.full(n, -1, dtype=np.int64)
        group, waiting, above = shard.astype(np.int64), np.arange(n), np.full(n, -1, dtype=np.int64)
        while len(waiting):
            first = np.ones(len(waiting), dtype=bool)
            first[1:] = group[1:] != group[:-1]
            own = np.cumsum(first) - 1
            heads = waiting[first]
            self.parent[heads] = above[first]
            rest = ~first
            waiting, head = waiting[rest], heads[own[rest]]
            distance = apart(fp[waiting], fp[head])
            self.edge[waiting] = distance
            key = own[rest] * (self.most + 1) + distance
            order = np.argsort(key, kind="stable")
            group, waiting, above = key[order], waiting[order], head[order]
        has = np.flatnonzero(self.parent >= 0)
        self.children = has[np.lexsort((self.edge[has], self.parent[has]))]
        self.rank = self.parent[self.children] * (self.most + 1) + self.edge[self.children]
        self.roots = np.flatnonzero(self.parent < 0)

    def links(self, root: np.ndarray, query: np.ndarray, radius: int):
        """Yields (query index, node index, distance) arrays of all pairs within radius; root: the tree of each query."""
        todo, width = [(np.arange(len(query)), root)], self.most + 1
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS_AT_ONCE:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = apart(query[q], self.fp[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near], d[near]
            # Children lie sorted by (parent, edge); those with an edge in [d - radius, d + radius] are a slice.
            low = np.searchsorted(self.rank, node * width + np.maximum(0, d - radius), side="left")
            high = np.searchsorted(self.rank, node * width + np.minimum(self.most, d + radius), side="right")
            n = high - low
            if n.any():
                total = int(n.sum())
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                todo.append((np.repeat(q, n), self.children[at]))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _in_trees(batches, radius: int, give):
    """give(rows, links) of the groups in a partition sorted by group: what it makes of the links within radius.

    Rows: tree, own (member of the tree side), ask, and the fingerprint's words w0, w1, ... . links
    yields (row, row, distance) arrays over the rows of several whole groups.
    """
    import pyarrow as pa

    held: list = []

    def solve(t):
        tree = t["tree"].to_numpy()
        words = [c for c in t.column_names if c[0] == "w" and c[1:].isdigit()]
        fp = np.stack([t[c].to_numpy().view(np.uint64) for c in words], axis=1)
        own, ask = t["own"].to_numpy(zero_copy_only=False), t["ask"].to_numpy(zero_copy_only=False)
        new = np.ones(len(tree), dtype=bool)
        new[1:] = tree[1:] != tree[:-1]
        shard = np.cumsum(new) - 1
        nodes = np.flatnonzero(own)
        if not len(nodes):
            return None
        forest = BkForest(shard[nodes], fp[nodes])
        root_of = np.full(shard[-1] + 1, -1, dtype=np.int64)
        root_of[shard[nodes[forest.roots]]] = forest.roots
        asking = np.flatnonzero(ask & (root_of[shard] >= 0))
        return give(t, ((asking[q], nodes[n], d) for q, n, d in forest.links(root_of[shard[asking]], fp[asking], radius)))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 20_000:
            continue
        t = pa.Table.from_batches(held)
        # The last group may go on in the next batch.
        tree = t["tree"].to_numpy()
        ends = np.flatnonzero(tree[1:] != tree[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut and (out := solve(t.slice(0, cut))) is not None:
            yield out
        held = t.slice(cut).to_batches()
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def _stars(t, links):
    """Links (a, b) of fingerprints as stars about the least row of what is connected."""
    import pyarrow as pa

    label = _least_labels(t.num_rows, ((a, b) for a, b, _ in links))
    far = np.flatnonzero(label != np.arange(t.num_rows))
    signed = t["w0"].to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(signed[label[far]])], ["a", "b"]) if len(far) else None


def _node_stars(t, links):
    """Links (a, b) of nodes as stars about the least node of what is connected."""
    import pyarrow as pa

    node = t["node"].to_numpy()
    label = _least_labels(t.num_rows, ((a, b) for a, b, _ in links))
    least = np.full(t.num_rows, np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    far = np.flatnonzero(least[label] != node)
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[label[far]])], ["a", "b"]) if len(far) else None


def _met_in_trees(shards: DataFrame, columns: list[str], tree_size: int, radius: int, give, schema: str = "a bigint, b bigint") -> DataFrame:
    """Links (schema) of shards (shard, n, columns): one of more than tree_size is dealt to several trees, and every pair of its parts meets in one task."""
    met = shards.withColumn("parts", F.ceil(F.col("n") / tree_size)).withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # With an equal part on both sides a fingerprint is a node and a query; else the lesser part's are the nodes.
    met = met.select(*columns, F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("tree"), (F.col("part") <= F.col("other")).alias("own"), (F.col("part") >= F.col("other")).alias("ask"))
    return met.repartition("tree").sortWithinPartitions("tree").mapInArrow(lambda b: _in_trees(b, radius, give), schema).distinct()


def _choices(bits: list[int], blocks: int, equal: int) -> list[tuple[int, list[int]]]:
    """For each choice of `equal` of the blocks that these bits are cut into: the mask of the chosen bits, and the bits that are left."""
    bounds = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    out = []
    for chosen in combinations(range(blocks), equal):
        mask = sum(1 << b for k in chosen for b in parts[k])
        out.append((mask - (1 << 64) if mask >> 63 else mask, [b for k in range(blocks) if k not in chosen for b in parts[k]]))
    return out


def _in_shards(fps: DataFrame, blocks: int, equal: int, tree_size: int, at: str) -> DataFrame:
    """fps (fp) in shards of two or more: fp, shard, n (its size).

    A shard holds the fingerprints with equal bits in one choice of `equal` blocks of the 64
    bits. One of more than tree_size is cut again, by choices of as many blocks of the bits
    that are left: of those, too, no pair within the radius differs in more than the rest.
    """
    first = _choices(list(range(64)), blocks, equal)
    keys = lambda chosen: F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")) for k, (mask, _) in enumerate(chosen)])
    keyed = save(fps.select("fp", F.explode(keys(first)).alias("k")).select("fp", "k.choice", "k.bits"), f"{at}-keys")
    sizes = save(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1"), f"{at}-sizes")
    met = keyed.join(sizes, ["choice", "bits"])
    small = met.filter(F.col("n") <= tree_size).select("fp", F.xxhash64("choice", "bits").alias("shard"), "n")
    deeper = F.array(*[keys(_choices(left, blocks, equal)) for _, left in first])
    large = met.filter(F.col("n") > tree_size).select("fp", "choice", "bits", F.explode(F.element_at(deeper, F.col("choice") + 1)).alias("k"))
    large = save(large.select("fp", F.xxhash64("choice", "bits", "k.choice", "k.bits").alias("shard")), f"{at}-deeper")
    counted = save(large.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), f"{at}-counted")
    return small.union(large.join(counted, "shard").select("fp", "shard", "n"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (fp) that connect all within radius of each other.

    Two fingerprints within radius agree in blocks - radius blocks at least, so they meet in
    a shard. A shard that is still larger than tree_size after the second cut is dealt to
    several BK-trees, and every pair of its parts meets in one task, so no task holds more than
    about twice tree_size of one shard. A task gives the links of each shard as a star about
    its least member, never all pairs.
    """
    equal = blocks - radius
    if equal < 1:
        raise ValueError("more blocks than the radius are needed")
    at = scratch(fps.sparkSession, "simhash-shards")
    shards = _in_shards(fps, blocks, equal, tree_size, at).withColumnRenamed("fp", "w0")
    links = save(_met_in_trees(shards, ["w0"], tree_size, radius, _stars), f"{at}-links")
    for k in ("keys", "sizes", "deeper", "counted"):
        remove(fps.sparkSession, f"{at}-{k}")
    return links


def _labelled(marked: DataFrame, radius: int) -> DataFrame:
    """fp, root and component_id of each fingerprint of marked (doc_id, fp), a written table."""
    spark, at = marked.sparkSession, scratch(marked.sparkSession, "simhash")
    distinct = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{at}-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius), "simhash")
    placed = save(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), f"{at}-placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = save(placed.join(least, "root").select("fp", "root", "component_id"), f"{at}-labels")
    for k in ("distinct", "placed"):
        remove(spark, f"{at}-{k}")
    return labels


def near_groups(docs: DataFrame, radius: int = RADIUS, words_a_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable by links of fingerprints within radius) of every row of docs.

    Rows with one fingerprint are linked, those without words (fingerprint zero) included.
    Null texts count as empty. A null doc_id is never a component_id unless all of its group
    are null. Rows that repeat a doc_id stay as rows of their own; extra columns are ignored;
    an empty table gives no rows.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(words_a_shingle)(F.col("text")).alias("fp"))
    marked = save(marked, scratch(docs.sparkSession, "simhash-docs"))
    return marked.join(_labelled(marked, radius).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _wide(texts: pd.Series) -> pd.DataFrame:
    """w0, w1: the fingerprint's words; alike: a hash of the set of shingles; n: its size."""
    import xxhash

    rows = []
    for t in texts:
        shingles = _shingles(t, NEAR_WORDS)
        lanes = [_hashes(shingles, SEED + k) for k in range(LANES)]
        own = np.unique(lanes[0])
        rows.append([*(_majority(h) if shingles else 0 for h in lanes), xxhash.xxh3_64_intdigest(own.tobytes(), SEED), len(own)])
    table_ = np.array(rows, dtype=np.uint64).reshape(-1, LANES + 2).view(np.int64)
    return pd.DataFrame(table_, columns=[*(f"w{k}" for k in range(LANES)), "alike", "n"])


def _sampled(fingerprints_: int, similarity: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many fingerprints: keys that hold some 1000 at most by chance, and tables enough for MEETING.

    Texts of Jaccard similarity s have an angle whose cosine is about 2 s / (1 + s), and differ
    in a bit with the angle's share of a half turn; MEETING is held for two standard deviations
    more than that. Up to a million fingerprints there are 10 bits and 41 tables; from there
    the tables grow as about the third root of the number.
    """
    bits, n = min(40, max(LEAST_BITS, math.ceil(math.log2(max(2, fingerprints_))) - 10)), 64 * LANES
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    agree = 1 - differ - 2 * math.sqrt(differ * (1 - differ) / n)
    return bits, math.ceil(math.log(1 - MEETING) / math.log(1 - agree**bits))


def _in_order(fp: np.ndarray, table_: int, first: int, last: int) -> np.ndarray:
    """The bits first to last of a table's own order of the fingerprints' bits (0 or 1, a row each), as numbers."""
    order = np.random.default_rng([SEED, table_]).permutation(fp.shape[1])[first:last]
    packed = np.zeros((len(fp), 8), dtype=np.uint8)
    part = np.packbits(fp[:, order], axis=1)
    packed[:, 8 - part.shape[1] :] = part
    return packed.view(">i8")[:, 0].astype(np.int64) >> (-(last - first) % 8)


def _keyed(fps: DataFrame, bits: int, tables: int) -> DataFrame:
    """fps (node, w0, w1, and more) with shard and further, a row for each table: the sampled bits of a key, and MORE_BITS of the table's order after them.

    Keys are made anew wherever they are read, as that costs less than to keep them.
    """
    words, rest = [f"w{k}" for k in range(LANES)], fps.columns
    schema = "shard bigint, further int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fps.schema.fields)

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fp = np.stack([part.column(w).to_numpy() for w in words], axis=1)
                fp = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                for t in range(tables):
                    shard = _in_order(fp, t, 0, bits) * tables + t
                    further = _in_order(fp, t, bits, bits + MORE_BITS).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(further), *(part.column(c) for c in rest)], ["shard", "further", *rest])

    return fps.mapInArrow(emit, schema)


def _named(keyed: DataFrame, shards: DataFrame, how: str) -> DataFrame:
    """keyed joined with shards (_shard, ...), a written table, which is sent to all tasks up to a bound."""
    known = F.broadcast(shards) if shards.count() <= MOST_CROWDED else shards
    return keyed.join(known, keyed["shard"] == known["_shard"], how)


def _wide_shards(keyed: DataFrame, crowded: DataFrame, tree_size: int, at: str) -> DataFrame:
    """keyed in shards, crowded ones (_shard, size) cut: node, w0, w1, shard, n (rows of a piece of a crowded shard, else 1).

    A crowded shard is cut by as many further bits of its table's order as make its pieces
    small by chance, and some more. Near copies that a cut parts are met in the second round.
    """
    words = [f"w{k}" for k in range(LANES)]
    met = _named(keyed, crowded, "left")
    small = met.filter("size IS NULL").select("node", *words, F.xxhash64("shard").alias("shard"), F.lit(1).cast("long").alias("n"))
    more = F.least((F.ceil(F.log2(F.col("size") / tree_size)) + 4).cast("int"), F.lit(MORE_BITS))
    piece = F.expr("shiftright(further, more)")
    large = met.filter("size IS NOT NULL").withColumn("more", MORE_BITS - more).select(F.xxhash64("shard", piece).alias("shard"), "node", *words)
    large = save(large, f"{at}-large")
    counted = save(large.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), f"{at}-counted")
    return small.union(large.join(counted, "shard").select("node", *words, "shard", "n"))


def _missed(fps: DataFrame, roots: DataFrame, bits: int, tables: int, crowded: DataFrame, tree_size: int, radius: int, at: str) -> DataFrame:
    """Links (a, b), as stars, of fingerprints within radius that meet in a crowded shard: those that its cuts parted.

    roots: node, root of what is connected already. In a shard all ask that don't belong to its
    largest group; they and the nodes are dealt to parts, and every part of those that ask meets
    every part of the nodes. So a large group of copies is read, but not compared with itself.
    """
    words = [f"w{k}" for k in range(LANES)]
    placed = save(fps.select("node", *words).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{at}-placed")
    large = save(_named(_keyed(placed, bits, tables), crowded, "inner").select("shard", "size", "node", *words, "root"), f"{at}-crowd")
    groups = large.groupBy("shard", "root").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max(F.struct("n", "root")).alias("main"))
    groups = save(groups.select(F.col("shard").alias("_shard"), F.col("main.root").alias("_main"), F.col("main.n").alias("_n")), f"{at}-main")
    met = large.join(groups, large["shard"] == groups["_shard"]).filter("size > _n").withColumn("out", F.col("root") != F.col("_main"))
    parts = lambda n: F.ceil(n / tree_size).cast("long")
    met = met.withColumns({"nodes": parts(F.col("size")), "asking": parts(F.col("size") - F.col("_n"))})
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    ends = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own = met.select("shard", "node", *words, part("nodes").alias("p"), F.explode(ends("asking")).alias("q"), F.lit(True).alias("own"), F.lit(False).alias("ask"))
    ask = met.filter("out").select("shard", "node", *words, F.explode(ends("nodes")).alias("p"), part("asking").alias("q"), F.lit(False).alias("own"), F.lit(True).alias("ask"))
    rows = own.union(ask).select("node", *words, F.xxhash64("shard", "p", "q").alias("tree"), "own", "ask")
    links = save(rows.repartition("tree").sortWithinPartitions("tree").mapInArrow(lambda b: _in_trees(b, radius, _node_stars), "a bigint, b bigint").distinct(), f"{at}-missed")
    for k in ("placed", "crowd", "main"):
        remove(fps.sparkSession, f"{at}-{k}")
    return links


def keep_one_a_group(docs: DataFrame, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, tree_size: int = NEAR_TREE_SIZE) -> DataFrame:
    """One row of docs for each group of near copies: that of the least doc_id, null last; rows and columns else unchanged.

    Near copies are texts whose sets of 5-word shingles (A-Z lower-cased; fewer words: the whole
    text's) have a Jaccard similarity of `similarity` or more; a group is what such links
    connect. Links are found by fingerprints of 128 bits: fingerprints that agree in the
    sampled bits of one of several tables meet in a BK-tree, and what links within radius connect
    is a group of candidates. A first round cuts crowded shards; a second one meets what the cuts
    parted and is in no group yet. The sets of a group are then joined exactly, in prefix trees:
    links are never listed, and none is left out. So no link of two
    texts that agree in a key is lost, however many do: two texts of just the least similarity
    meet with a chance of MEETING; those more alike meet more often. Rows are told apart by their place in the table, so rows that repeat an id
    with another text stand in the group of their own text, and of rows with one text and id
    one stays. Texts without words are alike, null texts among them. An empty table gives no rows.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession, "simhash-near")
    words, row, wide = [f"w{k}" for k in range(LANES)], unused(docs, "_row"), unused(docs, "_wide")
    schema = ", ".join(f"{c} bigint" for c in [*words, "alike", "n"])
    marked = docs.withColumns({row: F.monotonically_increasing_id(), wide: F.pandas_udf(_wide, schema)(F.col("text"))})
    marked = save(marked, f"{at}-docs")
    keys = marked.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{wide}.*"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("least")
    # A node is a set of shingles, by its least row; nodes with one fingerprint are linked to the least of them.
    nodes = save(keys.groupBy(*words, "alike", "n").agg(least).select(*words, "n", "least.no", "least.doc_id", F.col("least.row").alias("node")), f"{at}-nodes")
    fps = save(nodes.groupBy(*words).agg(F.min("node").alias("node")), f"{at}-fps")
    same = nodes.select(*words, F.col("node").alias("b")).join(fps.withColumnRenamed("node", "a"), words).filter("a <> b").select("a", "b")
    bits, tables = _sampled(fps.count(), similarity)
    keyed = _keyed(fps, bits, tables)
    crowded = save(keyed.groupBy(F.col("shard").alias("_shard")).agg(F.count("*").alias("size")).filter(F.col("size") > tree_size), f"{at}-crowded")
    shards = _wide_shards(keyed, crowded, tree_size, at)
    stars = save(_met_in_trees(shards, ["node", *words], tree_size, radius, _node_stars).union(same), f"{at}-stars")
    roots = save(components(stars, "simhash-near"), f"{at}-roots")
    if not crowded.isEmpty():
        missed = _missed(fps, roots, bits, tables, crowded, tree_size, radius, at)
        roots = save(components(stars.union(missed), "simhash-near"), f"{at}-roots2")
    groups = roots.join(nodes.select("node", "n"), "node").withColumn("weight", F.lit(1).cast("long"))
    links = linked_sets(groups, marked.select(F.col(row).alias("row"), "text"), NEAR_WORDS, round(100 * similarity))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "simhash-near")
    grouped = nodes.join(save(roots, f"{at}-linked"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = grouped.groupBy("root").agg(F.min(F.struct("no", "doc_id", "node")).alias("least")).select(F.col("least.node").alias("row"))
    gone = keys.select("row").join(save(stay, f"{at}-stay"), "row", "left_anti")
    kept = by_number(marked.drop(wide), row, gone, False).drop(row)
    for k in ("crowded", "large", "counted", "nodes", "fps", "stars", "roots", "roots2", "missed"):
        remove(spark, f"{at}-{k}")
    return kept


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
