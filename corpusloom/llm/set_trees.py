"""Exact Jaccard links of n-gram sets inside groups of candidates, by prefix trees over sets in one order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import by_number, remove, save, scratch
from corpusloom.llm.shingles import SEED, _hashes, _least_labels, _shingles

#: n-grams of the sets that one tree holds; larger groups are dealt to several trees whose pairs meet.
TREE_GRAMS = 300_000
#: Cells of the table (queries by n-grams) that a tree is asked with at once.
CELLS_AT_ONCE = 1 << 24
#: Texts whose sets a task makes before it sends them on.
TEXTS_AT_ONCE = 256
#: Pairs of a tree that are held before they become labels.
PAIRS_AT_ONCE = 1 << 20


def ngram_set(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of the text's word n-grams, each once, ascending; see _shingles."""
    grams = _shingles(text, words)
    return np.unique(_hashes(grams, SEED)) if grams else np.zeros(0, dtype=np.uint64)


class PrefixTree:
    """A trie of sets, each as its ascending ranks in one order of all their n-grams; runs of single children are one node.

    sizes: of the whole sets, which may hold n-grams besides that no other set has. A node has
    its run of ranks, its children, the sets that end at it, the least size of the sets below it
    and the most ranks that one of them has after it.
    """

    def __init__(self, ranks: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(ranks)), key=lambda k: ranks[k].astype(">u4").tobytes())
        sets, sizes = [ranks[k] for k in order], sizes[order]
        length = np.array([len(s) for s in sets], dtype=np.int64)
        shared = np.zeros(len(sets), dtype=np.int64)
        for k in range(1, len(sets)):
            n = min(length[k - 1], length[k])
            differ = np.flatnonzero(sets[k - 1][:n] != sets[k][:n])
            shared[k] = differ[0] if len(differ) else n
        self.sizes, self.nodes = sizes, []
        todo = [(0, len(sets), 0, None)]
        while todo:
            i, j, above, parent = todo.pop()
            depth = int(shared[i + 1 : j].min()) if j - i > 1 else int(length[i])
            end = i + int(np.count_nonzero(length[i:j] == depth))  # those that end here come first
            starts = [end, *(end + 1 + np.flatnonzero(shared[end + 1 : j] == depth)).tolist()] if end < j else []
            at, children = len(self.nodes), []
            self.nodes.append((sets[i][above:depth], children, np.arange(i, end), int(sizes[i:j].min()), int(length[i:j].max()) - depth))
            if parent is not None:
                self.nodes[parent][1].append(at)
            todo += [(a, b, depth, at) for a, b in zip(starts, [*starts[1:], j], strict=False)]
        self.order = np.array(order, dtype=np.int64)

    def links(self, ranks: list[np.ndarray], sizes: np.ndarray, width: int, percent: int):
        """Yields arrays (query, set) of all that are linked; width: the number of ranks.

        The queries go down the trie together. What a query shares with a node's path is
        counted once for all sets below; it leaves a subtree when all that it and the longest
        set there have left can't make up what the smallest set there asks for.
        """
        block = max(1, CELLS_AT_ONCE // max(1, width))
        for first in range(0, len(ranks), block):
            part = ranks[first : first + block]
            has = np.zeros((len(part), width), dtype=np.uint8)
            for k, r in enumerate(part):
                has[k, r] = 1
            seen = has.cumsum(axis=1, dtype=np.int32)
            size, total = sizes[first : first + block], np.array([len(r) for r in part], dtype=np.int64)
            todo = [(0, np.arange(len(part)), np.zeros(len(part), dtype=np.int64))]
            while todo:
                at, asking, overlap = todo.pop()
                run, children, held, least, after = self.nodes[at]
                if len(run):
                    overlap = overlap + has[np.ix_(asking, run)].sum(axis=1, dtype=np.int64)
                    left = np.minimum(total[asking] - seen[asking, run[-1]], after)
                    stay = (100 + percent) * (overlap + left) >= percent * (size[asking] + least)
                    asking, overlap = asking[stay], overlap[stay]
                if not len(asking):
                    continue
                if len(held):
                    q, y = np.nonzero((100 + percent) * overlap[:, None] >= percent * (size[asking][:, None] + self.sizes[held][None, :]))
                    if len(q):
                        yield first + asking[q], self.order[held[y]]
                todo += [(c, asking, overlap) for c in children]


def _ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as the ascending ranks of its n-grams that another set has too, the most frequent first; and the number of ranks."""
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), dtype=np.int64)
    rank[order] = np.arange(len(n))
    width = int(np.count_nonzero(n > 1))
    ends = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(r[r < width]) for r in np.split(rank[at], ends)], width


def _joined(tree, percent: int):
    """(node, root, links) of the rows of a tree that are linked: root the least node reached in it, links the documents linked with."""
    import pyarrow as pa

    grams = tree["grams"].combine_chunks()
    edge, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
    sets = [flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    sizes, weight, node = (tree[c].to_numpy() for c in ("n", "weight", "node"))
    own, ask = (np.flatnonzero(tree[c].to_numpy(zero_copy_only=False)) for c in ("own", "ask"))
    if not len(own) or not len(ask):
        return None
    ranks, width = _ranked(sets)
    trie = PrefixTree([ranks[k] for k in own], sizes[own])
    links, label = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    held, size = [], 0
    # Trees of one part ask with their own sets, and meet each pair twice.
    once = not np.array_equal(own, ask)
    for q, y in trie.links([ranks[k] for k in ask], sizes[ask], width, percent):
        a, b = ask[q], own[y]
        other = a != b
        a, b = a[other], b[other]
        np.add.at(links, a, weight[b])
        if once:
            np.add.at(links, b, weight[a])
        held.append((label[a], label[b]))
        size += len(a)
        if size > PAIRS_AT_ONCE:
            label, held, size = _least_labels(len(sets), held)[label], [], 0
    label = _least_labels(len(sets), held)[label]
    found = np.flatnonzero(links)
    if not len(found):
        return None
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(least[label[found]]), pa.array(links[found])], ["node", "root", "links"])


def _in_trees(percent: int):
    """Batches sorted by tree as the links of each tree."""

    def run(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            tree = batch.column("tree").to_numpy()
            ends = [*(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
            start = 0
            for end in ends:
                if held and held[0].column("tree")[0].as_py() != tree[start]:
                    if (out := _joined(pa.Table.from_batches(held), percent)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        if held and (out := _joined(pa.Table.from_batches(held), percent)) is not None:
            yield out

    return run


def _sets(words: int):
    """Batches with a text as batches with its n-grams instead."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                grams = [ngram_set(t.as_py(), words).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(grams, pa.list_(pa.int64()))], [*rest, "grams"])

    return run


def linked_sets(groups: DataFrame, texts: DataFrame, words: int, percent: int, tree_grams: int = TREE_GRAMS) -> DataFrame:
    """(node, root, links), written: for each linked node the least node it reaches in a tree, and the documents it is linked with there.

    groups: node, root (its group of candidates), weight (the documents it stands for) and n (the
    size of its set of word n-grams); texts: row, text, node being a row. Every pair of a group
    with a Jaccard similarity of percent / 100 or more is a link. A group's sets are dealt to
    parts of about tree_grams n-grams; every pair of parts meets in one tree.
    """
    at = scratch(texts.sparkSession, "sets")
    totals = groups.groupBy("root").agg(F.ceil(F.sum("n") / tree_grams).alias("parts"))
    dealt = save(groups.join(totals, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select("root", "node", "weight", "n", "parts", "part"), f"{at}-dealt")
    held = by_number(texts, "row", dealt.select(F.col("node").alias("row")), True)
    met = dealt.join(held, dealt["node"] == held["row"]).drop("row").mapInArrow(_sets(words), "root long, node long, weight long, n long, parts long, part long, grams array<long>")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # With an equal part on both sides a set is in the tree and a query; else the lesser part's are in the tree.
    met = met.select("node", "weight", "n", "grams", F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("tree"), (F.col("part") <= F.col("other")).alias("own"), (F.col("part") >= F.col("other")).alias("ask"))
    links = save(met.repartition("tree").sortWithinPartitions("tree").mapInArrow(_in_trees(percent), "node long, root long, links long"), f"{at}-links")
    remove(texts.sparkSession, f"{at}-dealt")
    return links
