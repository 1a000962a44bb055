"""Jaccard joins of word n-gram sets: candidates by equal parts, prefix trees over their ordered sets, connected components."""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import by_number, components, remove, save, scratch, sieve, table
from corpusloom.llm.set_trees import TEXTS_AT_ONCE, TREE_GRAMS, linked_sets, ngram_set

WORDS, PERCENT = 3, 90
#: Sizes of a band are within this ratio of each other; it must exceed that of the sizes of linked sets.
BAND = 1.4


class Bands:
    """Which parts two sets may share: sizes lie in bands, and a band's hashes are cut into parts, by value.

    Linked sets of sizes s and t differ in at most (s + t)(100 - p) / (100 + p) hashes. In a
    band whose larger sets have up to `most` hashes that is `differ`, so of differ + spare + 1
    parts at least spare + 1 hold the same hashes in both. Parts of too few hashes (weak ones)
    are met by chance; a set with no more than `spare` of them leaves them out, as it then
    shares a part that isn't weak with every set that it is linked with.
    """

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.ceil(max(BAND, 100 / percent) * self.low[-1])))

    def of(self, size: int) -> list[int]:
        """The set's band, and the next one if a linked set can lie there."""
        k = bisect.bisect_right(self.low, size) - 1
        return [k, k + 1] if 100 * size >= self.percent * self.low[k + 1] else [k]

    def parts(self, band: int) -> tuple[int, int, int]:
        """(parts, spare, least hashes of a part that isn't weak)."""
        differ = 2 * (self.low[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        if differ < 3:
            return differ + 1, 0, 1
        spare, least = (1, 1) if differ < 20 else (4 + differ // 25, 2)
        return differ + spare + 1, spare, least

    def keys(self, own: np.ndarray) -> np.ndarray:
        """A key for each part that the set is met by; none for sets that equal sets alone are linked with."""
        found = []
        for band in self.of(len(own)) if len(own) else []:
            parts, spare, least = self.parts(band)
            if parts == 1:
                continue
            edge = np.searchsorted(own >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(own)))
            key = sums[edge[1:]] - sums[edge[:-1]]
            weak = np.diff(edge) < least
            shown = np.flatnonzero(~weak) if weak.sum() <= spare else np.arange(parts)
            salt = (np.uint64(band) << np.uint64(32)) + shown.astype(np.uint64)
            found.append(_mixed(key[shown] ^ _mixed(salt + np.uint64(1))))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _described(words: int, percent: int):
    """Batches (row, doc_id, text) with n, the set's size, k0 and k1, a hash of it, and keys, those of its parts."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        bands = Bands(percent)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                n, whole, keys = [], [], []
                for text in part.column("text"):
                    own = ngram_set(text.as_py(), words)
                    n.append(len(own))
                    whole.append(xxhash.xxh3_128_digest(own.tobytes()))
                    keys.append(bands.keys(own).view(np.int64))
                k01 = np.frombuffer(b"".join(whole), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(k01[:, 0]), pa.array(k01[:, 1]), pa.array(keys, pa.list_(pa.int64()))], [*part.schema.names, "n", "k0", "k1", "keys"])

    return run


def _candidates(nodes: DataFrame, described: DataFrame, at: str) -> DataFrame:
    """(node, root): groups that hold all links; nodes that share a part's key with none are left out."""
    keyed = by_number(described.select("row", "keys"), "row", nodes.select(F.col("node").alias("row")), True)
    keyed = keyed.select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    repeated = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1").select("key", "first")
    met = sieve(keyed, "key", repeated := save(repeated, f"{at}-repeated"))
    edges = met.join(repeated, "key").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = save(components(edges, "ngram-candidates"), f"{at}-candidates")
    remove(nodes.sparkSession, f"{at}-repeated")
    return found


def set_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tree_grams: int = TREE_GRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs (doc_id, text).

    Rows are linked when their sets of word n-grams (A-Z lower-cased; with fewer words the whole
    sequence) have a Jaccard similarity of percent / 100 or more; no link is lost. n_shingles:
    the set's size; component_id: the least doc_id reachable by links, its own included;
    n_links: the rows it is linked with. Null texts and texts without words have empty sets and
    no links. A null doc_id is never a component_id unless all of its group are null. Rows that
    repeat a doc_id are rows of their own; other columns are ignored; an empty table gives no
    rows.

    Equal sets are one node. Nodes that share a part (see Bands) are in one group of candidates;
    its sets are dealt to trees of about tree_grams n-grams, and every pair of its parts meets.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be 1 to 100")
    spark, at = docs.sparkSession, scratch(docs.sparkSession, "ngrams")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = save(rows.mapInArrow(_described(words, percent), "row long, doc_id long, text string, n long, k0 long, k1 long, keys array<long>"), f"{at}-docs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id"))
    nodes = save(described.filter("n > 0").groupBy("k0", "k1").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.first("n").alias("n"), least.alias("least")), f"{at}-nodes")
    groups = _candidates(nodes, described, at).join(nodes.select("node", "weight", "n"), "node")
    links = linked_sets(groups, described.select("row", "text"), words, percent, tree_grams)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "ngram-join")
    found = roots.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    placed = save(nodes.join(found, "node", "left").select("k0", "k1", "least", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), f"{at}-placed")
    groups = placed.groupBy("root").agg(F.min("least")["doc_id"].alias("component_id"))
    labels = save(placed.join(groups, "root").select("k0", "k1", "component_id", "n_links"), f"{at}-labels")
    for k in ("nodes", "candidates", "placed"):
        remove(spark, f"{at}-{k}")
    ids = described.select("doc_id", "n", "k0", "k1")
    alone = ids.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return ids.filter("n > 0").join(labels, ["k0", "k1"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(alone)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_links(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda k: array_to_string(w[k : k + {WORDS - 1}], ' ')) END) AS gram FROM split WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= {PERCENT} * (x.n + y.n - s.n)),
reached AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(c.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
