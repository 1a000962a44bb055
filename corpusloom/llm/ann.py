"""Approximate nearest neighbours by multi-index hashing of learned binary codes, reranked on the vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import table

NEIGHBOURS = 20
#: The model is fitted on the vectors of so many least id hashes at most.
SAMPLE_VECTORS = 4096
#: Rotations of the space, each giving a bit a dimension; bits of an indexed substring.
ROTATIONS, SUBSTRING_BITS = 4, 8
#: Share of the sample's true neighbours within the search radius. Neighbours in the whole table are nearer.
SAMPLE_RECALL = 0.95
#: Rows of an index block at least and at most, blocks of a table up to that, and queries of a chunk.
LEAST_ROWS, MOST_ROWS, MOST_BLOCKS, CHUNK = 16_384, 262_144, 256, 1024


class CodeModel:
    """Iterative quantisation: rotations that bring vectors near the corners of a cube, and a Hamming radius."""

    def __init__(self, sample: np.ndarray, neighbours: int = NEIGHBOURS, recall: float = SAMPLE_RECALL):
        dim = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        z, rng, turns = sample - self.mean, np.random.default_rng(11), []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(30 if len(sample) > dim else 0):
                u, _, v = np.linalg.svd(z.T @ np.sign(z @ turn))
                turn = u @ v
            turns.append(turn)
        bits = ROTATIONS * dim
        pad = -bits % SUBSTRING_BITS
        self.turn = np.hstack([*turns, np.zeros((dim, pad))])
        self.radius = bits
        if len(sample) > neighbours + 1:
            asked = sample[: min(256, len(sample))]
            scores = asked @ sample.T
            scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
            top = np.argpartition(-scores, neighbours - 1, axis=1)[:, :neighbours]
            codes = self.codes(sample)
            apart = np.bitwise_count(codes[: len(asked), None] ^ codes[top]).sum(axis=2)
            self.radius = int(np.quantile(apart, recall, method="higher"))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) of uint8."""
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


class MultiIndex:
    """A table for each substring of the codes: rows by the substring's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        values = np.arange(257)
        self.starts = np.stack([np.searchsorted(np.sort(codes[:, k]), values) for k in range(codes.shape[1])])

    def reach(self, radius: int) -> list[int]:
        """How far each substring's values are probed, -1 for not at all.

        With radius = s * m + a over m substrings, a code within radius is within s of one of
        the first a + 1 substrings or within s - 1 of one of the others.
        """
        m = self.codes.shape[1]
        s, a = divmod(min(radius, m * SUBSTRING_BITS), m)
        return [s if k <= a else s - 1 for k in range(m)]

    def probed(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows in bits): the rows in any bucket that a query probes. Queries with one value of a substring probe it once."""
        n = len(self.codes)
        seen = np.zeros((len(queries), -(-n // 8)), dtype=np.uint8)
        values = np.arange(256, dtype=np.uint8)
        for k, reach in enumerate(self.reach(radius)):
            if reach < 0:
                continue
            sizes = np.diff(self.starts[k])
            asked, which = np.unique(queries[:, k], return_inverse=True)
            by_value = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
            for value, own in zip(asked, by_value, strict=True):
                near = np.bitwise_count(values ^ value) <= reach
                rows = np.zeros(n, dtype=bool)
                rows[self.order[np.repeat(near, sizes), k]] = True
                seen[own] |= np.packbits(rows)
        return seen

    def within(self, queries: np.ndarray, radius: int):
        """Yields all rows with codes within radius, for each of queries."""
        for code, seen in zip(queries, self.probed(queries, radius), strict=True):
            found = np.flatnonzero(np.unpackbits(seen, count=len(self.codes)))
            own, code = (x.view(_WORD) if x.shape[-1] % 8 == 0 else x for x in (self.codes[found], code))
            yield found[np.bitwise_count(own ^ code).sum(axis=1) <= radius]


_WORD = np.uint64


def best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of rows with the largest inner product, ties to the smaller id, without the query's own id."""
    rows = rows[ids[rows] != own]
    scores = (vectors[rows] * query).sum(axis=1)
    if len(rows) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        stay = scores >= least
        rows, scores = rows[stay], scores[stay]
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[order]], scores[order]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors (vec_id, embedding) for each of queries (alike).

    All vectors are indexed, in blocks by a hash of their id, and queries come in chunks; a
    task holds one block's multi-index and one chunk. It probes the fitted radius, reranks
    what it finds in double precision and gives a list of at most k a query; where a radius finds
    fewer than k rows in a block that has more, it grows until it doesn't. Vectors that are not `usable`
    take no part; those of each length are searched among themselves, as there is no inner
    product of others. A row never finds its own id. Rows that repeat a vec_id are separate
    candidates; of queries that repeat an id the least vector asks. Ties go to the smaller vec_id. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors, queries = clean(vectors).filter("vec_id is not null"), clean(queries).filter("vec_id is not null")
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # A table has vectors of one length, or of a few.
    dims = sorted(map(tuple, vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()))
    found = [_search(vectors.filter(F.size("embedding") == dim), queries.filter(F.size("embedding") == dim), dim, n, k) for dim, n in dims]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _search(vectors: DataFrame, queries: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    schema = "query_id bigint, vec_ids array<bigint>, scores array<double>"
    asked = queries.count()
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).collect()
    model = CodeModel(np.array([r["embedding"] for r in picked]).reshape(-1, dim), k)
    rows = min(max(LEAST_ROWS, -(-n // MOST_BLOCKS)), MOST_ROWS)
    blocks, chunks = -(-n // rows), max(1, -(-asked // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    index = vectors.select(deal(blocks, 1).alias("block"), every(chunks).alias("chunk"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asking = queries.select(every(blocks).alias("block"), deal(chunks, 2).alias("chunk"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def run(cell):
        import pandas as pd

        asks = cell["asks"].to_numpy()
        ids = cell["vec_id"].to_numpy()
        data = np.stack(cell["embedding"].to_numpy()).astype(np.float64)
        own_ids, own, wanted = ids[~asks], data[~asks], np.flatnonzero(asks)
        if not len(own) or not len(wanted):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_ids": np.zeros(0, object), "scores": np.zeros(0, object)})
        table, codes, out = MultiIndex(model.codes(own)), model.codes(data[wanted]), []
        width = codes.shape[1] * SUBSTRING_BITS
        for code, w, found in zip(codes, wanted, table.within(codes, model.radius), strict=True):
            radius = model.radius
            while len(found) <= k and radius < width:
                radius = min(width, radius + 8)
                found = next(table.within(code[None], radius))
            near, scores = best(data[w], ids[w], own_ids, own, found, k)
            out.append((ids[w], near, scores))
        return pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"])

    found = index.union(asking).groupBy("block", "chunk").applyInPandas(run, schema)
    # A query has at most MOST_BLOCKS * k finds, so its lists meet in one row.
    pairs = F.zip_with("vec_ids", "scores", lambda i, s: F.struct((-s).alias("away"), i.alias("vec_id")))
    merged = found.select("query_id", pairs.alias("p")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    ranked = merged.select("query_id", F.posexplode("p").alias("pos", "p"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), "p.vec_id", (-F.col("p.away")).alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
