"""Best-two-fit packing of documents into sequences of bounded length, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import save, scratch, table
from corpusloom.llm.piece_cache import CHARS_AT_ONCE
from corpusloom.llm.token_files import _encoder

CAPACITY = 2048
#: The id that ends a document in op10.
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Bins for `counts` pieces of each length; returns (slots, number of bins).

    A bin is filled greedily with the longest piece that fits; then its smallest piece gives
    way to two unpacked pieces if they fit the expanded gap more tightly. Pieces of a length
    are alike, so each pattern is used as often as the counts allow before the next is made:
    the work depends on the number of lengths (at most capacity), not on that of pieces.
    slots has a row for each pattern and length: length, first rank, last rank (exclusive),
    pieces a bin, first bin, place of the first in its bin.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids")
        left[length] += n
    taken, slots, bins = np.zeros_like(left), [], 0
    while left.any():
        use: dict[int, int] = {}
        free = left.copy()
        gap = capacity
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            length = int(fits[-1])
            n = min(int(free[length]), gap // length)
            use[length], gap = use.get(length, 0) + n, gap - n * length
            free[length] -= n
        if gap and len(use) and (pair := _better_pair(free, min(use), gap + min(use))):
            small = min(use)
            use[small] -= 1
            for length in pair:
                use[length] = use.get(length, 0) + 1
            use = {k: n for k, n in use.items() if n}
        times = min(int(left[k]) // n for k, n in use.items())
        place = 0
        for length in sorted(use, reverse=True):
            n = use[length]
            slots.append((length, taken[length], taken[length] + n * times, n, bins, place))
            taken[length] += n * times
            left[length] -= n * times
            place += n * length
        bins += times
    return np.array(slots, dtype=np.int64).reshape(-1, 6), bins


def _better_pair(free: np.ndarray, small: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is at most gap and the largest over small; None without any."""
    have = np.flatnonzero(free[:gap])
    if not have.size:
        return None
    other = np.searchsorted(have, gap - have, side="right") - 1
    sums, pairs = np.zeros(len(have), dtype=np.int64), np.zeros(len(have), dtype=np.int64)
    for k, (x, o) in enumerate(zip(have, other, strict=True)):
        while o >= 0 and have[o] == x and free[x] < 2:
            o -= 1
        if o >= 0:
            sums[k], pairs[k] = x + have[o], have[o]
    best = int(np.argmax(sums))
    return (int(have[best]), int(pairs[best])) if sums[best] > small else None


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False, chars_at_once: int = CHARS_AT_ONCE) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, source_task, task_rank[, ids].

    A document is its ids and end_id; one of more than capacity ids is cut into pieces of
    capacity, the last perhaps shorter. task_rank counts the pieces of a length in a task.
    Null texts count as empty. ids: little-endian unsigned 32-bit integers.
    """

    def run(batches):
        import pyarrow as pa

        encoder, end, seen, task = _encoder(tokenizer), end_id.to_bytes(4, "little"), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part, encoded in encoder.batches(batch, chars_at_once):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), task, seen[n], own if keep_ids else None))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))][: 7 + keep_ids], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "source_task", "task_rank", *["ids"] * keep_ids]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, source_task int, task_rank bigint" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False, chars_at_once: int = CHARS_AT_ONCE) -> DataFrame:
    """Each piece of docs with its sequence_id and offset in that sequence.

    The driver holds only the histogram of lengths, at most capacity numbers, and the plan
    made from it. A piece finds its rank among the pieces of its length from the counts a
    task and its rank in its task, then its place in the plan. An empty table gives no rows;
    rows that repeat a doc_id are packed as documents of their own; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = save(cut_documents(docs, tokenizer, end_id, capacity, keep_ids, chars_at_once), scratch(spark, "pieces"))
    per_task = pieces.groupBy("length", "source_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("source_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = save(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), scratch(spark, "bases"))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(counts, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # One sorted key for a search by (length, rank); ranks are below 2 ** 48.
    keys = (slots[:, 0] << 48) + slots[:, 1]
    ranked = pieces.join(bases.select("length", "source_task", "base").hint("merge"), ["length", "source_task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    out = [c for c in pieces.columns if c not in ("source_task", "task_rank")]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            s = slots[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            n = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(s[:, 4] + n // s[:, 3]), pa.array(s[:, 5] + n % s[:, 3] * length)], [*out, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in out)
    return ranked.select(*out, "rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
