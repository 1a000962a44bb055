"""Exact de-duplication as a log-structured merge index of text digests (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import BLOCK_BITS, bit_set, by_number, remove, save, scratch, table, unused

#: Rows of a memtable; a task flushes a run for each.
MEMTABLE_ROWS = 100_000
#: Bits of a filter for each digest in it; a block, a row of the filter, has BLOCK_BITS.
FILTER_BITS = 16
#: The bound of a filter that is sent to all tasks. Beyond it none is, and every row takes the exact lookup.
MOST_FILTER_BYTES = 64 << 20
#: The least size of a group in the filter.
REPEATED = 2


def normal_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class DigestIndex:
    """Sorted digest runs under one folder: `flush` adds runs of level 0, `compact` merges them into level 1.

    A run of level 0 is a memtable: the rows of a task are dealt to memtables as they come, and
    each is sorted and written as a file. `compact` merges all runs and the files of an earlier
    level 1 into one row a digest, with the smallest id and the number of rows, in sorted files
    that part the range of digests. A lookup asks the filter of the repeated digests first, so
    that only its hits are shuffled to the level's rows.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.runs, self.merged, self.written = spark, root or scratch(spark, "digests"), [], None, 0

    def _next(self, level: str) -> str:
        self.written += 1
        return f"{self.root}/{level}-{self.written}"

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows: (id long, digest binary). Returns the written runs."""
        path = self._next("level0")
        memtable = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / MEMTABLE_ROWS).alias("memtable")
        runs = rows.select("id", "digest", memtable).sortWithinPartitions("memtable", "digest", "id").select("id", "digest")
        runs.write.option("maxRecordsPerFile", MEMTABLE_ROWS).parquet(path)
        self.runs.append((path, self.spark.read.schema("id long, digest binary").parquet(path)))
        return self.runs[-1][1]

    def compact(self) -> DataFrame:
        """(digest, keep_id, group_size) over all that was flushed; a null id is the largest. The merged runs are removed."""
        parts = [r.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")) for _, r in self.runs]
        old = [p for p, _ in self.runs] + ([self.merged[0]] if self.merged else [])
        parts += [self.merged[1]] if self.merged else []
        merged = reduce(DataFrame.union, parts).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        path = self._next("level1")
        merged.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(path)
        self.runs, self.merged = [], (path, self.spark.read.schema("digest binary, keep_id long, group_size long").parquet(path))
        for p in old:
            remove(self.spark, p)
        return self.merged[1]

    def filter(self) -> tuple[int, DataFrame] | None:
        """(bits, blocks (block, bitmap)) over the digests of groups of two or more; None if the bound leaves no room."""
        repeated = self.merged[1].filter(F.col("group_size") >= REPEATED).select("digest")
        blocks = 1 + repeated.count() * FILTER_BITS // BLOCK_BITS
        if blocks * BLOCK_BITS // 8 > MOST_FILTER_BYTES:
            return None
        bits, path = blocks * BLOCK_BITS, self._next("filter")
        at = _bit(F.col("digest"), bits)
        return bits, save(repeated.select(F.floor(at / BLOCK_BITS).alias("block"), (at % BLOCK_BITS).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), path)

    def ask(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (with a column digest), parted: those that may be in a group of two or more, and those that surely are alone."""
        known = self.filter()
        if known is None:
            return rows, rows.filter(F.lit(False))
        bits, blocks = known
        bit, block, bitmap = (unused(rows, c) for c in ("_bit", "_block", "_bitmap"))
        blocks = F.broadcast(blocks.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
        asked = rows.withColumn(bit, _bit(F.col("digest"), bits)).withColumn(block, F.floor(F.col(bit) / BLOCK_BITS)).join(blocks, block, "left")
        hit = bit_set(F.col(bitmap), F.col(bit) % BLOCK_BITS)
        return asked.filter(hit).select(*rows.columns), asked.filter(~hit).select(*rows.columns)


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def _verified(index: DigestIndex, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, same, keep_id, keep_row, group_size) of each repeated digest; and the rows of those that hold several texts.

    Every group of the index is verified on bytes: the least and the greatest of its texts must
    be one (`same`). Those are found before the shuffle, so a large group moves as a row a task.
    Rows of the others (row, id, digest, other: the text) are to be grouped by their texts.
    """
    repeated = index.merged[1].filter(F.col("group_size") >= REPEATED)
    seen = save(hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), _least()), path := index._next("seen"))
    checked = repeated.join(seen.select("digest", "keep_row", (F.col("low") == F.col("high")).alias("same")), "digest")
    checked = save(checked.select("digest", "same", "keep_id", "keep_row", "group_size"), index._next("checked"))
    remove(index.spark, path)
    mixed = hits.join(checked.filter("not same").select("digest"), "digest").select("row", "id", "digest", F.col("norm").alias("other"))
    return checked, save(mixed, index._next("mixed"))


def _least() -> Column:
    return F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("keep_row")


def exact_dedup(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row per row of docs (doc_id, text): id, digest, other, keep_id, group_size.

    Texts are equal when their normal forms are: each run of white space
    ([\\x20\\x09-\\x0D]+) made one space, null counted as empty. Every digest hit is verified
    on the texts' bytes; where one digest has several texts its rows are grouped by their text,
    which `other` then holds. digest: a Column function from text to binary.
    Rows that repeat a doc_id count in group_size; they are one document, so with equal texts
    each carries the same decision. A null doc_id is never kept unless its whole group has
    null ids. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), normal_form(F.col("text")).alias("norm"))
    texts = save(texts.withColumn("digest", digest(F.col("norm"))), scratch(spark, "texts"))
    index = DigestIndex(spark)
    index.flush(texts.select("id", "digest"))
    index.compact()
    hits, alone = index.ask(texts)
    checked, mixed = _verified(index, hits)
    one, none = F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("string").alias("other")
    # Hits of the filter that the level doesn't hold as repeated are alone.
    same = hits.select("id", "digest").join(checked.select("digest", "same", "keep_id", "group_size"), "digest", "left").filter("same is null or same")
    same = same.select("id", "digest", none, F.when(F.col("same"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"))
    by_text = mixed.groupBy("digest", "other").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    others = mixed.join(by_text, ["digest", "other"]).select("id", "digest", "other", "keep_id", "group_size")
    return alone.select("id", "digest", none, F.col("id").alias("keep_id"), one).union(same).union(others)


def decisions(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """exact_dedup with the columns of its query; text_sha256 is that of the normal form."""
    found = exact_dedup(docs, digest)
    sha = F.when(F.col("other").isNotNull(), F.sha2(F.encode("other", "UTF-8"), 256)).otherwise(F.lower(F.hex("digest"))) if digest is sha256_digest else F.lit(None).cast("string")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row of docs for each text: that of the least doc_id, null last; rows and columns else unchanged.

    Texts are equal as in exact_dedup. Rows are told apart by their place in the table, so of
    rows that repeat an id and text one stays, and a row that repeats an id with another text
    stands for itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    row, key = unused(docs, "_row"), unused(docs, "_digest")
    marked = docs.withColumns({row: F.monotonically_increasing_id(), key: digest(normal_form(F.col("text")))})
    marked = save(marked, scratch(spark, "texts"))
    held = marked.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col(key).alias("digest"), F.col("text").alias("norm"))
    index = DigestIndex(spark)
    index.flush(held.select("id", "digest"))
    index.compact()
    hits, _ = index.ask(held)
    hits = hits.withColumn("norm", normal_form(F.col("norm")))
    checked, mixed = _verified(index, hits)
    repeated = hits.select("row", "digest").join(checked.select("digest", "same", "keep_row"), "digest")
    by_text = mixed.groupBy("digest", "other").agg(_least())
    others = mixed.join(by_text, ["digest", "other"]).select("row", "keep_row")
    gone = repeated.filter("same").select("row", "keep_row").union(others).filter("row <> keep_row").select("row")
    return by_number(marked.drop(key), row, gone, False).drop(row)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
