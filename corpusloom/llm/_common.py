"""What the pipeline operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, one of this process, which a local master alone can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(Path(tempfile.mkdtemp(prefix="corpusloom-")).as_uri())
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address in the shared folder."""
    return f"{shared_base(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores after it what no column of df is called."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def save(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df written as Parquet and reread: its lineage ends in files that outlive executors."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a bitmap that bitmap_construct_agg makes, and the bound of the bitmaps that are sent to all tasks.
BLOCK_BITS, MOST_SENT_BYTES = 32_768, 64 << 20


def bit_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit (0 to BLOCK_BITS - 1) is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)) != 0, F.lit(False))


def by_number(df: DataFrame, row: str, numbers: DataFrame, inside: bool) -> DataFrame:
    """The rows of df whose number, its column `row`, is in numbers (row), or is not.

    Numbers come of monotonically_increasing_id and lie close together, so they are packed into
    bitmaps, some bits a row of df. Up to a bound these go to all tasks and df isn't shuffled;
    beyond it df is joined.
    """
    block, bit = (lambda c: F.shiftright(c, 15)), (lambda c: c.bitwiseAND(F.lit(BLOCK_BITS - 1)))
    blocks = numbers.groupBy(block(F.col("row")).alias("block")).agg(F.bitmap_construct_agg(bit(F.col("row"))).alias("bitmap"))
    blocks = save(blocks, scratch(df.sparkSession, "numbers"))
    own = [df[c] for c in df.columns]
    if blocks.count() * (BLOCK_BITS // 8) > MOST_SENT_BYTES:
        return df.join(numbers, df[row] == numbers["row"], "left_semi" if inside else "left_anti").select(*own)
    sent = F.broadcast(blocks.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap")))
    joined = df.join(sent, block(df[row]) == sent["_block"], "left")
    hit = bit_set(sent["_bitmap"], bit(df[row]))
    return joined.filter(hit if inside else ~hit).select(*own)


def sieve(rows: DataFrame, key: str, keys: DataFrame, bits_a_key: int = 16) -> DataFrame:
    """The rows whose key may be in keys (key), a written table without repeats; few others pass.

    The keys are packed into bitmaps of bits_a_key bits each. Up to a bound these go to all
    tasks and rows aren't shuffled; beyond it all rows pass.
    """
    blocks = 1 + keys.count() * bits_a_key // BLOCK_BITS
    if blocks * (BLOCK_BITS // 8) > MOST_SENT_BYTES:
        return rows
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks * BLOCK_BITS))
    packed = keys.select(bit(F.col(key)).alias("bit")).groupBy(F.shiftright("bit", 15).alias("_block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("_bitmap"))
    sent = F.broadcast(save(packed, scratch(rows.sparkSession, "sieve")))
    own = [rows[c] for c in rows.columns]
    joined = rows.join(sent, F.shiftright(bit(rows[key]), 15) == sent["_block"])
    return joined.filter(bit_set(sent["_bitmap"], bit(rows[key]).bitwiseAND(F.lit(BLOCK_BITS - 1)))).select(*own)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) on written tables
    until a round changes nothing. Every step is a min aggregate, combined before its
    shuffle, and an equi-join whose large keys adaptive execution splits. Self loops
    contribute their node alone.
    """
    spark = edges.sparkSession
    paths = [scratch(spark, f"{name}-edges")]
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), paths[0])
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(a, b) & 1048575"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{paths[0]}-low{len(paths)}")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save(large.union(low.select("a", F.col("m").alias("b"))).filter("a >= b").distinct(), f"{paths[0]}-large{len(paths)}")
        least = save(large.filter("a > b").groupBy("a").agg(F.min("b").alias("m")), f"{paths[0]}-least{len(paths)}")
        small = large.filter("a > b").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        paths.append(f"{paths[0]}-{len(paths)}")
        now = save(small.union(least.select("a", F.col("m").alias("b"))).union(large.filter("a = b")).distinct(), paths[-1])
        for k in ("low", "large", "least"):
            remove(spark, f"{paths[0]}-{k}{len(paths) - 1}")
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    for p in paths[:-1]:
        remove(spark, p)
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
