"""Row numbers, running sums and order statistics over a whole table, with no task that holds all of it."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir; where that is unset a local master has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(Path(tempfile.mkdtemp(prefix="corpusloom-")).as_uri())
        base = _own[0]
    return f"{base.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores after it what no column of df is called."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in a scratch folder and reread: its lineage ends in files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """df written as `written` writes it, in n buckets of by, a file each: joins on by leave its rows where they lie."""
    path = scratch(df.sparkSession, name)
    called = f"corpusloom_{uuid.uuid4().hex}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(called)
    out = df.sparkSession.table(called)
    out._scratch, out._called = path, called
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of tables that `written` or `bucketed` made and that no result reads any more."""
    for t in tables:
        if hasattr(t, "_called"):
            t.sparkSession.sql(f"DROP TABLE {t._called}")
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, order: list, weights: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with a running sum for each of weights (name: a column of whole numbers), over rows in the given order, in each group of by.

    Rows are dealt to tasks by ranges of (by, order), written, and summed in each range; a
    range then adds what the ranges before it hold of its own group, a row a range and group.
    So a group, or a table, larger than a task is spread over many. order must tell all rows
    apart for a result that does not vary.
    """
    by = by or []
    part = "_range"
    ranged = df.withColumns({f"_w_{k}": w.cast("long") for k, w in weights.items()})
    ranged = ranged.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranges")
    held = ranged.groupBy(part, *by).agg(*[F.sum(f"_w_{k}").alias(f"_s_{k}") for k in weights])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select(part, *by, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0).cast("long")).alias(f"_b_{k}") for k in weights])
    own = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.alias("r").join(bases.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (part, *by)])
    joined = joined.select("r.*", *[F.col(f"b._b_{k}").alias(f"_b_{k}") for k in weights])
    return joined.select(*df.columns, *[(F.col(f"_b_{k}") + F.sum(f"_w_{k}").over(own)).alias(k) for k in weights])


def numbered(df: DataFrame, order: list, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the row number (from 1) in the given order, in each group of by."""
    return running(df, order, {name: F.lit(1)}, by)


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and, for each name of shares, the element at index floor(share * n) of the group's sorted values, nulls aside.

    Values are counted first; their running counts tell which one stands at an index.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    summed = running(counts, ["_v"], {"_upto": F.col("_n")}, by)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    joined = summed.join(total, by) if by else summed.crossJoin(F.broadcast(total))  # one row
    index = {k: F.floor(F.col("_all") * F.lit(s)) for k, s in shares.items()}
    return joined.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > i, F.col("_v"))).alias(k) for k, i in index.items()])
