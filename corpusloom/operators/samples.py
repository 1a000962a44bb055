"""Samples for annotation: rounds over categories, blinded copies, joins that must be one to one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import numbered, unused


def draw(key: str, salt: str) -> Column:
    """A random order that is the same for the same salt: the md5 of key and salt."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(salt)).cast("binary"))


def in_rounds(df: DataFrame, category: str, order: list, places: list[str], by: list[str]) -> DataFrame:
    """df with pick: rows in rounds, one of each category a round, categories as in places; rows of other categories come last in a round."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, places)), F.col(category)), F.lit(0)), F.lit(len(places) + 1))
    rounds = numbered(df.withColumn("_place", place), order, "_round", [*by, category])
    return numbered(rounds, ["_round", "_place", category], "pick", by).drop("_round", "_place")


def round_robin(df: DataFrame, key: str, by: str, categories: str, places: list[str], k: int, salt: str) -> DataFrame:
    """by, key, reason and pick: k rows of each group, picked in turn from pools by category.

    categories: an array column; a row may stand in several pools and leaves all once picked.
    Each turn takes the next of its pool in the order of draw(key, salt); when the pools are
    empty, rows of no category fill the rest. No more than k rows leave a pool for others, so
    the first 2 k of a pool are enough: a task holds so many rows of a group, however large.
    """
    long = df.select(by, key, F.explode(F.when(F.size(categories) > 0, F.col(categories)).otherwise(F.array(F.lit("")))).alias("pool"), draw(key, salt).alias("d"))
    long = long.filter(F.col("pool").isin(*places, ""))
    first = long.withColumn("rn", F.row_number().over(Window.partitionBy(by, "pool").orderBy("d", key))).filter(F.col("rn") <= 2 * k)
    types = dict(df.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        pools = {p: g.sort_values(["d", key])[key].tolist() for p, g in group.groupby("pool")}
        taken: dict = {}
        while len(taken) < k and any(x not in taken for p in places for x in pools.get(p, [])):
            for p in places:
                free = next((x for x in pools.get(p, []) if x not in taken), None)
                if free is not None and len(taken) < k:
                    taken[free] = p
        for x in pools.get("", []):
            if len(taken) < k:
                taken[x] = "none"
        return pd.DataFrame({by: group[by].iloc[0], key: list(taken), "reason": list(taken.values()), "pick": range(1, len(taken) + 1)})

    return first.groupBy(by).applyInPandas(pick, f"{by} {types[by]}, {key} {types[key]}, reason string, pick int")


def sample_ids(df: DataFrame, order: list[str], form: str) -> DataFrame:
    """df with sample_id, the rows' numbers in `order` from 1 in a format such as P2-%03d, which is wider for longer numbers."""
    number = unused(df, "_n")
    return numbered(df, order, number).withColumn("sample_id", F.format_string(form, F.col(number))).drop(number)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inner join by key, and what keeps it from being one to one: key and problem (only_left, only_right, repeated)."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_l")), right.groupBy(key).agg(F.count("*").alias("_r"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when((F.col("_l") > 1) | (F.col("_r") > 1), "repeated")
    return left.join(right, key), both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def exact_else_normal(asked: DataFrame, ledger: DataFrame, address: str, normal: str, value: str) -> DataFrame:
    """asked with value, match_type (`exact`, `normalised`) or problem (`none`, `several`): equal addresses first, else equal normal forms."""
    by = lambda c, p: ledger.groupBy(F.col(c).alias(f"_{p}")).agg(F.count("*").alias(f"_n{p}"), F.min(value).alias(f"_v{p}"))
    j = asked.join(by(address, "e"), F.col(address) == F.col("_e"), "left").join(by(normal, "m"), F.col(normal) == F.col("_m"), "left")
    exact = F.col("_ne").isNotNull()
    n = F.coalesce("_ne", "_nm", F.lit(0))
    return j.select(*asked.columns, F.when(n == 1, F.coalesce("_ve", "_vm")).alias(value), F.when(n == 1, F.when(exact, "exact").otherwise("normalised")).alias("match_type"), F.when(n == 0, "none").when(n > 1, "several").alias("problem"))
