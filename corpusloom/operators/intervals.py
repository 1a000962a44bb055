"""Intervals of shares, rates and agreement as columns and tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import stats

INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
# Resamples and seed of the published intervals.
RESAMPLES, SEED = 10_000, 20_260_812
#: Clusters whose sums a task may hold; cities, not rows.
MOST_CLUSTERS = 100_000


def _each(ks: pd.Series, ns: pd.Series, f: Callable) -> pd.DataFrame:
    """f of each distinct pair once; null where either is null or n is not positive."""
    known: dict = {}
    out = []
    for k, n in zip(ks, ns, strict=True):
        if k is None or n is None or k != k or n != n or n <= 0:
            out.append((None, None))
        else:
            out.append(known[k, n] if (k, n) in known else known.setdefault((k, n), f(k, n)))
    return pd.DataFrame(out, columns=["low", "high"], dtype="float64")


@F.pandas_udf(INTERVAL)
def binomial_interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
    """Exact 95 % interval (Clopper-Pearson) of k of n; null for n = 0."""
    return _each(ks, ns, lambda k, n: stats.clopper_pearson(int(k), int(n)))


@F.pandas_udf(INTERVAL)
def poisson_interval(ks: pd.Series, exposures: pd.Series) -> pd.DataFrame:
    """Exact 95 % interval (Garwood) of a rate of k events in an exposure; null without exposure."""
    return _each(ks, exposures, lambda k, e: stats.garwood(int(k), float(e)))


def ratio(sums: np.ndarray) -> np.ndarray:
    """The statistic of bootstrap for columns (part, whole)."""
    return sums[:, 0] / sums[:, 1]


def kappa_of_cells(sums: np.ndarray) -> np.ndarray:
    """The statistic of bootstrap for the four cells of two raters' yes and no: Cohen's kappa."""
    a, b, c, d = sums.T
    n = a + b + c + d
    chance = ((a + b) * (a + c) + (c + d) * (b + d)) / n**2
    return ((a + d) / n - chance) / (1 - chance)


def bootstrap(clusters: DataFrame, columns: list[str], statistic: Callable[[np.ndarray], np.ndarray], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One row: n (finite statistics), low and high (percentiles 2.5 and 97.5) of the statistic over resampled clusters.

    clusters has a row a cluster with its sums (columns); they are cities or reports, and their
    number is checked. Resamples are dealt to tasks; each draws with a seed of its own, so the
    result doesn't depend on how they are dealt. Without clusters the interval is null.
    """
    spark = clusters.sparkSession
    rows = clusters.select(*[F.col(c).cast("double") for c in columns]).orderBy(*columns).limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"bootstrap: more than {MOST_CLUSTERS} clusters; sum them first")
    table = np.array([list(r) for r in rows], dtype=float).reshape(-1, len(columns))

    def draw(batches):
        for batch in batches:
            out = []
            for k in batch["id"]:
                if len(table):
                    picks = np.random.default_rng([seed, int(k)]).integers(0, len(table), len(table))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        out.append(float(statistic(table[picks].sum(axis=0)[None])[0]))
            yield pd.DataFrame({"x": np.array([x for x in out if np.isfinite(x)], dtype=float)})

    drawn = spark.range(resamples).mapInPandas(draw, "x double")
    return drawn.agg(F.count("*").alias("n"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
