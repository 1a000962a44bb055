"""Levels, agreement, and exact intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(value: Column, low: Column, high: Column) -> Column:
    return F.when(value >= high, "high").when(value > low, "medium").otherwise("low")


def kappa(po: Column, pe: Column) -> Column:
    """Cohen's kappa; null if chance agreement is whole."""
    return F.when(pe != 1, (po - pe) / (1 - pe))


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            num = 1.0
        elif k % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval of a share k / n."""
    low = 0.0 if k == 0 else _bisect(lambda p: _beta_inc(k, n - k + 1, p) - alpha / 2, 0.0, 1.0)
    high = 1.0 if k == n else _bisect(lambda p: _beta_inc(k + 1, n - k, p) - (1 - alpha / 2), 0.0, 1.0)
    return low, high


def _poisson_cdf(k: int, mean: float) -> float:
    return math.fsum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1)) if mean > 0 else 1.0


def garwood(k: int, exposure: float = 1.0, alpha: float = 0.05) -> tuple[float, float]:
    """Exact Poisson interval of a rate k / exposure."""
    most = k + 20 * math.sqrt(k + 1) + 20
    low = 0.0 if k == 0 else _bisect(lambda m: 1 - _poisson_cdf(k - 1, m) - alpha / 2, 0.0, most)
    high = _bisect(lambda m: alpha / 2 - _poisson_cdf(k, m), 0.0, most)
    return low / exposure, high / exposure
