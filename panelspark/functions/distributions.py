"""Two-sided tails for result rows: a few per query, so an Arrow function over plain Python suffices."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_code


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, freedom: float) -> float:
    return beta_fraction(freedom / 2, 0.5, freedom / (freedom + t * t))


def t_two_sided(t: Column, freedom: Column) -> Column:
    ship_code(SparkSession.active())

    @F.pandas_udf("double")
    def tail(ts: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([t_tail(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(ts, fs, strict=True)], dtype="float64")

    return tail(t, freedom)


def normal_two_sided(z: Column) -> Column:
    ship_code(SparkSession.active())

    @F.pandas_udf("double")
    def tail(zs: pd.Series) -> pd.Series:
        return zs.map(lambda z: math.erfc(abs(z) / math.sqrt(2)) if pd.notna(z) else None).astype("float64")

    return tail(z)
