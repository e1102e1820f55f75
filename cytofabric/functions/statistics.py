"""Distribution functions that Spark lacks, as vectorised UDFs over aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all tables with these margins that are no likelier than [[a, b], [c, d]]."""
    r, s, n = a + b, a + c, a + b + c + d

    def log_p(k: int) -> float:
        f = math.lgamma
        return f(r + 1) + f(n - r + 1) + f(s + 1) + f(n - s + 1) - f(n + 1) - f(k + 1) - f(r - k + 1) - f(s - k + 1) - f(n - r - s + k + 1)

    low, high, own = max(0, r + s - n), min(r, s), log_p(a)
    return min(1.0, math.fsum(math.exp(p) for k in range(low, high + 1) if (p := log_p(k)) <= own + 1e-7))


def _each(function, *columns: pd.Series) -> pd.Series:
    """function of each row; null where an argument is null or not finite."""
    rows = zip(*columns, strict=True)
    return pd.Series([function(*map(float, r)) if all(v is not None and np.isfinite(v) for v in r) else None for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    return _each(normal_cdf, z)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(lambda *v: fisher_two_sided(*map(int, v)), a, b, c, d)


def register(spark: SparkSession) -> None:
    """Offer them, and the signature predicate, to SQL."""
    spark.udf.register("norm_cdf", norm_cdf)
    spark.udf.register("t_two_sided", t_tail)
    spark.udf.register("fisher_two_sided", fisher)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION phenotype_match(mask BIGINT, p BIGINT, n BIGINT) RETURNS BOOLEAN RETURN (mask & p) = p AND (mask & n) = 0")
