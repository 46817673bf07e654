"""Tail probabilities for the fold comparison (inventory J17)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(b, a, 1.0 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for step in range(2000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        value *= c * d
        if step and abs(1.0 - c * d) < 1e-15:
            break
    return front * (value - 1.0) / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's distribution."""
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; one row per pair of models."""
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)], index=t.index, dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_1_p_value(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v >= 0 else math.nan).astype("float64")


def chi2_2_p_value(x: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom."""
    return F.exp(-x / 2)
