"""Tail probabilities of Student's t and of F, and the t quantile.

Spark SQL has neither distribution. The functions are Arrow-batched and run only on model rows (one per
fitted line), never on events.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import col

# The functions travel to the executors as code, so those need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz method."""
    tiny, eps = 1e-300, 1e-15
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p_value(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_tail_value(f: float | None, df1: float | None, df2: float | None) -> float | None:
    """Probability of a larger F with df1 and df2 degrees of freedom."""
    if f is None or df1 is None or df2 is None or math.isnan(f) or math.isnan(df1) or math.isnan(df2) or df1 <= 0 or df2 <= 0:
        return None
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * max(f, 0.0)))


def t_quantile_value(p: float, df: float | None) -> float | None:
    """Upper quantile for 0.5 < p < 1 by bisection on the tail probability."""
    if df is None or math.isnan(df) or df <= 0:
        return None
    tail, low, high = 2.0 * (1.0 - p), 0.0, 2.0
    while two_sided_p_value(high, df) > tail:
        low, high = high, high * 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if two_sided_p_value(mid, df) > tail:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def _two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p_value(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile_value(a, b) for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail_value(*x) for x in zip(f, df1, df2)], dtype="float64")


def f_tail(f: str | Column, df1: str | Column, df2: str | Column) -> Column:
    return _f_tail(col(f).cast("double"), col(df1).cast("double"), col(df2).cast("double"))


def two_sided_p(t: str | Column, df: str | Column) -> Column:
    return _two_sided_p(col(t).cast("double"), col(df).cast("double"))


def t_quantile(p: float, df: str | Column) -> Column:
    return _t_quantile(F.lit(p), col(df).cast("double"))
