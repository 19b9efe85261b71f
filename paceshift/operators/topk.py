"""Top and bottom k with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extreme_k(df: DataFrame, metric: str, k: int, largest: bool = True) -> DataFrame:
    """Rows whose metric is among the k largest (smallest), with every row tied with the k-th.

    The k-th value comes from a bounded take-ordered and enters as a scalar subquery, so the tied rows,
    of which there may be very many, are filtered in place and never meet in one task. Rows without the
    metric are kept only when fewer than k rows have it.
    """
    m = F.col(metric)
    order = m.desc_nulls_last() if largest else m.asc_nulls_last()
    edge = F.min(metric) if largest else F.max(metric)
    head = df.select(metric).orderBy(order).limit(k)
    threshold = head.agg(F.when(F.count(metric) >= k, edge)).scalar()
    within = m >= threshold if largest else m <= threshold
    return df.where(within | threshold.isNull())


def top_k(df: DataFrame, metric: str, k: int) -> DataFrame:
    return extreme_k(df, metric, k, largest=True)


def bottom_k(df: DataFrame, metric: str, k: int) -> DataFrame:
    return extreme_k(df, metric, k, largest=False)
