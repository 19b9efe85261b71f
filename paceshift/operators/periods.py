"""Side-by-side comparison of two periods in one pass.

Conditional aggregates replace group-by-period followed by a pivot: no job to discover the period values,
one shuffle of partial aggregates, one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col

Measure = tuple[Callable[[Column], Column], "str | Column"]


def in_periods(periods: Sequence, period: str = "year") -> Column:
    return F.col(period).isin(*periods)


def by_period(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Measure],
    periods: Sequence,
    period: str = "year",
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key with ``{measure}_{period}`` columns, grouped by measure, then by period.

    ``totals`` are further aggregates over the same groups that are not split by period.
    """
    aggregates = [
        fn(F.when(F.col(period) == p, col(value))).alias(f"{name}_{p}")
        for name, (fn, value) in measures.items()
        for p in periods
    ]
    aggregates += [c.alias(name) for name, c in (totals or {}).items()]
    return df.where(in_periods(periods, period)).groupBy(*keys).agg(*aggregates)


def spread(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], periods: Sequence, period: str = "year"
) -> DataFrame:
    """Widen a table that already has one row per (key, period)."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(period) == p, F.col(v))).alias(f"{v}_{p}") for v in values for p in periods]
    )


def change(name: str, periods: Sequence) -> Column:
    """Later minus earlier value of a spread measure."""
    return F.col(f"{name}_{periods[1]}") - F.col(f"{name}_{periods[0]}")
