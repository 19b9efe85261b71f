"""Entities that qualify in both of two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import in_periods


def qualified_keys(
    population: DataFrame,
    key: str,
    periods: Sequence,
    threshold: int,
    condition: Column | None = None,
    period: str = "year",
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Keys with strictly more than ``threshold`` rows satisfying ``condition`` in every period."""
    rows = population.where(in_periods(periods, period))
    if condition is not None:
        rows = rows.where(condition)
    counted = rows.groupBy(key, *extra_keys).agg(
        *[F.count_if(F.col(period) == p).alias(f"__n{i}") for i, p in enumerate(periods)]
    )
    for i in range(len(periods)):
        counted = counted.where(F.col(f"__n{i}") > threshold)
    return counted.select(key, *extra_keys)


def qualify(
    df: DataFrame,
    key: str,
    periods: Sequence,
    threshold: int,
    condition: Column | None = None,
    period: str = "year",
    population: DataFrame | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Rows of ``df`` whose key qualifies in ``population`` (the table itself by default).

    The number of qualifying keys grows with the data, so no broadcast is forced: Spark measures the
    cohort and picks the join, and splits a hot key at run time when it has to shuffle. Where the metric
    is grouped by the same key, prefer counting in the same aggregate, as the leaderboards do.
    """
    cohort = qualified_keys(
        df if population is None else population, key, periods, threshold, condition, period
    ).withColumnRenamed(key, "__cohort_key")
    same = df[key].eqNullSafe(F.col("__cohort_key")) if null_safe else df[key] == F.col("__cohort_key")
    return df.join(cohort, same, "left_semi")
