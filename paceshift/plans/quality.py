"""Pitch quality: velocity and spin by pitch type, and their relation to tempo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import round_to
from ..operators.periods import by_period, change, in_periods
from ..operators.regression import fit_band, line_summary, simple_ols
from ..operators.reuse import written_once
from .tempo import CAP, PERIODS, PITCHER, TEMPO

TYPE = ["pitch_code", "pitch_desc"]
MEASURES = {"velo": "start_speed", "spin_rate": "spin_rate"}


def pitch_codes(events: DataFrame, min_rows: int = 25_000) -> DataFrame:
    """Pitch types thrown more than ``min_rows`` times, most common first."""
    counted = events.where(F.col("is_pitch")).groupBy("pitch_desc", "pitch_code").agg(F.count("*").alias("n"))
    return counted.dropna().where(F.col("n") > min_rows).orderBy(F.desc("n"), "pitch_code")


def leaderboards(
    events: DataFrame,
    types: DataFrame | None = None,
    min_rows: int = 100,
    periods: Sequence = PERIODS,
    metric: str = "velo",
    key: str = PITCHER,
) -> DataFrame:
    """Mean velocity and spin per pitch type and pitcher with more than ``min_rows`` rows, best first.

    All types come from one aggregate. The condition on types applies to the aggregated rows. Rows are
    not limited to pitches: a row has a pitch type only if it is one.
    """
    board = (
        events.where(in_periods(periods) & F.col("pitch_code").isNotNull())
        .groupBy("pitch_code", key)
        .agg(
            round_to(F.avg("start_speed"), 2).alias("velo"),
            round_to(F.avg("spin_rate"), 0).alias("spin_rate"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") > min_rows)
    )
    if types is not None:
        board = board.join(types.select("pitch_code"), "pitch_code", "left_semi")
    return board.orderBy("pitch_code", F.desc_nulls_last(metric), key)


def leaderboard(
    events: DataFrame,
    pitch_type: str,
    metric: str = "velo",
    min_rows: int = 100,
    periods: Sequence = PERIODS,
    key: str = PITCHER,
) -> DataFrame:
    """The leaderboard of one pitch type; the condition reaches the scan."""
    own = events.where(F.col("pitch_code") == pitch_type)
    return leaderboards(own, None, min_rows, periods, metric, key).drop("pitch_code")


def velo_spin_fit(board: DataFrame, points: int = 80) -> DataFrame:
    """Line of spin on velocity with its band, per pitch type, from a leaderboard."""
    return fit_band(board, ["pitch_code"], "spin_rate", "velo", points)


def _type_sums(events: DataFrame, periods: Sequence, key: str) -> DataFrame:
    """Pitches, sums and value counts per (pitcher, type): enough for the cohort, the list of types and
    the means by type, so the events are read and shuffled once."""
    measures = {"n": (F.count, F.lit(1))}
    for name, column in MEASURES.items():
        measures[f"sum_{name}"] = (F.sum, column)
        measures[f"count_{name}"] = (F.count, column)
    return written_once(by_period(events.where(F.col("is_pitch")), [key, *TYPE], measures, periods))


def by_type(
    events: DataFrame,
    measures: Sequence[str] = ("velo", "spin_rate"),
    min_pitches: int | None = 100,
    min_type_rows: int | None = 25_000,
    periods: Sequence = PERIODS,
    rounded: bool = False,
    key: str = PITCHER,
) -> DataFrame:
    """Mean velocity and spin per pitch type and period with their change.

    ``min_pitches=None`` takes every pitcher, ``min_type_rows=None`` every type.
    """
    sums = _type_sums(events, periods, key)
    cohort = sums
    if min_pitches is not None:
        per_pitcher = W.partitionBy(key)
        for p in periods:
            cohort = cohort.withColumn(f"__all_{p}", F.sum(f"n_{p}").over(per_pitcher))
        for p in periods:
            cohort = cohort.where(F.col(f"__all_{p}") > min_pitches)
    digits = {"velo": 2, "spin_rate": 0}
    means = []
    for m in measures:
        for p in periods:
            mean = F.sum(f"sum_{m}_{p}") / F.nullif(F.sum(f"count_{m}_{p}"), F.lit(0))
            means.append((round_to(mean, digits[m]) if rounded else mean).alias(f"avg_{m}_{p}"))
    out = cohort.groupBy("pitch_desc").agg(*means)
    for m in measures:
        diff = change(f"avg_{m}", periods)
        out = out.withColumn(f"{m}_change", round_to(diff, digits[m]) if rounded else diff)
    out = out.dropna()
    if min_type_rows is not None:
        pitches = sum((F.col(f"n_{p}") for p in periods), F.lit(0))
        known = (
            sums.dropna(subset=TYPE)
            .groupBy(*TYPE)
            .agg(F.sum(pitches).alias("n"))
            .where(F.col("n") > min_type_rows)
        )
        out = out.join(known.select("pitch_desc"), "pitch_desc", "left_semi")
    order = f"{measures[0]}_change" if rounded else f"avg_{measures[0]}_{periods[1]}"
    return out.orderBy(F.desc(order), "pitch_desc")


def change_points(
    events: DataFrame,
    measure: str = "velo",
    min_rows: int = 100,
    periods: Sequence = PERIODS,
    where: Column | None = None,
    types: DataFrame | None = None,
    key: str = PITCHER,
) -> DataFrame:
    """Per pitch type and pitcher: change in mean velocity (or spin) against change in mean tempo, over
    pitchers with more than ``min_rows`` such pitches in each period."""
    kept = F.col("is_pitch") & (F.col(TEMPO) < CAP if where is None else where)
    wide = by_period(
        events.where(kept & F.col("pitch_code").isNotNull()),
        ["pitch_code", key],
        {f"avg_{measure}": (F.avg, MEASURES[measure]), "avg_tempo": (F.avg, TEMPO), "n": (F.count, F.lit(1))},
        periods,
    )
    for p in periods:
        wide = wide.where(F.col(f"n_{p}") > min_rows)
    if types is not None:
        wide = wide.join(types.select("pitch_code"), "pitch_code", "left_semi")
    return wide.select(
        "pitch_code",
        key,
        change(f"avg_{measure}", periods).alias(f"diff_{measure}"),
        change("avg_tempo", periods).alias("diff_tempo"),
    )


def change_models(events: DataFrame, measure: str = "velo", p_values: bool = True, **options) -> DataFrame:
    """Least-squares line of the change in velocity (or spin) on the change in tempo, per pitch type."""
    points = change_points(events, measure, **options)
    return simple_ols(points, ["pitch_code"], f"diff_{measure}", "diff_tempo", p_values)


def change_summary(events: DataFrame, measure: str = "velo", p_values: bool = True, **options) -> DataFrame:
    """The whole printed summary of the same lines: coefficients, residuals, residual error, R squared, F."""
    points = written_once(change_points(events, measure, **options))  # a row for each pitcher and type
    return line_summary(points, ["pitch_code"], f"diff_{measure}", "diff_tempo", p_values)


def change_table(models: DataFrame, compat: bool = False) -> DataFrame:
    """The short result table. ``compat=True`` reports the intercept and its p-value under the name of the
    tempo coefficient, as the published table does; the default reports the slope."""
    row = "intercept" if compat else "slope"
    return models.select(
        "pitch_code",
        F.col(row).alias("diff_tempo_coefficient"),
        F.col(f"{row}_p").alias("diff_tempo_p_value"),
        "r_squared",
    )


def published_change_table(models: DataFrame, codes: DataFrame, compat: bool = False) -> DataFrame:
    """The short table with the description of each type in codes, rounded to three digits."""
    table = change_table(models, compat).join(codes.select("pitch_code", F.col("pitch_desc").alias("pitch_type")), "pitch_code")
    digits = ["diff_tempo_coefficient", "diff_tempo_p_value", "r_squared"]
    return table.select("pitch_type", *[round_to(c, 3).alias(c) for c in digits])


def change_fit(events: DataFrame, measure: str = "velo", points: int = 80, **options) -> DataFrame:
    return fit_band(
        change_points(events, measure, **options), ["pitch_code"], f"diff_{measure}", "diff_tempo", points
    )
