"""Tempo: distributions, period comparisons and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_text, recode, relative_change, round_to
from ..operators.cohort import qualified_keys
from ..operators.distribution import histogram, kernel_density
from ..operators.ordered import cell_counts, exact_quantiles
from ..operators.periods import by_period, change, in_periods, spread
from ..operators.reuse import written_once
from ..operators.topk import bottom_k, extreme_k, top_k

PERIODS = (2022, 2023)
CAP = 120.0
TEMPO = "pitch_tempo"
PITCHER = "pitcher_name"


def runners() -> Column:
    return recode(F.col("men_on_base") == "Empty", "Empty", "Men_On")


def first_pitch() -> Column:
    return recode(F.col("pitch_number") == 1, "1st pitch", "2nd+ pitch")


def pitches(first: bool = True, cap: float | None = None, floor: float | None = None) -> Column:
    """Condition on pitch rows: drop the first of a plate appearance, tempo strictly between bounds."""
    kept = F.col("is_pitch")
    if not first:
        kept = kept & (F.col("pitch_number") != 1)
    if floor is not None:
        kept = kept & (F.col(TEMPO) > floor)
    if cap is not None:
        kept = kept & (F.col(TEMPO) < cap)
    return kept


def game_rows(events: DataFrame, game_pk: int) -> DataFrame:
    return events.where(F.col("game_pk") == game_pk)


def longest_tempos(events: DataFrame, k: int = 50) -> DataFrame:
    return top_k(events.where(F.col("is_pitch") & (F.col("inning_count") != 1)), TEMPO, k)


def shortest_tempos(events: DataFrame, k: int = 100) -> DataFrame:
    return bottom_k(events, TEMPO, k)


def action_counts(events: DataFrame, year: int) -> DataFrame:
    """Non-pitch actions of one season by event."""
    actions = events.where(~F.col("is_pitch") & (F.col("year") == year))
    return actions.groupBy("details_event").agg(F.count("*").alias("n"))


def unlabelled_action_counts(events: DataFrame, year: int) -> DataFrame:
    """Non-pitch actions without an event, by description."""
    actions = events.where(
        ~F.col("is_pitch") & (F.col("year") == year) & F.col("details_event").isNull()
    )
    return actions.groupBy("details_description").agg(F.count("*").alias("n"))


def tempo_histogram(events: DataFrame, high: float = CAP) -> DataFrame:
    return histogram(events.where(F.col("is_pitch")), TEMPO, 0.0, high)


def tempo_density(events: DataFrame, where: Column | None = None, high: float = 60.0) -> DataFrame:
    """Tempo density by year. The default is all pitches; pass a condition to leave out, say, the first
    pitch of an inning."""
    kept = F.col("is_pitch") if where is None else F.col("is_pitch") & where
    return kernel_density(events.where(kept), TEMPO, 0.0, high, ["year"])


def tempo_density_by(
    events: DataFrame, facet: Column, name: str = "facet", where: Column | None = None, high: float = 60.0
) -> DataFrame:
    """Tempo density by year within the values of a facet expression; rows without a facet are a group."""
    kept = F.col("is_pitch") if where is None else where
    return kernel_density(
        events.where(kept).withColumn(name, facet), TEMPO, 0.0, high, [name, "year"]
    )


def mean_tempo(
    events: DataFrame, key: str, kept: Column, periods: Sequence = PERIODS, digits: int | None = None
) -> DataFrame:
    """Mean tempo per key and period."""
    rows = events.where(kept)
    wide = by_period(rows, [key], {"avg_tempo": (F.avg, TEMPO)}, periods)
    if digits is not None:
        wide = wide.withColumns(
            {f"avg_tempo_{p}": round_to(f"avg_tempo_{p}", digits) for p in periods}
        )
    return wide


def _with_relative(wide: DataFrame, periods: Sequence) -> DataFrame:
    relative = relative_change(f"avg_tempo_{periods[0]}", f"avg_tempo_{periods[1]}")
    return wide.withColumn("relative_change", relative).withColumn(
        "change_text", percent_text("relative_change")
    )


def tempo_by_runners(
    events: DataFrame, periods: Sequence = PERIODS, cap: float | None = CAP
) -> DataFrame:
    """Mean tempo with bases empty and with runners, after the first pitch, and its relative change."""
    rows = events.withColumn("runners", runners())
    return _with_relative(mean_tempo(rows, "runners", pitches(first=False, cap=cap), periods), periods)


def tempo_by_runners_rounded(events: DataFrame, periods: Sequence = PERIODS) -> DataFrame:
    """Variant: no cap, rounded means and their difference."""
    rows = events.withColumn("runners", runners())
    wide = mean_tempo(rows, "runners", pitches(first=False), periods, digits=2)
    return wide.withColumn("tempo_change", change("avg_tempo", periods))


def tempo_by_first_pitch(
    events: DataFrame, periods: Sequence = PERIODS, floor: float | None = 0.0, cap: float | None = CAP
) -> DataFrame:
    """Mean tempo of first and later pitches of a plate appearance, and its relative change."""
    rows = events.withColumn("pitch_of_at_bat", first_pitch())
    wide = mean_tempo(rows, "pitch_of_at_bat", pitches(floor=floor, cap=cap), periods)
    return _with_relative(wide, periods).orderBy(F.desc_nulls_last(f"avg_tempo_{periods[0]}"))


def team_change(
    events: DataFrame, periods: Sequence = PERIODS, cap: float | None = CAP, digits: int | None = 2
) -> DataFrame:
    """Teams by change in mean tempo, largest first; teams seen in one period only are dropped."""
    wide = mean_tempo(events, "fielding_team", pitches(first=False, cap=cap), periods, digits)
    diff = change("avg_tempo", periods)
    if digits is not None:
        diff = round_to(diff, digits)
    return wide.withColumn("tempo_change", diff).dropna().orderBy(F.desc("tempo_change"), "fielding_team")


def pitcher_medians(
    events: DataFrame,
    min_pitches: int,
    periods: Sequence = PERIODS,
    population: DataFrame | None = None,
    condition: Column | None = None,
    key: str = PITCHER,
) -> DataFrame:
    """Median tempo per pitcher and period with its change, over pitchers qualifying in both.

    Counts per (pitcher, year, cell of tempo) locate the medians and, unless the cohort is defined by another
    condition or table, give the cohort too.
    """
    rows = events.where(in_periods(periods) & F.col("is_pitch")).select(key, "year", (F.col("pitch_number") != 1).alias("later"), TEMPO)
    counted = written_once(cell_counts(rows, [key, "year", "later"], TEMPO))
    medians = exact_quantiles(rows.where("later"), [key, "year"], TEMPO, {"median_tempo": 0.5}, counted.where("later").drop("later"))
    if population is None and condition is None:
        pitches_thrown = [F.sum(F.when(F.col("year") == p, F.col("in_cell"))) > min_pitches for p in periods]
        cohort = counted.groupBy(key).agg(*[c.alias(f"__q{i}") for i, c in enumerate(pitches_thrown)])
        cohort = cohort.where(" AND ".join(f"__q{i}" for i in range(len(periods)))).select(key)
    else:
        cohort = qualified_keys(
            events if population is None else population,
            key,
            periods,
            min_pitches,
            F.col("is_pitch") if condition is None else condition,
        )
    wide = spread(medians, [key], ["median_tempo"], periods).dropna()
    return wide.join(cohort, key, "left_semi").withColumn("tempo_change", change("median_tempo", periods))


def median_leaders(
    events: DataFrame,
    metric: str,
    min_pitches: int,
    k: int = 15,
    largest: bool = False,
    periods: Sequence = PERIODS,
    **options,
) -> DataFrame:
    """The k pitchers with the largest (smallest) ``median_tempo_{period}`` or ``tempo_change``."""
    board = pitcher_medians(events, min_pitches, periods, **options)
    return extreme_k(board, metric, k, largest)


def pitcher_means(
    events: DataFrame,
    min_pitches: int,
    periods: Sequence = PERIODS,
    cap: float | None = CAP,
    digits: int | None = 2,
    key: str = PITCHER,
) -> DataFrame:
    """Mean tempo per pitcher and period over pitchers qualifying in both.

    Qualification and mean come from the same aggregate, so the events are read and shuffled once.
    """
    kept = pitches(first=False, cap=cap)
    wide = by_period(
        events,
        [key],
        {
            "avg_tempo": (F.avg, F.when(kept, F.col(TEMPO))),
            "__n": (F.count, F.when(F.col("is_pitch"), 1)),
        },
        periods,
    )
    for p in periods:
        wide = wide.where(F.col(f"__n_{p}") > min_pitches).drop(f"__n_{p}")
        if digits is not None:
            wide = wide.withColumn(f"avg_tempo_{p}", round_to(f"avg_tempo_{p}", digits))
    return wide.dropna()


def mean_leaders(
    events: DataFrame, min_pitches: int = 1, k: int = 10, largest: bool = False, periods: Sequence = PERIODS,
    **options,
) -> DataFrame:
    """The k fastest (slowest) pitchers by mean tempo in the first period."""
    board = pitcher_means(events, min_pitches, periods, **options)
    return extreme_k(board, f"avg_tempo_{periods[0]}", k, largest)


def pitcher_change(
    events: DataFrame, min_pitches: int = 100, periods: Sequence = PERIODS, digits: int | None = 2, **options
) -> DataFrame:
    """All qualifying pitchers by change in mean tempo, most reduced first."""
    board = pitcher_means(events, min_pitches, periods, digits=digits, **options)
    diff = change("avg_tempo", periods)
    if digits is not None:
        diff = round_to(diff, digits)
    return board.withColumn("tempo_change", diff).orderBy("tempo_change", options.get("key", PITCHER))
