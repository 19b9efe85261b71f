"""Altitude: park ranking, tempo by park, and fixed-effects models with a park moderator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import recode, round_to
from ..operators.distribution import kernel_density
from ..operators.numbering import rank_descending
from ..operators.ordered import cell_counts, exact_quantiles
from ..operators.periods import in_periods, spread
from ..operators.reuse import written_once
from ..operators.regression import coefficient_table, entity_effects, entity_sums, merge_sums, solve_fixed_effects
from .tempo import CAP, PERIODS, PITCHER, TEMPO, mean_tempo, pitches

# Abbreviations that differ between the park list and the team list.
TEAM_ABBR = {
    "ARI": "AZ",
    "CHW": "CWS",
    "KCR": "KC",
    "SDP": "SD",
    "SFG": "SF",
    "TBR": "TB",
    "WSN": "WSH",
}


def clean_abbr(column: str = "abbr", mapping: dict[str, str] = TEAM_ABBR) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))


def altitude_band(altitude: str = "altitude") -> Column:
    """Label bands, open at both ends: an altitude of exactly 900 or 1000, or up to 750, has none."""
    a = F.col(altitude)
    return (
        F.when(a > 1000, "above_1000")
        .when((a > 900) & (a < 1000), "900_to_1000")
        .when((a < 900) & (a > 750), "750_to_900")
    )


def altitude_ranking(parks: DataFrame) -> DataFrame:
    """Complete parks from high to low, with label and band; parks of equal altitude share a position.

    The label has the abbreviation as the list of parks gives it. Parks usually number in the dozens: they are counted, and one window ranks them
    only if they are few.
    """
    label = F.concat("park_name", F.lit(" ("), "abbr", F.lit(")"))
    complete = parks.withColumn("label", label).withColumn("abbr", clean_abbr()).dropna()
    ranked = rank_descending(written_once(complete), "altitude")
    return ranked.select(
        "position", "home_team", "park_name", "abbr", "altitude", altitude_band().alias("band"), "label"
    ).orderBy(F.desc("altitude"), "home_team")


def band_counts(parks: DataFrame) -> DataFrame:
    """Parks per label band."""
    return parks.groupBy(altitude_band().alias("band")).agg(
        F.count("*").alias("n"), F.min("altitude").alias("lowest"), F.max("altitude").alias("highest")
    )


def park_tempo(
    events: DataFrame, parks: DataFrame, periods: Sequence = PERIODS, cap: float | None = CAP
) -> DataFrame:
    """Mean tempo per home team and period with park and altitude, slowest of the second period first.

    The parks meet the aggregated teams, not the events.
    """
    teams = mean_tempo(events, "home_team", pitches(first=False, cap=cap), periods)
    joined = teams.join(parks.select("home_team", "park_name", "altitude"), "home_team", "left")
    columns = ["home_team", "park_name", "altitude", *[f"avg_tempo_{p}" for p in periods]]
    return joined.select(*columns).dropna().orderBy(F.desc(f"avg_tempo_{periods[1]}"), "home_team")


def with_park(events: DataFrame, parks: DataFrame, *columns: str) -> DataFrame:
    """Left-join park columns by home team. Spark broadcasts the parks when their measured size allows."""
    return events.join(parks.select("home_team", *columns), "home_team", "left")


def flagged(flag: Column, yes: str = "flagged", no: str = "elsewhere") -> Column:
    return recode(flag, yes, no)


def flag_density(
    events: DataFrame, parks: DataFrame, flag: Column, where: Column | None = None, high: float = 60.0
) -> DataFrame:
    """Tempo density at the flagged park and elsewhere, by year; games without a park are dropped."""
    rows = events.where(pitches(first=False) if where is None else where)
    rows = with_park(rows, parks, "abbr").withColumn("place", flagged(flag)).dropna(subset=["place"])
    return kernel_density(rows, TEMPO, 0.0, high, ["place", "year"])


def flag_summary(
    events: DataFrame, parks: DataFrame, flag: Column, periods: Sequence = PERIODS
) -> DataFrame:
    """Mean and median tempo at the flagged park and elsewhere, by period, larger second median first.

    Both start from the same cell counts, so two groups that hold everything are neither shuffled nor sorted as a whole.
    """
    rows = with_park(events.where(in_periods(periods) & pitches(first=False)), parks, "abbr")
    keys = ["place", "year"]
    rows = rows.withColumn("place", flagged(flag))
    cells = written_once(cell_counts(rows, keys, TEMPO, total=F.sum(TEMPO)))
    means = cells.where("cell IS NOT NULL").groupBy(*keys).agg((F.sum("total") / F.sum("in_cell")).alias("mean"))
    medians = exact_quantiles(rows, keys, TEMPO, {"median": 0.5}, cells)
    wide = spread(means, ["place"], ["mean"], periods).join(
        spread(medians, ["place"], ["median"], periods), "place"
    )
    return wide.dropna().orderBy(F.desc(f"median_{periods[1]}"), "place")


def _model_sums(
    rows: DataFrame, moderator: Column, kept: Column, outcome: str, key: str, totals: dict[str, Column] | None = None
) -> DataFrame:
    return entity_sums(
        rows,
        [key, "pitch_code", "year"],
        F.col(outcome),
        F.col(TEMPO),
        F.col(TEMPO) * moderator,
        where=kept & F.col(key).isNotNull(),
        totals=totals,
    )


def _qualified_types(sums: DataFrame, periods: Sequence, threshold: int, key: str) -> DataFrame:
    """(pitcher, type) pairs above the threshold in both periods, from the counts of the same sums."""
    counted = sums.where(F.col("pitch_code").isNotNull()).groupBy(key, "pitch_code").agg(
        *[F.sum(F.when(F.col("year") == p, F.col("n_all"))).alias(f"__n{i}") for i, p in enumerate(periods)]
    )
    for i in range(len(periods)):
        counted = counted.where(F.col(f"__n{i}") > threshold)
    return counted.select(key, "pitch_code")


def _model_entities(
    sums: DataFrame,
    periods: Sequence,
    min_pitches: int,
    row_scope: str,
    min_type_rows: int | None,
    types: Sequence[str] | None,
    key: str,
) -> DataFrame:
    """One row of sums per (type, year, pitcher) of the models to fit."""
    cohort = _qualified_types(sums, periods, min_pitches, key)
    if types is not None:
        cohort = cohort.where(F.col("pitch_code").isin(*types))
    if min_type_rows is not None:
        common = sums.groupBy("pitch_code").agg(F.sum("n_pitches").alias("__n")).where(F.col("__n") > min_type_rows)
        cohort = cohort.join(common, "pitch_code", "left_semi")
    if row_scope == "type":
        own = sums.where(F.col("n") > 0).drop("n_all", "n_pitches")
        return own.join(cohort, [key, "pitch_code"], "left_semi")
    if row_scope == "all":
        whole = merge_sums(sums.where(F.col("n") > 0), [key, "year"])
        return cohort.join(whole, key)
    raise ValueError("row_scope is 'all' or 'type'")


def fixed_effects_grid(
    events: DataFrame,
    parks: DataFrame,
    flag: Column,
    min_pitches: int = 100,
    min_type_rows: int | None = 25_000,
    types: Sequence[str] | None = None,
    row_scope: str = "type",
    kept: Column | None = None,
    periods: Sequence = PERIODS,
    model_years: Sequence | None = None,
    outcome: str = "start_speed",
    key: str = PITCHER,
    p_values: bool = True,
    effects: bool | str = False,
) -> DataFrame:
    """Velocity on tempo, tempo at the flagged park, and one intercept per pitcher, for each pitch type
    and season, over pitchers who qualify on that type in both seasons.

    ``row_scope="type"`` fits pitches of the type; ``"all"`` fits all pitches of those pitchers, as the
    published table does. The events are read once for all models; the cohort joins sums per pitcher.
    ``effects=True`` returns the pitchers' intercepts instead, with standard error, t and p; ``effects="table"`` the whole
    coefficient table.
    """
    rows = with_park(events.where(in_periods(periods)), parks, "abbr")
    moderator = F.when(flag, 1.0).when(~flag, 0.0)
    return _grid(
        rows, moderator, pitches(first=False, cap=CAP) if kept is None else kept, min_pitches, min_type_rows,
        types, row_scope, periods, model_years, outcome, key, p_values, effects,
    )


def flag_table(models: DataFrame, codes: DataFrame) -> DataFrame:
    """The short table of the flag models: description of the type, season, and both coefficients, rounded as published."""
    named = models.join(codes.select("pitch_code", F.col("pitch_desc").alias("pitch_type")), "pitch_code")
    return named.select(
        "pitch_type",
        "year",
        round_to("b_t", 3).alias("pitch_tempo_coefficient"),
        round_to("p_t", 3).alias("pitch_tempo_p_value"),
        round_to("b_z", 4).alias("pitch_tempo_abbr_coefficient"),
        round_to("p_z", 3).alias("pitch_tempo_abbr_p_value"),
        round_to("r2_uncentered", 3).alias("r_squared"),
    )


def altitude_model(
    events: DataFrame,
    parks: DataFrame,
    types: Sequence[str] = ("FF",),
    min_pitches: int = 100,
    row_scope: str = "type",
    kept: Column | None = None,
    periods: Sequence = PERIODS,
    model_years: Sequence | None = None,
    outcome: str = "start_speed",
    key: str = PITCHER,
    p_values: bool = True,
    effects: bool | str = False,
) -> DataFrame:
    """The same model with altitude as the moderator. By default the first pitch of a plate appearance is
    included and only the first period is fitted."""
    rows = with_park(events.where(in_periods(periods)), parks, "altitude")
    return _grid(
        rows, F.col("altitude").cast("double"), pitches(cap=CAP) if kept is None else kept, min_pitches, None,
        types, row_scope, periods, model_years or periods[:1], outcome, key, p_values, effects,
    )


def _grid(
    rows, moderator, kept, min_pitches, min_type_rows, types, row_scope, periods, model_years, outcome, key,
    p_values, effects,
) -> DataFrame:
    sums = _model_sums(
        rows,
        moderator,
        kept,
        outcome,
        key,
        {"n_all": F.count("*"), "n_pitches": F.count_if(F.col("is_pitch") & F.col("pitch_desc").isNotNull())},
    )
    sums = written_once(sums)
    entities = _model_entities(sums, periods, min_pitches, row_scope, min_type_rows, types, key)
    if model_years is not None:
        entities = entities.where(F.col("year").isin(*model_years))
    keys = ["pitch_code", "year"]
    if not effects:
        return solve_fixed_effects(entities, keys, p_values)
    entities = written_once(entities)
    model = written_once(solve_fixed_effects(entities, keys, effects == "table" or p_values, covariance=True))
    if effects == "table":
        return coefficient_table(entities, model, keys, key, ("pitch_tempo", "pitch_tempo:moderator"))
    return entity_effects(entities, model, keys, key, p_values)
