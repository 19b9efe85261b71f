"""Landed per-game files: which games belong to a season, and their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cleaned_names, in_years
from . import files, payloads
from .schemas import EVENT_HEADER, EVENTS, REQUIRED


def calendar(bounds: DataFrame, start: str = "start", end: str = "end", name: str = "date") -> DataFrame:
    """All days from start to end, both included, for each row of bounds."""
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))
    return bounds.select(F.explode(days).alias(name))


def calendar_between(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    return calendar(spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end")), name=name)


def season_games(
    schedule: DataFrame,
    year: int,
    finished: Column | None = None,
    regular: Column | None = None,
    game: str = "game_pk",
    date: str = "game_date",
) -> DataFrame:
    """One row per game of a season. Pass ``None`` to skip the finished or regular-season condition.

    The date may be a date, a timestamp or ISO text; the bounds reach the scan in each case.
    """
    rows = schedule.where(in_years(schedule, date, year, year))
    for condition in (finished, regular):
        if condition is not None:
            rows = rows.where(condition)
    return rows.groupBy(game).agg(F.count("*").alias("n"))


def games_on_days(schedule: DataFrame, days: DataFrame, game: str = "game_pk", date: str = "game_date") -> DataFrame:
    """Games on the given days, once each."""
    wanted = days.select(F.col(days.columns[0]).alias("__day")).distinct()
    rows = schedule.join(wanted, F.col(date).cast("date") == F.col("__day"), "left_semi")
    return rows.groupBy(game).agg(F.count("*").alias("n"))


def landed_events(spark: SparkSession, paths: Sequence[str], fmt: str = "json", required: Sequence[str] = REQUIRED, unknown: str = "drop") -> DataFrame:
    """All landed event files (JSON lines or CSV, under the raw field names) as one table.

    Columns a file lacks are null, but a required field that no row of the files has is an error. For JSON that
    takes a look at the field names of all rows when this is called; for CSV, at each header. ``unknown="keep"`` (JSON) also keeps every field that the
    event schema does not have, under a clean name and with the type that its values have; see ``payloads``.
    """
    if unknown not in ("drop", "keep") or (unknown == "keep" and fmt != "json"):
        raise ValueError("unknown is 'drop' or, for json, 'keep'")
    if fmt == "csv":
        return files.read_raw_events(spark, list(paths), required=required).drop("ingest_seq")
    if fmt != "json":
        raise ValueError("landed files are json or csv")
    if unknown == "keep":
        rows = payloads.read_payloads(spark, paths, files.raw_schema(), required)
        return payloads.renamed_fields(rows, EVENT_HEADER, cleaned_names(rows.columns))
    names = spark.read.text(list(paths)).select(F.explode(F.json_object_keys("value")).alias("name")).distinct()
    found = {r["name"] for r in names.collect()}  # as many as there are field names
    missing = [f for f in required if f not in found]
    if missing:
        raise ValueError(f"the landed files lack the fields {missing}")
    return files.renamed(spark.read.schema(files.raw_schema()).json(list(paths))).select(*EVENTS.names)


def ingest(events: DataFrame, games: DataFrame, game: str = "game_pk") -> DataFrame:
    """Events of the listed games."""
    return events.join(games.select(game), game, "left_semi")
