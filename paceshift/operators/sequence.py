"""Running counts and time since the previous event, in one shuffle of the events.

A window over (season, pitcher) or over a game puts a whole season of one key in one task, and a
season-wide lag puts everything there. Instead, events are cut into calendar slices (game, date, time
slice). Counts per slice are small and combine on the map side; their running totals give what each slice
starts from. These starting values join the events as extra rows that sort first in their slice, so the
in-slice windows simply continue from them. Events are shuffled once, by slice, whatever the key skew.

The slice counts also show slices that are too large for a task. Those, and only those, are cut further.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import gap_seconds
from .reuse import join_small, written_once


@dataclass(frozen=True)
class EventColumns:
    """Names of the columns the sequence operators use, and the slicing grain."""

    season: str = "year"
    date: str = "game_date"
    game: str = "game_pk"
    inning: str = "inning"
    start: str = "start_time"
    seq: str = "ingest_seq"
    pitcher: str = "pitcher_name"
    is_pitch: str = "is_pitch"
    slice_seconds: int = 3600
    max_slice_rows: int = 4_000_000
    seq_block: int = 1_000_000
    game_block: int = 4096

    @property
    def coarse_keys(self) -> list[str]:
        # The most selective first: sorts compare by the first column before they look at the rest.
        return [self.game, "__slice", self.date, self.season]

    @property
    def slice_keys(self) -> list[str]:
        return [*self.coarse_keys, *CUTS]


CUTS = ["__part", "__fine", "__block"]
COUNTS = ["season_count", "game_count", "inning_count"]


def _ordered(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _with_slices(df: DataFrame, c: EventColumns) -> DataFrame:
    """Slice number from the start time. Rows without one sort last and are cut by sequence number."""
    start = F.col(c.start)
    return df.withColumns(
        {
            "__slice": F.floor(F.unix_micros(start) / F.lit(c.slice_seconds * 1_000_000)),
            "__part": F.lit(0).cast("long"),
            "__fine": F.lit(0).cast("long"),
            "__block": F.when(start.isNull(), F.floor(F.col(c.seq) / F.lit(c.seq_block))),
        }
    )


def _cells(rows: DataFrame, c: EventColumns) -> DataFrame:
    return written_once(
        rows.groupBy(*c.slice_keys, c.pitcher, c.inning).agg(
            F.count("*").alias("n"),
            F.max(c.start).alias("last_start"),
        )
    )


def _numbered(counts: DataFrame, keys: Sequence[str], time: str, limit: int, out: str) -> DataFrame:
    """Cut the times of each key into consecutive parts of at most ``limit`` rows; a time with more than half of that is a part of its own, and marked."""
    order = W.partitionBy(*keys).orderBy(time)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    half = max(1, limit // 2)
    marked = counts.withColumns({"__crowded": F.col("n") > half, "__step": F.floor(before / F.lit(half))})
    new = (F.lag("__step").over(order) != F.col("__step")) | F.col("__crowded") | F.lag("__crowded").over(order)
    marked = marked.withColumn("__new", F.coalesce(new, F.lit(True)).cast("long"))
    part = F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn(out, part).select(*keys, time, out, "__crowded")


def _cut_large_slices(
    rows: DataFrame, cells: DataFrame, c: EventColumns
) -> tuple[DataFrame, DataFrame]:
    """Cut slices of more than ``max_slice_rows`` events by their counts per second; a second that is too large by
    its counts per instant; and an instant that is too large into blocks of sequence numbers. All keep the order of events.

    Only the large slices are counted again; there are at most total / ``max_slice_rows`` of them, usually none. A
    slice has at most ``slice_seconds`` seconds, and a second a million instants.
    """
    large = (
        cells.where(F.col("__slice").isNotNull())
        .groupBy(*c.coarse_keys)
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > c.max_slice_rows)
        .drop("n")
    )
    large = written_once(large)
    if large.isEmpty():
        return rows, cells
    spread = F.col(c.seq)
    micros = F.unix_micros(c.start)
    timed = rows.withColumns({"__us": micros, "__second": F.floor(micros / F.lit(1_000_000))})
    inside = join_small(timed, large, c.coarse_keys, spread)
    in_second = [*c.coarse_keys, "__second"]
    seconds = inside.groupBy(*in_second).agg(F.count("*").alias("n"))
    seconds = written_once(_numbered(seconds, c.coarse_keys, "__second", c.max_slice_rows, "__p"))
    crowded = written_once(seconds.where("__crowded").select(*in_second))
    instants = join_small(inside, crowded, in_second, spread).groupBy(*in_second, "__us").agg(F.count("*").alias("n"))
    instants = written_once(_numbered(instants, in_second, "__us", c.max_slice_rows, "__f").withColumnRenamed("__crowded", "__instant"))
    cut = join_small(timed, seconds.select(*in_second, "__p"), in_second, spread, "left")
    cut = join_small(cut, instants, [*in_second, "__us"], spread, "left")
    block = F.floor(F.col(c.seq) / F.lit(min(c.seq_block, c.max_slice_rows)))
    rows = cut.withColumns(
        {
            "__part": F.coalesce("__p", "__part"),
            "__fine": F.coalesce("__f", "__fine"),
            "__block": F.when(F.col("__instant"), block).otherwise(F.col("__block")),
        }
    ).drop("__us", "__second", "__p", "__f", "__instant")
    return rows, _cells(rows, c)


def _preceding(n: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    w = W.partitionBy(*keys).orderBy(*_ordered(*order)).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def running_start(
    cells: DataFrame, n: str, keys: Sequence[str], levels: Sequence[Sequence[str]], out: str
) -> DataFrame:
    """Total of ``n`` before each cell, per key, in the order of ``levels`` (coarse to fine).

    Each level is summed within its parent only, so no window holds more than the children of one parent.
    """
    order = [name for level in levels for name in level]
    if len(levels) == 1:
        return cells.withColumn(out, _preceding(n, keys, order))
    coarse = levels[:-1]
    coarse_keys = [name for level in coarse for name in level]
    parent = f"__parent{len(coarse)}"
    totals = cells.groupBy(*keys, *coarse_keys).agg(F.sum(n).alias(n))
    parents = running_start(totals, n, keys, coarse, parent).drop(n)
    parents = parents.withColumnsRenamed({k: f"__p_{k}" for k in [*keys, *coarse_keys]})
    within = cells.withColumn("__within", _preceding(n, [*keys, *coarse_keys], levels[-1]))
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in [*keys, *coarse_keys]]
    )
    return (
        within.join(parents, match)
        .withColumn(out, F.col(parent) + F.col("__within"))
        .drop(parent, "__within", *[f"__p_{k}" for k in [*keys, *coarse_keys]])
    )


def _count_starts(cells: DataFrame, c: EventColumns) -> list[DataFrame]:
    """Rows carrying the counts with which a slice begins."""
    in_game = [c.date, "__slice", *CUTS]
    per_pitcher = (
        cells.groupBy(*c.slice_keys, c.pitcher)
        .agg(F.sum("n").alias("n"))
        .withColumn("game_count", _preceding("n", [c.season, c.game, c.pitcher], in_game))
    )
    season = running_start(
        per_pitcher.where(F.col(c.pitcher).isNotNull()).withColumn(
            "__games", F.floor(F.col(c.game) / F.lit(c.game_block))
        ),
        "n",
        [c.season, c.pitcher],
        [[c.date], ["__games"], [c.game, "__slice", *CUTS]],
        "season_count",
    )
    inning = cells.withColumn(
        "inning_count", _preceding("n", [c.season, c.game, c.pitcher, c.inning], in_game)
    )
    starts = [
        per_pitcher.select(*c.slice_keys, c.pitcher, "game_count"),
        season.select(*c.slice_keys, c.pitcher, "season_count"),
        inning.select(*c.slice_keys, c.pitcher, c.inning, "inning_count"),
    ]
    return [start.withColumn("__kind", F.lit(0)) for start in starts]


def _gap_starts(cells: DataFrame, c: EventColumns) -> DataFrame:
    """One row per slice with the start time of the last pitch before it in the same game."""
    last = W.partitionBy(c.season, c.game).orderBy(*_ordered(c.date, "__slice", *CUTS))
    return (
        cells.groupBy(*c.slice_keys)
        .agg(F.max("last_start").alias("last_start"))
        .select(*c.slice_keys, F.lag("last_start").over(last).alias(c.start), F.lit(1).alias("__kind"))
    )


def _season_gap_starts(cells: DataFrame, c: EventColumns) -> DataFrame:
    """One row per slice with the start time of the last pitch before it in the whole season.

    The last start is carried down levels: a date's first game takes it from the date before, a game's first slice from the
    game before, and every other child from its neighbour. So a window holds the dates of a season, the games of a date, or the slices of a game on a date.
    """
    levels = [[c.season], [c.date], [c.game], ["__slice", *CUTS]]
    level = cells.groupBy(*c.slice_keys).agg(F.max("last_start").alias("last_start"))
    tables = [level]
    for depth in (2, 1):  # the last slice of each game of a date, then of each date
        keys = [k for part in levels[: depth + 1] for k in part]
        ends = W.partitionBy(*keys).orderBy(*[F.col(k).desc_nulls_first() for k in levels[depth + 1]])
        level = level.withColumn("__n", F.row_number().over(ends)).where(F.col("__n") == 1).select(*keys, "last_start")
        tables.insert(0, level)
    carried = None
    for depth, table in enumerate(tables, 1):
        parent, order = [k for part in levels[:depth] for k in part], levels[depth]
        within = W.partitionBy(*parent).orderBy(*_ordered(*order))
        # The first child has no neighbour; others take their neighbour's value even where that is missing.
        table = table.withColumns({"__first": F.row_number().over(within) == 1, "__before": F.lag("last_start").over(within)})
        if carried is not None:
            above = carried.select(*[F.col(k).alias(f"__p_{k}") for k in parent], F.col("__before").alias("__above"))
            match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in parent])
            table = table.join(above, match).withColumn("__before", F.when(F.col("__first"), F.col("__above")).otherwise(F.col("__before")))
            table = table.drop("__above", *[f"__p_{k}" for k in parent])
        carried = table.drop("__first")
    return carried.select(*c.slice_keys, F.col("__before").alias(c.start), F.lit(1).alias("__kind"))


def enrich(
    df: DataFrame, c: EventColumns = EventColumns(), counts: bool = True, gap: str | None = "pitch_tempo", lag_scope: str = "game"
) -> DataFrame:
    """Add running pitch counts and the seconds since the previous pitch.

    Order within a season is date, game, start time (missing last), sequence number. The season count is
    null for an unnamed pitcher, game and inning counts treat unnamed pitchers as one. The gap is null on
    a pitcher's first pitch of an inning, and everything is null on rows that are not pitches. A game
    resumed on a later date gets the gap to that game's own previous pitch; with ``lag_scope="season"``, to the
    previous pitch of the season, of whichever game, as the published table has it.

    With ``counts=False`` the table must already hold ``inning_count``.
    """
    if lag_scope not in ("game", "season"):
        raise ValueError("lag_scope is 'game' or 'season'")
    is_pitch = F.col(c.is_pitch)
    pitches = _with_slices(df.where(is_pitch), c)
    pitches, cells = _cut_large_slices(pitches, _cells(pitches, c), c)
    rows = pitches.withColumn("__kind", F.lit(2))
    starts = []
    if counts:
        rows = rows.withColumns({name: F.lit(1).cast("long") for name in COUNTS})
        starts += _count_starts(cells, c)
    if gap:
        starts.append(_gap_starts(cells, c) if lag_scope == "game" else _season_gap_starts(cells, c))
    carried = written_once(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), starts))
    rows = rows.unionByName(carried, allowMissingColumns=True).repartition(*c.slice_keys)

    def window(*keys: str):
        return W.partitionBy(*c.slice_keys, *keys).orderBy("__kind", *_ordered(c.start, c.seq))

    if gap:
        rows = rows.withColumn(gap, gap_seconds(c.start, F.lag(c.start).over(window())))
    if counts:

        def running(name: str, *keys: str) -> Column:
            upto = window(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
            return F.sum(F.coalesce(F.col(name), F.lit(0).cast("long"))).over(upto)

        rows = rows.withColumns(
            {
                "season_count": running("season_count", c.pitcher),
                "game_count": running("game_count", c.pitcher),
                "inning_count": running("inning_count", c.pitcher, c.inning),
            }
        )
    done = rows.where(F.col("__kind") == 2)
    if counts:
        done = done.withColumn("season_count", F.when(F.col(c.pitcher).isNotNull(), F.col("season_count")))
    if gap:
        done = done.withColumn(gap, F.when(F.col("inning_count") != 1, F.col(gap)))
    done = done.drop("__kind", "__slice", *CUTS)
    return done.unionByName(df.where(~is_pitch | is_pitch.isNull()), allowMissingColumns=True)


def running_counts(df: DataFrame, c: EventColumns = EventColumns()) -> DataFrame:
    """Season, game and inning running pitch counts per pitcher."""
    return enrich(df, c, counts=True, gap=None)


def add_gap(df: DataFrame, c: EventColumns = EventColumns(), name: str = "pitch_tempo", lag_scope: str = "game") -> DataFrame:
    """Seconds since the previous pitch of the game, or of the season; needs ``inning_count``."""
    return enrich(df, c, counts=False, gap=name, lag_scope=lag_scope)


def attach_by_id(
    df: DataFrame, derived: DataFrame, key: str, null_ids: str = "error", max_null_pairs: int | None = None, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Left-join a derived per-event frame back on an event id; a repeated id multiplies rows.

    By default derived rows must have an id: a missing one would pair with every row that has none. The windows above
    need no such join; this one is for frames derived elsewhere. ``null_ids="match"`` lets missing ids match missing
    ids. The pairs that this makes are counted first, and more than ``max_null_pairs``, where that is given, are an error. Both sides are dealt over a grid of
    tasks by a hash of their rows, so that no task holds all rows without an id nor makes many more than ``rows_per_task`` pairs.
    """
    if null_ids not in ("error", "match"):
        raise ValueError("null_ids is 'error' or 'match'")
    with_id, without = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    if null_ids == "error":
        checked = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"derived row without {key}")))
        named = derived.withColumn("__id", checked).drop(key)
    else:
        named = derived.where(F.col(key).isNotNull()).withColumnRenamed(key, "__id")
    joined = with_id.join(named, with_id[key] == F.col("__id"), "left").drop("__id")
    if null_ids == "error":
        return joined.unionByName(without, allowMissingColumns=True)
    loose = derived.where(F.col(key).isNull()).drop(key)
    n, m = without.count(), loose.count()
    if max_null_pairs is not None and n * m > max_null_pairs:
        raise ValueError(f"{n} rows without {key} and {m} derived ones make {n * m} pairs, more than {max_null_pairs}")
    if not m:
        return joined.unionByName(without, allowMissingColumns=True)
    cells = -(-n * m // rows_per_task)
    # Of cells tasks, so many rows and columns that a cell is about square; rows are repeated for each column and the other way round.
    down = max(1, min(cells, round((cells * n / m) ** 0.5))) if n else 1
    across = -(-cells // down) if cells else 1

    def grid(side: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(own_n))
        return side.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))))

    pairs = grid(without, "__row", down, "__column", across).join(grid(loose, "__column", across, "__row", down), ["__row", "__column"])
    return joined.unionByName(pairs.drop("__row", "__column"))
