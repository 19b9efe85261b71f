import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceshift.operators.sequence import EventColumns, _cells, _cut_large_slices, _with_slices, add_gap, attach_by_id, enrich, running_counts

SCHEMA = (
    "ingest_seq BIGINT, year INT, game_pk BIGINT, game_date DATE, start_time TIMESTAMP, play_id STRING, "
    "is_pitch BOOLEAN, inning INT, pitcher_name STRING"
)


def at(day, clock):
    return dt.datetime.fromisoformat(f"2023-04-0{day} {clock}") if clock else None


def event(seq, game, day, clock, play, pitch, inning, pitcher):
    return (seq, 2023, game, dt.date(2023, 4, day), at(day, clock), play, pitch, inning, pitcher)


MINI = [
    (event(1, 1, 1, "19:00:00", "p1", True, 1, "A"), (1, 1, 1, None)),
    (event(2, 1, 1, "19:00:20", "p2", True, 1, "A"), (2, 2, 2, 20.0)),
    (event(3, 1, 1, "19:00:25", "x1", False, 1, "A"), (None, None, None, None)),
    (event(4, 1, 1, "19:00:45", "p3", True, 1, "A"), (3, 3, 3, 25.0)),
    (event(5, 1, 1, "19:05:00", "p4", True, 1, "B"), (1, 1, 1, None)),
    (event(6, 1, 1, "19:05:18.500000", "p5", True, 1, "B"), (2, 2, 2, 18.5)),
    (event(7, 1, 1, "19:10:00", "p6", True, 2, "A"), (4, 4, 1, None)),
    (event(8, 1, 1, "19:10:00", "p7", True, 2, "A"), (5, 5, 2, 0.0)),
    (event(9, 2, 2, "19:00:00", "p8", True, 1, "A"), (6, 1, 1, None)),
    (event(10, 2, 2, "19:03:10", "p9", True, 1, "A"), (7, 2, 2, 190.0)),
    (event(11, 2, 2, "19:04:00", "p10", True, 1, None), (None, 1, 1, None)),
    (event(12, 2, 2, None, "p11", True, 1, "A"), (8, 3, 3, None)),
]

GRAINS = [
    EventColumns(),
    EventColumns(slice_seconds=30, seq_block=2, game_block=1),
    EventColumns(slice_seconds=7, seq_block=1, game_block=3),
    EventColumns(slice_seconds=7200, max_slice_rows=4),
    EventColumns(slice_seconds=600, max_slice_rows=1, seq_block=3),
]


def result(df, gap=True):
    names = ["season_count", "game_count", "inning_count"] + (["pitch_tempo"] if gap else [])
    return {r["ingest_seq"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("columns", GRAINS)
def test_hand_computed_table(spark, columns):
    rows = spark.createDataFrame([e for e, _ in MINI], SCHEMA).repartition(4)
    out = enrich(rows, columns)
    assert result(out) == {e[0]: want for e, want in MINI}
    assert not [c for c in out.columns if c.startswith("__")]


def plain(df, lag_scope="game"):
    """The definition, with whole-season and whole-game windows."""
    order = [F.col("game_date"), F.asc_nulls_last("start_time"), F.col("ingest_seq")]
    pitches = df.where("is_pitch")

    def number(*keys, season=False):
        by = [F.col("game_date"), F.col("game_pk"), *order[1:]] if season else order
        return F.row_number().over(W.partitionBy("year", *keys).orderBy(*by))

    scope = {"game": W.partitionBy("year", "game_pk").orderBy(*order), "season": W.partitionBy("year").orderBy("game_date", "game_pk", *order[1:])}
    last = F.lag("start_time").over(scope[lag_scope])
    out = pitches.select(
        "*",
        F.when(F.col("pitcher_name").isNotNull(), number("pitcher_name", season=True)).alias("season_count"),
        number("pitcher_name", "game_pk").alias("game_count"),
        number("pitcher_name", "game_pk", "inning").alias("inning_count"),
        ((F.unix_micros("start_time") - F.unix_micros(last)) / 1e6).alias("gap"),
    ).withColumn("pitch_tempo", F.when(F.col("inning_count") != 1, F.col("gap")))
    return out.drop("gap").unionByName(df.where("not is_pitch or is_pitch is null"), allowMissingColumns=True)


def random_events(seed, n, instants=9000):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        hot = rng.random() < 0.4
        day = rng.randrange(1, 5)
        game = 7 if hot else rng.randrange(1, 20)
        clock = dt.datetime(2023, 4, day, 18) + dt.timedelta(seconds=rng.randrange(0, instants))
        rows.append(
            (
                seq,
                rng.choice([2022, 2023]),
                game,
                dt.date(2023, 4, day),
                None if rng.random() < 0.1 else clock,
                f"p{seq}",
                rng.choice([True, True, True, False, None]),
                rng.randrange(1, 4),
                None if rng.random() < 0.1 else ("hot" if hot else rng.choice("ABC")),
            )
        )
    return rows


@pytest.mark.parametrize("seed,columns", list(enumerate(GRAINS)))
def test_same_as_plain_windows_on_skewed_random_events(spark, seed, columns):
    rows = spark.createDataFrame(random_events(seed, 600), SCHEMA).repartition(5)
    assert result(enrich(rows, columns)) == result(plain(rows))


@pytest.mark.parametrize("seed,columns", list(enumerate(GRAINS)))
def test_season_wide_lag_is_carried_over_games_and_dates(spark, seed, columns):
    rows = spark.createDataFrame(random_events(seed + 50, 500), SCHEMA).repartition(5)
    got = result(enrich(rows, columns, lag_scope="season"))
    assert got == result(plain(rows, "season")) and got != result(plain(rows))
    plan = enrich(rows, columns, lag_scope="season")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("columns", GRAINS[3:])
def test_slice_that_holds_one_instant_is_cut_by_sequence(spark, columns):
    rows = spark.createDataFrame(random_events(11, 400, instants=2), SCHEMA).repartition(3)
    assert result(enrich(rows, columns)) == result(plain(rows))


def test_crowded_instant_with_a_straggler_is_cut(spark):
    """Most events in one second, some of them in one instant, and one event half a minute later."""
    start = dt.datetime(2023, 4, 1, 19)
    times = [start] * 3000 + [start + dt.timedelta(microseconds=7 * i) for i in range(3000)] + [start + dt.timedelta(seconds=30)]
    rows = [(i, 2023, 1, start.date(), t, f"p{i}", True, 1, "A") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, SCHEMA)
    c = EventColumns(max_slice_rows=500)
    assert result(enrich(df, c)) == result(plain(df))
    pitches = _with_slices(df, c)
    cut, _ = _cut_large_slices(pitches, _cells(pitches, c), c)
    assert cut.count() == 6001 and cut.groupBy(*c.slice_keys).count().agg(F.max("count")).first()[0] <= 500


def test_counts_and_gap_can_be_added_one_after_the_other(spark):
    rows = spark.createDataFrame(random_events(9, 300), SCHEMA)
    counted = running_counts(rows)
    assert "pitch_tempo" not in counted.columns
    assert result(add_gap(counted)) == result(enrich(rows))


def test_game_resumed_on_a_later_date_continues_its_counts(spark):
    rows = [
        event(1, 1, 1, "19:00:00", "a", True, 1, "A"),
        event(2, 2, 2, "12:00:00", "b", True, 1, "A"),
        event(3, 1, 3, "12:00:00", "c", True, 1, "A"),
    ]
    out = result(enrich(spark.createDataFrame(rows, SCHEMA)))
    assert out[3] == (3, 2, 2, 2 * 86400.0 - 7 * 3600.0)


def test_counts_are_dense(spark):
    out = enrich(spark.createDataFrame(random_events(3, 400), SCHEMA)).where("is_pitch")
    bad = out.groupBy("year", "pitcher_name", "game_pk", "inning").agg(
        F.max("inning_count").alias("top"), F.countDistinct("inning_count").alias("d"), F.count("*").alias("n")
    )
    assert bad.where("top <> n or d <> n").count() == 0


def test_events_are_shuffled_once(spark):
    rows = spark.createDataFrame(random_events(4, 50), SCHEMA).withColumn("payload", F.lit("x"))
    plan = enrich(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join LeftOuter" not in plan


def test_attach_by_id(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "play_id STRING, x INT")
    right = spark.createDataFrame([("a", 10), ("a", 11)], "play_id STRING, y INT")
    got = sorted(attach_by_id(left, right, "play_id").collect(), key=str)
    assert sorted([(r.play_id, r.x, r.y) for r in got], key=str) == sorted(
        [("a", 1, 10), ("a", 1, 11), ("b", 2, None), (None, 3, None)], key=str
    )
    unnamed = spark.createDataFrame([(None, 1)], "play_id STRING, y INT")
    with pytest.raises(Exception, match="derived row without play_id"):
        attach_by_id(left, unnamed, "play_id").collect()


@pytest.mark.parametrize("per_task", [1, 7, 10_000])
def test_missing_ids_match_missing_ids_where_asked(spark, per_task):
    left = [(None if i % 3 == 0 else f"k{i % 7}", i) for i in range(60)]
    right = [(None if i % 4 == 0 else f"k{i % 9}", i) for i in range(40)]
    a, b = spark.createDataFrame(left, "play_id STRING, x INT"), spark.createDataFrame(right, "play_id STRING, y INT")
    got = sorted((r.play_id or "", r.x, r.y or -1) for r in attach_by_id(a, b, "play_id", null_ids="match", rows_per_task=per_task).collect())
    want = [(k or "", x, y or -1) for k, x in left for y in ([y for j, y in right if j == k] or [None])]
    assert got == sorted(want)
    only = sorted((r.x, r.y) for r in attach_by_id(a, b.where("play_id IS NOT NULL"), "play_id", null_ids="match").where("play_id IS NULL").collect())
    assert only == [(x, None) for k, x in left if k is None]
    with pytest.raises(ValueError, match="make 200 pairs, more than 199"):
        attach_by_id(a, b, "play_id", null_ids="match", max_null_pairs=199)


def test_pairs_of_missing_ids_have_no_limit_unless_one_is_given(spark):
    a = spark.range(10_001).selectExpr("cast(null AS string) AS play_id", "id AS x")
    b = spark.range(10_000).selectExpr("cast(null AS string) AS play_id", "id AS y")
    assert attach_by_id(a, b, "play_id", null_ids="match").count() == 100_010_000
