import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceshift.functions import scalars as S
from paceshift.operators import profile, reshape
from paceshift.operators.cohort import qualified_keys, qualify
from paceshift.operators.periods import by_period, change, spread


def test_ranges(spark):
    df = spark.range(1).selectExpr("1 AS a", "2 AS b", "3 AS c", "4 AS d", "5 AS e")
    assert reshape.select_ranges(df, ("a", "b"), "e", ("d", "e")).columns == ["a", "b", "e", "d"]
    assert reshape.drop_ranges(df, ("b", "d")).columns == ["a", "e"]
    assert reshape.relocate(df, ["d", "e"], before="b").columns == ["a", "d", "e", "b", "c"]
    assert reshape.relocate(df, ["a"], after="c").columns == ["b", "c", "a", "d", "e"]
    assert reshape.relocate(df, ["e"]).columns == ["e", "a", "b", "c", "d"]


def test_seasons_are_completed_with_typed_nulls(spark):
    old = spark.createDataFrame([(1, "x")], "id BIGINT, name STRING")
    new = spark.createDataFrame([("y", 2, 7)], "name STRING, id BIGINT, violation BIGINT")
    both = reshape.union_seasons([old, new], new.schema)
    assert both.schema["violation"].dataType == T.LongType()
    assert {tuple(r) for r in both.collect()} == {("x", 1, None), ("y", 2, 7)}
    with pytest.raises(ValueError, match="violation"):
        reshape.union_seasons([old, new])


def test_no_season_loses_a_column(spark):
    narrow = spark.createDataFrame([(1, "old")], "x INT, old_only STRING")
    wide = spark.createDataFrame([(2, "a", "b")], "x INT, v1 STRING, v2 STRING")
    with pytest.raises(ValueError, match="old_only"):
        reshape.union_seasons([narrow, wide], wide.schema)
    both = reshape.union_seasons([narrow, wide], reshape.all_fields([narrow, wide]))
    assert {tuple(r) for r in both.collect()} == {(1, "old", None, None), (2, None, "a", "b")}
    other = spark.createDataFrame([(3, "c")], "x INT, w STRING")  # as many columns, another name
    with pytest.raises(ValueError, match="old_only.*w|w.*old_only"):
        reshape.union_seasons([narrow, other])
    assert reshape.all_fields([narrow, other]).names == ["x", "old_only", "w"]
    with pytest.raises(ValueError, match="column x"):
        reshape.all_fields([narrow, spark.createDataFrame([("y",)], "x STRING")])


def test_append_row_keeps_the_types(spark):
    df = spark.createDataFrame([("a", 1)], T.StructType([T.StructField("s", T.StringType(), False), T.StructField("n", T.IntegerType(), False)]))
    out = reshape.append_row(df, s="b")
    assert [f.dataType for f in out.schema] == [T.StringType(), T.IntegerType()]
    assert {tuple(r) for r in out.collect()} == {("a", 1), ("b", None)}


def test_split_name(spark):
    df = spark.createDataFrame([("Doe, Jo", 1), (None, 2)], "entity STRING, id INT")
    out = reshape.split_name(df, "entity", ["last", "first"])
    assert out.columns == ["last", "first", "id"]
    assert {tuple(r) for r in out.collect()} == {("Doe", "Jo", 1), (None, None, 2)}
    for bad in ("Doe", "Doe, Jo, Jr."):
        with pytest.raises(Exception, match="expected 2 parts"):
            reshape.split_name(spark.createDataFrame([(bad, 1)], "entity STRING, id INT"), "entity", ["a", "b"]).collect()


def test_two_season_entities(spark):
    from paceshift.plans.cleaning import two_season_entities

    rows = [("Doe, Jo", 1), ("Doe, Jo", 1), ("Roe, Al", 2), ("Doe, Jo", 3)]
    out = two_season_entities(spark.createDataFrame(rows, "entity_name STRING, entity_id BIGINT"))
    assert [tuple(r) for r in out.collect()] == [("Jo Doe", 1)]


def test_rows_with_nulls_and_groups(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, "y"), (2, "y")], "a INT, b STRING")
    assert reshape.complete_rows(df).count() == 2
    assert reshape.complete_rows(df, ["a"]).count() == 3
    assert {tuple(r) for r in reshape.count_groups(df, "a").collect()} == {(1, 1), (None, 1), (2, 2)}
    assert reshape.distinct_keys(df, "b").count() == 3


def test_recode_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x INT")
    assert [r[0] for r in df.select(S.recode(F.col("x") == 1, "one", "other")).collect()] == ["one", "other", None]


def test_scalars(spark):
    row = spark.range(1).select(
        S.relative_change(F.lit(20.0), F.lit(17.0)).alias("r"),
        S.relative_change(F.lit(0.0), F.lit(17.0)).alias("r0"),
        S.percent_text(F.lit(-0.1534)).alias("p"),
        S.percent_text(F.lit(None).cast("double")).alias("p0"),
        S.round_to(F.lit(2.675), 2).alias("up"),
        S.round_to(F.lit(1e13), 6).alias("large"),
        S.round_to(F.lit(2.4999995), 0).alias("below"),
        S.round_to(F.lit(float("nan")), 2).alias("nan"),
        S.full_name(F.lit("Jo"), F.lit(None).cast("string")).alias("n"),
    ).collect()[0]
    assert row.r == pytest.approx(-0.15) and row.r0 is None
    assert (row.p, row.p0, row.up, row.n) == ("-15.3%", None, 2.68, None)
    assert (row.large, row.below, row.nan) == (1e13, 2.0, None)
    assert [S.snake_case(c) for c in ("PARKID", "pitchData.startSpeed", "details.type.code", "home_team")] == [
        "parkid", "pitch_data_start_speed", "details_type_code", "home_team",
    ]


def test_year_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp_ntz'2022-05-01 00:00:00' AS ts, 1 AS x").write.parquet(path)
    df = spark.read.parquet(path)
    kept = df.where(S.in_years(df, "ts", 2022, 2022))
    assert kept.count() == 1 and df.where(S.in_years(df, "ts", 2023, 2024)).count() == 0
    assert "GreaterThanOrEqual(ts" in kept._jdf.queryExecution().executedPlan().toString()


def test_profile(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a INT, b STRING, c DOUBLE")
    got = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert got == [("c", 2, 100.0), ("b", 1, 50.0), ("a", 0, 0.0)]
    summary = profile.missing_summary(df, F.col("a") > 1, ["b"]).collect()[0]
    assert tuple(summary) == (2, 3, 1, 1, 0.0)
    other = spark.createDataFrame([("z", 1)], "b STRING, a BIGINT")
    diff = {r.column_name: (r.type_a, r.type_b, r.status, r.n_a, r.n_b) for r in profile.schema_diff(df, other, filled=True).collect()}
    assert diff == {
        "a": ("int", "bigint", "differs", 2, 1),
        "b": ("string", "string", "same", 1, 1),
        "c": ("double", None, "only_a", 0, None),
    }
    plain = profile.schema_diff(df, other)
    assert [tuple(r) for r in plain.collect()] == [("a", "int", "bigint", "differs"), ("b", "string", "string", "same"), ("c", "double", None, "only_a")]
    assert "LogicalRDD" not in plain._jdf.queryExecution().optimizedPlan().toString()  # no scan of either table


def test_sample_does_not_depend_on_the_partitioning(spark):
    a = profile.sample_rows(spark.range(500).repartition(7), 20, ["id"], 1).collect()
    assert len(a) == 20 and a == profile.sample_rows(spark.range(500).coalesce(1), 20, ["id"], 1).collect()
    assert a != profile.sample_rows(spark.range(500), 20, ["id"], 2).collect()


ROWS = [("A", 2022)] * 3 + [("A", 2023)] * 3 + [("B", 2022)] * 5 + [(None, 2022)] * 3 + [(None, 2023)] * 4 + [("C", 2022)] * 3 + [("C", 2023)] * 2


def test_cohort_threshold_is_strict_and_missing_keys_are_a_group(spark):
    df = spark.createDataFrame(ROWS, "k STRING, year INT")
    assert {r.k for r in qualified_keys(df, "k", (2022, 2023), 2).collect()} == {"A", None}
    assert {r.k for r in qualified_keys(df, "k", (2022, 2023), 3).collect()} == set()
    assert qualify(df, "k", (2022, 2023), 2).groupBy("k").count().count() == 2
    assert {r.k for r in qualify(df, "k", (2022, 2023), 2, null_safe=False).collect()} == {"A"}


def test_cohort_condition_and_population(spark):
    df = spark.createDataFrame(ROWS, "k STRING, year INT").withColumn("code", F.when(F.col("k") == "A", "FC").otherwise("FF"))
    some = df.where("year = 2022")
    kept = qualify(some, "k", (2022, 2023), 1, F.col("code") == "FF", population=df)
    assert sorted({(r.k, r.year) for r in kept.collect()}, key=str) == [("C", 2022), (None, 2022)]
    assert qualify(some, "k", (2022, 2023), 1).count() == 0


def test_one_pass_comparison_equals_group_and_pivot(spark):
    df = spark.range(400).selectExpr("id % 7 AS k", "CAST(2022 + id % 2 AS INT) AS year", "IF(id % 5 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    mine = by_period(df, ["k"], {"m": (F.avg, "v"), "n": (F.count, F.lit(1))}, (2022, 2023)).withColumn("d", change("m", (2022, 2023)))
    assert mine.columns == ["k", "m_2022", "m_2023", "n_2022", "n_2023", "d"]
    pivot = [list(r) for r in df.groupBy("k").pivot("year", [2022, 2023]).agg(F.avg("v")).orderBy("k").collect()]
    long = df.groupBy("k", "year").agg(F.avg("v").alias("m"))
    for wide in (mine, spread(long, ["k"], ["m"], (2022, 2023))):
        got = [[r.k, r.m_2022, r.m_2023] for r in wide.orderBy("k").collect()]
        assert [x for row in got for x in row] == pytest.approx([x for row in pivot for x in row])
