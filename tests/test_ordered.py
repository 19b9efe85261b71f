import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from paceshift.operators.ordered import exact_median, exact_quantiles
from paceshift.operators.reuse import join_small
from paceshift.operators.topk import bottom_k, extreme_k, top_k


def groups(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.05 else rng.choice([rng.gauss(0, 50), float(rng.randrange(-3, 4)), 1e9 * rng.random()])
        rows.append((key, value))
    rows += [("one", 5.5), ("empty", None), ("empty", math.nan)]
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quantiles_match_numpy(spark, seed):
    rows = groups(seed)
    probs = {"q1": 0.25, "q2": 0.5, "q9": 0.9, "top": 1.0}
    got = {
        r["k"]: [r[p] for p in probs]
        for r in exact_quantiles(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v", probs).collect()
    }
    assert set(got) == {k for k, v in rows if k != "empty"}
    for key, values in got.items():
        sample = [v for k, v in rows if k == key and v is not None]
        assert values == pytest.approx(list(np.quantile(sample, list(probs.values()))), rel=1e-12)


def test_median_agrees_with_the_built_in(spark):
    df = spark.createDataFrame(groups(5), "k STRING, v DOUBLE")
    mine = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    built_in = {r.k: r.m for r in df.where("NOT isnan(v)").groupBy("k").agg({"v": "median"}).toDF("k", "m").collect() if r.m is not None}
    assert mine == pytest.approx(built_in)


def test_quantiles_of_the_whole_table(spark):
    df = spark.range(101).selectExpr("cast(id AS double) AS v")
    assert exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.905}).collect()[0][1:] == (50.0, pytest.approx(90.5))


def test_ties_at_the_edge_are_kept(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 8.0, 8.0, 8.0, 7.0, None])], "i INT, v DOUBLE")
    assert {r.i for r in top_k(df, "v", 2).collect()} == {0, 1, 2, 3}
    assert {r.i for r in bottom_k(df, "v", 1).collect()} == {4}


def test_missing_values_fill_up_only_when_needed(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, None, None])], "i INT, v DOUBLE")
    assert {r.i for r in top_k(df, "v", 2).collect()} == {0, 1}
    assert {r.i for r in top_k(df, "v", 3).collect()} == {0, 1, 2, 3}
    assert extreme_k(df.limit(0), "v", 3).count() == 0


def test_tied_rows_do_not_meet_in_one_task(spark):
    plan = top_k(spark.range(100), "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("max_values", [1, 3, 50])
def test_crowded_cells_are_cut(spark, max_values):
    rng = random.Random(4)
    rows = [("near", 93.0 + rng.random() * 1e-3) for _ in range(400)] + [("wide", rng.gauss(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    probs = {"a": 0.1, "b": 0.5, "c": 0.77}
    for r in exact_quantiles(df, ["k"], "v", probs, max_rows=max_values).collect():
        sample = [v for k, v in rows if k == r.k]
        assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(sample, list(probs.values()))), rel=1e-12)


def test_join_with_a_side_too_large_to_broadcast(spark):
    big = spark.createDataFrame([(i % 3 or None, i) for i in range(300)], "k INT, v INT")
    small = spark.createDataFrame([(1, "a"), (None, "b"), (9, "c")], "k INT, w STRING")
    for how, n in (("inner", 200), ("left", 300)):
        broadcast = join_small(big, small, ["k"], F.col("v"), how)
        salted = join_small(big, small, ["k"], F.col("v"), how, broadcast_rows=2)
        plain = join_small(big, small, ["k"], F.col("v"), how, small_rows=3, broadcast_rows=2, salts=1)
        assert broadcast.columns == salted.columns == plain.columns == ["k", "v", "w"]
        assert sorted(map(str, plain.collect())) == sorted(map(str, broadcast.collect()))
        assert sorted(map(str, broadcast.collect())) == sorted(map(str, salted.collect())) and salted.count() == n
    plan = join_small(big, small, ["k"], F.col("v"), broadcast_rows=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "__j_salt" in plan


def test_a_mass_of_equal_values_needs_no_cut(spark):
    df = spark.createDataFrame([(1, 5.0)] * 3000 + [(1, float(i)) for i in range(10)], "k INT, v DOUBLE")
    got = exact_quantiles(df, ["k"], "v", {"m": 0.5, "top": 1.0}, max_rows=10).collect()
    assert [tuple(r) for r in got] == [(1, 3010, 5.0, 9.0)]
