import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from paceshift.operators.numbering import group_numbers, rank_descending, running_total, split_order
from paceshift.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_total_in_the_order_of_several_columns(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(7)
    got = {x.i: x.before for x in running_total(df, ["k", "i"], F.col("n"), "before").collect()}
    total, want = 0, {}
    for _, i, n in sorted(rows, key=lambda x: (x[0] is None, x[0] or "", x[1])):
        want[i] = total
        total += n
    assert got == want


@pytest.mark.parametrize("broadcast_rows", [None, 3])
def test_group_numbers_with_a_hot_and_a_missing_key(spark, broadcast_rows):
    r = random.Random(2)
    rows = [(None if i % 7 == 0 else 5 if i % 3 == 0 else r.randint(0, 200), r.choice([None, "x", "y"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, i long")
    out = group_numbers(df, ["a", "b"], broadcast_rows=broadcast_rows)
    order = sorted({x[:2] for x in rows}, key=lambda k: (k[0] is None, k[0] or 0, k[1] is None, k[1] or ""))
    number = {k: n for n, k in enumerate(order, 1)}
    assert {x.i: x.group_number for x in out.collect()} == {i: number[a, b] for a, b, i in rows}
    assert "SinglePartition" not in plan_of(out).split("Range")[0]


def test_group_numbers_of_an_empty_table(spark):
    assert group_numbers(spark.createDataFrame([], "a long"), ["a"]).collect() == []


@pytest.mark.parametrize("window_rows", [10_000, 5])
def test_rank_descending_shares_positions(spark, window_rows):
    r = random.Random(3)
    values = [r.choice([None, *range(8)]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = {x.i: x.position for x in rank_descending(df, "v", window_rows=window_rows).collect()}
    want = {i: 1 + sum(w is not None if v is None else w is not None and w > v for w in values) for i, v in enumerate(values)}
    assert got == want


@pytest.mark.parametrize("split", [200, 1000, 1 << 20])
def test_file_order_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    r = random.Random(4)
    for name, n in (("a", 300), ("b", 1), ("c", 700), ("d", 0)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name},{i},{'x' * r.randint(0, 9)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = spark.read.schema("name string, i long, pad string").csv(str(tmp_path)).select("*", "_metadata.file_path", "_metadata.file_block_start")
        assert split > 1000 or rows.rdd.getNumPartitions() > 4
        got = split_order(rows, "file_path", "file_block_start", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, i) for name, n in (("a", 300), ("b", 1), ("c", 700)) for i in range(n)]
    assert [(x.name, x.i) for x in sorted(got, key=lambda x: x.seq)] == want
    assert [x.seq for x in sorted(got, key=lambda x: x.seq)] == list(range(1001))


def test_raw_events_are_numbered_through_all_files(spark, tmp_path):
    header = ["game_pk", "game_date", "startTime", "isPitch", "about.inning", "matchup.pitcher.fullName"]
    for f in range(3):
        lines = [f"{f},2022-04-0{f + 1},2022-04-0{f + 1}T10:00:{i:02d}Z,true,1,P{i}" for i in range(20)]
        (tmp_path / f"{f}.csv").write_text("\n".join([",".join(header), *lines]) + "\n")
    paths = [str(tmp_path / f"{f}.csv") for f in (2, 0, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        got = sorted((x.ingest_seq, x.game_pk, x.pitcher_name) for x in files.read_raw_events(spark, paths).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(n, f, f"P{i}") for n, (f, i) in enumerate(itertools.product(range(3), range(20)))]
    assert json.dumps(got[0]) == '[0, 0, "P0"]'
