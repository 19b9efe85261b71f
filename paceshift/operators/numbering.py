"""Numbers along a global order, without a window over the whole table.

Rows are dealt into ranges of the order, numbered within each range, and the sizes of the ranges before are added: a
row for each range is all that meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import col
from .reuse import SALTS, join_small, written_once


def running_total(rows: DataFrame, order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """The total of ``amount`` over all rows before each, in the order of the columns ``order`` (missing last), which must tell rows apart.

    Rows are sorted by range; equal leading columns alone don't make a range large, as all columns of the order cut it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = rows.repartitionByRange(parts, *by).withColumns({"__amount": amount, "__range": F.spark_partition_id()})
    dealt = written_once(dealt)
    sums = dealt.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    # As many rows as there are ranges.
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    within = F.coalesce(F.sum("__amount").over(W.partitionBy("__range").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = dealt.withColumn("__within", within).join(F.broadcast(before), "__range")
    return summed.withColumn(out, (F.col("__earlier") + F.col("__within")).cast("long")).drop("__range", "__amount", "__within", "__earlier")


def group_numbers(df: DataFrame, keys: Sequence[str], out: str = "group_number", broadcast_rows: int | None = None) -> DataFrame:
    """Number the groups of ``keys`` from 1 in the order of their keys; a missing key is a group of its own and comes last.

    The same as a dense rank over the whole table. Only the distinct keys are sorted, and rows are joined with their
    group's number; a group that holds most rows is split by a hash of the row where the numbers can't be broadcast.
    """
    distinct = df.select(*keys).distinct()
    numbered = running_total(distinct, keys, F.lit(1), "__before").withColumn(out, F.col("__before") + 1).drop("__before")
    options = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    return join_small(df, written_once(numbered), list(keys), F.xxhash64(*df.columns), salts=SALTS, **options)


def rank_descending(df: DataFrame, value: str, out: str = "position", window_rows: int = 10_000) -> DataFrame:
    """Rank by ``value`` from the largest, ties sharing the better rank, missing last.

    A table that was counted to have at most ``window_rows`` rows is ranked by one window. A larger one through its distinct values: each
    value's rank is one more than the rows of the values above.
    """
    if df.limit(window_rows + 1).count() <= window_rows:
        return df.withColumn(out, F.rank().over(W.orderBy(F.col(value).desc_nulls_last())).cast("long"))
    counts = df.groupBy(value).agg(F.count("*").alias("__n")).withColumn("__down", -F.col(value))
    above = running_total(counts, ["__down"], F.col("__n"), out).select(value, (F.col(out) + 1).alias(out))
    return join_small(df, written_once(above), [value], F.xxhash64(*df.columns))


def split_order(df: DataFrame, file: str | Column, start: str | Column, out: str = "ingest_seq") -> DataFrame:
    """Number the rows of a file scan densely from 0 in file order: by path, then place in the file.

    ``file`` and ``start`` say which split of which file a row comes from. A split's rows are read one after another by one task, so their
    place in it is known there; the rows of the splits before are counted in a first pass over the files. The numbers do not depend on how files are
    split, on the order of tasks, or on a task being run again. Both passes must use the same split size.
    """
    tagged = df.withColumns({"__file": col(file), "__start": col(start), "__at": F.monotonically_increasing_id()})
    splits = tagged.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = running_total(splits, ["__file", "__start"], F.col("__n"), "__before").drop("__n")
    placed = join_small(tagged, written_once(before), ["__file", "__start"], F.col("__at"))
    return placed.withColumn(out, F.col("__before") + F.col("__at") - F.col("__first")).drop("__file", "__start", "__at", "__before", "__first")
