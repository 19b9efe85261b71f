"""Data behind histograms and density curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import GAUSS_NORM, cell_counts, exact_quantiles, nrd0
from .reuse import join_small, written_once


def histogram(
    df: DataFrame, value: str, low: float, high: float, width: float = 1.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts in right-closed bins centred on multiples of the width; values outside the limits are dropped.

    The two outermost bins reach beyond the limits, and a plot leaves them out: ``is_edge`` marks them.
    """
    v = F.col(value)
    centre = F.ceil(v / F.lit(float(width)) - F.lit(0.5)) * F.lit(float(width))
    binned = df.where(v.between(low, high)).groupBy(*keys, centre.cast("double").alias("bin"))
    half = width / 2.0
    return binned.agg(F.count("*").alias("n")).withColumn(
        "is_edge", (F.col("bin") - half < low) | (F.col("bin") + half > high)
    )


def kernel_density(
    df: DataFrame,
    value: str,
    low: float,
    high: float,
    keys: Sequence[str],
    points: int = 512,
    lattice: int = 512,
) -> DataFrame:
    """Gaussian kernel density per key on ``points`` positions from ``low`` to ``high``.

    The mass of each group is spread linearly over a fixed lattice that reaches four bandwidths beyond the
    limits, smoothed there, and interpolated. The rows are read three times (cells, quartile cells, lattice) and not
    shuffled: each group shrinks to at most ``lattice`` weights before anything is gathered, and the smoothing costs the same for a thousand rows and for a trillion.
    """
    if not keys:
        raise ValueError("a density needs at least one grouping key")
    keys = list(keys)
    rows = df.where(F.col(value).between(low, high)).select(*keys, F.col(value).cast("double").alias("value"))
    centre = (low + high) / 2.0
    shifted = F.col("value") - F.lit(centre)
    cells = written_once(cell_counts(rows, keys, "value", s1=F.sum(shifted), s2=F.sum(shifted * shifted)))
    moments = cells.groupBy(*keys).agg(F.sum("in_cell").alias("__n"), F.sum("s1").alias("__s1"), F.sum("s2").alias("__s2"))
    quartiles = exact_quantiles(rows, keys, "value", {"q1": 0.25, "q3": 0.75}, cells)
    quartiles = quartiles.drop("n").withColumnsRenamed({k: f"__q_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys])
    n = F.col("__n")
    variance = (F.col("__s2") - F.col("__s1") * F.col("__s1") / n) / (n - 1)
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    mean = F.lit(centre) + F.col("__s1") / n
    width = nrd0(sd, F.col("q3") - F.col("q1"), n, mean)
    spread = written_once(moments.where(n > 1).join(quartiles, same).select(*keys, n, width.alias("bw")))
    start = F.lit(low) - 4.0 * F.col("bw")
    step = (F.lit(high - low) + 8.0 * F.col("bw")) / F.lit(lattice - 1)
    placed = join_small(rows, spread, keys, F.col("value"))
    placed = placed.withColumn("__at", (F.col("value") - start) / step)
    share = F.col("__at") - F.floor("__at")
    # Each row adds to the two lattice points around it: one sum for each point, combined where the rows are read.
    sums = placed.groupBy(*keys, n, "bw", F.floor("__at").cast("int").alias("j")).agg(F.sum((1.0 - share) / n).alias("w0"), F.sum(share / n).alias("w1"))
    both = F.array(F.struct(F.col("j"), F.col("w0").alias("w")), F.struct((F.col("j") + 1).alias("j"), F.col("w1").alias("w")))
    weights = sums.select(*keys, n, "bw", F.explode(both).alias("p")).groupBy(*keys, "__n", "bw", "p.j").agg(F.sum("p.w").alias("w"))
    # At most `lattice` + 1 elements per group, whatever its number of rows.
    gathered = weights.groupBy(*keys, "__n", "bw").agg(
        F.sort_array(F.collect_list(F.struct("j", "w"))).alias("cells")
    )

    def smooth(k: Column) -> Column:
        def add(total: Column, cell: Column) -> Column:
            z = (k - cell["j"]) * step / F.col("bw")
            return total + cell["w"] * F.exp(F.lit(-0.5) * z * z)

        return F.aggregate(F.col("cells"), F.lit(0.0), add) * F.lit(GAUSS_NORM) / F.col("bw")

    # Spread again, as a few groups would otherwise be smoothed in a few tasks.
    at_points = gathered.select(
        *keys, "__n", "bw", "cells", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    ).repartition(*keys, "i")
    x = F.lit(low) + F.col("i") * F.lit((high - low) / (points - 1))
    located = at_points.withColumn("x", x).withColumn("__at", (F.col("x") - start) / step)
    located = located.withColumn("__k", F.least(F.floor("__at"), F.lit(lattice - 2)))
    here, there = smooth(F.col("__k")), smooth(F.col("__k") + 1)
    part = F.col("__at") - F.col("__k")
    return located.select(
        *keys, F.col("i"), "x", ((1.0 - part) * here + part * there).alias("density"), F.col("__n").alias("n"), "bw"
    )
