"""Exact order statistics for groups of any size.

``median`` and ``percentile`` keep one map of all distinct values of a group in one task. Here rows are first
counted in coarse, order-preserving cells (combined on the map side). Then only the cells in which a wanted rank lies
are opened, so neither rows nor distinct values are shuffled as a whole, and a key that holds a third of the
table is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reuse import SALTS, join_small, written_once

CELLS_PER_UNIT = 512
MAX_ROWS = 1_000_000
SPLIT = 4096


def value_cell(value: Column, per_unit: int = CELLS_PER_UNIT) -> Column:
    """Monotone map from a double to a bounded set of integers (about 512 cells per e-fold)."""
    return F.signum(value).cast("long") * F.floor(F.log1p(F.abs(value)) * F.lit(float(per_unit)))


def cell_counts(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Rows per (key, cell) with their lowest and highest value, and further aggregates; ``cell`` is null for missing values and NaN.

    All of it combines on the map side: a group has a bounded number of cells, however many values it has.
    """
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumns({"__value": number, "cell": value_cell(number)})
    return rows.groupBy(*keys, "cell").agg(
        F.count("*").alias("in_cell"), F.min("__value").alias("low"), F.max("__value").alias("high"), *[c.alias(n) for n, c in sums.items()]
    )


def _before(total: str, keys: Sequence[str], order: str) -> Column:
    lower = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(lower), F.lit(0))


def _part(value: str = "value") -> Column:
    """Which of SPLIT equal spans of its cell a value is in."""
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return F.coalesce(F.floor((F.col(value) - F.col("low")) / width * F.lit(SPLIT - 1.0)), F.lit(0))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], cells: DataFrame | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Interpolated quantiles (the default rule of R and of SQL percentile_cont) per key, with the number of values ``n``.

    A first pass counts rows per cell (or ``cells`` holds that already, as ``cell_counts`` of the same rows gives it). A
    second pass reads only the rows of the cells that hold a wanted rank; where all of these hold one value each, there is none. As long as one has more than
    ``max_rows`` rows that are not all equal, it is cut into equal spans and counted again. Missing values and NaN are left out.
    """
    keys = list(keys)
    n = F.col("n")

    def position(p: float) -> Column:
        return (n - 1) * F.lit(float(p))

    def ranks(p: float) -> tuple[Column, Column]:
        return F.floor(position(p)), F.ceil(position(p))

    below, in_cell = F.col("below"), F.col("in_cell")
    wanted = reduce(
        lambda a, b: a | b,
        [(r >= below) & (r < below + in_cell) for p in probs.values() for r in ranks(p)],
    )
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, number.alias("value")).where(F.col("value").isNotNull()).withColumn("cell", value_cell(F.col("value")))
    counted = written_once(cell_counts(df, keys, value)) if cells is None else cells
    cells = counted.where(F.col("cell").isNotNull()).select(*keys, "cell", "in_cell", "low", "high")
    cells = cells.withColumns({"below": _before("in_cell", keys, "cell"), "n": F.sum("in_cell").over(W.partitionBy(*keys))})
    known = []
    while True:
        slot = F.row_number().over(W.partitionBy(*keys).orderBy("cell")) - 1
        cells = written_once(cells.where(wanted).withColumn("__slot", slot.cast("long")))
        # Where the lowest and the highest value are one, the cell need not be opened.
        settled = cells.where(F.col("low") == F.col("high"))
        known.append(settled.select(*keys, F.col("low").alias("value"), "n", F.col("below").alias("__start"), (F.col("below") + F.col("in_cell")).alias("__end")))
        cells = cells.where(F.col("low") < F.col("high"))
        n_cells, crowd = cells.agg(F.count("*"), F.max("in_cell")).first()
        if not n_cells:
            break
        crowded = crowd > max_rows
        located = join_small(rows, cells, [*keys, "cell"], F.col("value"), small_rows=n_cells, salts=SALTS if crowded else 1)
        if not crowded:
            break
        # At most two cells for each wanted quantile of a key, so the numbers of their spans stay small.
        finer = located.withColumns({"__part": _part(), "__base": F.col("below")})
        sizes = finer.groupBy(*keys, "__slot", "__part").agg(
            F.count("*").alias("in_cell"), F.min("value").alias("__low"), F.max("value").alias("__high"), F.max("__base").alias("__base"), F.max("n").alias("n")
        )
        number_of = (F.col("__slot") * SPLIT + F.col("__part")).alias("cell")
        cells = sizes.withColumn("below", F.col("__base") + _before("in_cell", [*keys, "__slot"], "__part")).select(
            *keys, number_of, "in_cell", F.col("__low").alias("low"), F.col("__high").alias("high"), "below", "n"
        )
        rows = finer.select(*keys, "value", number_of)
    if n_cells:
        counts = located.groupBy(*keys, "cell", "value").agg(F.count("*").alias("freq"), F.max("below").alias("below"), F.max("n").alias("n"))
        upto = W.partitionBy(*keys, "cell").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
        counts = counts.withColumn("__end", F.col("below") + F.sum("freq").over(upto))
        known.append(counts.select(*keys, "value", "n", (F.col("__end") - F.col("freq")).alias("__start"), "__end"))
    counts = reduce(lambda a, b: a.unionByName(b), known)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), F.col("value")))

    picks = [F.max("n").alias("n")]
    for i, p in enumerate(probs.values()):
        low, high = ranks(p)
        picks += [at(low).alias(f"__low{i}"), at(high).alias(f"__high{i}")]
    found = counts.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        "n",
        *[
            (
                F.col(f"__low{i}")
                + (position(p) - F.floor(position(p))) * (F.col(f"__high{i}") - F.col(f"__low{i}"))
            ).alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key; a key without any value has no row."""
    return exact_quantiles(df, keys, value, {name: 0.5}).drop("n")


def nrd0(sd: Column, iqr: Column, n: Column, fallback: Column) -> Column:
    """Rule-of-thumb kernel bandwidth, with the usual fallbacks for a degenerate spread."""
    spread = F.least(sd, iqr / F.lit(1.34))
    spread = F.coalesce(
        F.nullif(spread, F.lit(0.0)), F.nullif(sd, F.lit(0.0)), F.nullif(F.abs(fallback), F.lit(0.0)), F.lit(1.0)
    )
    return F.lit(0.9) * spread * F.pow(n.cast("double"), F.lit(-0.2))


GAUSS_NORM = 1.0 / math.sqrt(2.0 * math.pi)
