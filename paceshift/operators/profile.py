"""Table profiles: missing values, schema comparison, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, most first, from one aggregate over one scan."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]
    )
    return counted.unpivot("__rows", columns, "variable", "n_miss").select(
        "variable",
        "n_miss",
        (F.lit(100.0) * F.col("n_miss") / F.nullif(F.col("__rows"), F.lit(0))).alias("pct_miss"),
    ).orderBy(F.desc("n_miss"), "variable")


def missing_summary(
    df: DataFrame, population: Column, measurements: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: columns wholly missing, columns complete, and the share of the rows of ``population``
    that lack at least one of ``measurements``."""
    columns = list(columns or df.columns)
    lacking = F.lit(False)
    for m in measurements:
        lacking = lacking | F.col(m).isNull()
    counted = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(population).alias("n_population"),
        F.count_if(population & lacking).alias("n_lacking"),
        *[F.count(F.col(f"`{c}`")).alias(f"__{c}") for c in columns],
    )
    empty = sum((F.when(F.col(f"__{c}") == 0, 1).otherwise(0) for c in columns), F.lit(0))
    full = sum((F.when(F.col(f"__{c}") == F.col("n_rows"), 1).otherwise(0) for c in columns), F.lit(0))
    return counted.select(
        "n_rows",
        F.lit(len(columns)).alias("n_columns"),
        empty.alias("n_empty_columns"),
        full.alias("n_complete_columns"),
        (F.lit(100.0) * F.col("n_lacking") / F.nullif(F.col("n_population"), F.lit(0))).alias("pct_lacking"),
    )


def schema_diff(a: DataFrame, b: DataFrame, filled: bool = False) -> DataFrame:
    """Columns of two tables with their types and whether the tables agree, from the schemas alone.

    ``filled`` adds how many values each column has, from one scan of each table.
    """
    types = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (a, b)]
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    counts = [df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]) if filled else df.sparkSession.range(1) for df in (a, b)]
    counts = [c.select(F.struct("*").alias(f"n_{side}")) for c, side in zip(counts, "ab", strict=True)]
    one = counts[0].join(F.broadcast(counts[1]))  # one row each

    def described(name: str) -> Column:
        left, right = (t.get(name) for t in types)
        status = "only_b" if left is None else "only_a" if right is None else "same" if left == right else "differs"
        fields = [F.lit(name).alias("column_name"), F.lit(left).cast("string").alias("type_a"), F.lit(right).cast("string").alias("type_b"), F.lit(status).alias("status")]
        for side, own in zip("ab", types, strict=True) if filled else ():
            fields.append((F.col(f"n_{side}").getField(name) if name in own else F.lit(None).cast("long")).alias(f"n_{side}"))
        return F.struct(*fields)

    return one.select(F.explode(F.array(*[described(n) for n in names])).alias("x")).select("x.*")


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest digest of seed and key: the same in every run and on any partitioning. A bounded take-ordered, not a sort of the table."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(digest, *key).limit(n)
