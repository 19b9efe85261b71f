"""Column selection, schema reconciliation and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def expand_ranges(columns: Sequence[str], picks: Sequence[str | tuple[str, str]]) -> list[str]:
    """Names for a mix of single columns and inclusive (first, last) ranges, each name once."""
    names: list[str] = []
    for pick in picks:
        if isinstance(pick, str):
            names.append(pick)
        else:
            first, last = (columns.index(name) for name in pick)
            names.extend(columns[first : last + 1])
    return list(dict.fromkeys(names))


def select_ranges(df: DataFrame, *picks: str | tuple[str, str]) -> DataFrame:
    """Columns by name and by inclusive range; names may contain dots."""
    return df.select(*[F.col(f"`{name}`") for name in expand_ranges(df.columns, picks)])


def drop_ranges(df: DataFrame, *picks: str | tuple[str, str]) -> DataFrame:
    return df.drop(*expand_ranges(df.columns, picks))


def relocate(df: DataFrame, names: Sequence[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Move columns to the front, or next to another column."""
    rest = [c for c in df.columns if c not in names]
    at = 0
    if before is not None:
        at = rest.index(before)
    elif after is not None:
        at = rest.index(after) + 1
    return df.select(*rest[:at], *names, *rest[at:])


def add_null_columns(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Add the missing ones of ``fields`` as nulls of the declared type (an untyped null would be void)."""
    missing = [f for f in fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def all_fields(seasons: Sequence[DataFrame]) -> T.StructType:
    """The fields of all seasons, in the order in which they first appear. The same name with two types is an error."""
    fields: dict[str, T.StructField] = {}
    for season in seasons:
        for f in season.schema.fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
            if known.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in one season and {f.dataType.simpleString()} in another")
    return T.StructType(list(fields.values()))


def union_seasons(seasons: Sequence[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """Append season tables by column name.

    With a schema every season is first completed and cast to it; a column that the schema lacks is an error.
    Without one the columns must agree, as in a strict append; ``all_fields`` gives the schema that completes them.
    """
    names = set(schema.names if schema is not None else seasons[0].columns)
    for season in seasons:
        extra, missing = sorted(set(season.columns) - names), sorted(names - set(season.columns))
        if extra or (missing and schema is None):
            raise ValueError(f"seasons differ: not in all of them are {extra + missing}")
    if schema is not None:
        seasons = [
            add_null_columns(s, schema.fields).select(
                *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
            )
            for s in seasons
        ]
    return reduce(lambda a, b: a.unionByName(b), seasons)


def append_row(df: DataFrame, **values) -> DataFrame:
    """Append one literal row, typed by the table's own schema."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(row)


def split_name(df: DataFrame, column: str, into: Sequence[str], delimiter: str = ", ") -> DataFrame:
    """Split a text into exactly ``len(into)`` parts; any other number of parts is an error."""
    escaped = "\\Q" + delimiter + "\\E"
    parts = F.split(F.col(column), escaped)
    checked = F.when(
        F.col(column).isNull() | (F.size(parts) == len(into)), parts
    ).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(into)} parts in {column}: "), F.col(column))))
    out = df.withColumn("__parts", checked)
    at = df.columns.index(column)
    names = [*df.columns[:at], *into, *df.columns[at + 1 :]]
    out = out.withColumns({name: F.col("__parts")[i] for i, name in enumerate(into)})
    return out.select(*names)


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls (all columns, or the named ones)."""
    return df.dropna("any", subset=list(subset) if subset else None)


def count_groups(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per group; missing keys form a group."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key with the number of rows it had."""
    return count_groups(df, *keys)
