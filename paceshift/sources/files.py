"""CSV and Parquet tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_names
from ..operators.numbering import split_order
from .schemas import ENRICHED, EVENT_HEADER, EVENTS, PARKS_RAW, REQUIRED

CORRUPT = "_corrupt_record"
#: Columns that say which file and which place in it a row was read from.
PLACE = ["__file", "__start"]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file (or of the first one of a folder)."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, null_value: str | None = "NA",
    fail_on_bad_rows: bool = True, optional: Collection[str] = (), with_place: bool = False,
) -> DataFrame:
    """CSV with a header, under a declared schema; empty fields, ``null_value`` and NaN are missing.

    Columns are bound by name: each path has its own header (all files of a folder the same one, or it is an
    error). A column of the schema that a header lacks is an error unless ``optional`` names it, in which case it
    is null; columns that the schema lacks are left out. ``null_value=None`` keeps the text ``NA``. A row that
    does not parse is an error unless ``fail_on_bad_rows`` is off, in which case it is kept with its text in
    ``_corrupt_record``. ``with_place`` adds the path and the first byte of the split of each row as ``__file`` and ``__start``. One
    line is read of each path when this is called.
    """
    fields = {f.name: f for f in schema.fields}
    out = list(schema.fields)
    if not fail_on_bad_rows:
        out.append(T.StructField(CORRUPT, T.StringType()))
    parts = []
    for one in [path] if isinstance(path, str) else path:
        header = header_of(spark, one)
        missing = [n for n in fields if n not in header and n not in optional]
        if missing:
            raise ValueError(f"{one} lacks the columns {missing}")
        declared = T.StructType([fields.get(h, T.StructField(h, T.StringType())) for h in header] + out[len(fields) :])
        reader = spark.read.option("header", True).option("enforceSchema", False)
        reader = reader.option("mode", "FAILFAST" if fail_on_bad_rows else "PERMISSIVE")
        if null_value is not None:
            reader = reader.option("nullValue", null_value)
        if not fail_on_bad_rows:
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        read = reader.schema(declared).csv(one)
        place = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1])] if with_place else []
        parts.append(read.select(*[(F.col(f"`{f.name}`") if f.name in declared.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in out], *place))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.select(*[
        (F.nullif(F.col(f"`{c}`"), F.lit("")) if c in texts else F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) if c in numbers else F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])


def raw_schema(rename: Mapping[str, str] = EVENT_HEADER) -> T.StructType:
    """The event columns under their raw names."""
    types = {f.name: f.dataType for f in EVENTS.fields}
    return T.StructType([T.StructField(raw, types[name]) for raw, name in rename.items()])


def renamed(df: DataFrame, rename: Mapping[str, str] = EVENT_HEADER) -> DataFrame:
    return df.select(*[F.col(f"`{raw}`").alias(name) for raw, name in rename.items()])


def read_raw_events(spark: SparkSession, path: str | Sequence[str], rename: Mapping[str, str] = EVENT_HEADER, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Raw event files, each with the header it has, cut to the known columns.

    Columns that a header lacks become typed nulls, but a missing required one is an error. ``ingest_seq`` numbers the
    rows densely from 0, the files in the order of their paths and rows in file order, however large files are split. Rows are counted by split when this is called.
    """
    paths = [path] if isinstance(path, str) else sorted(path)
    raw = read_csv(spark, paths, raw_schema(rename), optional=set(rename) - set(required), with_place=True)
    known = renamed(raw, {**rename, **{p: p for p in PLACE}}).select(*[f.name for f in EVENTS.fields], *PLACE)
    return split_order(known, *PLACE)


def read_parks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The park list under clean names; the text ``NA`` is a league, not a missing value."""
    return clean_names(read_csv(spark, path, PARKS_RAW, null_value=None))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Parquet by partition column: later period filters prune directories instead of rows."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENRICHED).parquet(path)
