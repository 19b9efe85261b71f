"""Landed JSON payloads with whatever fields they have.

The fields and their types are found in one distributed pass over the lines, in which each line says which field has
which kind of value. Only the different (field, kind) pairs reach the driver, as many as there are fields. One type is then chosen for each field by
a widening rule, and all files are read under that schema, bound by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of value from narrow to wide, and the type a field gets whose widest value is of that kind.
NUMBERS = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType()}
OTHERS = {"BOOLEAN": T.BooleanType(), "STRING": T.StringType(), "NESTED": T.StringType()}


def found_fields(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name, kind, n, file): each field of JSON lines with each kind of value it has, the number of values and one of the files; in one pass.

    Kinds are BIGINT, DOUBLE (any number with a fraction or exponent, or beyond 64 bits), BOOLEAN, STRING, NESTED (objects and arrays) and VOID (null). A line that is
    no JSON object is an error.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = F.from_json("value", "map<string, variant>", {"mode": "FAILFAST"})
    fields = lines.select("file", F.explode(parsed).alias("name", "v"))
    schema = F.schema_of_variant("v")
    kind = (
        F.when(schema.startswith("OBJECT") | schema.startswith("ARRAY"), "NESTED")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "DOUBLE")
        .otherwise(schema)
    )
    # By file first: a count is kept by hash, while the smallest of texts would have all fields of a task sorted. What is left has a row for each file, field and kind.
    counted = fields.groupBy("name", kind.alias("kind"), "file").agg(F.count("*").alias("n"))
    return counted.groupBy("name", "kind").agg(F.sum("n").alias("n"), F.min("file").alias("file"))


def merged_fields(found: DataFrame, declared: T.StructType | None = None) -> T.StructType:
    """One type for each field: a declared field has its own; whole numbers widen to doubles, null to anything, and nested values are kept as JSON text.

    Any other two kinds in one field are an error that names a file of each. A field that is null everywhere is text. Fields are in the order of their names, after the declared ones.
    """
    fields = {f.name: f for f in (declared.fields if declared is not None else [])}
    kinds: dict[str, dict[str, str]] = {}
    for row in found.collect():  # as many as there are fields and kinds
        kinds.setdefault(row["name"], {})[row["kind"]] = row["file"]
    for name in sorted(kinds):
        if name in fields:
            continue
        known = {k: file for k, file in kinds[name].items() if k != "VOID"}
        if not known:
            kind: T.DataType = T.StringType()
        elif set(known) <= set(NUMBERS):
            kind = NUMBERS["DOUBLE" if "DOUBLE" in known else "BIGINT"]
        elif len(known) == 1:
            kind = OTHERS[next(iter(known))]
        else:
            told = ", ".join(f"{k} in {file}" for k, file in sorted(known.items()))
            raise ValueError(f"field {name} has values that do not go together: {told}")
        fields[name] = T.StructField(name, kind)
    return T.StructType(list(fields.values()))


def read_payloads(spark: SparkSession, paths: Sequence[str], declared: T.StructType | None = None, required: Sequence[str] = ()) -> DataFrame:
    """All JSON lines as one table with every field that any line has, bound by name; a field that a line lacks is null.

    ``declared`` gives the types of known fields, of which those in ``required`` must occur. Runs one job when called.
    """
    found = found_fields(spark, paths).cache()
    try:
        schema = merged_fields(found, declared)
        names = {r["name"] for r in found.select("name").distinct().collect()}
    finally:
        found.unpersist()
    missing = [f for f in required if f not in names]
    if missing:
        raise ValueError(f"the landed files lack the fields {missing}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def renamed_fields(df: DataFrame, known: Mapping[str, str], cleaned: Mapping[str, str]) -> DataFrame:
    """Known fields under their table names; the others under ``cleaned`` ones, numbered where a table name has that already."""
    taken = set(known.values())
    out = []
    for c in df.columns:
        name, k = known.get(c, cleaned[c]), 1
        while c not in known and name in taken:
            k += 1
            name = f"{cleaned[c]}_{k}"
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)
