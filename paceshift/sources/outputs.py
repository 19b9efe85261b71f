"""One output for each value of a column, with a manifest that a rerun compares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.reuse import written_once


def manifest_of(df: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, digest): rows per output and a sum of their hashes, which does not depend on their order."""
    digest = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string")
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), digest.alias("digest"))


def read_manifest(spark, path: str, schema: T.StructType) -> DataFrame:
    """The manifest of the last finished run; empty where there was none."""
    versioned = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    try:
        rows = spark.read.schema(versioned).parquet(f"{path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return spark.createDataFrame([], versioned)
    return rows.where(F.col("version") == last)


def write_outputs(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write one output per value of ``by`` below ``path`` and return the manifest with a ``status`` for each: written or unchanged.

    An output whose rows and digest are as in the last manifest is not written again; the others are replaced, one folder each. Outputs
    of values that df does not have are left as they are, and stay in the manifest. The manifest is written last, as a new version, so a run that was
    broken off is made good by the next one. A missing value of ``by`` is an output too.
    """
    spark = df.sparkSession
    rows = written_once(df)
    new = written_once(manifest_of(rows, by))
    old = read_manifest(spark, path, new.schema)
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    before = old.select(F.col(by).alias("__by"), F.col("n_rows").alias("__n"), F.col("digest").alias("__d"))
    compared = new.join(before, new[by].eqNullSafe(F.col("__by")), "left")
    same = F.col("n_rows").eqNullSafe(F.col("__n")) & F.col("digest").eqNullSafe(F.col("__d"))
    status = written_once(compared.select(by, "n_rows", "digest", F.when(same, "unchanged").otherwise("written").alias("status")))
    touched = status.where("status = 'written'").select(F.col(by).alias("__by"))
    if not touched.isEmpty():
        changed = rows.join(touched, rows[by].eqNullSafe(F.col("__by")), "left_semi")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/outputs")
        kept = old.drop("version").join(new.select(F.col(by).alias("__by")), F.col(by).eqNullSafe(F.col("__by")), "left_anti")
        listed = new.unionByName(kept).withColumn("version", F.lit(version))
        listed.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/manifest")
    return status


def read_outputs(spark, path: str, schema: T.StructType) -> DataFrame:
    """All outputs as one table, under the schema they were written with."""
    return spark.read.schema(schema).parquet(f"{path}/outputs").select(*schema.names)
