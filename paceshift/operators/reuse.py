"""Intermediate tables that several branches of a plan read, and joins with small ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64


def written_once(df: DataFrame) -> DataFrame:
    """A table whose input is scanned once, however many branches use it.

    With a checkpoint folder (``spark.checkpoint.dir``, or ``setCheckpointDir``) it is written there, and losing an executor
    loses nothing. Without one it is kept in memory and on disk until the session ends; lost parts are computed again. The session's own settings
    are not touched, and no local folder is used. With a folder this runs a job.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that all executors share, below the session's checkpoint folder. A local session that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="paceshift-")
    return f"{root}/paceshift-{uuid.uuid4().hex}"


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    small_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Null-safe equi-join with a table that is usually small, safe for a key that holds most of ``big``.

    ``small`` should be written already: its rows are counted, unless ``small_rows`` says how many there
    are, and up to ``broadcast_rows`` it is broadcast. Beyond that each key is spread over ``salts`` tasks
    by a hash of ``spread_by``; one salt is enough where no key is known to have many rows.
    """
    right = small.withColumnsRenamed({k: f"__j_{k}" for k in on})
    match = reduce(lambda a, b: a & b, [big[k].eqNullSafe(F.col(f"__j_{k}")) for k in on])
    if small_rows is None:
        small_rows = small.limit(broadcast_rows + 1).count()
    if small_rows <= broadcast_rows:
        joined = big.join(F.broadcast(right), match, how)
    elif salts == 1:
        joined = big.join(right, match, how)
    else:
        right = right.withColumn("__j_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64(spread_by), F.lit(salts))
        joined = big.join(right, match & (salt == F.col("__j_salt")), how).drop("__j_salt")
    return joined.drop(*[f"__j_{k}" for k in on])
