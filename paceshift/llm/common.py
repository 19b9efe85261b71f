"""What the corpus operators share: sizes, written intermediates, columns with clashing names, components."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of other characters. Fixed values, as the queries define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns go, so that their names cannot clash."""
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder: cuts the lineage, and losing an executor loses nothing.

    Where the session names no folder (tests, a local shell), a local session gets a temporary one, and any
    other keeps the table on the executors' disks, from where lost parts are computed again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="paceshift-")
        if folder is None:
            return df.persist(StorageLevel.DISK_ONLY)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, which lies in a shared folder: written by committed tasks and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, size: Column, per_part: int, least: int = 1) -> int:
    """How many parts of about per_part a table has, by the sum of size. One scan of the columns in size."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(least, int(total // per_part) + 1)


def unit_hash(*columns: Column, seed: str = "") -> Column:
    """A whole number from 0 to 2^52 - 1, the same in every run and in SQL engines that have md5."""
    keys = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(keys), 1, 13), 16, 10).cast("long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each id of nodes, itself included.

    Labels go to neighbours by a map-side combined minimum, and labels follow labels (pointer jumping), so a
    star takes two rounds and a chain of n about log n. Both tables are written after each round; ids without
    links take no part in the rounds. Hot nodes are only a join key whose rows AQE splits; nothing is gathered.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = written(both.union(both.select("dst", "src")).where("src <> dst").distinct())
    label = written(both.groupBy("src").agg(F.min("dst").alias("near")).select(F.col("src").alias("id"), F.least("src", "near").alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        up = label.select(F.col("id").alias("new"), F.col("label").alias("above"))
        moved = written(step.join(up, "new").select("id", F.least("new", "above").alias("label"), "old"))
        changed = moved.where("label <> old").limit(1).count()
        label = moved.select("id", "label")
        if not changed:
            break
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
