"""A corpus pipeline: good documents, one of each group of near copies, without secrets, mixed by source, packed for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceshift.llm import mixing, order_minhash, packing, quality, secret_scan
from paceshift.llm.common import WORD, text_of, written
from paceshift.operators.reuse import join_small


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject. Null texts are judged as empty ones; each row is judged by its text alone, so repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long"), "quality")
    return quality.keep_good(docs, quality.train(text_of(docs), labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Of rows with one id, the first by text stays.

    Rows without an id are named by a hash of their text, above all ids, so that one of each group stays, and none beside a row with an id.
    Those without words have no copies and all stay; where ids go beyond 2^62, no names are left and all rows without one stay.
    """
    top = max(docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0, 0)
    name = F.when(F.col("text").rlike(WORD) & F.lit(top < 1 << 62), F.lit(top + 1) + F.pmod(F.xxhash64("text"), F.lit((1 << 63) - 2 - min(top, 1 << 62))))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), name).alias("doc_id"), F.struct("*").alias("row"))  # so that no column's name can clash
    found = order_minhash.near_duplicates(text_of(rows.select("doc_id", "row.text")))
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    named = rows.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumn("n", first).where("n = 1")
    return named.select("row.*").union(rows.where("doc_id IS NULL").select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their text and n_chars counted anew where that changed it. Null and empty texts stay as they are; repeated rows are masked alike, and all stay."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    after = secret_scan.redact(rows)
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    count = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": count}
    return after.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never. Rows with one id are taken equally often."""
    copies = mixing.mix(mixing.sized(docs)).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select("doc_id", F.struct("*").alias("row"))  # so that no column's name can clash
    taken = join_small(rows, written(copies), ["doc_id"], F.xxhash64("row.text"), salts=1)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. Null texts are packed as empty ones, of which the end alone is a piece; each of repeated rows is packed, under its id."""
    return packing.pack(text_of(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", without_copies),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("packing", packed),
]
#: The stages learn, sketch and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
