"""Quality scores by a regularised quadratic discriminant over statistics of a document."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import text_of

#: At most this many labelled rows are used to fit; the ones with the smallest hash of their id.
FIT_ROWS = 20_000
#: Share of the pooled covariance, and of a multiple of the unit matrix, in a class's covariance.
POOLED, RIDGE = 0.1, 0.02
#: Standardised statistics are held within this many deviations.
REACH = 8.0
#: From this score on a document is predicted to be good.
THRESHOLD = 0.3

STATISTICS = (
    "log_words log_chars word_length letters upper digits lines distinct top_word repeats "
    "sentence brackets quotes other_marks marked_ends compressed log_line"
).split()
#: ASCII punctuation by use; together all of it.
MARKS = [np.isin(np.arange(256), np.frombuffer(m, np.uint8)) for m in (b".,;:!?", b"()[]{}<>", b"'\"`", b"#$%&*+-/=@\\^_|~")]
PUNCTUATION = np.logical_or.reduce(MARKS)
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def statistics(text: str) -> list[float]:
    """Shares under an arcsine root and counts under a logarithm, so that classes look more like normal ones."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, bytes_ = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    counts = Counter(words)
    equal = sum(map(str.__eq__, words, words[1:]))
    tail = sum(ord(w[-1]) < 128 and bool(PUNCTUATION[ord(w[-1])]) for w in words)

    def share(x: float, of: float) -> float:
        return float(np.arcsin(np.sqrt(min(1.0, x / max(1.0, of)))))

    lines = raw.count(b"\n") + 1
    return [
        float(np.log1p(n)), float(np.log1p(len(raw))), float(np.log1p((len(raw) - n) / max(1, n))),
        share(bytes_[LETTER].sum(), size), share(bytes_[UPPER].sum(), max(1, bytes_[LETTER].sum())), share(bytes_[DIGIT].sum(), size),
        float(np.log1p(lines)), float(np.log1p(len(counts)) - 0.8 * np.log1p(n)),
        share(max(counts.values(), default=0), n), share(equal, n), *[share(bytes_[m].sum(), size) for m in MARKS], share(tail, n),
        share(len(zlib.compress(raw, 1)), size), float(np.log1p(len(raw) / lines)),
    ]


@dataclass
class Discriminant:
    """Class means and Cholesky factors, computed once and used for every row."""

    middle: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse of the lower Cholesky factor of each class's covariance
    offsets: list[float]  # log prior less half the log determinant

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        z = np.clip((rows - self.middle) / self.spread, -REACH, REACH)
        density = [b - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, b in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: np.ndarray, labels: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """With no rows of a class, both classes share one density, and the scores are the prior alone."""
    width = rows.shape[1]
    middle = np.median(rows, axis=0) if len(rows) else np.zeros(width)
    spread = (rows.std(axis=0) if len(rows) else np.zeros(width)) + 1e-3
    z = np.clip((rows - middle) / spread, -REACH, REACH)
    classes = [z[labels == c] for c in (0, 1)]
    usable = min(map(len, classes)) > 1
    means = [c.mean(axis=0) if usable else np.zeros(width) for c in classes]
    own = [np.cov(c.T, bias=True) if usable else np.eye(width) for c in classes]
    both = sum(len(c) * s for c, s in zip(classes, own, strict=True)) / max(1, len(z)) if usable else np.eye(width)
    factors, offsets = [], []
    for c, s in zip(classes, own, strict=True):
        s = (1 - pooled - ridge) * s + pooled * both + ridge * (np.trace(both) / width + 1e-6) * np.eye(width)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log((len(c) + 1) / (len(z) + 2)) - np.log(np.diag(low)).sum()))
    return Discriminant(middle, spread, means, factors, offsets)


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of (doc_id, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "statistics": [statistics(t) for t in batch["text"]]})

    return docs.mapInPandas(each, "doc_id long, statistics array<double>")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on at most fit_rows of labels (doc_id, quality) and their documents (doc_id, text).

    Labels other than 0 and 1, and labels without an id, are left out; a label that is given twice counts once. Of rows that share a labelled id, one
    is used, that with the smallest text hash, so at most fit_rows rows reach the driver however often an id occurs. Null texts are empty; rows without an id are not used.
    """
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int")).distinct()
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(fit_rows)
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most fit_rows labels
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text")))
    rows = rows.groupBy("labelled", "quality").agg(first.alias("one")).select("quality", "one.text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "statistics": [statistics(t) for t in batch["text"]]})

    found = rows.select("quality", "text").mapInPandas(each, "quality int, statistics array<double>").toPandas()
    values = np.array(found["statistics"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    order = np.lexsort(values.T)  # the sum over rows, and so the model, does not depend on their order
    return fit(values[order], found["quality"].to_numpy()[order])


def score(docs: DataFrame, model: Discriminant, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text and the columns in keep) with score, from the text alone. Null texts score as empty ones.

    Every row is scored by itself: repeated rows and ids get equal scores for equal texts, and ids may be null.
    """
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)], "score double"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([statistics(t or "") for t in batch["text"]], dtype=float).reshape(-1, len(STATISTICS))
            yield batch[["doc_id", *keep]].assign(score=model.scores(values))

    return docs.select("doc_id", *[c for c in dict.fromkeys(("text", *keep))]).mapInPandas(each, schema)


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, as they are, whose text (null: empty) scores at least threshold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(values) >= threshold))

    return docs.mapInArrow(each, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = text_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long"), "quality")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, labels.where(~held_out))
    scored = score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
