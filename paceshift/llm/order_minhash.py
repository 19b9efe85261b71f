"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of five words, each labelled with its occurrence. One sketch keeps the few runs with the
smallest hashes in the order of the text, so equal sketches need the same runs in the same order: they are
sensitive to edit similarity, where plain MinHash forgets order. Texts that share a sketch are candidates. A pair is linked
if an alignment within a band matches enough runs: M / (n1 + n2 - M) >= 0.8, with M the longest chain of equal
labelled runs in order. Without moved passages that is the Jaccard similarity of the runs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import components, tasks, text_of, written
from paceshift.llm.shingles import groups_of, mix, shingles_of, words_of

WORDS, SIMILARITY = 5, 0.8
#: Sketches, and runs in a sketch. At similarity 0.8 a pair shares none of the sketches with odds of (1 - 0.8^4)^24 = 3e-6.
SKETCHES, KEPT = 24, 4
#: Texts in a block of a large bucket.
BLOCK_ROWS = 512


def sketches(runs: np.ndarray, starts: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One row for each text with runs: the hash of its ordered smallest runs, for each sketch."""
    counts = np.diff(starts)
    texts = len(counts)
    owner = np.repeat(np.arange(texts), counts)
    # Runs below a share of the hash range that holds 2 * kept + 6 of them on average; the few texts with too few take all.
    share = np.minimum(1.0, (2 * kept + 6) / counts)
    limit = np.where(share >= 1.0, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) << np.uint64(1))
    limits = limit[owner]
    out = np.empty((texts, sketches), np.uint64)
    need = np.minimum(counts, kept)
    for s in range(sketches):
        values = mix_once(runs, s)
        chosen = np.flatnonzero(values <= limits)
        short = np.bincount(owner[chosen], minlength=texts) < need
        if short.any():
            chosen = np.flatnonzero((values <= limits) | short[owner])
        mine = owner[chosen]
        order = np.lexsort((values[chosen], mine))
        chosen, mine = chosen[order], mine[order]
        begin = np.searchsorted(mine, np.arange(texts))
        rank = np.arange(len(mine)) - begin[mine]
        chosen, mine, rank = (x[rank < kept] for x in (chosen, mine, rank))
        places = np.full((texts, kept), -1, np.int64)
        places[mine, rank] = chosen
        places.sort(axis=1)
        value = np.full(texts, s + 1, np.uint64)
        for j in range(kept):
            value = mix(value * np.uint64(3) + np.where(places[:, j] >= 0, runs[np.maximum(places[:, j], 0)], np.uint64(0)))
        out[:, s] = value
    return out


def mix_once(h: np.ndarray, seed: int) -> np.ndarray:
    """The order of sketch seed: a cheaper scramble, as h is one already."""
    v = (h ^ np.uint64((0xA0761D6478BD642F * (2 * seed + 1)) % 2**64)) * np.uint64((0xE7037ED1A0B428DB * (2 * seed + 1)) % 2**64 | 1)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x8EBC6AF09C88C6E3)
    return v


def sketch_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, two halves of a digest of the words, number of runs, sketches (null for a text without words)."""
    for batch in batches:
        raws = batch["raw"].tolist()
        ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
        for part in groups_of(raws):
            some = raws[part]
            words, firsts = words_of(some)
            runs, starts = shingles_of(some, WORDS)
            counts = np.diff(starts)
            full = np.flatnonzero(counts > 0)
            rows = [None] * len(some)
            if len(full):
                made = sketches(runs, np.concatenate([starts[full], starts[-1:]]))
                for i, row in zip(full.tolist(), made.view(np.int64).tolist(), strict=True):
                    rows[i] = row
            digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(firsts, firsts[1:], strict=False)]
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pd.Series(ids[part], dtype="Int64"), "c1": halves[:, 0], "c2": halves[:, 1], "n": counts, "sketches": rows})


def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, labelled runs in order (4 bytes of each hash)."""
    for batch in batches:
        raws = batch["raw"].tolist()
        ids = batch["id"].tolist()
        for part in groups_of(raws):
            runs, starts = shingles_of(raws[part], WORDS)
            low = (runs >> np.uint64(32)).astype("<u4")
            yield pd.DataFrame({"id": ids[part], "runs": [low[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]})


def longest_rise(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    ends: list[int] = []
    for v in values.tolist():
        i = bisect_left(ends, v)
        if i == len(ends):
            ends.append(v)
        else:
            ends[i] = v
    return len(ends)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment of labelled runs reaches the similarity. Each run is once in a and once in b, so the
    alignment is a longest rise of places in b; places further apart than the runs that may stay unmatched are out of the band."""
    need = similarity * (len(a) + len(b)) / (1 + similarity)  # M / (n1 + n2 - M) >= s
    if min(len(a), len(b)) < need - 1e-9:
        return False
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    band = len(a) + len(b) - 2 * need + 1e-9
    near = np.abs(in_a - in_b) <= band
    if near.sum() < need - 1e-9:
        return False
    order = np.argsort(in_a[near])
    return longest_rise(in_b[near][order]) >= need - 1e-9


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [similar(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in zip(batch["runs_a"], batch["runs_b"], strict=True)]
        yield batch[["a", "b"]].assign(linked=np.array(found, dtype=bool))


def common_runs(runs: list[np.ndarray]) -> np.ndarray:
    """How many runs each two texts have in common."""
    values, place, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    shared = np.flatnonzero(times[place] > 1)
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(runs), len(runs)), np.float32)
    width = 4096
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        low, high = np.searchsorted(place, [start, start + width])
        has = np.zeros((len(runs), width), np.float32)
        has[owner[low:high], place[low:high] - start] = 1.0
        common += has @ has.T
    return common


def compare_step(ids: np.ndarray, side: np.ndarray, runs: list[np.ndarray], sketch: int, made: np.ndarray) -> list[tuple[int, int, int]]:
    """For each text that is similar to another of a step: the smallest id of its class, its id, and the smallest id that it was aligned with and is similar to. Pairs that share an earlier sketch are left to its bucket."""
    sizes = np.array([len(r) for r in runs])
    need = SIMILARITY * (sizes[:, None] + sizes[None, :]) / (1 + SIMILARITY) - 1e-9
    meet = (side[:, None] != side[None, :]) | (side[:, None] == 2)
    a, b = np.nonzero(np.triu((common_runs(runs) >= need) & meet, 1))
    first = (made[a] == made[b]).argmax(axis=1) == sketch
    label = list(range(len(ids)))
    direct = [None] * len(ids)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y and similar(runs[i], runs[j]):
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            label[y] = x
            for one, other in ((i, j), (j, i)):
                direct[one] = int(ids[other]) if direct[one] is None else min(direct[one], int(ids[other]))
    return [(int(ids[root(i)]), int(ids[i]), d) for i, d in enumerate(direct) if d is not None]


def compare_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (key, step); the rows of one step are held at a time."""
    held: pd.DataFrame | None = None

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in rows.groupby(["key", "step"], sort=False):
            runs = [np.frombuffer(r, "<u4") for r in part["runs"]]
            found += compare_step(part["id"].to_numpy(), part["side"].to_numpy(), runs, int(part["sketch"].iloc[0]), np.array(part["sketches"].tolist()))
        return pd.DataFrame(found, columns=["a", "b", "direct"], dtype="int64")

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        open_ = ((rows["key"] == rows["key"].iloc[-1]) & (rows["step"] == rows["step"].iloc[-1])).to_numpy()
        held = rows[open_]
        if not open_.all():
            yield done(rows[~open_])
    if held is not None:
        yield done(held)


def links(texts: DataFrame, docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, direct): links a - b that join all texts (id, sketches) that share a sketch and are similar; b was aligned with direct. Rows with a = b only tell that.

    Two texts alone in a bucket are a pair, which is verified once for all buckets that hold it. Larger buckets are cut
    into blocks, and each two blocks meet in a step of its own, so a group of many near copies is neither gathered in one
    task nor written as pairs: a step counts common runs of all its texts at once, aligns those that are not joined yet,
    and gives one link for each text.
    """
    open_ = texts.select("id", F.posexplode("sketches").alias("sketch", "key"))
    buckets = open_.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    open_ = written(open_.join(buckets, "key"))
    runs = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw")).join(open_.select("id").distinct(), "id", "left_semi")
    runs = written(runs.mapInPandas(sequences, "id long, runs binary"))
    pairs = open_.where("members = 2").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b").distinct()
    left = runs.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = runs.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    both = pairs.where("a < b").join(left, "a").join(right, "b").select("a", "b", "runs_a", "runs_b")
    alone = both.mapInPandas(verify, "a long, b long, linked boolean").where("linked")
    alone = alone.select(F.explode(F.array(F.struct("a", "b", F.col("a").alias("direct")), F.struct("a", F.col("a").alias("b"), F.col("b").alias("direct")))).alias("x")).select("x.*")

    large = open_.where("members > 2").withColumn("blocks", F.ceil(F.col("members") / block_rows).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    steps = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            (F.least("block", o).cast("long") * (1 << 31) + F.greatest("block", o)).alias("step"),
            F.when(F.col("block") == o, F.lit(2)).when(F.col("block") < o, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    large = large.select("id", "sketch", "key", F.explode(steps).alias("s")).select("id", "sketch", "key", "s.step", "s.side")
    data = runs.join(texts.select("id", "sketches"), "id")
    work = large.join(data, "id").repartition(2 * tasks(docs.sparkSession), "key", "step").sortWithinPartitions("key", "step")
    return alone.union(work.mapInPandas(compare_buckets, "a long, b long, direct long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, component_id (the smallest id of its class), kept (it is that id) and linked_id.

    linked_id is the smallest id that this one is tied to directly: the document whose equal text was compared for this one, else a document whose text was
    aligned with this one's and found similar. The first holder of a text has null if nothing but equal texts is like it, and so has a text without words. Texts with the same words are one text. Texts without words are left alone, each in a class of its own. Rows with the same
    id are one document: what links one of their texts links them all. Rows without an id are in the class of their
    text, and can't be its smallest.
    """
    raws = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    made = written(raws.mapInPandas(sketch_texts, "doc_id long, c1 long, c2 long, n long, sketches array<long>"))
    texts = made.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("sketches").alias("sketches"))
    texts = written(texts.where("id IS NOT NULL"))
    found = written(links(texts.select("id", "sketches"), docs))
    # Rows with one id and several texts: their texts' classes are one.
    own = made.where("n > 0").select("doc_id", "c1", "c2").join(texts.select("c1", "c2", "id"), ["c1", "c2"])
    several = own.where("doc_id IS NOT NULL AND doc_id <> id").join(texts.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    several = several.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    label = components(texts.select("id").distinct(), written(found.select("a", "b").where("a <> b").union(several).distinct()))
    direct = found.groupBy(F.col("b").alias("id")).agg(F.min("direct").alias("direct"))
    found = texts.join(label, "id", "left").join(direct, "id", "left").select("c1", "c2", "id", "direct", F.coalesce("component", "id").alias("component"))
    out = made.join(found, ["c1", "c2"], "left")
    copy = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("id"))
    out = out.select("doc_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(copy, F.col("id")).otherwise(F.col("direct")).alias("linked_id"))
    return out.select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "linked_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(text_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
