"""Scores of documents by a recurrent language model trained on a part of the same documents.

Word counts of all training documents come first, as a shuffled table by a 64-bit hash of the word; a fixed number of the most frequent ones
goes to the tasks. Training passes over every training document once: in each round the tasks go on from the
same weights on documents of their own, and their weights are averaged. A corpus of fewer than LEAST_TOKENS is
passed over again, by one task, until so many have been seen. A small share of the training documents is held back, and where the network does not
give these a better likelihood than the counts that it starts from, the counts' shares are used. Scoring passes over all documents; words outside
the list are joined with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceshift.llm import recurrent_lm as lm
from paceshift.llm.common import text_of, written
from paceshift.llm.shingles import groups_of, words_of

#: Most frequent words that tasks hold, distinct words and tokens gathered before a task works on them, combiners of weights.
LISTED, DISTINCT_HELD, TOKENS_HELD, COMBINERS = 1 << 19, 2_000_000, 3_000_000, 16
#: Documents dealt to the rounds, of SHARES, and the learning rate of each round.
SHARES, ROUNDS = 8, ((0, 1, 0.1), (1, 8, 0.1))
#: Tokens to train on at least, passes over a small corpus at most, and one in how many training documents is held back.
LEAST_TOKENS, MOST_PASSES, HELD_BACK = 4_000_000, 24, 64
#: Words of the longest document times passes: its words come one after another, so that many passes over one would take long.
MOST_STEPS = 100_000


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, c) of the batch's words; with h null, the number of documents."""
    hashes, counts, held, documents = [], [], 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        all_, place = np.unique(np.concatenate(hashes), return_inverse=True)
        return all_, np.bincount(place, weights=np.concatenate(counts), minlength=len(all_)).astype(np.int64)

    for batch in batches:
        raws = [r.lower() for r in batch["raw"]]
        documents += len(raws)
        for part in groups_of(raws):
            h, c = np.unique(words_of(raws[part])[0], return_counts=True)
            hashes.append(h)
            counts.append(c)
            held += len(h)
            if held > DISTINCT_HELD:
                h, c = merged()
                hashes, counts, held = [h], [c], len(h)
                if held > DISTINCT_HELD // 2:
                    yield pd.DataFrame({"h": h.view(np.int64), "c": c})
                    hashes, counts, held = [], [], 0
    if hashes:
        h, c = merged()
        yield pd.DataFrame({"h": h.view(np.int64), "c": c})
    if documents:
        yield pd.DataFrame({"h": pd.array([None], dtype="Int64"), "c": [documents]})


_LEXICONS: dict[tuple, lm.Lexicon] = {}  # the last one of a worker process


def lexicon_of(values: tuple) -> lm.Lexicon:
    key = (len(values[0]), *values[2:], int(values[1].sum()) if len(values[1]) else 0, int(values[0][:1].sum()))
    if key not in _LEXICONS or not np.array_equal(_LEXICONS[key].hashes, values[0]):
        _LEXICONS.clear()
        _LEXICONS[key] = lm.Lexicon(*values)
    return _LEXICONS[key]


class Gathered:
    """Documents as numbers, END last, up to about TOKENS_HELD tokens."""

    def __init__(self, lexicon: lm.Lexicon):
        self.lexicon = lexicon
        self.words, self.counts, self.size = [], [], 0

    def add(self, raws: list[bytes]) -> None:
        words, firsts = words_of(raws)
        self.words.append(words)
        self.counts.append(np.diff(firsts))
        self.size += len(words) + len(raws)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, index in the list or -1, numbers with END after each document, lengths with END)."""
        words, counts = np.concatenate(self.words), np.concatenate(self.counts)
        self.words, self.counts, self.size = [], [], 0
        at = self.lexicon.find(words)
        numbers = np.full(len(words) + len(counts), lm.END, np.int32)
        if len(words):
            listed = self.lexicon.numbers[np.maximum(at, 0)] if len(self.lexicon.numbers) else np.zeros(len(words), np.int32)
            numbers[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = np.where(at >= 0, listed, lm.WORDS + lm.OTHERS)
        return words, at, numbers, counts + 1


def train_on(values: tuple, flat: np.ndarray, rate: float, passes: int = 1):
    """One row from each task: tokens and weights times tokens. What a task has gathered is passed over several times."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = lexicon_of(values)
        net, rule, held, tokens = lm.Network(flat.copy()), lm.Adagrad(rate), Gathered(lexicon), 0

        def learn(gathered: tuple) -> None:
            for _ in range(max(1, min(passes, MOST_STEPS // int(gathered[1].max())))):
                net.train(*gathered, rule)

        for batch in batches:
            raws = [r.lower() for r in batch["raw"]]
            for part in groups_of(raws):
                held.add(raws[part])
                if held.size >= TOKENS_HELD:
                    tokens += held.size
                    learn(held.take()[2:])
        if held.size:
            tokens += held.size
            learn(held.take()[2:])
        if tokens:
            yield pd.DataFrame({"tokens": [tokens], "weights": [(net.flat.astype(np.float64) * tokens).tobytes()]})

    return each


def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens, total = 0, np.zeros(lm.SIZE)
    for batch in batches:
        for n, w in zip(batch["tokens"], batch["weights"], strict=True):
            tokens, total = tokens + n, total + np.frombuffer(w)
    if tokens:
        yield pd.DataFrame({"tokens": [tokens], "weights": [total.tobytes()]})


def compare(values: tuple, flat: np.ndarray):
    """How much more likely the network makes the documents than the counts do: a row for each task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, gain = lexicon_of(values), 0.0
        net, held = lm.Network(flat), Gathered(lexicon)
        for batch in batches:
            raws = [r.lower() for r in batch["raw"]]
            for part in groups_of(raws):
                held.add(raws[part])
                if held.size >= TOKENS_HELD:
                    numbers, lengths = held.take()[2:]
                    gain += float((net.score(numbers, lengths) - lexicon.by_counts[numbers]).sum())
        if held.size:
            numbers, lengths = held.take()[2:]
            gain += float((net.score(numbers, lengths) - lexicon.by_counts[numbers]).sum())
        yield pd.DataFrame({"gain": [gain]})

    return each


def score_with(values: tuple, flat: np.ndarray | None):
    """One row for each document, without what words outside the list add; those with their counts in the document. Without weights, by the counts' shares."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, net, part = lexicon_of(values), None if flat is None else lm.Network(flat), TaskContext.get().partitionId()
        listed_base, end_base = lexicon.base(lexicon.counts), float(lexicon.base(np.array([lexicon.ends]))[0])
        done = 0

        def scored(ids: list) -> pd.DataFrame:
            nonlocal done
            words, at, numbers, lengths = held.take()
            log = lexicon.by_counts[numbers] if net is None else net.score(numbers, lengths)
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            score = np.add.reduceat(log, firsts)
            owner = np.repeat(np.arange(len(lengths)), lengths - 1)
            hit = at >= 0
            index, mine, n = at[hit], owner[hit], len(lengths)
            add = lambda x, o=mine: np.bincount(o, weights=x, minlength=n)
            if len(index):
                score = score + add(lexicon.within[index])
                base = add(listed_base[index]) + end_base
            else:
                base = np.full(n, end_base)
            known = np.bincount(mine, minlength=n) + (lexicon.ends > 0)
            rare, rare_owner = words[~hit], owner[~hit]
            order = np.lexsort((rare, rare_owner))
            rare, rare_owner = rare[order], rare_owner[order]
            new = np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1])])[: len(rare)]
            heads = np.flatnonzero(new)
            times = np.diff(np.concatenate([heads, [len(rare)]]))
            edges = np.searchsorted(rare_owner[heads], np.arange(n + 1))
            signed = rare[heads].view(np.int64)
            out = pd.DataFrame({
                "part": part, "at": np.arange(done, done + n), "doc_id": pd.Series(ids, dtype="Int64"), "n_tokens": lengths.astype(np.int64), "known": known.astype(np.int64),
                "base": base, "score": score / np.log(10.0),
                "rare": [signed[a:b] for a, b in zip(edges, edges[1:], strict=False)], "times": [times[a:b] for a, b in zip(edges, edges[1:], strict=False)],
            })
            done += n
            return out

        held, ids = Gathered(lexicon), []
        for batch in batches:
            raws = [r.lower() for r in batch["raw"]]
            own = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            for some in groups_of(raws):
                held.add(raws[some])
                ids += own[some]
                if held.size >= TOKENS_HELD:
                    yield scored(ids)
                    ids = []
        if ids:
            yield scored(ids)

    return each


def score_documents(docs: DataFrame, learnt: Column, share: Column, listed: int = LISTED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lower-cased, and one end. learnt marks the training documents, share deals them to the rounds (0 to SHARES - 1).
    Null texts are empty, and have the end alone. Without training documents every word is unknown and has the same chance. Words are
    told apart by a 64-bit hash. Each row is scored, also where rows repeat.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), F.coalesce(learnt, F.lit(False)).alias("learnt"), share.alias("share"))
    counts = docs.where("learnt").select("raw").mapInPandas(count_words, "h long, c long")
    level = F.floor(F.log2("c") * 8).cast("int")
    counts = written(counts.groupBy("h").agg(F.sum("c").alias("c")))
    levels = counts.where("h IS NOT NULL").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # at most 8 * 64 rows
    least, n = 0, 0
    for row in sorted(levels, reverse=True):
        n += row["n"]
        if n > listed:
            least = row["level"] + 1
            break
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.lit(0))).first()
    tokens, distinct, ends = (int(x) for x in whole)
    top = counts.where(F.col("h").isNotNull() & (level >= least)).toPandas()  # at most listed rows
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    values = (hashes[order], top["c"].to_numpy(np.int64)[order], tokens, distinct, ends)
    lexicon = lm.Lexicon(*values)

    flat = lm.untrained(lexicon)
    back = F.pmod(F.xxhash64("raw"), F.lit(HELD_BACK)) == 0  # copies of a text together
    passes = min(MOST_PASSES, -(-LEAST_TOKENS // max(1, tokens)))
    for first, last, rate in ROUNDS if passes == 1 else ((0, SHARES, 0.1),):
        some = docs.where(F.col("learnt") & ~back & (F.col("share") >= first) & (F.col("share") < last)).select("raw")
        if passes > 1:
            some = some.coalesce(1)  # fewer than LEAST_TOKENS
        kind = "tokens long, weights binary"
        sums = some.mapInPandas(train_on(values, flat, rate, passes), kind).repartition(COMBINERS).mapInPandas(add_up, kind).collect()  # at most COMBINERS rows
        if sums:
            flat = (sum(np.frombuffer(r["weights"]) for r in sums) / sum(r["tokens"] for r in sums)).astype(np.float32)

    gain = docs.where(F.col("learnt") & back).select("raw").mapInPandas(compare(values, flat), "gain double").agg(F.sum("gain")).first()[0]
    flat = flat if gain and gain > 0 else None

    schema = "part long, at long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"
    scored = written(docs.select("doc_id", "raw").mapInPandas(score_with(values, flat), schema))
    rare = scored.select("part", "at", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("part", "at", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    others = counts.where(F.col("h").isNotNull() & (level < least))
    rare = rare.join(others, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    times = F.col("times").cast("double")
    added = rare.groupBy("part", "at").agg(
        F.sum(times * F.log10((F.col("c") + 0.1) / F.lit(tokens + 0.1 * (distinct + 1)))).alias("more_base"),
        F.sum(times * F.log10((F.col("c") + 0.1) / F.lit(float(lexicon.rare_mass)))).alias("more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"),
    )
    out = scored.drop("rare", "times").join(added, ["part", "at"], "left")
    zero = F.lit(0)
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = text_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    scored = score_documents(docs, crc % 10 != 0, F.floor(crc / 10) % SHARES)
    held_out = F.coalesce(crc % 10 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
