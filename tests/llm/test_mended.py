"""Rows without ids, ids and copies that repeat very often, and models against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge_cases import edge_rows, prose
from pyspark.sql import functions as F

from paceshift.llm import lm_scoring, mixing, quality, simhash, suffix_dedup
from paceshift.llm.common import text_of
from paceshift.llm.queries import QUERIES


def spark_hash(text, seed=42):
    return xxhash.xxh64(text.encode(), seed=seed & ((1 << 64) - 1)).intdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_fit_rows_are_bounded_where_an_id_repeats(spark):
    """100,000 rows share a labelled id: one of them is used."""
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    docs = docs.union(spark.createDataFrame([(2, "other words here"), (None, "no id"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    one = min((signed(spark_hash(f"text {k}")), f"text {k}") for k in range(7))[1]
    rows = np.array([quality.statistics(t) for t in (one, "other words here", "")])
    order = np.lexsort(rows.T)
    want = quality.fit(rows[order], np.array([1, 0, 0])[order])
    assert np.array_equal(model.middle, want.middle) and np.array_equal(model.spread, want.spread)
    assert quality.train(docs, labels, fit_rows=1).middle.shape == (len(quality.STATISTICS),)


def test_quality_scores_against_plain_numpy(spark, edge_dir):
    labels = {(r.doc_id, r.quality) for r in spark.read.parquet(f"{edge_dir}/labels.parquet").collect()}
    texts = {}
    for i, t, *_ in edge_rows():
        texts[i] = min(texts.get(i, (1 << 63, "")), (signed(spark_hash(t or "")), t or ""))
    fit = [(q, texts[i][1]) for i, q in labels if i in texts and q in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.statistics(t) for _, t in fit]), np.array([q for q, _ in fit])
    middle, spread = np.median(x, axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - middle) / spread, -quality.REACH, quality.REACH)
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)

    def density(row, c):
        s = (1 - quality.POOLED - quality.RIDGE) * np.cov(z[y == c].T, bias=True) + quality.POOLED * pooled
        s += quality.RIDGE * (np.trace(pooled) / len(s) + 1e-6) * np.eye(len(s))
        away = row - z[y == c].mean(axis=0)
        return np.log(((y == c).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * away @ np.linalg.solve(s, away)

    want = Counter()
    for i, t, *_ in edge_rows():
        row = np.clip((np.array(quality.statistics(t or "")) - middle) / spread, -quality.REACH, quality.REACH)
        want[i, round(float(1 / (1 + np.exp(np.clip(density(row, 0) - density(row, 1), -700, 700)))), 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in QUERIES["op8_quality"](spark, edge_dir).collect()) == want


def test_repeats_in_rows_without_ids(spark):
    """A third of the rows has no id and a third one id; both are spread over the blocks, and results are as by the definition."""
    r = random.Random(6)
    passages = [prose(30, 900 + k) for k in range(12)]
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, " ".join(r.choice(passages) for _ in range(3)) + f" {n}") for n in range(150)]
    last = 1 << 63
    first = {}
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - 49):
            key = last if i is None else i
            first[raw[p : p + 50]] = min(key, first.get(raw[p : p + 50], key))
    want = Counter()
    for i, t in rows:
        raw, key = t.encode(), last if i is None else i
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key:
                gone[p : p + 50] = b"\1" * 50
        want[i, bytes(c for c, g in zip(raw, gone, strict=True) if not g)] += 1
    got = suffix_dedup.remove_repeats(text_of(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter((x.doc_id, bytes(x.kept)) for x in got.collect()) == want


def plain_fingerprint(text):
    words = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    votes, total = [0] * 64, 0
    for a, b in zip(words, [*words[1:], ""], strict=True):
        weight = min(4, 1 + (len(a) + len(b)) // 6) if a else 0
        h = spark_hash(b, spark_hash(a))
        total += weight
        for k in range(64):
            votes[k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_fingerprints_against_plain_votes_and_with_many_copies(spark):
    texts = [prose(n, n) for n in (1, 2, 30, 200)] + ["", "  ", "é \U0001f600 x" * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[3])] * 3000 + [(None, texts[2])] * 5 + [(51, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.fingerprint_edits(docs).collect()
    assert Counter((x.doc_id, x.fingerprint) for x in got) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t in rows)
    copies = [x for x in got if x.doc_id == 50]
    assert len(copies) == 3000 and {x.n_within for x in copies} == {3000 + 1}
    assert Counter(x.near_next == 1.0 for x in copies) == {True: 3000}


def test_votes_of_copies_stay_within_their_counters(spark):
    """Of equal rows one votes: the sums are those of one row, however many there are."""
    docs = spark.createDataFrame([(1, "long words carry more votes here")] * 500 + [(2, "another")], "doc_id long, text string")
    seen = []
    kept = simhash.fingerprints
    simhash.fingerprints = lambda rows, keys, text: seen.append(rows) or kept(rows, keys, text)
    try:
        simhash.fingerprint_edits(docs).collect()
    finally:
        simhash.fingerprints = kept
    # The first and the last of the equal rows and the other one, as they are and edited.
    assert seen[0].where("body <> ''").count() == 6


def test_mix_of_many_sources_and_of_rows_without_ids(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"), (F.col("id") % 90 + 1).alias("size"), F.col("id").cast("string").alias("tie"))
    targets = mixing.source_targets(docs, (5, 2, 1), 3.0).collect()
    sizes = {f"s{k}": sum(i % 90 + 1 for i in range(k, 20_000, 5000)) for k in range(5000)}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))}
    target, open_ = {}, set(sizes)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} or {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    assert {t.source: t.target for t in targets} == pytest.approx(target)
    plan = mixing.source_targets(docs, (5, 2, 1), 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    taken = mixing.mix(docs.withColumn("source", F.lit("one"))).where("doc_id IS NULL")
    assert taken.agg(F.countDistinct("copies")).first()[0] == 1  # one source, so all are taken once
    half = mixing.mix(docs.withColumn("source", F.when(F.col("tie").cast("long") % 2 == 0, "a").otherwise("b")))
    assert half.where("doc_id IS NULL").groupBy("copies").count().count() > 1  # rows without an id are not all taken alike


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_language_model_beats_its_base(spark, folder):
    got = lm_scoring.query(spark, folder).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()
    assert len(got) == 2 and all(r.score > r.base + 0.1 for r in got)


def test_repeats_do_not_depend_on_blocks_parts_and_tasks(spark, monkeypatch):
    r = random.Random(12)
    passages = ["".join(r.choice("abc ") for _ in range(r.randint(40, 160))) for _ in range(8)]
    texts = [(i * 11 % 120 if i % 3 else None, "".join(r.choice(passages)[r.randint(0, 30) :] for _ in range(4))) for i in range(120)]
    docs = text_of(spark.createDataFrame(texts, "doc_id long, text string"))
    one = sorted(suffix_dedup.remove_repeats(docs).collect(), key=str)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 512)
    monkeypatch.setattr(suffix_dedup, "NAMES_BYTES", 4096)
    monkeypatch.setattr(suffix_dedup, "TASKS", 9)
    many = suffix_dedup.remove_repeats(docs)
    assert sorted(many.collect(), key=str) == one
    assert sum(x.n_removed for x in one) > 0
