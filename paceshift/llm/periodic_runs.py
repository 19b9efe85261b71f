"""Periodic runs of words, by a suffix automaton whose link tree is a link-cut tree.

Words are appended one by one. After each, all suffixes of the text so far end at the new word: these are the states
on the path from the newest state to the root of the link tree, and an access of the link-cut tree recolours that path
with the new end. The path falls into the segments that earlier accesses left, each with one colour, the end of
the last earlier occurrence of its states. Where a segment's longest state, of L words, ended before at a distance
p <= L, the last L + p words have smallest period p: a square, and L says how far it reaches to the left. A later end of
the same stretch extends it to the right, so that after the last word each run is known once.

A run of at least 12 words with period q has max(12 - q, q) >= 6 places in a row that agree with the place q words on. So
every word of a run lies in a string of six words that its text has twice, and a run lies in a stretch of such words. The
automaton is built over these stretches; all other words cannot be part of a run.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import WORD, text_of
from paceshift.llm.shingles import MULTIPLIER, mix

MIN_LENGTH = 12
#: Words of a stretch from which on the automaton's tables are arrays of four-byte numbers, a tenth of the size of lists and somewhat slower.
LONG = 1 << 17
#: Words of which a worker looks for repeated strings at once.
CHUNK = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class LinkCutAutomaton:
    """Suffix automaton of the words appended so far. States are numbered from 1, the root; 0 is none.

    left, right and up make the splay trees of the preferred paths, by depth; up of a splay tree's root is the state above its path. The colour
    of a path, the last end of its states, is kept at the root of its splay tree. Most states have one successor, kept in two tables; others
    have the rest in a dictionary.
    """

    def __init__(self, words: int):
        size = 2 * words + 3
        zeros = (lambda: [0] * size) if words < LONG else (lambda: array("i", bytes(4 * size)))
        self.length, self.link, self.word, self.to, self.left, self.right, self.up, self.colour = (zeros() for _ in range(8))
        self.more: dict[int, dict[int, int]] = {}
        self.states = self.last = 1
        self.ends = 0  # words appended; a colour is a number of words, so 0 is none

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        root = y
        while True:
            z = up[root]
            if not z or (left[z] != root and right[z] != root):
                break
            root = z
        self.colour[x] = self.colour[root]
        while y:
            z = up[y]
            below = x == left[y]
            if not below and x != right[y]:
                return
            if z and (left[z] == y or right[z] == y):
                # Two steps: the upper one first where both go the same way.
                top = up[z]
                if below == (left[z] == y):
                    if below:
                        a, b = right[y], right[x]
                        left[z], right[y], left[y], right[x] = a, z, b, y
                    else:
                        a, b = left[y], left[x]
                        right[z], left[y], right[y], left[x] = a, z, b, y
                    up[z], up[y] = y, x
                    if a:
                        up[a] = z
                    if b:
                        up[b] = y
                else:
                    if below:
                        a, b = right[x], left[x]
                        left[y], right[z], right[x], left[x] = a, b, y, z
                    else:
                        a, b = left[x], right[x]
                        right[y], left[z], left[x], right[x] = a, b, y, z
                    up[y] = up[z] = x
                    if a:
                        up[a] = y
                    if b:
                        up[b] = z
                y = up[x] = top
                if top:
                    if left[top] == z:
                        left[top] = x
                    elif right[top] == z:
                        right[top] = x
            else:
                if below:
                    a = left[y] = right[x]
                    right[x] = y
                else:
                    a = right[y] = left[x]
                    left[x] = y
                if a:
                    up[a] = y
                up[y], up[x] = x, z
                return

    def after(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (0, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def append(self, word: int) -> list[tuple[int, int]]:
        """Append a word (above 0). Returns (end, L) for each segment of the recoloured path, the longest suffix of L words that ended after end words before."""
        length, link = self.length, self.link
        state, self.states = self.last, self.states + 1
        new = self.states
        length[new] = length[state] + 1
        while state and not (found := self.after(state, word)):
            self.lead(state, word, new)
            state = link[state]
        if not state:
            link[new] = 1
        elif length[state] + 1 == length[found]:
            link[new] = found
        else:
            link[new] = self.split(state, word, found)
        self.last = new
        self.up[new] = link[new]
        return self.access(new)

    def split(self, state: int, word: int, found: int) -> int:
        """A copy of found for its shorter strings, in the tree just above found and with found's colour."""
        self.states += 1
        copy = self.states
        self.length[copy] = self.length[state] + 1
        self.word[copy], self.to[copy] = self.word[found], self.to[found]
        if found in self.more:
            self.more[copy] = dict(self.more[found])
        self.link[copy], self.link[found] = self.link[found], copy
        self.splay(found)
        above = self.left[copy] = self.left[found]
        if above:
            self.up[above] = copy
        self.left[found], self.up[copy] = copy, found
        while state and self.after(state, word) == found:
            self.lead(state, word, copy)
            state = self.link[state]
        return copy

    def access(self, state: int) -> list[tuple[int, int]]:
        right, up, colour, length = self.right, self.up, self.colour, self.length
        self.ends += 1
        segments, below = [], 0
        while state:
            self.splay(state)
            end = colour[state]
            if end:
                segments.append((end, length[state]))
            rest = right[state]
            if rest:
                colour[rest] = end  # what hangs below leaves the path and keeps its colour
            right[state] = below
            below, state = state, up[state]
        colour[below] = self.ends
        return segments


def runs_of(words: list[int], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbers above 0, by start and period."""
    automaton = LinkCutAutomaton(len(words))
    append, found = automaton.append, {}
    for i, word in enumerate(words, 1):
        for end, reach in append(word):
            period = i - end
            if reach >= period:
                found[i - reach - period, period] = i
    return sorted((start, end - start, period) for (start, period), end in found.items() if end - start >= max(least, 2 * period))


def stretches(ids: np.ndarray, docs: np.ndarray, width: int = MIN_LENGTH // 2) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words covered by strings of width words that their document has twice. ids and docs run over the words of several documents, one after another."""
    n = len(ids) - width + 1
    if n < 2:
        return []
    h = docs[:n].astype(np.uint64) * MULTIPLIER
    for k in range(width):
        h = mix(h + ids[k : k + n].astype(np.uint64))
    whole = np.flatnonzero(docs[:n] == docs[width - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = np.concatenate([[False], h[order[1:]] == h[order[:-1]], [False]]) if len(order) else np.zeros(1, bool)
    starts = np.sort(order[same[1:] | same[:-1]])
    if not len(starts):
        return []
    # Strings that overlap or touch within a document make one stretch.
    cut = np.flatnonzero((np.diff(starts) > width) | (np.diff(docs[starts]) != 0)) + 1
    edges = np.concatenate([[0], cut, [len(starts)]])
    return [(int(starts[a]), int(starts[b - 1]) + width) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Numbers(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def runs_of_documents(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = [len(t) for t in texts]
    number = Numbers()
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, sum(sizes))
    docs = np.repeat(np.arange(len(texts)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, end in stretches(ids, docs):
        if end - first >= MIN_LENGTH:
            doc = int(docs[first])
            out[doc] += [(start + first - int(begins[doc]), length, period) for start, length, period in runs_of(ids[first:end].tolist())]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, runs (array of start, length, period by start, then period) and collapsed, the text without repeats.

    Null texts are empty and have no runs. Rows are judged alone, so repeated rows and ids give equal rows, and ids may be null. Nothing is shuffled; a worker holds
    one chunk of texts, and for a stretch of repeated words about 80 bytes a word, and more for words that several words follow.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0), batch.column(1)
            first, size = 0, 0
            texts: list[list[bytes]] = []
            for i in range(len(batch)):
                texts.append(raws[i].as_py().split())  # at ASCII white space, as WORD
                size += len(texts[-1])
                if size >= CHUNK or i == len(batch) - 1:
                    found = runs_of_documents(texts)
                    rows = [[{"start": a, "length": b, "period": c} for a, b, c in runs] for runs in found]
                    short = [collapsed(words, runs) for words, runs in zip(texts, found, strict=True)]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([ids.slice(first, i + 1 - first), pa.array(rows, kind), pa.array(short, pa.binary())], ["doc_id", "runs", "raw"])
                    first, size, texts = i + 1, 0, []

    found = text_of(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(each, f"doc_id long, runs {RUNS}, raw binary")
    return found.select("doc_id", "runs", F.col("raw").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten by the id's crc32 repeats its words from some word on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = text_of(docs).withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    marked = marked.withColumn("words", words).withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    marked = marked.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))

    def word(x: Column, i: Column) -> Column:
        away = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get("words", away.cast("int"))

    planted = F.array_join(F.transform("words", word), " ")
    return marked.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # The greatest length; among equal ones the smallest start, then period.
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.expr("1000L * -top.less div top.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
