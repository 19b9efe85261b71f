"""Phrases whose words keep together, by dynamic itemset counting over shards.

The documents are dealt into shards, which are scanned in a cycle. Single words are counted from the first shard on. A longer phrase becomes active at
the first shard boundary where both its parts, without the last and without the first word, have reached the threshold, is counted
from there through one full cycle of shards, and then is done. So the scans of lengths one, two and three
interleave. A phrase that reaches the threshold has parts that reach it too, so none is missed.

When a phrase becomes active must be known where its words are read. Each phrase has a cell, by its hash, and a board holds the
boundary at which the first phrase of each cell reached the threshold. A phrase is active from the latest of the cells of its parts, and of their parts, on. Boards
have a fixed size. The counters of active phrases are kept by hash, in parts of arrays that are merged after each shard; those that are done are dropped.

Phrases that share a hash or a cell can only make more phrases candidates, never fewer. So the cells that reached the threshold hold every
frequent phrase, and a last scan counts the phrases of these cells as text, which gives exact counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceshift.llm.common import parts_for, removed, stored, tasks
from paceshift.llm.shingles import mix, powers
from paceshift.operators.reuse import join_small, shared_folder

THRESHOLD, LONGEST, TOP = 10, 3, 2000
#: Share of a phrase's count that a longer one must have to replace it, in percent.
INSIDE = 50
SHARDS = 4
#: Cells of a board; a byte each.
CELL_BITS = 23
NEVER = 255
#: Bytes of text that a worker looks at once; longer texts are cut between words.
SLICE = 2 << 20
#: Bytes of text whose phrases share a part, and different phrases that a worker counts before it passes them on.
PART_BYTES, HELD = 32 << 20, 1 << 21
#: Fixed values, as the query defines them: ends of pieces, and letters that are lower-cased.
ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes(ord(".") if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAK = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")

COUNTERS = "part long, size int, keys binary, counts binary, starts binary"
NAMES = "size int, lang string, phrase string, n long"


def slices(raw: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A text in slices that begin with the last words of the piece before, as many as a phrase can reach back over, and the number of these words."""
    at, head, carried = 0, b"", 0
    while len(raw) - at > most:
        found = BREAK.search(raw, at + most)
        stop = found.start() if found else len(raw)
        part = head + raw[at:stop]
        yield part, carried
        words = part.translate(PLAIN).rpartition(b".")[2].split()[1 - LONGEST :]
        at, head, carried = stop, b" ".join(words), len(words)
    yield head + raw[at:], carried


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], list[bytes], int]]:
    """(langs, texts, carried words) of about most bytes; only a slice of a long text, alone, has carried words."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = raw.as_py()
            if len(text) > most:
                yield from (([lang], [part], carried) for part, carried in slices(text, most))
                continue
            langs.append(lang)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield langs, texts, 0
                langs, texts, size = [], [], 0
    yield langs, texts, 0


def seeds_of(langs: list[str]) -> np.ndarray:
    return mix(np.fromiter((zlib.crc32(lang.encode()) for lang in langs), np.uint64, len(langs)))


def words_of(texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the piece) of each word of some texts, seeded by text, without a Python object for each."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(PLAIN), np.uint8)  # an end between texts
    end = raw == ord(".")
    word = ~(end | (raw == 32) | (raw == 9))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begins, lengths = edge[0::2], edge[1::2] - edge[0::2]
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(word)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[np.arange(len(inside)) - np.repeat(first, lengths)]
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))))
    return mix(mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)) + seeds[text]), np.cumsum(end)[begins]


def longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases, from those of the phrases without their last word and of these words."""
    return mix(left * np.uint64(3) + right)


def cells_of(hashes: np.ndarray, board: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(len(board) - 1)).astype(np.int64)


def active_phrases(texts: list[bytes], seeds: np.ndarray, carried: int, step: int, shards: int, boards: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash, boundary from which it is counted) of each occurrence of a phrase that is active in this step."""
    words, piece = words_of(texts, seeds)
    if step < shards:
        yield 1, words[carried:], np.zeros(len(words) - carried, np.uint8)
    reached = boards[0][cells_of(words, boards[0])]
    start = np.maximum(reached[:-1], reached[1:])  # NEVER is the largest
    start[piece[:-1] != piece[1:]] = NEVER
    at = np.flatnonzero(start != NEVER)
    hashes = longer(words[at], words[at + 1])
    now = (start[at] <= step) & (step < start[at].astype(int) + shards) & (at + 1 >= carried)
    yield 2, hashes[now], start[at[now]]
    # Other pairs may have reached a pair's cell before its own words did; till then the pair is not seen here.
    reached = np.maximum(boards[1][cells_of(hashes, boards[1])], start[at])
    next_to = np.flatnonzero(at[:-1] + 1 == at[1:])
    start = np.maximum(reached[next_to], reached[next_to + 1])
    now = (start != NEVER) & (start <= step) & (step < start.astype(int) + shards) & (at[next_to] + 2 >= carried)
    yield 3, longer(hashes[next_to[now]], words[at[next_to[now]] + 2]), start[now]


class Tally:
    """Counters of one length: different hashes in order, their counts and the boundaries from which they count."""

    def __init__(self):
        self.hashes, self.counts, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> None:
        hashes, counts, starts = np.concatenate([self.hashes, hashes]), np.concatenate([self.counts, counts]), np.concatenate([self.starts, starts])
        if len(hashes):
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            self.hashes, self.counts, self.starts = hashes[heads], np.add.reduceat(counts[order], heads), np.maximum.reduceat(starts[order], heads)


def counted(shard: DataFrame, step: int, shards: int, parts: int, boards) -> DataFrame:
    """Counters of the active phrases in a shard (lang, raw), by part; phrases of a task are combined."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {size: Tally() for size in (1, 2, 3)}
        waiting: dict[int, list] = {size: [] for size in tallies}

        def combine() -> None:
            for size, found in waiting.items():
                if found:
                    hashes, starts = (np.concatenate(x) for x in zip(*found, strict=True))
                    tallies[size].add(hashes, np.ones(len(hashes), np.int64), starts)
                    found.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            combine()
            for size, tally in tallies.items():
                part = ((tally.hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                columns = [tally.hashes[order].astype("<u4"), np.minimum(tally.counts[order], 65535).astype("<u2"), tally.starts[order]]
                edges = np.concatenate([np.flatnonzero(np.diff(part[order], prepend=-1)), [len(order)]])
                rows = [(int(part[order[a]]), size, *(c[a:b].tobytes() for c in columns)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 1024], strict=True)], COUNTER_NAMES).cast(COUNTER_TYPES) for i in range(0, len(rows), 1024))
                tallies[size] = Tally()

        for langs, texts, carried in groups(batches, SLICE):
            for size, hashes, starts in active_phrases(texts, seeds_of(langs), carried, step, shards, boards.value):
                waiting[size].append((hashes, starts))
            if sum(len(h) for found in waiting.values() for h, _ in found) >= HELD:
                combine()
            if sum(len(t.hashes) for t in tallies.values()) >= 2 * HELD:
                yield from flush()
        yield from flush()

    return shard.mapInArrow(each, COUNTERS)


COUNTER_NAMES = [c.split()[0] for c in COUNTERS.split(", ")]
COUNTER_TYPES = pa.schema(list(zip(COUNTER_NAMES, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)))


def merged(step: int, shards: int, threshold: int):
    """The counters of a part after a step: those still counting, and as a row with no counts the keys of those that have reached the threshold."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, own in rows.groupby("size"):
            tally = Tally()
            keys, counts, starts = (np.frombuffer(b"".join(own[c]), kind) for c, kind in (("keys", "<u4"), ("counts", "<u2"), ("starts", "u1")))
            tally.add(keys.astype(np.uint64), counts.astype(np.int64), starts)
            found = tally.hashes[tally.counts >= threshold]
            if len(found):
                out.append((key[0], size, found.astype("<u4").tobytes(), None, None))
            left = tally.starts.astype(int) + shards > step + 1
            if left.any():
                out.append((key[0], size, tally.hashes[left].astype("<u4").tobytes(), np.minimum(tally.counts[left], 65535).astype("<u2").tobytes(), tally.starts[left].tobytes()))
        return pd.DataFrame(out, columns=COUNTER_NAMES)

    return each


def reached_cells(state: DataFrame, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, cells) that hold a phrase which reached the threshold. Cells travel as bits of 64-bit words, so the driver gets no more than a board has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.unique(np.frombuffer(raw.as_py(), "<u4") & np.uint32(cells - 1))
                heads = np.flatnonzero(np.diff(found >> 6, prepend=-1))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (found & np.uint32(63)).astype(np.uint64), heads)
                at = (found[heads] >> 6).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(bits.view(np.int64))], ["size", "at", "bits"])

    words = state.where("counts IS NULL").select("size", "keys").mapInArrow(each, "size int, at int, bits long")
    found = words.groupBy("size", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    size, at, bits = (found[c].to_numpy() for c in ("size", "at", "bits"))
    for k in np.unique(size).tolist():
        board = np.zeros(-(-cells // 64), np.int64)
        board[at[size == k]] = bits[size == k]
        yield k, np.flatnonzero(np.unpackbits(board.view(np.uint8), bitorder="little"))


class Vocabulary(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tally_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different codes, place of each code among them, how often each occurs)."""
    return np.unique(codes, return_inverse=True, return_counts=True)


def named_phrases(lang: str, texts: list[bytes], carried: int, boards: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, phrases, counts) of all phrases of some texts in cells that reached the threshold; size 0 has the number of words."""
    number = Vocabulary()
    ids = np.array([number[w] for w in b" . ".join([t.translate(PLAIN).replace(b".", b" . ") for t in texts]).split()], np.int64)
    if len(number) == 1:
        return
    words = list(number)
    v = len(words)
    names = pa.array(words, pa.binary())
    hashes = np.concatenate([np.zeros(1, np.uint64), words_of([b" ".join(words[1:])], seeds_of([lang]))[0]])
    known = boards[0][cells_of(hashes, boards[0])] != NEVER
    known[0] = False
    counts = np.bincount(ids[carried:], minlength=v)
    yield 0, pa.array([b""]), np.array([counts[1:].sum()])
    yield 1, names.filter(pa.array(known)), counts[known]
    at = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
    codes, place, _ = tally_of(ids[at] * v + ids[at + 1])
    first, second = codes // v, codes % v
    pairs = longer(hashes[first], hashes[second])
    known = boards[1][cells_of(pairs, boards[1])] != NEVER
    counts = np.bincount(place[at + 1 >= carried], minlength=len(codes))
    keep = np.flatnonzero(known & (counts > 0))
    yield 2, pc.binary_join_element_wise(names.take(pa.array(first[keep])), names.take(pa.array(second[keep])), b" "), counts[keep]
    pair = np.full(len(ids), -1, np.int64)
    pair[at] = np.where(known, np.arange(len(codes)), -1)[place]
    at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    at = at[at + 2 >= carried]
    codes, _, counts = tally_of(pair[at] * max(1, len(first)) + pair[at + 1])
    before, last = codes // max(1, len(first)), second[codes % max(1, len(first))]
    keep = boards[2][cells_of(longer(pairs[before], hashes[last]), boards[2])] != NEVER
    before, last = before[keep], last[keep]
    yield 3, pc.binary_join_element_wise(*[names.take(pa.array(x)) for x in (first[before], second[before], last)], b" "), counts[keep]


def named(docs: DataFrame, boards) -> DataFrame:
    """(size, lang, phrase, n) of the phrases in cells that reached the threshold, some of them several times; size 0 for all words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts, carried in groups(batches, 4 * SLICE):
            for lang in dict.fromkeys(langs):
                for size, phrases, counts in named_phrases(lang, [t for t, x in zip(texts, langs, strict=True) if x == lang], carried, boards.value):
                    columns = [pa.array(np.full(len(phrases), size, np.int32)), pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())]
                    whole = pa.RecordBatch.from_arrays(columns, ["size", "lang", "phrase", "n"])
                    yield from (whole.slice(i, 1 << 16) for i in range(0, len(phrases), 1 << 16))

    return docs.mapInArrow(each, NAMES)


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, cell_bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, n) of the phrases of up to three words that occur threshold times or more, (lang, n) of all words), both exact.

    docs has (lang, text); null texts are empty and null langs are "und". Every row counts, copies too. Runs jobs when called; tables are in the shared folder.
    """
    if not 1 <= threshold < 65536 or not 0 < LONGEST * shards < NEVER:
        raise ValueError("threshold or shards out of range")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    dealt = given.withColumn("shard", F.floor(F.rand(17) * shards).cast("int"))  # at random, so that copies too are spread
    dealt.write.partitionBy("shard").parquet(f"{folder}/shards")
    whole = spark.read.schema(dealt.schema).parquet(f"{folder}/shards")
    parts = parts_for(whole, F.octet_length("raw"), PART_BYTES, 2 * tasks(spark))
    boards = [np.full(1 << cell_bits, NEVER, np.uint8) for _ in range(LONGEST)]
    state, last, step = None, shards, 0
    while step < last:
        sent = spark.sparkContext.broadcast(boards[:-1])
        new = counted(whole.where(F.col("shard") == step % shards).select("lang", "raw"), step, shards, parts, sent)
        both = new if state is None else new.unionByName(state.where("counts IS NOT NULL"))
        state = stored(both.groupBy("part").applyInPandas(merged(step, shards, threshold), COUNTERS), f"{folder}/state{step}")
        step += 1
        for size, found in reached_cells(state, 1 << cell_bits):
            fresh = found[boards[size - 1][found] == NEVER]
            boards[size - 1][fresh] = step
            last = max(last, step + shards) if size < LONGEST and len(fresh) else last
        if step > 1:
            removed(spark, f"{folder}/state{step - 2}")
        sent.destroy()
    counts = named(whole.select("lang", "raw"), spark.sparkContext.broadcast(boards)).groupBy("size", "lang", "phrase").agg(F.sum("n").alias("n"))
    counts = stored(counts.where((F.col("size") == 0) | (F.col("n") >= threshold)), f"{folder}/phrases")
    removed(spark, f"{folder}/state{step - 1}")
    removed(spark, f"{folder}/shards")
    return counts.where("size > 0").select("lang", "size", "phrase", "n"), counts.where("size = 0").select("lang", "n")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, inside: int = INSIDE, top: int = TOP, shards: int = SHARDS, cell_bits: int = CELL_BITS) -> DataFrame:
    """The first top phrases of two and three words of each language by how much their parts keep together: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its parts at the worst cut, n all words of the language. Phrases that a longer one holds in inside percent of their
    occurrences or more are left out. Ties go by a, then phrase in byte order; repeated rows count again. Null and empty texts have no words.
    """
    return scored(*frequent_phrases(docs, threshold, shards, cell_bits), inside, top)


def scored(found: DataFrame, words: DataFrame, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The ranking of collocations() from the counts of frequent phrases and of all words. The products of counts are decimals of 38 digits."""
    known = found.select("lang", "phrase", F.col("n").alias("f"))
    parts = F.split("phrase", " ")
    phrases = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    spread = F.xxhash64("phrase")
    cuts = []
    for size in range(2, LONGEST + 1):
        sized = phrases.where(F.col("size") == size)
        for k in range(1, size):
            cut = sized.withColumns({"left": F.concat_ws(" ", F.slice(parts, 1, k)), "right": F.concat_ws(" ", F.slice(parts, k + 1, size))})
            cut = join_small(cut, known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"], spread, salts=1)
            cut = join_small(cut, known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"], spread, salts=1)
            cuts.append(cut.select("lang", "size", "phrase", "a", F.lit(k).alias("k"), "l", "r"))
    cut = cuts[0]
    for other in cuts[1:]:
        cut = cut.unionByName(other)
    exact = "cast(1000000 AS decimal(7)) * (cast(a AS decimal(15)) * cast(a AS decimal(15))) div (cast(l AS decimal(18)) * cast(r AS decimal(18)))"
    cut = cut.withColumn("score", F.expr(exact).cast("long"))
    worst = cut.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    longest = phrases.where(F.col("size") == LONGEST)
    held = [longest.select("lang", F.concat_ws(" ", F.slice(parts, i, LONGEST - 1)).alias("phrase"), F.col("a").alias("whole")) for i in (1, 2)]
    held = held[0].unionByName(held[1]).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (F.lit(100) * F.col("whole") < F.lit(inside) * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.join(F.broadcast(words), "lang")  # a row for each language
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    phrases AS (
        SELECT lang, 1 AS size, unnest(w) AS phrase FROM listed
        UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM listed
        UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM listed),
    f AS (SELECT lang, size, phrase, count(*) AS n FROM phrases GROUP BY ALL),
    words AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
    cuts AS (
        SELECT lang, size, phrase, a, unnest(range(1, size)) AS k, array_to_string(w[:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM candidates),
    scored AS (
        SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
        FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = one JOIN f AS y ON y.lang = cuts.lang AND y.phrase = two),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (
        SELECT lang, phrase, max(a) AS whole
        FROM (SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM candidates WHERE size = 3
              UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM candidates WHERE size = 3)
        GROUP BY ALL),
    kept AS (
        SELECT worst.* FROM worst LEFT JOIN held USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < 50 * a)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, kept.phrase) AS rank, kept.phrase, a, l, r, words.n, score
    FROM kept JOIN words USING (lang) QUALIFY rank <= 2000"""
