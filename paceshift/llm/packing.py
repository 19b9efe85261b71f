"""Packing documents into fixed windows of tokens, planned by non-negative least squares.

Lengths are planned in units of 64 tokens. A document gives whole windows, a main piece of b units, and a sliver
of under a unit. Whole windows stand alone. Main pieces are packed by combinations of up to four lengths that
fill a window exactly; how often each combination is used solves a non-negative least squares problem against
the histogram of b. The counts are rounded down; the pieces left over follow one another and are cut where a window is full.
Slivers do the same within a task. What is left at the end of a run is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceshift.llm.common import text_of, written

WINDOW = 4096
UNIT = 64
UNITS = WINDOW // UNIT
#: At most so many pieces are planned together.
DEPTH = 4
END_ID = 2
#: Words whose ids a worker keeps; then it starts anew.
KNOWN_WORDS = 600_000


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordIds(dict):
    """Ids of a word as little-endian bytes. The tokenizer splits at white space first, so words have ids of their own.

    A word of Latin letters is one piece for the tokenizer's splitter, and in composed form already; in lower case it goes to the merges directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        last, stem = word[-1:], word[:-1]
        if last in ".,;:!?" and self.plain(stem):  # a mark after letters is a token of its own
            ids = self[stem] + self[last]
        elif self.plain(word):
            lower = word.lower()
            ids = self.merge(word) if lower == word else self[lower]
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids

    @staticmethod
    def plain(word: str) -> bool:
        """Latin letters that are letters in lower case too (U+0130 becomes a letter and a mark)."""
        return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word

    def encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merge(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.merges.tokenize(letters)]).tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[str, WordIds] = {}  # one for each worker process


def shift_tables() -> np.ndarray:
    """What a CRC-32 becomes when a unit's bytes follow, by each of its four bytes: crc(a + b) = shifted crc(a) ^ crc(b)."""
    tail = bytes(UNIT * 4)
    at_zero = zlib.crc32(tail)
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        # A message's CRC can be set to any value; started from it, zeros show the linear map.
        tables[bit // 8, 1 << (bit % 8)] = zlib.crc32(tail, 1 << bit) ^ at_zero
    for value in range(256):
        for bit in range(8):
            if value != 1 << bit and value >> bit & 1:
                tables[:, value] ^= tables[:, 1 << bit]
    return tables


def joined_crc(units: bytes, tables: np.ndarray) -> int:
    """CRC-32 of units that follow one another, from the CRC-32 of each."""
    crc = 0
    for unit in np.frombuffer(units, "<u4").tolist():
        crc = int(tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]) ^ unit
    return crc


def powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


PIECES = "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, offset long, bin int, rank long, units binary"


def cut_documents(path: str):
    """Rows of PIECES: placed pieces with seq within their part, and main pieces with their rank among the part's equal lengths."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WORDS.get(path)
        if words is None:
            words = _WORDS[path] = WordIds(path)
        part = TaskContext.get().partitionId()
        end = END_ID.to_bytes(4, "little")
        seq, ranks = 0, [0] * (UNITS + 1)
        rows: list[tuple] = []
        open_, filled = [], 0  # slivers of the open sequence: doc, start, ids, doc_tokens

        def place(doc: int, start: int, ids: bytes, total: int, offset: int) -> None:
            rows.append((part, doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, None, None, None))

        def close(sizes: list[int]) -> None:
            """Cut the open slivers into sequences of these sizes."""
            nonlocal seq
            waiting = open_[::-1]
            for size in sizes:
                at = 0
                while at < size:
                    doc, start, ids, total = waiting.pop()
                    take = min(size - at, len(ids) // 4)
                    place(doc, start, ids[: take * 4], total, at)
                    if take * 4 < len(ids):
                        waiting.append((doc, start + take, ids[take * 4 :], total))
                    at += take
                seq += 1
            open_[:] = waiting[::-1]

        def frame() -> pd.DataFrame:
            names = [c.split()[0] for c in PIECES.split(", ")]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            rows.clear()
            return out.astype({c: "int64" for c in ("part", "start", "length", "ids_crc32", "doc_tokens")})

        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"], strict=True):
                ids = words.of(text) + end
                total, whole = len(ids) // 4, len(ids) // (WINDOW * 4)
                for k in range(whole):
                    place(doc, k * WINDOW, ids[k * WINDOW * 4 : (k + 1) * WINDOW * 4], total, 0)
                    seq += 1
                start = whole * WINDOW
                b = (total - start) // UNIT
                if b:
                    main = ids[start * 4 : (start + b * UNIT) * 4]
                    units = array("I", [zlib.crc32(main[i : i + UNIT * 4]) for i in range(0, len(main), UNIT * 4)]).tobytes()
                    rows.append((part, doc, start, b * UNIT, zlib.crc32(main), total, None, None, b, ranks[b], units))
                    ranks[b] += 1
                start += b * UNIT
                if start < total:
                    open_.append((doc, start, ids[start * 4 :], total))
                    filled += total - start
                    if filled >= WINDOW:
                        close([WINDOW])
                        filled -= WINDOW
                if len(rows) >= 20_000:
                    yield frame()
        close(powers(filled))
        yield frame()

    return each


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write units as two to depth lengths of at least 1, from short to long."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        low = chosen[-1] if chosen else 1
        if chosen and left >= low:
            found.append((*chosen, left))
        if len(chosen) + 2 <= depth:
            for x in range(low, left // 2 + 1):
                extend((*chosen, x), left - x)

    extend((), units)
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        gradient = np.where(active, -np.inf, a.T @ (b - a @ x))
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9 * scale:
            break
        active[best] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                break
            step = (x[low] / (x[low] - s[low] + 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12 * scale
            x[~active] = 0.0
        x = s
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; never more pieces of a length than histogram (by length, 0 to UNITS - 1) has."""
    columns = combinations()
    a = np.zeros((UNITS, len(columns)))
    for k, c in enumerate(columns):
        np.add.at(a[:, k], list(c), 1)
    times = np.floor(nonnegative_least_squares(a, histogram.astype(float)) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    chosen = []
    for k in np.argsort(-times, kind="stable"):
        if times[k] > 0:
            use = a[:, k].astype(np.int64)
            n = int(min(times[k], (left[use > 0] // use[use > 0]).min()))
            if n > 0:
                left -= n * use
                chosen.append((columns[k], n))
    return chosen


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """By length: (first rank, end, first sequence, offset in units), by rank; and the number of sequences."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for c, n in chosen:
        at = 0
        for length in c:
            runs = by_length.setdefault(length, [])
            first = runs[-1][1] if runs else 0
            runs.append((first, first + n, sequence, at))
            at += length
        sequence += n
    return by_length, sequence


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END_ID, so that an empty or null text has one id. Rows with the same doc_id are packed as
    separate documents with the same id. Sequences have WINDOW ids or a power of two of them, without padding.

    Each text is tokenized once and the pieces are written; no ids are kept but as checksums, so that a piece can be
    cut between units later. Ranks of equal lengths come from counts per task and length. The plan is made from 63 counts.
    """
    pieces = written(docs.mapInPandas(cut_documents(path), PIECES))
    counts = pieces.where("bin IS NOT NULL").groupBy("bin", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("bin", "part", "n", F.coalesce(before, F.lit(0)).alias("before")))
    histogram = np.zeros(UNITS, dtype=np.int64)
    for bin_, n in counts.groupBy("bin").agg(F.sum("n")).collect():  # at most UNITS - 1 rows
        histogram[bin_] = n
    by_length, planned = slots(plan(histogram))
    used = {b: runs[-1][1] for b, runs in by_length.items()}
    left = [int(histogram[b]) - used.get(b, 0) for b in range(UNITS)]
    first_unit = np.concatenate([np.cumsum([n * b for b, n in enumerate(left)][::-1])[::-1][1:], [0]])  # long ones first
    units_left = sum(n * b for b, n in enumerate(left))
    full = units_left // UNITS * UNITS
    ends = [full]  # where the last, partial window is cut
    for p in powers(units_left - full):
        ends.append(ends[-1] + p)
    tables = shift_tables()
    out_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = (batch[c].tolist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank", "units"))
            for doc, start, length, crc, total, b, rank, units in zip(*columns, strict=True):
                runs = by_length.get(b, [])
                if rank < used.get(b, 0):
                    low, high = 0, len(runs) - 1
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (low, middle) if rank < runs[middle][1] else (middle + 1, high)
                    first, _, sequence, at = runs[low]
                    rows.append((doc, start, length, crc, total, sequence + rank - first, at * UNIT))
                    continue
                at = int(first_unit[b]) + (rank - used.get(b, 0)) * b
                done = 0
                while done < b:
                    if at < full:
                        sequence, base, stop = at // UNITS, at // UNITS * UNITS, (at // UNITS + 1) * UNITS
                    else:
                        k = next(i for i in range(1, len(ends)) if at < ends[i])
                        sequence, base, stop = full // UNITS + k - 1, ends[k - 1], ends[k]
                    take = min(b - done, stop - at)
                    part_crc = crc if take == b else joined_crc(units[done * 4 : (done + take) * 4], tables)
                    rows.append((doc, start + done * UNIT, take * UNIT, part_crc, total, planned + sequence, (at - base) * UNIT))
                    done += take
                    at += take
            yield pd.DataFrame(rows, columns=out_names)

    main = pieces.where("bin IS NOT NULL").join(counts.select("bin", "part", "before"), ["bin", "part"])
    main = main.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("rank") + F.col("before")).alias("rank"), "units")
    placed = main.mapInPandas(place, ", ".join(f"{c} long" for c in out_names))
    # Two number ranges: odd for planned sequences, even for those that one task filled by itself.
    alone = pieces.where("bin IS NULL").select(*out_names[:5], ((F.col("part") * (1 << 36) + F.col("seq")) * 2).alias("sequence_id"), "offset")
    return alone.union(placed.withColumn("sequence_id", F.col("sequence_id") * 2 + 1))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(text_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("word_bpe_49k.json"))
