"""Removal of byte strings that an earlier document has, by sorted suffixes.

A string of LENGTH bytes is removed from a document if it also starts in a document with a smaller id. Only
suffixes that start at anchors are sorted: of the ANCHOR-byte strings in each string of LENGTH bytes, the one with the
smallest hash is an anchor, so equal strings have the same anchor at the same place. Anchors that only one document
has are dropped. The others, with the bytes around them that a string of LENGTH bytes around the anchor can reach, are put in
order by deep-shallow sorting, to the right of the anchor and to its left; common prefixes of neighbours then
tell which strings around the anchor an earlier document has.

Documents are dealt into blocks, and blocks, not documents, exchange what they know about an anchor: each
block names an anchor or a context once, for its smallest id, however many documents of the block have it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import tasks, text_of
from paceshift.llm.shingles import MULTIPLIER, mix
from paceshift.llm.suffix_sort import common_prefixes, deep_shallow_order

LENGTH, ANCHOR = 50, 24
LEFT = LENGTH - ANCHOR  # bytes before an anchor that a string around it can reach
WIDTH = LEFT + LENGTH
BLOCK_BYTES = 8 << 20
#: Anchors are compared by hash in parts of the anchors of about so many bytes of text.
NAMES_BYTES = 64 << 20
#: Blocks and parts are dealt to one task each, up to TASKS tasks; beyond that a task takes several, one after the other.
TASKS = 16_384
#: Documents with an anchor from which on it is dealt out by the strings around it, as one part could not hold its contexts.
CROWDED = 20_000
SLICE = 1 << 20


def anchors(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts that lie end to end; text i is buffer[starts[i]:starts[i + 1]]."""
    places, hashes = [], []
    sizes = np.diff(starts)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE, side="right")) - 1)
        low, high = int(starts[first]), int(starts[last])
        if high - low >= LENGTH:
            p, h = anchors_of_slice(buffer[low:high], starts[first : last + 1] - low)
            places.append(p + low)
            hashes.append(h)
        first = last
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of width values."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def anchors_of_slice(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buffer)
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for o in range(8):
        some = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        eight[o::8] = some[: len(eight[o::8])]
    m = n - ANCHOR + 1
    h = eight[:m] * MULTIPLIER
    h += eight[8 : m + 8]
    h *= np.uint64(0xE7037ED1A0B428DB)
    h += eight[16 : m + 16]
    h += np.uint64(0xA24BAED4963EE407)  # zeros too are scrambled
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    high = (h >> np.uint64(32)).astype(np.uint32)
    np.maximum(high, 1, out=high)  # 0 is below all hashes: no whole string starts there
    lowest = slide(high, LEFT + 1, np.minimum)  # of the anchors in the string that starts here
    whole = np.zeros(len(lowest) + 1, np.int32)  # strings that lie in one text
    fits = np.diff(starts) >= LENGTH
    np.add.at(whole, starts[:-1][fits], 1)
    np.add.at(whole, starts[1:][fits] - LENGTH + 1, -1)
    lowest = np.where(np.cumsum(whole[:-1]) > 0, lowest, 0)
    edge = np.zeros(LEFT, np.uint32)
    chosen = slide(np.concatenate([edge, lowest, edge]), LEFT + 1, np.maximum)
    places = np.flatnonzero(high == chosen)
    return places, mix(h[places])


def merged(slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each slot, in order, those that touch or overlap as one."""
    if not len(slot):
        return slot, low, high
    order = np.lexsort((low, slot))
    slot, low, high = slot[order], low[order], high[order]
    reach = np.maximum.accumulate(high + (slot << 32)) - (slot << 32)  # the last end so far in the slot
    new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (low[1:] > reach[:-1])])
    heads = np.flatnonzero(new)
    return slot[heads], low[heads], np.maximum.reduceat(high, heads)


def packed(*columns: np.ndarray) -> list[bytes]:
    return [c.tobytes() for c in columns]


class Block:
    """The texts of one block, end to end, in the order of (id, text). A slot is a text's place in that order."""

    def __init__(self, rows: pd.DataFrame):
        order = sorted(range(len(rows)), key=lambda i: (rows["doc"].iat[i], rows["raw"].iat[i]))
        self.rows = rows.iloc[order]
        self.ids = self.rows["doc"].to_numpy(np.int64)
        self.raws = list(self.rows["raw"])
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in self.raws])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.raws), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, hashes = anchors(self.buffer, self.starts)
        return places, hashes, np.searchsorted(self.starts, places, side="right") - 1


def name_anchors(parts: int):
    """First round: each block names its anchors, with the number of its documents that have it (up to 255)."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows)
        _, hashes, slots = block.anchors()
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], block.ids[slots[order]]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
        other = new | np.concatenate([[True], ids[1:] != ids[:-1]])[: len(hashes)]
        heads = np.flatnonzero(new)
        found = np.minimum(np.add.reduceat(other.astype(np.int64), heads), 255).astype(np.uint8) if len(heads) else np.zeros(0, np.uint8)
        return by_part(hashes[heads], parts, key[0], lambda part: packed((hashes[heads][part] // np.uint64(parts)).astype("<u4"), found[part]), ["names", "counts"])

    return each


def by_part(hashes: np.ndarray, parts: int, block: int, columns, names: list[str]) -> pd.DataFrame:
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, block, *columns(order[edges[p] : edges[p + 1]])) for p in range(parts) if edges[p] < edges[p + 1]]
    return pd.DataFrame(rows, columns=["part", "block", *names])


def answer(limit: int):
    """Second round: each block learns which of its anchors another document has, and which are crowded."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, "<u4") for x in rows["names"]]
        counts = [np.frombuffer(x, np.uint8) for x in rows["counts"]]
        values, place = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(values))
        out, at = [], 0
        for part, block, own in zip(rows["part"], rows["block"], names, strict=True):
            n = total[place[at : at + len(own)]]
            at += len(own)
            if (n > 1).any():
                out.append((part, block, *packed(own[n > 1], (n[n > 1] > limit).astype(np.uint8))))
        return pd.DataFrame(out, columns=["part", "block", "names", "crowded"])

    return each


def contexts(names: int, parts: int):
    """Third round: contexts of anchors that several documents have, once for each block; and what the block can tell by itself: of a context,
    all documents but those with the smallest id repeat it. Anchors were named in names parts, contexts go to parts."""

    def each(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "block", "blob", "n"]
        if not len(rows) or not len(answers):
            return pd.DataFrame(columns=columns)
        block = Block(rows)
        places, hashes, slots = block.anchors()
        known = np.concatenate([np.frombuffer(x, "<u4").astype(np.uint64) + (np.uint64(p) << np.uint64(32)) for p, x in zip(answers["part"], answers["names"], strict=True)])
        crowded = np.concatenate([np.frombuffer(x, np.uint8) for x in answers["crowded"]])
        order = np.argsort(known)
        known, crowded = known[order], crowded[order]
        own = ((hashes % np.uint64(names)) << np.uint64(32)) + ((hashes // np.uint64(names)) & np.uint64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        mine = np.flatnonzero(known[at] == own)
        places, hashes, slots, crowded = places[mine], hashes[mine], slots[mine], crowded[at[mine]] > 0
        left = np.minimum(LEFT, places - block.starts[slots])
        right = np.minimum(LENGTH, block.starts[slots + 1] - places)
        if crowded.any():
            # The strings around a crowded anchor, each as an anchor of its own without bytes to its left.
            few = ~crowded
            n = np.maximum(0, left - np.maximum(0, LENGTH - right) + 1)[crowded]
            back = np.repeat(left[crowded], n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            begin, slot = np.repeat(places[crowded], n) - back, np.repeat(slots[crowded], n)
            begin, first = np.unique(begin, return_index=True)
            strings = np.lib.stride_tricks.sliding_window_view(block.buffer, LENGTH)[begin]
            many = row_hash(strings)
            places, slots, hashes = (np.concatenate([a[few], b]) for a, b in ((places, begin), (slots, slot[first]), (hashes, many)))
            left, right = np.concatenate([left[few], np.zeros(len(begin), np.int64)]), np.concatenate([right[few], np.full(len(begin), LENGTH)])
        if not len(places):
            return pd.DataFrame(columns=columns)
        text = np.zeros((len(places), WIDTH + 2), np.uint8)
        surrounded = np.concatenate([np.zeros(LEFT, np.uint8), block.buffer, np.zeros(LENGTH, np.uint8)])
        text[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(surrounded, WIDTH)[places]
        column = np.arange(WIDTH)
        text[:, :WIDTH][(column < (LEFT - left)[:, None]) | (column >= (LEFT + right)[:, None])] = 0
        text[:, WIDTH], text[:, WIDTH + 1] = left, right
        order = np.argsort(places, kind="stable")
        places, hashes, slots, left, right, text = (x[order] for x in (places, hashes, slots, left, right, text))
        # The block's own contexts in the order of what follows and what precedes the anchor; equal ones lie together, by place.
        order = deep_shallow_order(around(text), hashes)
        places, hashes, slots, left, right, text = (x[order] for x in (places, hashes, slots, left, right, text))
        new = np.concatenate([[True], (text[1:] != text[:-1]).any(axis=1) | (hashes[1:] != hashes[:-1])])
        heads = np.flatnonzero(new)
        owner = np.cumsum(new) - 1
        ids = block.ids[slots]
        smallest = ids[heads][owner] == ids  # texts are in the order of ids
        again = ~smallest
        local = merged(slots[again], (places - block.starts[slots] - left)[again], (places - block.starts[slots] + right)[again])
        stay = np.flatnonzero(smallest)
        counts = np.bincount(owner[stay], minlength=len(heads))
        ends = np.cumsum(counts)
        slot, offset = slots[stay].astype("<u4"), (places - block.starts[slots])[stay].astype("<u4")

        def blob(chosen: np.ndarray) -> list:
            take = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in chosen]) if len(chosen) else np.zeros(0, np.int64)
            arrays = (hashes[heads[chosen]], ids[heads[chosen]].astype("<i8"), counts[chosen].astype("<u4"), text[heads[chosen]], slot[take], offset[take])
            return [squeezed(b"".join(packed(*arrays))), len(chosen)]

        out = by_part(mix(hashes[heads]), parts, key[0], blob, ["blob", "n"])
        told = pd.DataFrame([(-1 - key[0], key[0], interval_blob(*local), 0)], columns=columns)
        return pd.concat([out, told], ignore_index=True)

    return each


def squeezed(raw: bytes) -> bytes:
    """Contexts are text; a shuffle's own codec makes little of the short pieces."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def interval_blob(slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    return b"".join(packed(slot.astype("<u4"), low.astype("<u4"), high.astype("<u4")))


def intervals(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4").reshape(3, -1).astype(np.int64)


def row_hash(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for word in padded.view("<u8").T:
        out = (out ^ word) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return mix(out)


def around(text: np.ndarray) -> np.ndarray:
    """One string for both directions: what the anchor starts, then what is before it, backwards, then the two lengths."""
    return np.concatenate([text[:, LEFT:WIDTH], text[:, :LEFT][:, ::-1], text[:, WIDTH:]], axis=1)


def earlier_strings(text: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the least and the greatest number of bytes before the anchor at which a string starts that a context of its group
    with a smaller id also has; -1 where there is none."""
    n = len(ids)
    least, greatest = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    string = around(text)
    order = deep_shallow_order(string, group)
    prefix = common_prefixes(string, order, group)
    new = prefix < string.shape[1]
    whole = np.cumsum(new) - 1  # equal contexts
    heads = np.flatnonzero(new)
    first = np.minimum.reduceat(ids[order], heads)
    left, right = text[:, WIDTH].astype(np.int64), text[:, WIDTH + 1].astype(np.int64)
    later = ids[order] > first[whole]
    rows = order[later]
    least[rows], greatest[rows] = np.maximum(0, LENGTH - right[rows]), left[rows]
    # The rest is decided between different contexts of a group; each takes the smallest id that has it.
    kinds = order[heads]
    kind_group = group[kinds]
    several = np.bincount(np.unique(kind_group, return_inverse=True)[1])
    chosen = np.flatnonzero(np.repeat(several > 1, several)) if len(several) else np.zeros(0, np.int64)  # kinds lie by group
    if not len(chosen):
        return least, greatest
    kinds = kinds[chosen]
    own, kind_ids = group[kinds], first[chosen]
    to_right = common_prefixes(string[:, :LENGTH], kinds, group)
    back = string[kinds, LENGTH : LENGTH + LEFT]
    by_left = deep_shallow_order(back, own)
    to_left = common_prefixes(back, by_left, own)
    kind_left, kind_right = left[kinds], right[kinds]
    low, high = np.full(len(kinds), LENGTH, np.int64), np.full(len(kinds), -1, np.int64)
    left_class = np.empty(len(kinds), np.int64)
    for a in range(LEFT + 1):
        right_class = np.cumsum(to_right < LENGTH - a)
        left_class[by_left] = np.cumsum(to_left < a)
        fits = np.flatnonzero((kind_left >= a) & (kind_right >= LENGTH - a))
        if len(fits) < 2:
            continue
        _, same = np.unique(left_class[fits] * (len(kinds) + 1) + right_class[fits], return_inverse=True)
        smallest = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, kind_ids[fits])
        found = fits[kind_ids[fits] > smallest[same]]
        low[found] = np.minimum(low[found], a)
        high[found] = a
    # Back to all contexts: those with the smallest id of their kind.
    place = np.full(len(heads), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[whole]
    mine = (at >= 0) & ~later
    rows, at = order[mine], at[mine]
    least[rows], greatest[rows] = low[at], high[at]
    return least, greatest


def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Fourth round: the places of each block at which an earlier document has the same string."""
    if key[0] < 0:
        return rows[["block", "blob"]]
    parts = [[] for _ in range(6)]
    for blob, n in zip(map(opened, rows["blob"]), rows["n"], strict=True):
        at = 0
        for k, (kind, width) in enumerate((("<u8", 8), ("<i8", 8), ("<u4", 4), (np.uint8, WIDTH + 2))):
            parts[k].append(np.frombuffer(blob, kind, count=n * (width if kind is np.uint8 else 1), offset=at))
            at += n * width
        m = (len(blob) - at) // 8
        parts[4].append(np.frombuffer(blob, "<u4", count=m, offset=at))
        parts[5].append(np.frombuffer(blob, "<u4", count=m, offset=at + 4 * m))
    hashes, ids, counts, text, slot, offset = (np.concatenate(p) for p in parts)
    text = text.reshape(-1, WIDTH + 2)
    block = np.repeat(rows["block"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    _, group, members = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group] > 1)
    if not len(shared):
        return pd.DataFrame(columns=["block", "blob"])
    least, greatest = earlier_strings(text[shared], group[shared], ids[shared])
    found = shared[greatest >= 0]
    least, greatest = least[greatest >= 0], greatest[greatest >= 0]
    n = counts[found].astype(np.int64)
    begin = (np.cumsum(counts, dtype=np.int64) - counts)[found]
    take = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = offset[take].astype(np.int64) - np.repeat(greatest, n)
    high = offset[take].astype(np.int64) - np.repeat(least, n) + LENGTH
    owner, slots = np.repeat(block[found], n), slot[take].astype(np.int64)
    out = []
    for b in np.unique(owner).tolist():
        mine = owner == b
        out.append((b, interval_blob(*merged(slots[mine], low[mine], high[mine]))))
    return pd.DataFrame(out, columns=["block", "blob"])


def cut(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Last round: the texts of a block without what the intervals cover."""
    block = Block(rows)
    slot, low, high = merged(*np.concatenate([np.zeros((3, 0), np.int64), *map(intervals, found["blob"])], axis=1))
    edges = np.searchsorted(slot, np.arange(len(block.raws) + 1))
    kept, removed, spans = [], [], []
    for i, raw in enumerate(block.raws):
        at, pieces, gone = 0, [], 0
        for k in range(edges[i], edges[i + 1]):
            pieces.append(raw[at : low[k]])
            gone += int(high[k] - low[k])
            at = high[k]
        pieces.append(raw[at:])
        kept.append(b"".join(pieces))
        removed.append(gone)
        spans.append(int(edges[i + 1] - edges[i]))
    return pd.DataFrame({"doc": block.ids, "no_id": block.rows["no_id"].to_numpy(), "n_bytes": [len(r) for r in block.raws], "n_removed": removed, "n_spans": spans, "kept": kept})


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Null texts are empty. Strings are judged on the input. Rows with the same id are not earlier than each other; rows without an id
    come after all others. Texts under LENGTH bytes keep all.

    The texts are dealt into blocks once, and read from there in three of the rounds.
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = tasks(spark)
    blocks = max(2 * n, size // BLOCK_BYTES + 1)
    names = max(n, size // NAMES_BYTES + 1)
    dealt = max(n, min(blocks, TASKS))
    rows = docs.select(F.coalesce("doc_id", F.lit(last)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("binary").alias("raw"))
    # By id and text, so that rows without an id, or with one id, are not all in one block.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc", "raw"), F.lit(blocks))).repartition(dealt, "block")
    named = rows.groupBy("block").applyInPandas(name_anchors(names), "part long, block long, names binary, counts binary").repartition(names, "part")
    answers = named.groupBy("part").applyInPandas(answer(crowded), "part long, block long, names binary, crowded binary")
    told = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(contexts(names, blocks), "part long, block long, blob binary, n long").repartition(dealt, "part")
    found = told.groupBy("part").applyInPandas(compare, "block long, blob binary")
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(cut, "doc long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(text_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
