"""Word shingles of many texts at once: hashes in numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, index of its first word for each text and the number of words at the end)."""
    sizes = np.array([len(r) + 1 for r in raws], dtype=np.int64)
    buffer = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    word = ~SPACES[buffer]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begins, ends = edge[0::2], edge[1::2]
    firsts = np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(begins):
        return np.zeros(0, np.uint64), firsts
    lengths = ends - begins
    inside = np.flatnonzero(word)
    offset = inside - np.repeat(begins, lengths)
    values = (buffer[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[offset]
    return mix(np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64)), firsts


def shingles_of(raws: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled hashes of all runs of k words, first index for each text and the number at the end).

    A text of one to k - 1 words has one shingle of all its words; a text without words has none. The i-th
    occurrence of a run within a text has a hash of its own.
    """
    words, firsts = words_of(raws)
    counts = np.diff(firsts)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(made)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    text = np.repeat(np.arange(len(raws)), made)
    at = firsts[text] + np.arange(starts[-1]) - starts[text]
    run = np.zeros(starts[-1], np.uint64)
    for j in range(k):
        use = at + j < firsts[text + 1]
        run = run * MULTIPLIER + np.where(use, words[np.minimum(at + j, len(words) - 1)], np.uint64(j))
    run = mix(run)
    order = np.argsort(run + mix(text.astype(np.uint64)), kind="stable")
    sorted_, owner = run[order], text[order]
    again = np.concatenate([[False], (sorted_[1:] == sorted_[:-1]) & (owner[1:] == owner[:-1])])
    if again.any():
        index = np.arange(len(order))
        label = index - np.maximum.accumulate(np.where(again, 0, index))
        repeated = order[again]
        run[repeated] = mix(run[repeated] + label[again].astype(np.uint64) * MULTIPLIER)
    return run, starts


def groups_of(raws: list[bytes], limit: int = GROUP_BYTES):
    """Consecutive slices of about limit bytes."""
    start, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r) + 1
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(raws):
        yield slice(start, len(raws))
