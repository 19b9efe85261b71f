"""Deep-shallow sorting of suffixes.

Multikey quicksort, eight bytes at a time, orders suffixes to a shallow depth: each open set of suffixes is parted in three by
a pivot, and the middle part goes on eight bytes deeper. All open sets are parted in one pass over their rows. Groups that still agree at that depth
have long common prefixes; each is ordered by a blind trie, which keeps only the depths at which its suffixes
part, and looks at the text once for each insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Distinct strings of one length. A node is (depth, children by the byte at that depth); a leaf is a string."""

    def __init__(self, first: bytes):
        self.root: tuple | bytes = first

    def insert(self, s: bytes) -> None:
        # Down by the branching bytes alone, without looking at what lies between, to any leaf below.
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth]) or next(iter(children.values()))
        part = common_prefix(s, node)  # no stored string agrees further with s than this one
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < part:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == part:
            node[1][s[part]] = s
            return
        other = node
        while isinstance(other, tuple):
            other = next(iter(other[1].values()))
        split = (part, {s[part]: s, other[part]: node})
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def ordered(self) -> list[bytes]:
        out, waiting = [], [self.root]
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                waiting.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node)
        return out


def multikey_quicksort(words: np.ndarray, order: np.ndarray, starts: np.ndarray, levels: int) -> np.ndarray:
    """Sort order, in place, within the sets that begin at starts, by the first levels of words (a row each). Equal rows keep their order.
    Returns where the sets of rows that agree in all levels begin."""
    random = np.random.default_rng(len(order))
    begin, size = starts, np.diff(np.append(starts, len(order)))
    level = np.zeros(len(begin), np.int64)
    closed = []
    while True:
        done = (size < 2) | (level >= levels)
        closed.append(begin[done])
        begin, size, level = begin[~done], size[~done], level[~done]
        if not len(begin):
            return np.sort(np.concatenate(closed))
        head = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(own)) - head[own] + begin[own]
        rows = order[place]
        key = words[rows, level[own]].astype(np.uint64)
        pivot = np.sort(key[head + (random.random((3, len(size))) * size).astype(np.int64)], axis=0)[1]
        side = (key >= pivot[own]).astype(np.int8) + (key > pivot[own])
        counts, to = np.empty((3, len(size)), np.int64), np.empty(len(own), np.int64)
        before = begin
        for s in range(3):
            mine = side == s
            passed = np.cumsum(mine)
            ahead = passed[head] - mine[head]
            counts[s] = passed[head + size - 1] - ahead
            to[mine] = (before - ahead - 1)[own[mine]] + passed[mine]
            before = before + counts[s]
        order[to] = rows
        begin = np.concatenate([begin, begin + counts[0], begin + counts[0] + counts[1]])
        level = np.concatenate([level, level + 1, level])
        size = counts.reshape(-1)
        some = size > 0
        begin, size, level = begin[some], size[some], level[some]


def deep_shallow_order(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of rows (bytes, one string a row, all of one width) by group and string; equal strings keep their order."""
    n, width = rows.shape
    order = np.argsort(group, kind="stable")
    if n < 2:
        return order
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    levels = -(-min(shallow, width) // 8)
    begin = multikey_quicksort(padded.view(">u8"), order, starts, levels)
    size = np.diff(np.append(begin, n))
    begin, size = begin[size > 1], size[size > 1]
    if not len(begin) or 8 * levels >= width:
        return order
    heads = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(begin - heads, size)
    like_first = (rows[order[at]] == np.repeat(rows[order[begin]], size, axis=0)).all(axis=1)
    for k in np.flatnonzero(~np.logical_and.reduceat(like_first, heads)).tolist():
        places = slice(begin[k], begin[k] + size[k])
        members: dict[bytes, list[int]] = {}
        for i in order[places].tolist():
            members.setdefault(rows[i].tobytes(), []).append(i)
        strings = iter(members)
        trie = BlindTrie(next(strings))
        for s in strings:
            trie.insert(s)
        order[places] = [i for s in trie.ordered() for i in members[s]]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in order with the one before it in its group; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for start in range(1, len(order), 1 << 16):
        now, last = order[start : start + (1 << 16)], order[start - 1 : start - 1 + (1 << 16)]
        last = last[: len(now)]
        differ = rows[now] != rows[last]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[start : start + len(now)] = np.where(group[now] == group[last], length, -1)
    return out
