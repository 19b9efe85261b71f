"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Texts are laid end to end in lanes that step through windows together. Gradients stop at a window's start, the state does
not: a document's likelihood is that of the whole document. A word's probability is that of its class times
its own within the class. Frequent words have a softmax of their own in their class; in the other classes words are
drawn by their counts, so words beyond any vocabulary have probabilities too and they add up to 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Hidden units, steps of a window, lanes, classes of frequent words, words in one, classes of the other known words.
HIDDEN, STEPS, LANES, CLASSES, MEMBERS, OTHERS = 16, 20, 512, 32, 32, 7
WORDS = CLASSES * MEMBERS
OUTPUTS = CLASSES + OTHERS + 1  # the last class holds the words that are not in the lexicon
#: Tokens of a step of the optimiser.
STEP_TOKENS = 4096
#: Scores of a softmax are held within this, where their exponentials can be added up.
HIGHEST = np.float32(60.0)
END = 0  # number of the end sign, which is taken to be frequent


@dataclass
class Lexicon:
    """Training counts: of all tokens, and one by one of at most a fixed number of the most frequent words.

    Numbers below WORDS are frequent words (END first), then come the other classes.
    """

    hashes: np.ndarray  # of listed words, sorted
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        order = np.lexsort((self.hashes, -self.counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.numbers = (rank + 1).astype(np.int32)  # END is 0
        tail = order[WORDS - 1 :]
        mass = np.cumsum(self.counts[tail])
        self.numbers[tail] = WORDS + np.minimum(OTHERS - 1, (mass - self.counts[tail]) * OTHERS // max(1, mass[-1] if len(mass) else 1))
        listed = np.concatenate([[self.ends], self.counts[order[: WORDS - 1]]])
        self.frequent = np.zeros(WORDS)
        self.frequent[: len(listed)] = listed
        others = np.bincount(self.numbers[tail] - WORDS, weights=self.counts[tail], minlength=OTHERS)
        self.rare_mass = self.tokens - self.ends - int(self.counts.sum()) + 0.1 * (self.distinct - len(self.hashes) - (self.ends > 0) + 1)
        self.mass = np.concatenate([self.frequent.reshape(CLASSES, MEMBERS).sum(axis=1), others, [self.rare_mass]])
        # log of the count's share of its class, for listed words that have no softmax of their own
        self.within = np.zeros(len(order))
        self.within[tail] = np.log(self.counts[tail]) - np.log(others[self.numbers[tail] - WORDS])
        # log of the counts' share, by number; of a class for words that have no softmax of their own
        shares = np.concatenate([self.frequent, self.mass[CLASSES:]])
        self.by_counts = np.log(np.maximum(shares, 1e-6) / max(1.0, self.mass.sum()))
        # Each slot names the last of the hashes with these leading bits; where that is another word, it is searched for.
        self.shift = np.uint64(64 - max(4, int(len(order) * 4).bit_length()))
        slots = (self.hashes >> self.shift).astype(np.int64)
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slot[slots] = np.arange(len(order))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index of each hash among the listed ones, or -1."""
        at = self.slot[(words >> self.shift).astype(np.int64)]
        if not len(self.hashes):
            return at
        hit = at >= 0
        wrong = np.flatnonzero(hit & (self.hashes[np.maximum(at, 0)] != words))
        found = np.minimum(np.searchsorted(self.hashes, words[wrong]), len(self.hashes) - 1)
        at[wrong] = np.where(self.hashes[found] == words[wrong], found, -1)
        return at

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


SHAPES = {"inputs": (WORDS + OTHERS + 1, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN, OUTPUTS),
          "class_bias": (OUTPUTS,), "words": (CLASSES, MEMBERS, HIDDEN), "word_bias": (CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def untrained(lexicon: Lexicon, seed: int = 7) -> np.ndarray:
    """Small random weights, with biases that give the counts' shares."""
    random = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    p["inputs"][:] = random.normal(0, 0.1, p["inputs"].shape)
    p["inputs"][:, :HIDDEN] += 1.0  # states are kept at first
    p["state"][:] = random.normal(0, HIDDEN**-0.5, p["state"].shape)
    p["classes"][:] = random.normal(0, 0.05, p["classes"].shape)
    p["words"][:] = random.normal(0, 0.05, p["words"].shape)
    p["class_bias"][:] = np.log(np.maximum(lexicon.mass, 1e-6) / max(1.0, lexicon.mass.sum()))
    p["word_bias"][:] = np.where(lexicon.frequent > 0, np.log(np.maximum(lexicon.frequent, 1)), -30.0).reshape(CLASSES, MEMBERS)
    return flat


@dataclass
class Lanes:
    """Documents end to end in lanes of about one length, the longest lane first. place: index of a token in the order of the documents, -1 beyond a lane's end."""

    place: np.ndarray  # steps x lanes
    starts: np.ndarray  # whether a document starts there
    active: np.ndarray  # lanes that have a token at a step


def lay(lengths: np.ndarray) -> Lanes:
    total = int(lengths.sum())
    # As many lanes as keep the longest document from outlasting the others, within bounds.
    lanes = int(min(len(lengths), max(1, total // 512), LANES, max(LANES // 4, total // max(1, lengths.max()))))
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    heap = [(0, k) for k in range(lanes)]
    chosen: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        chosen[k].append(i)
        heapq.heappush(heap, (load + int(lengths[i]), k))
    loads = np.array([int(lengths[c].sum()) for c in chosen])
    order = np.argsort(-loads, kind="stable")
    random = np.random.default_rng(len(lengths))  # else all lanes would go from long to short
    place = np.full((int(loads.max()), lanes), -1, np.int32)
    starts = np.zeros(place.shape, bool)
    for column, k in enumerate(order.tolist()):
        at = 0
        for i in random.permutation(chosen[k]).tolist():
            n = int(lengths[i])
            place[at : at + n, column] = np.arange(firsts[i], firsts[i] + n)
            starts[at, column] = True
            at += n
    return Lanes(place, starts, (place >= 0).sum(axis=1))


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.p = views(flat)

    def run(self, h: np.ndarray, inputs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """States after each step of a window, and what the way back needs."""
        steps, lanes = inputs.shape
        k = HIDDEN
        x = self.p["inputs"][inputs]
        kept = {"before": np.empty((steps, lanes, k), np.float32), "gates": np.empty((steps, lanes, 2 * k), np.float32),
                "new": np.empty((steps, lanes, k), np.float32), "mixed": np.empty((steps, lanes, k), np.float32)}
        states = np.empty((steps, lanes, k), np.float32)
        for t in range(steps):
            if starts[t].any():
                h = h * ~starts[t][:, None]
            kept["before"][t] = h
            u = h @ self.p["state"]
            gates = kept["gates"][t]
            np.add(x[t, :, : 2 * k], u[:, : 2 * k], out=gates)
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            kept["mixed"][t] = u[:, 2 * k :]
            new = np.multiply(gates[:, k:], u[:, 2 * k :], out=kept["new"][t])
            new += x[t, :, 2 * k :]
            np.tanh(new, out=new)
            h = h - new
            h *= gates[:, :k]
            h += new
            states[t] = h
        return states, kept

    def back(self, d_states: np.ndarray, kept: dict, inputs: np.ndarray, starts: np.ndarray, gradient: dict) -> None:
        """Truncated backpropagation: through the steps of this window only."""
        steps, lanes = inputs.shape
        k = HIDDEN
        d_x = np.empty((steps, lanes, 3 * k), np.float32)
        d_u = np.empty((steps, lanes, 3 * k), np.float32)
        turned = np.ascontiguousarray(self.p["state"].T)
        d_h = np.zeros((lanes, k), np.float32)
        for t in reversed(range(steps)):
            d_h = d_h + d_states[t]
            z, r, new = kept["gates"][t, :, :k], kept["gates"][t, :, k:], kept["new"][t]
            d_new = d_h * (1 - z)
            d_new *= 1 - new * new
            d_x[t, :, 2 * k :] = d_new
            d_x[t, :, :k] = d_h * (kept["before"][t] - new) * z * (1 - z)
            d_x[t, :, k : 2 * k] = d_new * kept["mixed"][t] * r * (1 - r)
            d_u[t, :, : 2 * k] = d_x[t, :, : 2 * k]
            d_u[t, :, 2 * k :] = d_new * r
            d_h = d_h * z + d_u[t] @ turned
            if starts[t].any():
                d_h *= ~starts[t][:, None]
        gradient["state"] += kept["before"].reshape(-1, k).T @ d_u.reshape(-1, 3 * k)
        add_rows(gradient["inputs"], inputs.ravel(), d_x.reshape(-1, 3 * k))

    def outputs(self, states: np.ndarray, numbers: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each number (without the share within count-based classes), and the gradient at the states."""
        frequent = numbers < WORDS
        classes = np.where(frequent, numbers // MEMBERS, numbers - WORDS + CLASSES)
        rows = np.arange(len(numbers))
        score = states @ self.p["classes"]
        score += self.p["class_bias"]
        np.clip(score, -HIGHEST, HIGHEST, out=score)
        said = score[rows, classes]
        np.exp(score, out=score)
        sums = score @ np.ones(OUTPUTS, np.float32)
        log = (said - np.log(sums)).astype(np.float64)
        d_states = None
        if gradient is not None:
            score /= sums[:, None]
            score[rows, classes] -= 1.0
            gradient["classes"] += states.T @ score
            gradient["class_bias"] += score.sum(axis=0)
            d_states = score @ self.p["classes"].T
        own = np.flatnonzero(frequent)
        own = own[np.argsort(classes[own], kind="stable")]
        edges = np.searchsorted(classes[own], np.arange(CLASSES + 1))
        shifted = self.p["word_bias"] - self.p["word_bias"].max(axis=1, keepdims=True)
        for c in range(CLASSES):
            some = own[edges[c] : edges[c + 1]]
            if not len(some):
                continue
            h, member, at = states[some], numbers[some] % MEMBERS, np.arange(len(some))
            score = h @ self.p["words"][c].T
            score += shifted[c]
            np.clip(score, -HIGHEST, HIGHEST, out=score)
            said = score[at, member]
            np.exp(score, out=score)
            sums = score @ np.ones(MEMBERS, np.float32)
            log[some] += said - np.log(sums)
            if gradient is not None:
                score /= sums[:, None]
                score[at, member] -= 1.0
                gradient["words"][c] += score.T @ h
                gradient["word_bias"][c] += score.sum(axis=0)
                d_states[some] += score @ self.p["words"][c]
        return log, d_states

    def windows(self, numbers: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        """Places of a window's tokens, states, what the way back needs; the state is carried from each to the next."""
        lanes = lay(lengths)
        before = np.empty(len(numbers), np.int32)  # what a token follows: END at a document's start
        before[1:] = numbers[:-1]
        before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = END
        h = np.zeros((lanes.place.shape[1], HIDDEN), np.float32)
        for start in range(0, len(lanes.place), STEPS):
            n = int(lanes.active[start])
            place, starts = lanes.place[start : start + STEPS, :n], lanes.starts[start : start + STEPS, :n]
            inputs = np.where(place >= 0, before[place], END)
            states, kept = self.run(h[:n], inputs, starts)
            h = states[-1]
            yield place, starts, inputs, states, kept

    def score(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each token; documents lie end to end in numbers, each with END as its last token."""
        out = np.empty(len(numbers))
        for place, _, _, states, _ in self.windows(numbers, lengths):
            valid = place.ravel() >= 0
            at = place.ravel()[valid]
            out[at] = self.outputs(states.reshape(-1, HIDDEN)[valid], numbers[at])[0]
        return out

    def train(self, numbers: np.ndarray, lengths: np.ndarray, rule: Adagrad) -> None:
        """One step for STEP_TOKENS tokens or more, so that windows in which few lanes are left weigh no more than others; the rest at the end makes a smaller one."""
        flat, seen = np.zeros(SIZE, np.float32), 0
        gradient = views(flat)
        for place, starts, inputs, states, kept in self.windows(numbers, lengths):
            valid = np.flatnonzero(place.ravel() >= 0)
            _, d_valid = self.outputs(states.reshape(-1, HIDDEN)[valid], numbers[place.ravel()[valid]], gradient)
            d_states = np.zeros((place.size, HIDDEN), np.float32)
            d_states[valid] = d_valid
            self.back(d_states.reshape(states.shape), kept, inputs, starts, gradient)
            seen += len(valid)
            if seen >= STEP_TOKENS:
                flat /= seen
                rule.step(self.flat, flat)
                flat[:], seen = 0, 0
        if seen:
            flat /= seen
            rule.step(self.flat, flat, seen / STEP_TOKENS)


def add_rows(table: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(index, kind="stable")
    index = index[order]
    heads = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    table[index[heads]] += np.add.reduceat(rows[order], heads, axis=0)


class Adagrad:
    """Steps shrink with the squares of a weight's past gradients, so rare words keep large ones."""

    def __init__(self, rate: float):
        self.rate = rate
        self.square: np.ndarray | None = None

    def step(self, flat: np.ndarray, gradient: np.ndarray, weight: float = 1.0) -> None:
        if self.square is None:
            self.square = np.full(SIZE, float((gradient * gradient).mean()) + 1e-12, np.float32)
        self.square += weight * gradient * gradient
        flat -= weight * self.rate * gradient / np.sqrt(self.square)
