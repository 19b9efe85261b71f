"""Exact copies, collocations and periodic runs against plain Python, over all edge cases, ids that are null and long repetitions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_cases import DOCUMENTS, edge_rows, prose, save, table
from hypothesis import given, settings
from hypothesis import strategies as st

from paceshift.llm import collocations, exact_index, periodic_runs
from paceshift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def more_rows():
    """The edge cases, rows without ids, copies that differ in white space, phrases that recur, and repetitions."""
    r = random.Random(9)
    rows = edge_rows()
    rows += [(None, "one two three four", "de", None, 18), (None, "one  two\tthree four", None, "b", 1), (None, None, None, None, None), (None, "alone", "en", "a", 5)]
    rows += [(400 + i, prose(60, 77).replace(" ", " " * (1 + i % 3)), "en", "a", 1) for i in range(9)]
    rows += [(500 + i, f"New York, in the City of new york. Word{i % 3} in the city\x0bof x{i % 2}; the   a\x85b", [None, "und", "en"][i % 3], "a", 1) for i in range(40)]
    for i in range(60):
        base = [f"w{r.randint(0, 30)}" for _ in range(r.randint(1, 40))]
        rows.append((1000 + i, " ".join(base * r.randint(1, 5) + base[: r.randint(0, len(base))]) + " end" * r.randint(0, 20), "fr", "a", 1))
    return rows


@pytest.fixture(scope="module")
def more_dir(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("more"), documents=table(spark, more_rows(), DOCUMENTS))


def plain_copies(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, n, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[:3] == best[:3], hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return out


def checked_copies(got, rows):
    """kept is true once for each group; which of rows that tie in size and id is left open."""
    want = plain_copies(rows)
    assert Counter((*x[:3], x[4]) for x in got) == Counter((*x[:3], x[4]) for x in want)
    assert Counter((x[0], x[4]) for x in got if x[3]) == Counter({(x[1], x[4]): 1 for x in want})


def test_exact_copies_query(spark, more_dir):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op11_exact_index"](spark, more_dir).collect()]
    checked_copies(got, [(i, t or "") for i, t, *_ in more_rows()])


@pytest.mark.parametrize("options", [{"key_bits": 3}, {"run_rows": 7, "heavy": 3}, {"run_bytes": 2000, "bucket_bytes": 100, "owner_bytes": 3000}, {"run_rows": 1, "heavy": 2, "key_bits": 1, "bucket_bytes": 1}])
def test_exact_copies_with_small_limits(spark, options):
    """Keys that collide, buckets that overflow, runs that end early and texts that many runs name change nothing."""
    r = random.Random(3)
    rows = [(r.choice([None, *range(50)]), r.choice(["", "a b", "ab ", "c", "hot text"]) + r.choice(["", " ", "x" * 300]) * r.randint(0, 2)) for _ in range(150)] + [(7, "hot text")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(x.doc_id, x.keep_id, x.group_size, x.kept, bytes(x.sha256).hex()) for x in exact_index.exact_copies(docs, **options).collect()]
    checked_copies(got, rows)


def test_directory_doubles_and_chains():
    directory = exact_index.Directory(owner_bits=2, bucket_bytes=400)
    r = random.Random(1)
    keys = [r.getrandbits(62) for _ in range(200)] + [5] * 30  # all of one owner: the first two bits are 0
    texts = [b"t%d" % i for i in range(len(keys))]
    added = [directory.find_or_add(k, t, i) for i, (k, t) in enumerate(zip(keys, texts, strict=True))]
    assert directory.depth > 4 and len(directory.entries) == 1 << directory.depth
    for bucket in set(directory.entries):
        assert bucket.bytes <= 400 or len(bucket.chains) == 1
        assert directory.entries.count(bucket) == 1 << (directory.depth - bucket.depth)
    assert [directory.find_or_add(k, t, -1) for k, t in zip(keys, texts, strict=True)] == added
    assert [a.chain for a in added[200:]] == list(range(30))
    assert all(format(k, "064b")[2:].startswith(directory.name(k)) for k in keys)


def plain_phrases(rows, threshold=10, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= threshold}
        board = []
        for p, a in candidates.items():
            if any(100 * c >= 50 * a for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            board.append((-score, -a, " ".join(p).encode(), left, right))
        board.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(board[:top])]
    return sorted(out)


def test_collocations_query(spark, more_dir):
    got = sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, more_dir).collect())
    want = plain_phrases([(lang or "und", t or "") for _, t, lang, *_ in more_rows()])
    assert got == want and sum(w[0] == "und" for w in want) > 3 and max(w[2].count(" ") for w in want) == 2


@pytest.mark.parametrize(("shards", "threshold", "cells"), [(1, 2, 22), (3, 2, 22), (5, 3, 7), (2, 4, 6)])
def test_collocations_by_shards(spark, shards, threshold, cells):
    """Any number of shards, and boards so small that all phrases share cells, give the same counts."""
    r = random.Random(shards)
    rows = [(r.choice("xy"), " ".join(r.choice("abcdefgh") + r.choice(["", "", ".", "1"]) for _ in range(r.randint(0, 12)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(x) for x in collocations.collocations(docs, threshold, top=25, shards=shards, cell_bits=cells).collect())
    assert got == plain_phrases(rows, threshold, 25)


def test_phrases_are_counted_for_a_whole_cycle():
    """Also where other phrases reached the cells of a phrase's parts long before its words did."""
    texts, seeds, shards = [b"a b c"], collocations.seeds_of(["en"]), 4
    words, _ = collocations.words_of(texts, seeds)
    pairs = collocations.longer(words[:-1], words[1:])
    for reached in itertools.product((1, 3, 5), repeat=5):
        steps = Counter()
        for step in range(12):
            boards = [np.full(1 << 12, collocations.NEVER, np.uint8) for _ in range(2)]
            for board, hashes, at in ((boards[0], words, reached[:3]), (boards[1], pairs, reached[3:])):
                known = [x <= step for x in at]
                board[collocations.cells_of(hashes, board)[known]] = np.array(at)[known]
            for size, hashes, _ in collocations.active_phrases(texts, seeds, 0, step, shards, boards):
                steps.update((size, int(h)) for h in hashes)
        assert len(steps) == 6 and set(steps.values()) == {shards}, reached


def test_collocations_with_cells_that_rare_words_share(spark):
    """Words that become frequent late, in pairs whose cells others have reached."""
    r = random.Random(8)
    rows = [("x", " ".join(f"{r.choice('abcdefgh')}{int(r.paretovariate(0.7))}" for _ in range(40))) for _ in range(300)]
    rows += [("x", f"p{i % 60} q{i % 60} r{i % 60}") for i in range(240)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(x) for x in collocations.collocations(docs, 4, cell_bits=9).collect())
    assert got == plain_phrases(rows, 4)


def test_long_texts_in_slices(spark):
    """A text is counted as a whole, whether it is cut between any words or not."""
    r = random.Random(2)
    raw = " ".join(r.choice(["New", "york", "a", "b.", "c;d", "\u00e9"]) + r.choice(["", "", "\t", "\n", "!"]) for _ in range(3000)).encode()
    boards = [np.zeros(64, np.uint8) for _ in range(3)]  # all cells have reached the threshold

    def all_phrases(most):
        named, hashed = Counter(), Counter()
        for part, carried in collocations.slices(raw, most):
            for size, phrases, counts in collocations.named_phrases("en", [part], carried, boards):
                for p, n in zip(phrases.to_pylist(), counts.tolist(), strict=True):
                    named[size, p] += n
            for size, hashes, _ in collocations.active_phrases([part], collocations.seeds_of(["en"]), carried, 0, 4, boards):
                hashed.update((size, int(h)) for h in hashes)
        return {k: n for k, n in named.items() if n}, hashed

    whole = all_phrases(1 << 20)
    assert sorted(whole[1].values()) == sorted(n for (size, _), n in whole[0].items() if size)
    for most in (1, 7, 50, 1000):
        assert all_phrases(most) == whole


def test_collocation_scores_past_64_bits(spark):
    """a * a and l * r beyond 64 bits, through the same expression."""
    a, left, right = 9 * 10**11, 10**12 - 1, 10**12 - 7
    found = spark.createDataFrame([("en", 1, "p", left), ("en", 1, "q", right), ("en", 2, "p q", a)], "lang string, size int, phrase string, n long")
    words = spark.createDataFrame([("en", 4 * 10**12)], "lang string, n long")
    row = collocations.scored(found, words).collect()
    assert [(x.phrase, x.score) for x in row] == [("p q", 1000000 * a * a // (left * right))]


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        j = 0
        while j < n - q:
            start = j
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - start + q >= max(least, 2 * q):
                found.setdefault((start, j - start + q), q)  # its smallest period comes first
            j += 1
    return sorted((s, length, q) for (s, length), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70), st.integers(1, 30), st.integers(1, 4), st.integers(2, 12))
def test_runs_against_all_periods(head, period, repeats, least):
    words = head + (head[-period:] or [1]) * repeats
    assert periodic_runs.runs_of(words, least) == plain_runs(words, least)
    docs = [[b"%d" % w for w in x] for x in (words, words[::-1], [])]
    assert periodic_runs.runs_of_documents(docs) == [plain_runs(words), plain_runs(words[::-1]), []]


def test_runs_of_long_texts(monkeypatch):
    """Arrays in place of lists, and a text that is one repetition of 4,000 words."""
    monkeypatch.setattr(periodic_runs, "LONG", 100)
    r = random.Random(5)
    base = [r.randint(1, 500) for _ in range(4000)]
    assert (0, 19_000, 4000) in periodic_runs.runs_of((base * 5)[:19_000])
    assert periodic_runs.runs_of([1] * 3000 + [2] + [1] * 20) == [(0, 3000, 1), (3001, 20, 1)]
    words = [r.randint(1, 2) for _ in range(400)]
    assert periodic_runs.runs_of(words) == plain_runs(words)


def test_stretches_cover_all_runs():
    r = random.Random(8)
    for _ in range(100):
        words = [r.randint(1, 4) for _ in range(r.randint(0, 60))]
        a = r.randint(0, len(words))
        words += words[a:] * r.randint(1, 3)
        found = periodic_runs.stretches(np.array(words, np.int64), np.zeros(len(words), np.int64))
        for start, length, _ in plain_runs(words):
            assert any(a <= start and start + length <= b for a, b in found)


def test_periodic_runs_query(spark, more_dir):
    want = []
    for i, t, *_ in more_rows():
        words = WORD.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words) if n < 5000 else periodic_runs.runs_of_documents([[w.encode() for w in words]])[0]
        gone = set(itertools.chain.from_iterable(range(s + q, s + length) for s, length, q in runs))
        top = min(((-length, s, q) for s, length, q in runs), default=None)
        best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        short = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(short.encode()).hexdigest()))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = [tuple(r[c] for c in names) for r in QUERIES["op13_periodic_runs"](spark, more_dir).collect()]
    assert Counter(got) == Counter(want) and sum(w[1] > 0 for w in want) > 40
