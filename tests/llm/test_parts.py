"""The methods inside the operators, against plain forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceshift.llm import lattice_hash, mixing, order_minhash, packing, quality, secret_scan, simhash, suffix_dedup, suffix_sort, url_rules
from paceshift.llm import recurrent_lm as lm
from paceshift.llm.common import components, text_of


def test_components_of_chain_star_and_single(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 130), 500]], "id long")
    got = dict(components(nodes, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {500: 500}


@pytest.mark.parametrize("seed", range(20))
def test_deep_shallow_order(seed):
    r = random.Random(seed)
    width, letters = r.choice([8, 26, 50, 78]), r.choice([2, 3, 200])
    base = bytes(r.randrange(letters) for _ in range(width))
    rows = []
    for _ in range(r.randint(1, 80)):
        s = bytearray(base)
        for _ in range(r.randint(0, 3)):
            s[r.randrange(width)] = r.randrange(letters)
        rows.append(bytes(s))
    matrix, group = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width), np.array([r.randint(0, 2) for _ in rows])
    order = suffix_sort.deep_shallow_order(matrix, group, 8)
    assert [(group[i], rows[i]) for i in order] == sorted((group[i], x) for i, x in enumerate(rows))


@pytest.mark.parametrize("crowded", [20_000, 30, 3])
def test_repeats_with_crowded_anchors(spark, crowded):
    r = random.Random(crowded)
    passages = ["".join(r.choice("ab ") for _ in range(r.randint(30, 200))) for _ in range(10)]
    docs = [(i * 7 % 90, "".join(r.choice(passages)[r.randint(0, 20) :] if r.random() < 0.6 else r.choice("cdé") * r.randint(0, 60) for _ in range(5))) for i in range(90)]
    first = {}
    for i, t in docs:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    want = {}
    for i, t in docs:
        raw = t.encode()
        gone = set(itertools.chain.from_iterable(range(p, p + 50) for p in range(len(raw) - 49) if first[raw[p : p + 50]] < i))
        want[i] = bytes(c for p, c in enumerate(raw) if p not in gone)
    got = suffix_dedup.remove_repeats(text_of(spark.createDataFrame(docs, "doc_id long, text string")), crowded).collect()
    assert {x.doc_id: bytes(x.kept) for x in got} == want


def test_repeats_of_nul_bytes(spark):
    nul = "\0"
    docs = [(1, "first " + nul * 60 + " end"), (2, "another " + nul * 60 + " tail"), (3, nul * 55), (4, "x" + nul * 30 + "y" * 30), (5, "z" * 9 + nul * 30 + "y" * 30), (6, nul * 49)]
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = {}
    for i, t in docs:
        gone = set(itertools.chain.from_iterable(range(p, p + 50) for p in range(len(t) - 49) if first[t[p : p + 50]] < i))
        want[i] = "".join(c for p, c in enumerate(t) if p not in gone).encode()
    assert want[2] == b"anothertail" and not want[3] and want[5] == b"z" * 9
    got = suffix_dedup.remove_repeats(text_of(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {x.doc_id: bytes(x.kept) for x in got} == want


def test_network_gradient_is_the_slope_of_the_loss():
    counts = np.arange(1500, 0, -1)
    lexicon = lm.Lexicon(np.sort(np.random.default_rng(1).integers(1, 1 << 62, 1500).astype(np.uint64)), counts, int(counts.sum()) + 50, 1600, 20)
    flat = lm.untrained(lexicon).astype(np.float64)
    net = lm.Network(flat)
    r = np.random.default_rng(2)
    numbers, lengths = r.integers(1, lm.WORDS + lm.OTHERS + 1, 40).astype(np.int32), np.array([12, 8, 20])
    numbers[np.cumsum(lengths) - 1] = lm.END

    def loss():
        return -sum(net.outputs(s.reshape(-1, lm.HIDDEN), numbers[p.ravel()])[0].sum() for p, _, _, s, _ in net.windows(numbers, lengths))

    gradient = np.zeros(lm.SIZE)
    for place, starts, inputs, states, kept in net.windows(numbers, lengths):
        _, d = net.outputs(states.reshape(-1, lm.HIDDEN), numbers[place.ravel()], lm.views(gradient))
        net.back(d.reshape(states.shape), kept, inputs, starts, lm.views(gradient))
    for i in r.choice(np.flatnonzero(np.abs(gradient) > 0.05), 12, replace=False).tolist():
        flat[i] += 1e-2
        up = loss()
        flat[i] -= 2e-2
        down = loss()
        flat[i] += 1e-2
        assert gradient[i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=0.01)


def test_probabilities_add_up_and_training_helps():
    r = np.random.default_rng(3)
    words = np.sort(r.integers(1, 1 << 62, 3000).astype(np.uint64))
    counts = np.maximum(1, (30_000 / np.arange(1, 3001)).astype(np.int64))
    lexicon = lm.Lexicon(words, counts, int(counts.sum()) + 110, 3041, 100)
    net = lm.Network(lm.untrained(lexicon))
    state = r.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    frequent = np.exp(net.outputs(np.repeat(state, lm.WORDS, 0), np.arange(lm.WORDS))[0]).sum()
    classes = np.exp(net.outputs(np.repeat(state, lm.OTHERS + 1, 0), np.arange(lm.WORDS, lm.WORDS + lm.OTHERS + 1))[0])
    assert frequent + classes.sum() == pytest.approx(1, abs=1e-4)
    for c in range(lm.OTHERS):
        assert np.exp(lexicon.within[lexicon.numbers == lm.WORDS + c]).sum() == pytest.approx(1)
    assert (lexicon.find(words) == np.arange(3000)).all() and (lexicon.find(words + np.uint64(1)) == -1).sum() > 2990
    # Documents of one of two kinds: their words tell which, so the state carries it on.
    lengths = np.full(200, 60)
    kinds = np.repeat(r.integers(0, 2, 200), 60)
    numbers = (r.integers(1, 15, 12_000) + 16 * kinds).astype(np.int32)
    numbers[np.cumsum(lengths) - 1] = lm.END
    before = net.score(numbers, lengths).mean()
    for _ in range(10):
        net.train(numbers, lengths, lm.Adagrad(0.1))
    assert net.score(numbers, lengths).mean() > before + 0.5
    assert np.allclose(net.score(numbers, lengths)[:60], net.score(numbers[:60], lengths[:1]), atol=1e-4)


def test_rest_of_the_training_tokens_is_used():
    r = np.random.default_rng(12)
    counts = np.arange(1500, 0, -1)
    lexicon = lm.Lexicon(np.sort(r.integers(1, 1 << 62, 1500).astype(np.uint64)), counts, int(counts.sum()) + 50, 1600, 20)
    start = lm.untrained(lexicon)
    moved = []
    for documents in (1, 40):
        numbers, lengths = r.integers(1, 9, documents * 50).astype(np.int32), np.full(documents, 50)
        numbers[np.cumsum(lengths) - 1] = lm.END
        net = lm.Network(start.copy())
        before = net.score(numbers, lengths).mean()
        net.train(numbers, lengths, lm.Adagrad(0.1))
        assert net.score(numbers, lengths).mean() > before
        moved.append(np.abs(net.flat - start).max())
    assert 0 < moved[0] < moved[1] < 0.1


def test_rules_nested_deeply_and_hot_hosts(spark):
    r = random.Random(5)
    labels = ["a", "b", "com"]
    rules = {(".".join(r.choice(labels) for _ in range(r.randint(1, 4))), r.choice(["", "/", "/x", "/x/y"])): r.choice(["allow", "block"]) for _ in range(60)}
    urls = [(i, "http://" + ".".join(r.choice(labels) for _ in range(r.randint(1, 6))) + r.choice(["", "/", "/x", "/x/y/z", "/q"])) for i in range(400)]
    urls += [(1000 + i, f"http://a.b.com/x/{i}") for i in range(400)]
    got = url_rules.judge_urls(spark.createDataFrame(urls, "id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string"), "none")
    want = set()
    for i, u in urls:
        host, _, path = u[7:].partition("/")
        path = u[7 + len(host) :]
        fits = [(len(h), len(p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.add((i, *(max(fits)[2:] if fits else (None, "none"))))
    assert {(x.id, x.rule, x.verdict) for x in got.collect()} == want


def test_alignment_keeps_order_and_band():
    a = np.arange(100, dtype="<u4")
    assert order_minhash.similar(a, a)
    assert order_minhash.similar(a, a[10:])
    assert not order_minhash.similar(a, np.concatenate([a[50:], a[:50]]))  # the same runs, but moved
    assert not order_minhash.similar(a, np.concatenate([a[:85], np.arange(200, 225, dtype="<u4")]))
    assert order_minhash.longest_rise(np.array([3, 1, 2, 5, 4, 6])) == 4


def test_randomness_and_false_discoveries(spark):
    r = random.Random(6)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    words = ["".join(r.choice(["the", "ing", "tion", "and", "er", "es"]) for _ in range(n))[:n] for n in range(16, 46) for _ in range(10)]
    p = spark.createDataFrame([(x, x in hexes) for x in hexes + words + ["a" * 40, "0" * 20, "=" * 20]], "body string, random boolean").withColumn("p", secret_scan.randomness(F.col("body"))).collect()
    random_p, word_p = [x.p for x in p if x.random], [x.p for x in p if not x.random]
    assert 0.2 < np.median(random_p) < 0.9 and np.quantile(word_p, 0.9) < 0.05
    assert not secret_scan.least_cells([(10, 900, False, 50)], 0.05)  # nothing to compare with
    assert secret_scan.least_cells([(10, 3, True, 500), (12, 900, False, 50)], 0.05) == {12: 4}


def random_spans(spark, texts):
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {x.doc_id for x in got if "random:" in x.spans}


def test_copies_do_not_decide_what_is_random(spark):
    r = random.Random(11)
    words = ["".join(r.choice(["the", "ing", "tion", "and", "er", "es"]) for _ in range(20))[: r.randint(40, 44)] for _ in range(200)]
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44)) for _ in range(30)]
    slug = "how-to-set-up-a-table-of-all-the-things-here"
    lone = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(40))
    found = random_spans(spark, [*keys, *words])
    assert len(found) >= 25 and max(found) < 30
    assert random_spans(spark, [*keys, *words, *[slug + " again"] * 2000]) == found
    assert len({i for i in random_spans(spark, [*keys, *words, *[lone] * 2000]) if i < 30}) >= 25
    assert len(random_spans(spark, [*keys[:-1], *[keys[-1]] * 50, *words])) >= 50  # all copies share its fate


def test_random_strings_where_no_negative_is_known(spark):
    r = random.Random(12)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44)) for _ in range(30)]
    slugs = [f"{a}-{b}-{a}-and-{b}-of-all-the-{a}-{b}" for a in ("table", "thing", "order") for b in ("house", "tree", "green")]
    found = random_spans(spark, [*keys, *slugs])
    assert len(found) >= 10 and max(found) < 30  # none before; the drawn letters are strict
    assert not random_spans(spark, slugs)


def test_simhash_tables_find_all_within_the_radius(spark):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(20)]
    prints = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(8)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    got = [(x.fingerprint, x.other, x.distance) for x in simhash.within(df, df).collect()]
    want = {(a, b, n) for (a,), (b,) in itertools.product(signed, repeat=2) if (n := bin((a ^ b) & (1 << 64) - 1).count("1")) <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_rows_have_a_fingerprint_each(spark):
    rows = [(1, "some words of a text")] * 3 + [(2, "quite another text here")] + [(None, "no id at all for this")] * 5000 + [(None, "nor for that")] + [(50, "some words of a text")]
    got = simhash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    assert next(x.n_within for x in got if x.doc_id == 50) == 3
    mine = [x for x in got if x.doc_id == 1]
    two = next(int(x.fingerprint, 16) for x in got if x.doc_id == 2)
    away = 1 - bin(int(mine[0].fingerprint, 16) ^ two).count("1") / 64
    assert sorted(x.near_next for x in mine) == [away, 1.0, 1.0]
    assert len({x.edited_sha256 for x in mine if x.near_next == 1}) == 1 and len({x.edited_sha256 for x in mine}) == 2


def test_unequal_weights_in_the_mix(spark):
    rows = [(i, "a" if i % 2 else "b", 10 + i % 7, 4.0 if i % 10 == 1 else 1.0) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double"), (3, 1)).collect()
    assert len(got) == 3000 and max(x.copies for x in got) <= 3
    for s, odd in (("a", 1), ("b", 0)):
        mine = [x for x in got if x.doc_id % 2 == odd]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 8
    heavy, light = ([x.copies for x in got if x.doc_id % 2 and (x.doc_id % 10 == 1) == h] for h in (True, False))
    assert np.mean(heavy) > 2 * np.mean(light)


def test_discriminant_matches_densities():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 1, (300, 3)), r.normal(1.5, [0.3, 1, 2], (500, 3))])
    y = np.repeat([0, 1], [300, 500])
    model = quality.fit(x, y, 0.0, 0.0)
    z = np.clip((x - model.middle) / model.spread, -quality.REACH, quality.REACH)
    density = []
    for c in (0, 1):
        mean, cov = z[y == c].mean(axis=0), np.cov(z[y == c].T, bias=True)
        d = z - mean
        density.append(np.log(((y == c).sum() + 1) / 802) - 0.5 * (np.log(np.linalg.det(cov)) + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(density[0] - density[1])))
    assert np.isfinite(quality.fit(x[:0], y[:0]).scores(x)).all() and np.isfinite(quality.fit(x[:1], y[:1]).scores(x)).all()


def test_plan_never_takes_more_than_there_is():
    r = np.random.default_rng(9)
    for histogram in (r.integers(0, 900, packing.UNITS), np.zeros(packing.UNITS, int), np.eye(packing.UNITS, dtype=int)[32] * 11):
        histogram[0] = 0
        used = np.zeros(packing.UNITS, int)
        for c, n in packing.plan(histogram):
            assert sum(c) == packing.UNITS
            np.add.at(used, list(c), n)
        assert (used <= histogram).all()
    a, x = r.random((20, 60)), np.maximum(0, r.normal(0, 1, 60))
    found = packing.nonnegative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)


def test_e8_decoding_is_nearest():
    r = np.random.default_rng(10)
    x = r.normal(0, 1.5, (200, 8))
    got = lattice_hash.decode(x)
    roots = lattice_hash.neighbours()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    doubled = 2 * got
    assert np.allclose(doubled, np.rint(doubled)) and ((doubled % 2).std(axis=1) < 1e-9).all() and np.allclose(got.sum(axis=1) % 2, 0)
    distance = ((x - got) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all()
    assert all(((x - got - root) ** 2).sum(axis=1).min() >= 0 and (((x - got - root) ** 2).sum(axis=1) >= distance - 1e-9).all() for root in roots)
