"""Each corpus query over tables with every edge case, against plain Python; and over empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from edge_cases import edge_rows

import corpus_pipeline
from paceshift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(i, t or "") for i, t, *_ in edge_rows()]


def rows_of(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def multiset(rows):
    return Counter(rows)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    query = QUERIES.get(name, corpus_pipeline.run)
    assert query(spark, empty_dir).collect() == []


def test_lm_scoring(spark, edge_dir):
    got = rows_of(spark, edge_dir, "op1_lm_scoring")
    tokens = [(i, [*WORD.findall(t.translate(LOWER)), None]) for i, t in ROWS]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in ROWS}
    counts = Counter(itertools.chain.from_iterable(t for i, t in tokens if not held[i]))
    n, v = sum(counts.values()), len(counts)
    want = multiset(
        (i, held[i], len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens
    )
    assert multiset((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_url_filter(spark, edge_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{edge_dir}/pages.parquet").collect()]

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(spark, edge_dir, "op2_url_filter")]
    assert multiset(got) == multiset((i, *judged(u)) for i, u in pages)


def test_suffix_dedup(spark, edge_dir):
    first = {}
    for i, t in ROWS:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    want = []
    for i, t in ROWS:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = rows_of(spark, edge_dir, "op3_suffix_dedup")
    assert multiset((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == multiset(want)
    assert sum(w[2] for w in want) > 6000


def labelled_runs(words):
    seen, out = Counter(), set()
    for j in range(max(1, len(words) - 4) if words else 0):
        run = tuple(words[j : j + 5])
        out.add((run, seen[run]))
        seen[run] += 1
    return out


def test_near_duplicates(spark, edge_dir):
    runs = [(i, labelled_runs(WORD.findall(t))) for i, t in ROWS]
    label = {i: i for i, _ in ROWS}
    for _ in ROWS:
        for (i, a), (j, b) in itertools.combinations(runs, 2):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                label[i] = label[j] = min(label[i], label[j])
    got = rows_of(spark, edge_dir, "op4_near_duplicates")
    assert multiset((r["doc_id"], r["component_id"], r["kept"]) for r in got) == multiset((i, label[i], label[i] == i) for i, _ in ROWS)
    assert label[8] == 6


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secret_scan(spark, edge_dir):
    got = rows_of(spark, edge_dir, "op5_secret_scan")
    want = []
    for i, t in ROWS:
        spans = base_spans(t)
        digest = hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), digest))
    assert multiset((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == multiset(want)
    assert len(got) == len(ROWS)


def test_simhash(spark, edge_dir):
    got = rows_of(spark, edge_dir, "op6_simhash")
    by_text = defaultdict(set)
    texts = dict(ROWS)
    single = [i for i, n in Counter(i for i, _ in ROWS).items() if n == 1]
    order = sorted(texts)
    rows = {r["doc_id"]: r for r in got}
    assert {r["doc_id"] for r in got} == set(order)
    for i in single:
        t, r = texts[i], rows[i]
        by_text[t].add(r["fingerprint"])
        following = order[(order.index(i) + 1) % len(order)]
        if following in single:
            q = len(t) // 4
            edited = t[: len(t) - q] + texts[following][:q]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["n_chars"] == len(t)
            bits = bin(int(r["fingerprint"], 16) ^ int(rows[following]["fingerprint"], 16)).count("1")
            assert r["near_next"] == pytest.approx(1 - bits / 64)
        bits = bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1")
        assert r["near_edited"] == pytest.approx(1 - bits / 64)
        near = sum(bin(int(r["fingerprint"], 16) ^ int(o["fingerprint"], 16)).count("1") <= 3 for o in got) - 1
        assert r["n_within"] == (near if i % 50 == 0 else None)
    assert all(len(x) == 1 for x in by_text.values())


def test_mixing(spark, edge_dir):
    got = rows_of(spark, edge_dir, "op7_mix_sources")
    sizes = [(i, len(WORD.findall(t or "")), s) for i, t, _, s, _ in edge_rows()]
    assert multiset((r["doc_id"], r["size"]) for r in got) == multiset((i, n) for i, n, _ in sizes)
    source = defaultdict(int)
    for _, n, s in sizes:
        source[s] += n
    names = sorted(source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # the excess goes round again until no target is above its cap
        level = (sum(source.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * source[s]}
        target |= {s: 3.0 * source[s] for s in over} or {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    own = dict((i, s) for i, _, s in sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[own[r["doc_id"]]])
        assert r["source_size"] == source[own[r["doc_id"]]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[own[r["doc_id"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for _, n, x in sizes if x == s) / 2 + 1e-6
    assert multiset(tuple(r.items()) for r in got) == multiset(tuple(r.items()) for r in rows_of(spark, edge_dir, "op7_mix_sources"))


def test_quality(spark, edge_dir):
    got = rows_of(spark, edge_dir, "op8_quality")
    assert multiset(r["doc_id"] for r in got) == multiset(i for i, _ in ROWS)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def check_pieces(pieces, ids_of):
    """ids_of: the documents' ids by doc_id (several documents may share one)."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    own = defaultdict(Counter)
    for p in pieces:
        own[p["doc_id"]][p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]] += 1
    for i, documents in ids_of.items():
        assert sum(n * length for (_, length, _, _), n in own[i].items()) == sum(map(len, documents))
        for start, length, crc, total in own[i]:
            assert any(len(d) == total and zlib.crc32(np.array(d[start : start + length], "<u4").tobytes()) == crc for d in documents)


def test_packing(spark, edge_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for i, t in ROWS:
        ids[i].append([*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    check_pieces(rows_of(spark, edge_dir, "op9_packing"), ids)


def test_near_vectors(spark, edge_dir):
    vectors = {}
    for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect():
        vectors[r.vec_id] = r.embedding
    usable = {i: np.array(v, float) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}

    def cosine(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0.0

    linked = {i: {j for j in usable if j != i and cosine(usable[i], usable[j]) >= 0.9} if i in usable else set() for i in vectors}
    label = {i: i for i in vectors}
    for _ in vectors:
        for i, near in linked.items():
            label[i] = min([label[i], *(label[j] for j in near)])
    got = rows_of(spark, edge_dir, "op10_near_vectors")
    assert len(got) == len(vectors) + 1  # one row is there twice
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= len(linked[i]) for i in vectors)
    assert sum(found.values()) >= 0.9 * sum(map(len, linked.values()))
    assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (label[i], label[i] == i) for i in vectors}


def test_pipeline_over_edge_cases(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, edge_dir)
        assert after.columns == docs.columns
        assert after.count() >= 0
    # Each later stage over the whole of the edge cases too.
    kept = corpus_pipeline.without_copies(spark, docs, edge_dir).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in ROWS} - {7, 8})
    clean = {(r.doc_id, r.text) for r in corpus_pipeline.without_secrets(spark, docs, edge_dir).select("doc_id", "text").collect()}
    assert (10, "[SECRET]\" [SECRET]") in clean or any(i == 10 and "AKIA" not in t for i, t in clean if t)
    assert {(i, t) for i, t in clean if i != 10} >= {(i, t) for i, t, *_ in edge_rows() if i not in (10, 12, 13)}
    check_pieces([r.asDict() for r in corpus_pipeline.run(spark, edge_dir).collect()], {})


def test_copies_without_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a)] * 4 + [(None, a + " more"), (7, b), (None, b), (None, b + " more"), (None, ""), (None, ""), (None, None), (8, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, "").collect()]
    assert sum(i is None and bool(t) for i, t in kept) == 1 and {t for i, t in kept if i is None and t} <= {a, a + " more"}
    assert multiset((i, t) for i, t in kept if i is not None or not t) == multiset([(7, b), (8, "other words"), (None, ""), (None, ""), (None, None)])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_pipeline_against_brute_force(spark, folder, tmp_path):
    """Stage by stage on the test data: what each one keeps and what it changes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if name == "packing":
            break
        after = Counter(r.doc_id for r in rows)
        if name == "quality classifier":
            assert all((i in after) == (q == 1) for i, q in quality.items())
            assert all(before[r.doc_id] == r for r in rows)
        elif name == "near duplicates":
            runs = [(i, labelled_runs(WORD.findall(r.text or ""))) for i, r in sorted(before.items())]
            label = {i: i for i, _ in runs}
            holders = defaultdict(list)
            for n, (_, run) in enumerate(runs):
                for x in run:
                    holders[x].append(n)
            pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
            links = [(runs[a][0], runs[b][0]) for a, b in pairs if len(runs[a][1] & runs[b][1]) >= 0.8 * len(runs[a][1] | runs[b][1])]
            for _ in range(6):
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
            assert set(after) == {i for i in label if label[i] == i} and set(after.values()) == {1}
        elif name == "secret scans":
            assert set(after) == set(before)
            for r in rows:
                assert not base_spans(r.text or "")
                assert r == before[r.doc_id] or "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert set(after.values()) <= {1, 2, 3} and set(after) <= set(before)
            assert all(before[r.doc_id] == r for r in rows)
        before = {r.doc_id: r for r in rows}
        last = rows
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in last:
        ids[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
    check_pieces([r.asDict() for r in rows], ids)
