"""Large buckets of near copies, in blocks of any size."""

import itertools
import random

import numpy as np
import pytest

from paceshift.llm import order_minhash
from paceshift.llm.common import text_of

REAL = order_minhash.links


def texts_in_groups(seed):
    """Near copies of a few bodies that share a long head, so that buckets hold several classes; chains of edits; exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    head, docs = [word() for _ in range(60)], []
    for body in [[word() for _ in range(60)] for _ in range(4)]:
        for _ in range(25):
            text = head + body
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    chain = [word() for _ in range(120)]
    for i in range(20):
        chain = chain[3:] + [word() for _ in range(3)]
        docs += [" ".join(chain)] * (1 + i % 2)
    r.shuffle(docs)
    return [(7 * i % 997, t) for i, t in enumerate(docs)]


def similar(a, b):
    runs = [{}, {}]
    for words, seen in zip((a.split(), b.split()), runs, strict=True):
        for j in range(len(words) - 4):
            run = tuple(words[j : j + 5])
            seen.setdefault(run, j)
    common = [(runs[0][x], runs[1][x]) for x in runs[0].keys() & runs[1].keys()]
    m = order_minhash.longest_rise(np.array([j for _, j in sorted(common)]))
    return m >= 0.8 * (len(runs[0]) + len(runs[1]) - m) - 1e-9


@pytest.mark.parametrize("block_rows", [1, 3, 8, 512])
def test_classes_do_not_depend_on_blocks(spark, monkeypatch, block_rows):
    docs = texts_in_groups(block_rows)
    label = {i: i for i, _ in docs}
    pairs = {(i, j) for (i, a), (j, b) in itertools.combinations(docs, 2) if similar(a, b)}
    for _ in docs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    monkeypatch.setattr(order_minhash, "links", lambda texts, rows: REAL(texts, rows, block_rows))
    got = order_minhash.near_duplicates(text_of(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert len(set(label.values())) > 4
    # Every link that is reported is a similar pair, and whoever is not alone has one, unless it only has exact copies.
    linked = pairs | {(j, i) for i, j in pairs}
    assert all((r.doc_id, r.linked_id) in linked for r in got if r.linked_id is not None)
    texts = dict(docs)
    for r in got:
        others = [i for i in label if label[i] == label[r.doc_id] and texts[i] != texts[r.doc_id]]
        assert r.linked_id is not None or not others
