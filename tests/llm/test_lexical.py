"""Ranked lexical search against a plain loop over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from retort.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, asked in items.items():
        scored = []
        for doc, c in counted:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("cells", "vocabulary"), [(lexical.CELLS, lexical.VOCABULARY), (8, 2500)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, cells, vocabulary):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Été", "漢字", "ÉTÉ", "x1"]
    some = lambda n: rng.choice([" ", "-", "\x1c", " "]).join(rng.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=n))
    docs = [(k, some(rng.choice([1, 3, 20, 200]))) for k in range(300)]
    docs += [(k, docs[k][1]) for k in range(40)] + [(1000 + k, docs[7][1]) for k in range(50)] + [(400, None), (401, ""), (402, " -_\n"), (None, "w1 w2 w60"), (403, "W1 " * 30_000)]
    items = [(k, some(rng.choice([1, 5, 40]))) for k in range(12)] + [(3, "w1 w1 w59"), (4, "unknownword"), (20, None), (21, ""), (None, "w1"), (22, docs[5][1])]
    items += [items[0]]
    wanted: dict = {}
    for item, text in dict.fromkeys(items):
        if item is not None:
            wanted[item] = wanted.get(item, Counter()) + Counter(terms(text))
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    out = lexical.ranked_search(frame, asked, k=7)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, out.collect())) == key(brute(docs, wanted, 7))
    assert lexical.ranked_search(frame.limit(0), asked).count() == 0
    assert lexical.ranked_search(frame, asked.limit(0)).count() == 0


def test_masks_are_not_all_evaluated():
    import numpy as np

    rng = np.random.default_rng(1)
    present = rng.random((4000, 12)) < 0.2
    gains = np.where(present, rng.integers(400_000, 500_000, present.shape), 0)
    weights = rng.integers(1, 9000, 12)
    order = rng.permutation(4000)
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, np.ndarray) and out.ndim == 2:
                seen.append(len(out))
            return np.asarray(out)

    best, score = lexical.best_by_masks(present, gains.view(Counting), weights, order, 20)
    all_scores = gains @ weights
    wanted = np.lexsort((order, -all_scores))[:20]
    assert best.tolist() == wanted.tolist() and score.tolist() == all_scores[wanted].tolist()
    assert sum(seen) < 1000
