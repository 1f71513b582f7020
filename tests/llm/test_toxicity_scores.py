"""Scores of whole documents against a scorer that goes word by word and subsequence by subsequence."""

from __future__ import annotations

import itertools
import math
import os
import random
import tracemalloc

import numpy as np
import pytest

from retort.llm import toxicity


def naive(model, text):
    """The chance of a text by plain loops over the subsequences of each of its words."""
    norms, best = toxicity._norms(toxicity.WINDOW + 2), []
    size = toxicity.ALPHABET + 1
    for word in toxicity.units(text):
        margins = []
        for part in toxicity._windows(word):
            code, _, sizes = toxicity._coded([part], model.alphabet)
            symbols = code[: sizes[0]].tolist()
            total = 0.0
            for a, b, c in itertools.combinations(range(len(symbols)), 3):
                if c - a < toxicity.SPAN:
                    total += toxicity.DECAY ** (c - a + 1) * float(model.weights[(symbols[a] * size + symbols[b]) * size + symbols[c]])
            margins.append(total / norms[len(symbols)] + model.bias)
        best.append(max(margins))
    best = [max(-2.0, min(2.0, m)) for m in sorted(best, reverse=True)[:2]]
    x = [*best, *[-2.0] * (2 - len(best)), 1.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.document, x, strict=True))))


def test_scores_equal_a_naive_scorer(spark):
    rng = random.Random(4)
    syllables = ["ta", "lo", "ren", "vi", "sho", "mek", "du", "pra"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    rows = []
    for k in range(240):
        text = [word() for _ in range(rng.randrange(5, 60))]
        if toxic := k % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["grumplow", "snarkwit", "gr-umplow", "snarrkwit!"]))
        rows.append((k, " ".join(text), int(toxic)))
    docs = [(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "x" * 700 + " g r u m p l o w"), (903, "Ünï 漢字 😀 a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, labels).collect()}
    for k, text in docs:
        assert out[k]["score"] == pytest.approx(naive(model, text or ""), rel=1e-6, abs=1e-9)
        assert out[k]["predicted"] == int(out[k]["score"] >= 0.3)


def test_the_driver_does_not_fit(spark, monkeypatch):
    def fit(sample, totals):
        return toxicity.Model({}, np.zeros(1), float(os.getpid()), (len(sample), *totals))

    monkeypatch.setattr(toxicity, "fit", fit)
    frame = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    assert model.bias not in (0.0, float(os.getpid()))
    assert model.document[0] == sum(model.document[1:]) > 20
    assert toxicity.train(frame.limit(0), labels).document[0] == toxicity.train(frame, labels.limit(0)).document[0] == 0


def test_margins_of_many_words_are_worked_out_in_parts():
    rng = np.random.default_rng(3)
    weights = np.zeros((toxicity.ALPHABET + 1,) * 3)
    weights[1:, 1:, 1:] = rng.random((toxicity.ALPHABET,) * 3)  # gaps between words weigh nothing
    model = toxicity.Model({c: k + 1 for k, c in enumerate("\x01\x02abcdefgh")}, weights.ravel(), -0.5)
    words = ["".join("abcdefgh"[k] for k in rng.integers(0, 8, 12)) for _ in range(60_000)] + ["", "abc" * 40]
    tracemalloc.start()
    found = model.margins(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    for k in (0, 8191, 8192, 59_999, 60_000, 60_001):
        assert found[k] == pytest.approx(model.margins([words[k]])[0], rel=1e-12)
    assert len(model.margins([])) == 0
