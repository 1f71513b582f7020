"""Substring dedup against a plain loop over all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from retort.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for i in range(k, k + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)] + ["É", "é", "漢字"]
    some = lambda n: rng.choices(words, k=n)
    passages = [some(n) for n in (34, 35, 36, 60, 140)]
    texts = []
    for _ in range(120):
        parts = [some(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 30))
            parts += [p[a : a + rng.randrange(20, 140)], some(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w for part in parts for w in part))
    near = some(300)
    for _ in range(60):  # copies with a changed word
        t = list(near)
        t[rng.randrange(300)] = "changed"
        texts.append(" ".join(t))
    texts += [" ".join(near)] * 30 + [" ".join(near).upper()]
    texts += ["a " * 5000, "a b " * 40, "x y z " * 12, " ".join(some(34)), "a " * 35, "b " * 36, "", None, " \n\t", "one", "é\x0b漢\x0c\x1f x"]
    same = some(40)
    return texts + [" ".join(same + some(5) + same)]


@pytest.mark.parametrize(("window", "size"), [(35, repeats.CHUNK), (35, 3000), (4, 3000), (2, 500)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, size):
    monkeypatch.setattr(repeats, "LEAST", 1 << 8)
    monkeypatch.setattr(repeats, "KEYS", 1)
    texts = corpus(window)
    rows = [(k, t, 1, "n") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string").repartition(3)
    made = repeats.chunked

    def smaller(docs):  # chunks of few documents, as workers don't see a patched size
        return made(docs.repartition(max(1, 100_000 // size), "doc_id"))

    monkeypatch.setattr(repeats, "chunked", smaller)
    out = repeats.without_repeats(frame, window)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    wanted = dict(enumerate(brute(texts, window)))
    assert {k: v for k, v in got.items() if v != wanted[k]} == {}
    assert len(got) == len(texts)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"v{k}" for k in range(50))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text + " tail"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(frame).collect())
    assert got == [(0, 51, 50, "tail"), (1, 50, 50, ""), (1, 50, 50, ""), (2, 0, 0, "")]
    assert repeats.without_repeats(frame.limit(0)).count() == 0
    assert repeats.without_repeats(frame.where("text is null")).count() == 1


def test_packing_and_rolling():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1 << 40, 1 << 41, 1000, dtype=np.uint64))
    for base in (0, 1 << 40):
        assert (repeats.unpack_sorted(len(keys), base, *repeats.pack_sorted(keys, base)) == keys).all()
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    both = np.concatenate((words, words[100:200], words))
    hashes = repeats.rolling(both, 18)
    assert (hashes[100:183] == hashes[300:383]).all() and len(np.unique(hashes)) == len(set(map(bytes, np.lib.stride_tricks.sliding_window_view(both, 18))))
    swapped = both.copy()
    swapped[[0, 1]] = swapped[[1, 0]]
    assert repeats.rolling(swapped, 18)[0] != hashes[0]
