"""Vector searches against brute force, toxicity by held-out accuracy, the pipeline stage by stage."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.llm import nearest, topk, toxicity
from retort.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
HERE = os.path.isdir(FOLDER)


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(450, 6)) * 0.3, 2)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, x[100].tolist()), (1000, None), (1001, []), (1002, [None] * 6), (1003, [float("nan")] * 6), (1004, [float("inf")] + [0.0] * 5), (1005, [0.0] * 6), (2000, [1.0, 2.0]), (None, [1.0] * 6)]
    return x, spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, score int")


def test_top_k(spark):
    x, frame = vectors(spark)
    ints = np.floor(64 * np.vstack((x, np.zeros((1, 6)))).astype(np.float32).astype(float)).astype(int)
    ids = np.array([*range(450), 1005])
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, every=20, k=7).collect())
    wanted = []
    for q in range(0, 450, 20):
        s = ints @ ints[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:7]
        wanted += [(q, r + 1, int(ids[k]), int(s[k])) for r, k in enumerate(order)]
    assert got == sorted(wanted)
    assert topk.exact_top_k(frame.limit(0)).count() == 0


def test_nearest(spark):
    x, frame = vectors(spark)
    x = x.astype(np.float32).astype(float)
    got = sorted(tuple(r) for r in nearest.nearest_neighbours(frame, every=50, k=6).collect())
    wanted = []
    for q in range(0, 450, 50):
        d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        order = [k for k in np.lexsort((np.arange(450), d)) if k != q][:6]
        wanted += [(q, r + 1, int(k), float(d[k])) for r, k in enumerate(order)]
    assert got == sorted(wanted)
    few = frame.where("vec_id IN (0, 3, 5)")
    assert nearest.nearest_neighbours(few, every=50, k=6).count() == 2


def brute_top_k(rows, every, k):
    """By exact whole numbers; rows: (id, vector)."""
    import math

    whole = lambda x: int(x) * 64 if abs(x) >= 2.0**53 else math.floor(x * 64)
    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    out = []
    for i, v in ints:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ints if j != i)[:k]
            out += [(i, r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size", [1e-3, 1.0, 1e5, 1e9, 1e155, 1e200, 1e307])
def test_vectors_of_any_size(spark, size):
    from fractions import Fraction

    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=5) * (size if k % 3 else 1.0)).tolist()) for k in range(90)] + [(90, [20000.0, 1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, every=10, k=6).collect()) == brute_top_k(rows, 10, 6)
    got = {}
    for r in nearest.nearest_neighbours(frame, every=10, k=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, v in rows:
        if i % 10 == 0:
            true = {j: sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(v, w, strict=True)) for j, w in rows if j != i}
            found = sorted(got[i])
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5, 6]
            assert all(abs(Fraction(s) ** 2 - true[j]) * 10**9 <= true[j] for _, j, s in found)
            assert max(true[j] for _, j, _ in found) <= sorted(true.values())[5] * (1 + Fraction(1, 10**9))


def test_vector_searches_of_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 2.5]), (2, [0.0, 2.5]), (3, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS v", "3 AS dim")
    got = [tuple(r) for r in nearest.nearest_neighbours(frame, every=50, k=3).orderBy("rank").collect()]
    assert [(v, round(s, 6)) for _, _, v, s in got] == [(1, 0.0), (2, 0.5), (1, round(5**0.5, 6))]
    assert [r["vec_id"] for r in topk.exact_top_k(frame, every=50, k=2).orderBy("rank").collect()] == [2, 1]
    assert nearest.nearest_neighbours(frame.limit(0)).count() == topk.exact_top_k(frame.limit(0)).count() == 0


def corpus(seed, n=700):
    rng = random.Random(seed)
    syllables = ["ta", "lo", "mi", "ren", "sto", "vek", "ul", "ban", "dri", "os"]
    insults = ["grumplow", "snarkwit", "blotzen"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for k in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 80))], int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            w = rng.choice(insults) + rng.choice(["", "s", "ing", "ta"])
            words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(9000, None, 0.5), (9001, "", 0.5), (9002, "ta lo gr-ump-low s.n.a.r.k.w.i.t b l o t z e n", 0.5), (None, "ta lo", 0.5), (9003, "x" * 3000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = {k: x for k, _, x in rows}
    held = [k for k in truth if out[k]["held_out"]]
    assert len(held) > 100 and sum(out[k]["predicted"] == truth[k] for k in held) / len(held) > 0.97
    assert out[9002]["predicted"] == 1, "gaps and inserted characters"
    assert out[9000]["predicted"] == out[9001]["predicted"] == out[None]["predicted"] == 0 and not out[None]["held_out"]
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= toxicity.score_toxicity(docs, none).first()["score"] <= 1


def test_kernel_equals_naive_subsequences():
    import itertools

    words = ["grumplow", "gr-umplow", "ab", "a", "漢字漢字", "Ωmegaωω", "tarenlotarenlotarenlotar"]
    alphabet = {"\x01": 1, "\x02": 2} | {c: k + 3 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz-")}

    def features(word):
        code, _, sizes = toxicity._coded([word], alphabet)
        symbols, out = code[: sizes[0]].tolist(), {}
        for at in itertools.combinations(range(len(symbols)), 3):
            if at[2] - at[0] < toxicity.SPAN:
                key = tuple(symbols[k] for k in at)
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    norms = toxicity._norms(toxicity.WINDOW + 2)
    got = toxicity._kernel(words, words, alphabet)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = features(a), features(b)
            assert got[i, j] == pytest.approx(sum(v * y.get(k, 0.0) for k, v in x.items()) / norms[len(a) + 2] / norms[len(b) + 2])
    assert len(set(toxicity._coded(["漢字"], alphabet)[0][1:3].tolist())) == 2, "characters without a number of their own count"


def test_toxicity_without_blanks_and_with_repeated_ids(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        toxic = int(k % 4 == 0)
        text = "".join(rng.choice("天地人日月山水火木金土風雨雪花") for _ in range(120))
        at = rng.randrange(100)
        rows.append((k, text[:at] + ("惡毒壞鬼" if toxic else "") + text[at:], toxic))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    truth = {k: x for k, _, x in rows}
    assert len(out) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.95


def test_kernel_is_positive_semidefinite_and_tolerates_gaps():
    words = ["grumplow", "gr-umplow", "grumpplow", "tarenlo", "stovek", "gxrumplow"]
    alphabet = {"\x01": 1, "\x02": 2} | {c: k + 3 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz-")}
    k = toxicity._kernel(words, words, alphabet)
    assert np.linalg.eigvalsh(k).min() > -1e-9
    assert k[0, 1] > 2 * k[0, 3] and k[0, 5] > 2 * k[0, 4]


@pytest.mark.skipif(not HERE, reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    got, wanted = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert columns == sorted(wanted.columns) and rows(got) == rows(wanted)


@pytest.mark.skipif(not HERE, reason="needs the driver's tables")
def test_pipeline_stages_of_odd_documents(spark):
    import corpus_pipeline
    from retort.llm.common import cut

    names = "score double, predicted int, held_out string, size string, target int, taken int, source_size int, email string, spans int, words int, key int"
    texts = ["", None, " \t", "x" * 60_000, "a b " * 20_000, *(f"some words that differ {k} and then some more {k * 7} of them {k % 3}" for k in range(40))]
    rows = [(k if k != 8 else None, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 0.5, 7, "h", "z", 1, 2, 3, "e", 4, 5, 6) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[12], rows[13]], "doc_id long, text string, lang string, source string, n_chars long, " + names)
    own = dict(zip([n.split()[0] for n in names.split(", ")], rows[0][5:], strict=True))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0, name
        out = cut(stage(spark, docs, FOLDER))
        if k < 4:
            assert out.columns == docs.columns
            assert {tuple(r[c] for c in own) for r in out.collect()} == {tuple(own.values())}, name
        assert out.count() >= (40 if k != 3 else 1)
        if k == 1:
            assert out.count() == len(rows)
        docs = out if k < 4 else docs


@pytest.mark.skipif(not HERE, reason="needs the driver's tables")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from retort.llm.common import cut, documents

    docs, columns = documents(spark, FOLDER), documents(spark, FOLDER).columns
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, FOLDER))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] and sizes[5] == sizes[4]
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0
