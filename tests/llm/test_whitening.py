"""Whitening against a dense solver and exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from retort.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "z") for i, v in rows], "vec_id long, embedding array<double>, n int, x string").repartition(3)


@pytest.mark.parametrize("dim", [3, 24])
def test_whitening_equals_a_dense_solver(spark, dim):
    rng = np.random.default_rng(dim)
    data = rng.normal(size=(400, dim)) @ np.diag(np.linspace(0.2, 2, dim)) + 0.3
    rows = [(k, v) for k, v in enumerate(data)] + [(k, data[k % 7]) for k in range(1000, 1120)] + [(None, data[3])]
    odd = [(2000, None), (2001, []), (2002, [None] * dim), (2003, [float("nan")] * dim), (2004, [float("inf")] + [0.0] * (dim - 1))]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, rows + odd)).collect()}
    most = min(dim, 16)
    assert len(got) == (len(rows)) * most
    whole = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in rows}
    fit = np.array(sorted({tuple(v) for v in whole.values()}), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = np.array([[float(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    white = {k: np.array([(n * v - s) / n for v, s in zip(whole[k], sums, strict=True)]) @ vectors / np.sqrt(values) for k in whole}
    for c in range(most):
        sign = 1 if got[(0, c + 1)]["whitened"] * white[0][c] > 0 else -1
        for k in whole:
            r = got[(k, c + 1)]
            assert r["n"] == n and int(r["deviation"]) == sum((n * v - s) ** 2 for v, s in zip(whole[k], sums, strict=True))
            assert r["whitened"] == pytest.approx(sign * white[k][c], abs=1e-9)
            assert r["explained"] == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-10)
            assert r["identity_error"] < 1e-9


def test_degenerate_tables(spark):
    empty = whitening.whiten(table(spark, [(1, None)]))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 and r["deviation"] == 0 for r in same)
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)] + [(50, [1.0, 7.0]), (51, [2.0, 7.0])])).collect()
    assert len(line) == 27 + 4
    first = sorted((r["vec_id"], r["whitened"]) for r in line if r["component"] == 1 and r["vec_id"] < 50)
    wanted = [(k - 4) / math.sqrt(60 / 9) for k in range(9)]
    assert [w for _, w in first] == pytest.approx(wanted, abs=1e-12)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in line if r["component"] > 1)
    huge = whitening.whiten(table(spark, [(k, [k * 1e12, -k * 1e12]) for k in range(3)])).collect()
    assert sorted({int(r["deviation"]) for r in huge}) == [0, 2 * (3 * 64 * 10**12) ** 2]


def test_contour_finds_clusters_and_inertia_counts():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.concatenate((np.full(9, 5.0), 5 + 1e-9 * np.arange(4), [4.0, 3.0, 3.0], np.linspace(0.1, 1, 24)))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (0.05, 0.5, 2.9, 3.5, 4.5, 6.0):
        assert whitening.above(matrix, shift) == (values > shift).sum()
    assert whitening.above(np.array([[0.0, 2.0], [2.0, 0.0]]), 0.0) == 1
    found = [whitening.feast(matrix, *interval) for interval in whitening.upper_intervals(matrix, 18)]
    got = np.sort(np.concatenate([v for v, _ in found]))[::-1]
    assert len(got) >= 18 and got[:18] == pytest.approx(np.sort(values)[::-1][:18], abs=1e-12)
    vectors = np.hstack([v for _, v in found])
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-9
