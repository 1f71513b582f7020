"""Kernel ridge regression by conjugate gradients, products and moments of local kernels, against closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions.kernels import kernel_array
from retort.operators import pairs, regression, ridge


def closed(k, y, lam):
    """Coefficients and what predictions need, by a dense solver."""
    h = k - k.mean(1, keepdims=True) - k.mean(0, keepdims=True) + k.mean()
    alpha = np.linalg.solve(h + lam * np.eye(len(y)), y - y.mean())
    return lambda rows: (rows - rows.mean(1, keepdims=True) - k.mean(0) + k.mean()) @ alpha + y.mean()


@pytest.mark.parametrize(("side", "sent"), [(8192, ridge.SENT), (110, 0)])
def test_vectors(spark, monkeypatch, side, sent):
    monkeypatch.setattr(ridge, "SIDE", side)
    monkeypatch.setattr(ridge, "SENT", sent)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    y = np.sin(x[:, 0]) + x[:, 1] + 7
    train = spark.createDataFrame([(7 * k, v.tolist(), float(t), 1) for k, (v, t) in enumerate(zip(x, y, strict=True))] + [(99_991, None, 1.0, 2), (99_990, [0.0] * 5, None, 2)], "id long, v array<double>, y double, i int")
    rows = rng.normal(size=(50, 5))
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id long, v array<double>")
    for kernel, sigma, lam in (("Matern52", 3.0, 0.1),):
        model = ridge.fit_vectors(train, kernel, sigma, lam)
        wanted = closed(kernel_array(kernel, pairs.distances(x, x) / sigma), y, lam)(kernel_array(kernel, pairs.distances(rows, x) / sigma))
        got = {r["id"]: r["prediction"] for r in ridge.predict_vectors(model, asked).collect()}
        assert [got[k] for k in range(50)] == pytest.approx(wanted, abs=1e-7)
    old = {r["id"]: r["prediction"] for r in regression.predict(train.where("y is not null AND v is not null").drop("i"), asked, "Matern52", 3.0, 0.1).collect()}
    assert [got[k] for k in range(50)] == pytest.approx([old[k] for k in range(50)], abs=1e-7)


def test_few_rows_and_no_end(spark):
    empty = spark.createDataFrame([], "id long, v array<double>, y double")
    asked = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert [tuple(r) for r in ridge.predict_vectors(ridge.fit_vectors(empty, "Gaussian", 1.0, 0.1), asked).collect()] == [(1, 0.0)]
    one = spark.createDataFrame([(5, [2.0], 3.5)], "id long, v array<double>, y double")
    assert [tuple(r) for r in ridge.predict_vectors(ridge.fit_vectors(one, "Gaussian", 1.0, 0.1), asked).collect()] == [(1, 3.5)]
    three = spark.createDataFrame([(k, [float(k)], float(k * k)) for k in range(5)], "id long, v array<double>, y double")
    tiles = ridge.GlobalTiles(three.select("id", "v"), "Gaussian", 1.0)
    with pytest.raises(ArithmeticError):
        ridge.fit(tiles, three, "id", 1e-9, most=1)


def molecules_of(spark, seed, n, size):
    rng = np.random.default_rng(seed)
    atoms = [(m, f"e{rng.integers(2)}", rng.uniform(size=4).tolist()) for m in range(n) for _ in range(rng.integers(*size))]
    return atoms, spark.createDataFrame(atoms, "mol long, z string, v array<double>")


def dense(atoms, kernel, sigma, elemental, other=None):
    """The unnormalised local kernel between two lists of atoms, and the molecules' numbers."""
    other = other or atoms
    k = kernel_array(kernel, pairs.distances(np.array([a[2] for a in atoms]), np.array([b[2] for b in other])) / sigma)
    if elemental:
        k = k * np.array([[a[1] == b[1] for b in other] for a in atoms])
    to = lambda rows: np.array([[r[0] == m for r in rows] for m in range(1 + max(r[0] for r in rows))], float)
    return to(atoms) @ k @ to(other).T


@pytest.mark.parametrize("mode", ["all", "elemental"])
def test_molecules(spark, monkeypatch, mode):
    monkeypatch.setattr(pairs, "ATOMS", 40)
    atoms, frame = molecules_of(spark, 1, 20, (2, 9))
    more, asked = molecules_of(spark, 2, 9, (1, 5))
    k, own, met = (dense(*a) for a in ((atoms, "Gaussian", 0.5, mode == "elemental"), (more, "Gaussian", 0.5, mode == "elemental"), (more, "Gaussian", 0.5, mode == "elemental", atoms)))
    met = met / np.sqrt(np.outer(np.diag(own), np.diag(k)))
    k = k / np.sqrt(np.outer(np.diag(k), np.diag(k)))
    y = np.arange(20.0) ** 1.5
    labels = spark.createDataFrame([(m, float(v)) for m, v in enumerate(y)], "mol long, y double")
    model = ridge.fit_molecules(frame, labels, "Gaussian", 0.5, 0.01, mode)
    got = {r["mol"]: r["prediction"] for r in ridge.predict_molecules(model, asked).collect()}
    assert [got[m] for m in range(9)] == pytest.approx(closed(k, y, 0.01)(met), rel=1e-6)
    coefficients = labels.select("mol", F.col("y").alias("c")).where("mol < 15")
    products = {r["mol"]: r["c"] for r in pairs.local_products(asked, frame, coefficients, ["c"], "Gaussian", 0.5, mode).collect()}
    assert [products[m] for m in range(9)] == pytest.approx(met[:, :15] @ y[:15], rel=1e-9)


@pytest.mark.parametrize(("kernel", "sigma", "mode"), [("Gaussian", 0.4, "elemental"), ("Exponential", 0.2, "all")])
def test_moments_give_the_kernel(spark, monkeypatch, kernel, sigma, mode):
    monkeypatch.setattr(pairs, "ATOMS", 64)
    atoms, frame = molecules_of(spark, 3, 20, (3, 8))
    k = dense(atoms, kernel, sigma, mode == "elemental")
    k = k / np.sqrt(np.outer(np.diag(k), np.diag(k)))
    moments = pairs.local_moments(frame, pairs.POWERS[kernel], mode)
    last = moments.groupBy("i", "j").agg(F.max_by("m0", "bin").alias("n")).collect()
    counts = dense(atoms, "Power", 1e12, mode == "elemental")
    assert {(r["i"], r["j"]): round(r["n"]) for r in last} == {(i, j): round(counts[i, j]) for i in range(20) for j in range(i, 20) if round(counts[i, j])}
    rows = pairs.local_kernels_of_scales(frame, kernel, [sigma, 1e4], mode).collect()
    got = {(r["i"], r["j"]): r["k"] for r in rows if r["sigma"] == sigma}
    assert max(abs(got[i, j] - k[i, j]) for i in range(20) for j in range(i, 20)) < 1e-8
    wide = {(r["i"], r["j"]): r["k"] for r in rows if r["sigma"] == 1e4}  # rejected, so exact
    exact = {(r["i"], r["j"]): r["k"] for r in pairs.local_kernel(frame, kernel, 1e4, mode).collect()}
    assert wide == pytest.approx(exact, abs=1e-12) and len(wide) == 210


def test_columns_of_the_kernel_make_fewer_steps(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2]
    rows = spark.createDataFrame([(3 * k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double").cache()
    tiles = ridge.GlobalTiles(rows.select("id", "v"), "Gaussian", 2.0)

    class Plain:
        ids, multiply = tiles.ids, staticmethod(tiles.multiply)

    lam = 0.05
    near, plain = ridge.fit(tiles, rows, "id", lam), ridge.fit(Plain, rows, "id", lam)
    assert 3 * near.steps < plain.steps
    order = [i // 3 for i in tiles.ids]
    k = kernel_array("Gaussian", pairs.distances(x, x) / 2.0)
    h = k - k.mean(1, keepdims=True) - k.mean(0, keepdims=True) + k.mean()
    wanted = np.linalg.solve(h + lam * np.eye(400), y - y.mean())[order]
    for model in (near, plain):
        assert model.alpha == pytest.approx(wanted, abs=1e-8)
    same = spark.createDataFrame([(k, [1.0, 2.0], float(k)) for k in range(9)], "id long, v array<double>, y double")  # a kernel of rank 1
    assert ridge.fit_vectors(same, "Gaussian", 1.0, 0.1).alpha == pytest.approx((np.array([0, 1, 2, 3, 4, 5, 6, 7, 8]) - 4) / 0.1)


def test_a_tile_of_the_gaussian_kernel():
    rng = np.random.default_rng(13)
    a = rng.normal(size=(20, 6))
    b = np.concatenate([a[:5], rng.normal(size=(7, 6))])
    for factor in (1.0, 1e-3, 1e5):  # far from 0 the root's rounding is kept
        got, wanted = (f(factor * a, factor * b) for f in (lambda p, q: ridge.kernel_of("Gaussian", p, q, 1.5, {}), lambda p, q: kernel_array("Gaussian", pairs.distances(p, q) / 1.5)))
        assert np.abs(got - wanted).max() < 1e-12 and got.max() <= 1.0
