"""Shells of a basis, sums over pairs of nuclei, divergences of samples, percentiles by ranges."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from retort.functions.hashing import first_48_bits
from retort.operators import basis, nuclear, pairs, stats


def test_shells(spark):
    rows = [("H", 0, 0), ("H", 1, 0), ("H", 2, 1), ("C", 0, 0), ("C", 1, 1), ("C", 2, 0), ("C", 3, 1), ("C", 4, 2), ("O", 0, 1), ("O", 1, 0), ("O", 2, 1), ("O", 3, 2)]
    frame = spark.createDataFrame([(e, s, l, float(k), 1.0) for e, s, l in rows for k in range(2)], "element string, shell int, l int, exp double, coef double")
    got = sorted({(r["element"], r["shell"], r["l"], r["place"]) for r in basis.select_shells(frame, "PSD").collect()})
    assert got == [("C", 0, 0, 0), ("C", 1, 1, 1), ("C", 4, 2, 2), ("H", 0, 0, 0), ("H", 1, 0, 1), ("H", 2, 1, 2), ("O", 0, 1, 1), ("O", 1, 0, 0), ("O", 3, 2, 2)]
    assert basis.select_shells(frame, "S").where("element = 'C'").count() == 2
    with pytest.raises(ValueError, match="element O has 1 shells S, 2"):
        basis.select_shells(frame, "SSPPD")
    with pytest.raises(ValueError, match="no such shells"):
        basis.select_shells(frame, "SX")
    assert basis.parse_shells("SPPD") == {0: 1, 1: 2, 2: 1}


def test_nuclear_sums_are_derivatives(spark):
    rng = random.Random(2)
    atoms = [(m, i, float(rng.randrange(1, 9)), *(rng.uniform(-2, 2) for _ in range(3))) for m, n in (("a", 4), ("b", 2), ("c", 1)) for i in range(n)]
    changes = [("a", 0, 0.5), ("a", 2, -1.5), ("b", 1, 2.0), ("c", 0, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "mol string, i int, q double, x double, y double, z double")
    moved = spark.createDataFrame(changes, "mol string, i int, d double")

    def energy(rows, m):
        own = [r for r in rows if r[0] == m]
        return sum(a[2] * b[2] / math.dist(a[3:], b[3:]) for a in own for b in own if a[1] < b[1])

    at = lambda t: [(m, i, q + t * sum(d for n, j, d in changes if (n, j) == (m, i)), *p) for m, i, q, *p in atoms]
    value = lambda out: {r["mol"]: r["value"] for r in out.collect()}
    e, first, second = value(nuclear.repulsion(frame(atoms))), value(nuclear.charge_derivative(frame(atoms), moved)), value(nuclear.charge_second_derivative(frame(atoms), moved))
    for m in "abc":
        assert e[m] == pytest.approx(energy(atoms, m))
        low, high = energy(at(-1), m), energy(at(1), m)  # of second order, so exact
        assert first[m] == pytest.approx((high - low) / 2, abs=1e-9) and second[m] == pytest.approx(high + low - 2 * e[m], abs=1e-9)
    force = {(r["mol"], r["i"]): r for r in nuclear.gradient(frame(atoms)).collect()}
    changed = {(r["mol"], r["i"]): r for r in nuclear.gradient_charge_derivative(frame(atoms), moved).collect()}
    later = {(r["mol"], r["i"]): r for r in nuclear.gradient(frame(at(1e-4))).collect()}
    sooner = {(r["mol"], r["i"]): r for r in nuclear.gradient(frame(at(-1e-4))).collect()}
    for k, atom in enumerate(atoms):
        for axis, name in enumerate(("gx", "gy", "gz")):
            shift = lambda t, axis=axis, k=k: [tuple(v + t if (j == k and c == 3 + axis) else v for c, v in enumerate(a)) for j, a in enumerate(atoms)]
            assert force[atom[:2]][name] == pytest.approx((energy(shift(1e-5), atom[0]) - energy(shift(-1e-5), atom[0])) / 2e-5, rel=1e-5, abs=1e-7)
            assert changed[atom[:2]][name] == pytest.approx((later[atom[:2]][name] - sooner[atom[:2]][name]) / 2e-4, rel=1e-6, abs=1e-7)


def test_divergences_of_samples(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(50), rng.randrange(50)) for k in range(200)]
    out = {r["share"]: r for r in stats.sampled_divergences(spark.createDataFrame(rows, "k int, f1 int, f2 int"), "k", [0.25, 1.0]).collect()}
    assert out[0.25]["n"] == 50
    one, two = (np.array([r[c] for r in rows], float) for c in (1, 2))
    every = np.unique(np.concatenate((one, two)))
    assert out[1.0]["ks"] == pytest.approx(max(abs((one <= x).mean() - (two <= x).mean()) for x in every))
    p, q = one / one.sum() + 1e-10, two / two.sum() + 1e-10
    p, q = p / p.sum(), q / q.sum()
    assert out[1.0]["kl"] == pytest.approx((p * np.log(p / q)).sum()) and out[1.0]["reverse_kl"] == pytest.approx((q * np.log(q / p)).sum())


def test_percentiles_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE", 40)
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.normal(size=300), np.full(100, 0.5)))
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    shares = [0.0, 0.1, 0.5, 0.737, 1.0]
    assert stats.percentiles(frame, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert stats.percentiles(frame.where("x is null"), "x", [0.5]) == [None]
    assert pairs.length_scale(spark.createDataFrame([(1, [0.0])], "id long, v array<double>")).first()["scale"] is None
    low, high = stats.interval(frame, "x").first()
    assert (low, high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def test_bootstrap_equals_plain_loops_and_makes_no_row_per_draw(spark):
    rows = [("a", 3, 0), ("b", 1, 2), ("c" * 60, 0, 5), ("d", 2, 2), ("é", 7, 1), (None, 1, 1)]
    merged = spark.createDataFrame(rows, "k string, f1 long, f2 long").repartition(3)
    found = stats.bootstrap(merged, "k", 40, "s")
    assert "Generate" not in found._jdf.queryExecution().toString()
    got = {r["round"]: (r["ks"], r["kl"]) for r in found.collect()}
    rows = [rows[-1], *rows[:-1]]  # nulls first
    for r in range(40):
        drawn = []
        for k, one, two in rows:
            text = f"{r}:s" if k is None else f"{k}:{r}:s"
            u = (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            drawn.append((sum(c <= u for c in stats.POISSON), one, two))
        totals = [sum(t * x[k] for t, *x in drawn) for k in (0, 1)]
        drawn = [(t, *(x[k] / totals[k] + 1e-10 if totals[k] else 1e-10 for k in (0, 1))) for t, *x in drawn if t]
        a, b = (sum(t * x[k] for t, *x in drawn) for k in (0, 1))
        gaps = [abs(sum(t * (p - q) for t, p, q in drawn[: n + 1])) for n in range(len(drawn))]
        assert got[r] == pytest.approx((max(gaps), sum(t * p / a * math.log((p / a) / (q / b)) for t, p, q in drawn)), abs=1e-9)


def test_many_hashes_at_once_equal_the_library():
    starts, ends = [b"", b"1:", b"22:", b"x" * 52, b"y" * 70], [b"0", b"17:0", b"z" * 9]
    wanted = [[int(hashlib.md5(s + e).hexdigest()[:12], 16) for e in ends] for s in starts]
    assert first_48_bits(starts, ends).tolist() == wanted


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(90, 3))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(pairs, "PART", 1)  # a block is a partition
    for met in (pairs.block_pairs(frame, 8), pairs.block_rectangles(frame, frame.limit(20), 8)):
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    many = pairs.block_pairs(frame, 1)
    assert many.rdd.getNumPartitions() < many.count() == len({(tuple(r["a_ids"]), tuple(r["b_ids"])) for r in many.collect()})
    monkeypatch.setattr(pairs, "BLOCK", 8)
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (8,))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    k = np.exp(-d / 2)
    sums = {(r["id"], r["kernel"]): r["total"] for r in pairs.kernel_row_sums(frame, {"Exponential": {}, "Gaussian": {}}, 2.0).collect()}
    assert len(sums) == 180 and [sums[i, "Exponential"] for i in range(90)] == pytest.approx(k.sum(1))
    c = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    centered = {r["i"]: (r["power"], r["most"]) for r in pairs.centered_sums(frame, "Exponential", 2.0).collect()}
    assert [centered[i][0] for i in range(90)] == pytest.approx((c * c).sum(1)) and [centered[i][1] for i in range(90)] == pytest.approx(c.max(1))
    np.fill_diagonal(d, np.inf)
    nearest = {r["id"]: r["d2"] for r in pairs.nearest_squared(frame).collect()}
    assert [nearest[i] for i in range(90)] == pytest.approx(d.min(1) ** 2)


def test_results_of_few_blocks_are_held(monkeypatch):
    monkeypatch.setattr(pairs, "LEFT", 2)
    column = lambda values, kind: pa.array(values, kind)
    names, vectors = pa.list_(pa.int64()), pa.list_(pa.list_(pa.float64()))
    left = [[0, 1], [2], [3], [0, 1]]
    batch = pa.RecordBatch.from_arrays([column(left, names), column([[[float(i)] for i in ids] for ids in left], vectors), column([[9]] * 4, names), column([[[1.0]]] * 4, vectors)], names=["a", "b", "c", "d"])
    got = [(i.tolist(), s.tolist()) for i, s in pairs._by_left([batch, batch.slice(0, 1)], lambda i, a, j, b: a.sum(1) + b.sum(), np.add)]
    assert got == [([0, 1], [1.0, 2.0]), ([2], [3.0]), ([3], [4.0]), ([0, 1], [2.0, 4.0])]
