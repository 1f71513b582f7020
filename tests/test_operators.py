"""Operators against literals and naive implementations."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import kernels
from retort.functions.kernels import kernel_array
from retort.operators import dimension, graphs, molecules, pairs, regression, sampling, space, stats, taylor

WATER = "3\nwater\nO 0 0 0\nH 0 0 1\n1 0 1 0"
METHANE = "5\n\nC 0 0 0\nH 1 0 0\nH 0 1 0\nH 0 0 1\nH 1 1 1"


def test_geometries(spark):
    rows = spark.createDataFrame([(1, WATER, 3.0), (2, METHANE, -1.0)], "m int, xyz string, e double")
    assert [r["el"] for r in rows.where("m = 1").select(F.inline(molecules.atoms_of(F.col("xyz")))).collect()] == ["O", "H", "H"]
    out = {r["m"]: r["label"] for r in molecules.select_molecules(rows, "n_H > 1 and n_N == 0", "e / n_atoms + n_C").collect()}
    assert out == {1: 1.0, 2: pytest.approx(0.8)}
    assert molecules.select_molecules(rows, "n_C > 0").columns == ["m", "xyz", "e"]
    assert molecules.charges(rows).select("charge", "spin_multiplicity").distinct().collect() == [(0, 1)]


def test_pair_feature(spark):
    atoms = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0), (1, 1, 1.0, 2.0, 0.0, 0.0), (2, 0, 6.0, 0.0, 0.0, 0.0), (2, 1, 8.0, 0.0, 1.5, 0.0), (3, 0, 1.0, 0.0, 0.0, 0.0)], "mol int, i int, z double, x double, y double, zc double")
    out = {r["mol"]: r["feature"] for r in molecules.pair_feature(atoms, "mol", "i").collect()}
    assert out == {1: pytest.approx(np.exp(-6)), 2: pytest.approx(6**2.5 * 8**2.5 * np.exp(-4.5)), 3: 0.0}


def test_local_kernels_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(1)
    atoms = [(m, int(rng.integers(1, 3)), rng.normal(size=3).tolist()) for m in range(4) for _ in range(int(rng.integers(2, 5)))]
    weights = {(1, 1): 1.0, (1, 2): 0.3, (2, 2): 0.8}
    frame = spark.createDataFrame(atoms, "mol int, z int, v array<double>")
    table = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "z1 int, z2 int, w double")
    for mode in ("all", "elemental", "alchemical"):
        got = {(r["i"], r["j"]): r["k"] for r in pairs.local_kernel(frame, "Gaussian", 1.3, mode, table).collect()}
        naive: dict = {}
        for (m, z, v), (n, y, u) in itertools.product(atoms, atoms):
            w = {"all": 1.0, "elemental": float(z == y), "alchemical": weights[min(z, y), max(z, y)]}[mode]
            naive[m, n] = naive.get((m, n), 0.0) + w * float(kernel_array("Gaussian", np.linalg.norm(np.subtract(v, u)) / 1.3))
        assert sorted(got) == [(i, j) for i in range(4) for j in range(i, 4)]
        for i, j in got:
            assert got[i, j] == pytest.approx(naive[i, j] / np.sqrt(naive[i, i] * naive[j, j]))
        few = frame.where("mol < 2")
        across = {(r["i"], r["j"]): r["k"] for r in pairs.local_kernel_between(few, frame.where("mol >= 2"), "Gaussian", 1.3, mode, table).collect()}
        assert across == {(i, j): pytest.approx(got[i, j]) for i in (0, 1) for j in (2, 3)}
    monkeypatch.setattr(pairs, "ATOMS", 2)
    cut_up = {(r["i"], r["j"]): r["k"] for r in pairs.local_kernel(frame, "Gaussian", 1.3, "alchemical", table).collect()}
    assert cut_up == {pair: pytest.approx(k) for pair, k in got.items()}
    with pytest.raises(Exception, match="no weight"):
        pairs.local_kernel(frame, "Gaussian", 1.3, "alchemical", table.where("z2 = 2")).collect()


def test_global_kernels_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(23, 5))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    packed = pairs.block_pairs(frame, 7)
    assert packed.count() == 16
    k = np.zeros((23, 23))
    for r in pairs.global_kernel(frame, "Matern32", 2.0).collect():
        k[r["i"], r["j"]] = r["k"]
    assert np.allclose(k, kernel_array("Matern32", d / 2))
    c = pairs.centered(pairs.global_kernel(frame, "Matern32", 2.0)).groupBy("i").agg(F.sum("k").alias("s")).collect()
    assert max(abs(r["s"]) for r in c) < 1e-9
    np.fill_diagonal(d, np.inf)
    assert pairs.length_scale(frame).first()[0] == pytest.approx(np.sqrt(np.median(d.min(1) ** 2)))


def test_power_moments_give_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 12, 200)
    frame = spark.createDataFrame([(k % 2, 0, float(v)) for k, v in enumerate(x)], "i int, j int, x double")
    grid = [2.0, 5.0, 9.0, 12.0]
    moments = pairs.power_moments(frame, grid, 20)
    got = {r["i"]: r["k"] for r in pairs.kernel_from_moments(moments, grid, 12.0, 1.0).collect()}
    for i in (0, 1):
        assert got[i] == pytest.approx(np.exp(-x[i::2]).sum(), rel=1e-5)


def test_enumeration(spark):
    types = space.parse_space("C:4 F:1 H:1")
    sizes = spark.createDataFrame([(0,), (3,), (4,), (5,)], "natoms int")
    cases = space.enumerate_cases(sizes, types)
    assert {r["natoms"]: r["count"] for r in cases.groupBy("natoms").count().collect()} == {3: 1, 4: 4, 5: 9}
    assert space.space_text(space.parse_space("C:4 H:1 P:3,5")) == "C:4 H:1 P:3,5"
    five = space.enumerate_cases(spark.createDataFrame([(6,)], "natoms int"), space.parse_space("C:4 H:1 N:3 O:2 F:1"))
    assert five.count() == 92
    known = spark.createDataFrame([("4.5", 6.0)], "label string, n double")
    counted = {r["label"]: (r["n"], r["source"]) for r in space.count_cases(cases.where("natoms = 5"), known).collect()}
    assert counted["4.5"] == (6.0, "exact") and counted["1.1_1.3_4.1"][1] == "missing"
    big = spark.createDataFrame([([("C", 4, 30), ("H", 1, 22)],), ([("C", 4, 30), ("H", 1, 10), ("F", 1, 12)],)], "stoichiometry array<struct<label string, valence int, count int>>")
    pure, mixed = (r["n"] for r in space.count_cases(big).orderBy("label", ascending=False).collect())
    degrees, a, b = [1] * 22 + [4] * 30, 1.22066271, -0.72953204
    m = [sum(math.prod(range(d - r + 1, d + 1)) for d in degrees if d >= r) for r in (1, 2, 3)]
    ways = math.factorial(m[0]) // (math.factorial(m[0] // 2) * 2 ** (m[0] // 2))
    log = math.log(ways / math.prod(map(math.factorial, degrees))) - m[1] / (2 * m[0]) + m[1] ** 2 / (4 * m[0] ** 2) + m[1] ** 4 / (4 * m[0] ** 5) - m[1] ** 2 * m[2] / (2 * m[0] ** 4) + m[2] ** 2 / (6 * m[0] ** 3)
    wanted = int(math.exp(a * (0.75617982 * log - 14.40107699) + b)) // math.factorial(22)
    assert wanted > 0 and pure == pytest.approx(wanted, rel=1e-9)
    scale = 1 + math.log(math.comb(22, 10)) / m[0]
    assert mixed == pytest.approx(int(math.exp(a * ((max(math.log(wanted), 1) - b) / a * scale) + b)), rel=1e-2)
    by_pure = space.count_cases(big.where("size(stoichiometry) = 3"), paths=spark.createDataFrame([("1.22_4.30", 30.0)], "label string, length double")).first()
    assert by_pure["source"] == "pure" and by_pure["n"] == pytest.approx(math.exp(a * ((math.log(int(math.exp(a * 30 + b))) - b) / a * scale) + b), rel=1e-9)
    tables = [spark.createDataFrame(rows, "label string, n double, length double") for rows in ([("a", None, 3.0), ("b", 5.0, None), ("c", None, 1.0)], [("a", None, 2.0), ("b", None, 9.0)])]
    assert sorted(tuple(r) for r in space.merge_counts(*tables).collect()) == [("a", None, 2.0), ("b", 5.0, None), ("c", None, 1.0)]
    assert [r["label"] for r in space.estimated_only(tables[0].where("n > 0"), tables[1].where("length > 0"), 1e3).collect()] == ["a"]
    assert space.covered_space(spark, "A").count() == 15 and space.covered_space(spark, "B").count() == 10
    with pytest.raises(ValueError):
        space.parse_space("C4")


def test_samples(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert sampling.sample(rows, "k", 37).count() == 37 and sampling.sample(rows, "k", 5000).count() == 1000
    assert sampling.training_sizes(100, 1000) == [100, 128, 256, 512, 1000]
    split = sampling.holdout_split(rows, "k", 700)
    assert split.where("is_train").count() == 700
    assert sorted(r["position"] for r in sampling.numbered(rows, "k", "s", cell=64).collect()) == list(range(1, 1001))
    with pytest.raises(ValueError):
        sampling.holdout_split(rows, "k", 1000)
    weighted = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "k long, w double")
    draws = [r["k"] for r in sampling.weighted_choice(weighted, "k", "w", 2000).collect()]
    assert len(draws) == 2000 and 0.7 < draws.count(2) / 2000 < 0.8 and 3 not in draws


def test_regression(spark):
    rng = np.random.default_rng(4)
    data = [(k, int(rng.integers(3)), float(rng.normal())) for k in range(60)]
    rows = spark.createDataFrame([(k, s, x, 2.0 * x + (1.0, 5.0, 8.0)[s]) for k, s, x in data], "k int, s int, x double, y double")
    hot = molecules.one_hot(rows, "s").withColumn("one", F.lit(1))
    worst = regression.detrend(hot, ["one", "s_0", "s_1", "s_2", "x"], "y").agg(F.max(F.abs("residual"))).first()[0]
    assert worst < 1e-8
    train = spark.createDataFrame([(k, [k / 4.0], float(np.sin(k / 4.0))) for k in range(24)], "id long, v array<double>, y double")
    test = spark.createDataFrame([(k, [k / 4.0 + 0.1], float(np.sin(k / 4.0 + 0.1))) for k in range(23)], "id long, v array<double>, y double")
    out = regression.predict(train, test, "Gaussian", 1.0, 1e-8).join(test, "id")
    assert regression.errors(out, "y").first()["rmse"] < 1e-3
    tried = regression.hyperparameters(train, "Gaussian", [1.0, 1e9], splits=3).collect()
    assert {r["sigma"] for r in tried} == {1.0} and len(tried) == 3 * len(regression.LAMBDAS)
    assert regression.swept([0.5, 1.0, 2.0, 4.0, 8.0], [0.5, 1.0, 2.0, 8.0], 1.0) == [1.0, 2.0, 0.5]
    noisy = spark.createDataFrame([(k, k + 1, [k / 8.0], float(np.sin(k / 8.0) + 3.0 + k % 2)) for k in range(120)], "id long, position long, v array<double>, y double").withColumn("odd", F.col("id") % 2).withColumn("even", 1 - F.col("odd"))
    curve = regression.learning_curve(noisy.where("position <= 80"), noisy.where("position > 80").drop("position"), "Gaussian", [40, 80], splits=8, features=["odd", "even"]).orderBy("ntrain").collect()
    assert [r["ntrain"] for r in curve] == [1, 40, 80] and curve[2]["val_rmse"] < 0.2 * curve[0]["val_rmse"]
    with pytest.raises(ValueError):
        regression.detrend_design(rows, "k", ["colour"])


def test_splits_by_one_decomposition_equal_single_solutions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3))
    k = regression._centered(np.exp(-((x[:, None] - x[None]) ** 2).sum(-1)))
    y = rng.normal(size=30)
    y -= y.mean()
    got = {(lam, split): rmse for lam, split, rmse, *_ in regression._split_errors(k, y, [1e-3, 1e-1], 5, 0.2, 3)}
    order, rng = np.arange(30), np.random.default_rng(3)
    for split in range(5):
        rng.shuffle(order)
        fit, valid = order[:-6], order[-6:]
        for lam in (1e-3, 1e-1):
            alpha = np.linalg.solve(k[np.ix_(fit, fit)] + lam * np.eye(24), y[fit])
            assert got[lam, split] == pytest.approx(np.sqrt(((k[np.ix_(valid, fit)] @ alpha - y[valid]) ** 2).mean()), rel=1e-6)


def test_distributions(spark):
    one = spark.createDataFrame([("a", 3), ("b", 1)], "k string, freq long")
    two = spark.createDataFrame([("b", 2), ("c", 2)], "k string, freq long")
    out = stats.distances(stats.merge_frequencies(one, two, "k"), "k").first()
    assert out["ks"] == pytest.approx(0.75) and out["area_one"] == pytest.approx(1.875) and out["area"] == pytest.approx(0.875)
    p, q = np.array([0.75, 0.25, 0]) + 1e-10, np.array([0, 0.5, 0.5]) + 1e-10
    p, q = p / p.sum(), q / q.sum()
    assert out["kl"] == pytest.approx((p * np.log(p / q)).sum())
    assert stats.two_sample_ks(spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.15), (2, 0.3)], "side int, x double")).first()["ks"] == pytest.approx(0.5)


def test_taylor(spark):
    points = [(4 + a * 0.01, 4 + b * 0.01) for a in range(-2, 3) for b in range(-2, 3)]
    frame = spark.createDataFrame([(a, b, a * b**3 + b**2 + a) for a, b in points], "a double, b double, y double")
    model = taylor.Taylor.fit(frame, ["a", "b"], ["y"], {"a": 4.0, "b": 4.0}, 2)
    constant, g, h = model.gradient_and_hessian("y")
    assert constant == pytest.approx(276) and np.allclose(g, [65, 200], rtol=1e-4) and np.allclose(h, [[0, 48], [48, 98]], atol=1)
    assert model.query(frame.limit(3), ["y"]).columns == ["a", "b", "y", "pred_y"]
    with pytest.raises(ValueError):
        taylor.Taylor.fit(frame, ["a", "b"], ["y"], {"a": 9.0, "b": 4.0}, 2)
    bowl = taylor.Taylor(["x"], {"x": 0.0}, [("y", {}, 1.0), ("y", {"x": 1}, -2.0), ("y", {"x": 2}, 2.0)])
    assert bowl.minimize("y", {"x": (-5, 5)})["x"] == pytest.approx(1, abs=1e-3)
    assert bowl.minimize("y", {"x": (-5, 0.5)})["x"] == pytest.approx(0.5, abs=1e-6)


def naive_dimension(g_e, h_e, g_p, h_p, gap=1e-4):
    """Step by step, as the search is defined, with the double sum over modes."""
    n = len(g_e)
    lam, vectors = np.linalg.eigh(h_p)
    grid = np.logspace(-10, 1, 100)
    limits = []
    for k in range(n):
        x = vectors[k]
        x = np.concatenate((x[2::4], x[0::4], x[1::4], x[3::4]))
        value = lambda s: abs(s * (g_e @ x) + s * s * (x @ h_e @ x) / 2)  # noqa: E731, B023
        limits.append([next((sign * s for s in grid if value(sign * s) > 4.75e-4), sign * 10.0) for sign in (1, -1)])

    def error(kept):
        total = 0.0
        for i, j in itertools.product([k for k in range(n) if k not in kept], repeat=2):
            (a, b), (c, d) = limits[i], limits[j]
            total += lam[i] ** 2 * (a**5 - b**5) / (a - b) / 5 if i == j else lam[i] * lam[j] * (a**3 - b**3) * (c**3 - d**3) / ((a - b) * (c - d)) / 9
        return np.sqrt(total)

    kept, found = [], {0: error([])}
    for step in range(1, n + 1):
        tried = [(error([*kept, k]), k) for k in range(n) if k not in kept]
        best = min([t for t in tried if t[0] < 1], default=(1.0, None))
        kept.append(best[1])
        own = [k for k in kept if k is not None]
        values = np.array([lam[k] if k in own else 0.0 for k in range(n)])
        count = int((abs(values) > 0).sum())
        sizes = np.sort(abs(np.linalg.eigvalsh(vectors @ np.diag(values) @ vectors.T)))[::-1][:count]
        unit = g_p / np.linalg.norm(g_p)
        dim = step + (sum(abs(unit @ v) / np.linalg.norm(v) for v in vectors[:count]) < 0.95) - int((abs(np.diff(sizes)) < gap).sum())
        found[dim] = min(found.get(dim, np.inf), best[0])
    out, last = [], 0.0
    for dim in range(n + 1):
        last = found.get(dim, last) if dim <= max(found) else 0.0
        out.append(last)
    return out


def test_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(6):
        scale = [1e-3, 1e-2, 0.1, 1.0, 5.0, 20.0][k]
        h_e, h_p = (x + x.T for x in rng.normal(size=(2, 8, 8)) * scale)
        if k == 2:
            h_p = np.diag([1.0, 1.0, 1.0, 2.0, 2.0, 0.5, 0.0, 3.0])
        rows.append((k, (rng.normal(size=8) * 1e-3).tolist(), h_e.tolist(), rng.normal(size=8).tolist(), h_p.tolist()))
    kind = "mol long, g_e array<double>, h_e array<array<double>>, g_p array<double>, h_p array<array<double>>"
    frame = spark.createDataFrame(rows, kind)
    got = dimension.intrinsic_dimension(frame).orderBy("mol", "dim").collect()
    for mol, *parts in rows:
        assert [r["error"] for r in got if r["mol"] == mol] == pytest.approx(naive_dimension(*map(np.array, parts)), rel=1e-6, abs=1e-9)
    scaled = dimension.intrinsic_dimension(frame, groups=[True, False] * 4)
    assert scaled.count() == 54
    flat = spark.createDataFrame([(1, [0.0] * 4, [[0.0] * 4] * 4, [1.0, 2.0, 3.0, 4.0], [[1.0] * 4] * 4)], kind)
    with pytest.raises(Exception, match="constant"):
        dimension.intrinsic_dimension(flat).collect()
    tried = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.4), (1, 3, 0.2)], "m int, dim int, error double")
    assert [r["error"] for r in dimension.best_by_dimension(tried, ["m"], 4).orderBy("dim").collect()] == [0, 0.4, 0.4, 0.2, 0.2]


def test_checks_and_registries(spark):
    rows = spark.createDataFrame([(1, WATER, 3.0, ["O", "H"]), (2, METHANE, -1.0, ["C", "H"])], "m int, xyz string, e double, els array<string>")
    with pytest.raises(ValueError, match="no molecule"):
        molecules.checked_selection(rows, "n_N > 0")
    with pytest.warns(UserWarning, match="keeps all"):
        assert molecules.checked_selection(rows, "n_H > 0").count() == 2
    molecules.check_predictions(rows, rows.drop("e"), "els", ["xyz"])
    with pytest.raises(ValueError, match="lack"):
        molecules.check_predictions(rows, rows.drop("xyz"), "els", ["xyz"])
    with pytest.raises(ValueError, match="without labels"):
        molecules.check_predictions(rows.where("m = 1"), rows, "els", ["xyz"])
    kernels.register_kernel("Own", lambda r, ops: ops.exp(-3 * r))
    try:
        assert kernel_array("Own", np.ones(1))[0] == pytest.approx(np.exp(-3))
        with pytest.raises(ValueError):
            kernels.register_kernel("Own", lambda r, ops: ops.exp(-r))
        with pytest.raises(ValueError):
            kernels.register_kernel("Other", lambda r, ops: 2 * ops.exp(-r))
    finally:
        del kernels.KERNELS["Own"]
    with pytest.raises(ValueError):
        molecules.represent(rows, "none", "m")
    line = taylor.Taylor(["x"], {"x": 1.0}, [("y", {}, 2.0), ("y", {"x": 1}, 3.0)])
    assert line.maximize("y", {"x": (0.0, 2.0)})["x"] == pytest.approx(2.0) and line.reach("y", 2.6, {"x": (0.0, 2.0)})["x"] == pytest.approx(1.2, abs=1e-6)
    assert {r["term"]: r["value"] for r in line.detail(spark.createDataFrame([(2.0,)], "x double"), "y").collect()} == {"1": 2.0, "x": 3.0}


def test_graphs(spark):
    assert graphs.automorphisms(["H", "H"], [(0, 1)]) == 2
    assert graphs.automorphisms(["C", "C", "H", "H", "H", "H"], [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]) == 8
    for k in range(40):
        rng = random.Random(k)
        degree = rng.choice([[4, 1, 1, 1, 1], [4, 4, 2, 2], [3, 3, 2, 1, 1], [4, 4, 4, 1, 1, 1, 1]])
        edges = graphs.connected_multigraph(degree, rng)
        assert all(a != b for a, b in edges) and graphs.is_connected(len(degree), edges)
        assert [sum(k in e for e in edges) for k in range(len(degree))] == degree
    with pytest.raises(ValueError):
        graphs.connected_multigraph([5, 1], random.Random(0))
    out = graphs.random_graphs(spark.createDataFrame([(1, [4, 4, 1, 1, 1, 1]), (2, [3])], "g long, degrees array<int>")).groupBy("g").agg(F.sum("bond").alias("n")).collect()
    assert [(r["g"], r["n"]) for r in out] == [(1, 6)]
    assert graphs.edit_distance({(0, 1): 1, (1, 2): 1}, {(0, 2): 1, (1, 2): 1}, [0, 0, 0]) == 0
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 1, 2)], "g int, u int, v int")
    nodes = spark.createDataFrame([(1, 0, "C"), (1, 1, "C"), (1, 2, "H")], "g int, node int, element string")
    assert graphs.count_bonds(edges, nodes, "C", "C", 2).first()["n"] == 1


def test_random_graphs_are_uniform(spark):
    rows = spark.range(2000).select(F.col("id").alias("g"), F.expr("array(3, 3, 3, 3)").alias("degrees"))
    sizes = graphs.random_graphs(rows).groupBy("g").count()
    # seven graphs have these degrees: one of six single bonds, six of two double and two single bonds
    share = sizes.agg(F.avg((F.col("count") == 6).cast("int"))).first()[0]
    assert abs(share - 1 / 7) < 0.04


def test_random_graphs_query_takes_all_steps():
    import inspect

    from retort.plans import catalogue

    assert "steps" not in inspect.getsource(catalogue.QUERIES["random_graphs"])
    assert inspect.signature(graphs.random_graphs).parameters["steps"].default == 100


def test_detrending_by_large_numbers_beside_a_constant(spark):
    # numbers from a million on are not dependent on a constant, nor are they where a third column is
    far = spark.createDataFrame([(1_000_000 + k, 4500.0 - 0.25 * k + (-1) ** k) for k in range(200)], "x long, y double").withColumns({"one": F.lit(1), "two": F.lit(2)})
    k = np.arange(200.0)
    y = 4500.0 - 0.25 * k + (-1) ** k
    slope = ((k - k.mean()) * (y - y.mean())).sum() / ((k - k.mean()) ** 2).sum()
    for features in (["one", "x"], ["one", "two", "x"]):
        got = regression.detrend(far, features, "y").orderBy("x").select("residual").toPandas()["residual"].to_numpy()
        assert np.abs(got - (y - y.mean() - slope * (k - k.mean()))).max() < 1e-7
