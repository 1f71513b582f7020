"""The search over candidate stencils."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from retort.operators.taylor import Taylor


def grid(spark, f, steps, n):
    rows = [(*p, f(*p)) for p in itertools.product(steps, repeat=n)]
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{v} double" for v in [*"xyz"[:n], "e"]))


def test_a_quadratic_is_exact(spark):
    points = grid(spark, lambda x, y: x * x + 2 * y * y + 4 * x * y + 7 + x + 3 * y, (-1e-3, 0, 1e-3), 2)
    model = Taylor.search(points, ["x", "y"], ["e"], {"x": 0, "y": 0}, 2)
    c, g, h = model.gradient_and_hessian("e")
    assert c == 7 and np.allclose(g, [1, 3]) and np.allclose(h, [[2, 4], [4, 4]], atol=1e-5)


def test_additional_terms_and_checks(spark):
    f = lambda x, y: 1 + 2 * x - y + 3 * x * x * y
    points = grid(spark, f, (-2, -1, 0, 1, 2), 2)
    model = Taylor.search(points, ["x", "y"], ["e"], {"x": 0, "y": 0}, 1, [("x", "x", "y")])
    found = {tuple(sorted(p.items())): v for _, p, v in model.monomials}
    assert found[(("x", 2), ("y", 1))] == pytest.approx(6) and found[(("x", 1),)] == pytest.approx(2) and found[(("y", 1),)] == pytest.approx(-1)
    with pytest.raises(ValueError, match="no such"):
        Taylor.search(points, ["x", "y"], ["e"], {"x": 0, "y": 0}, 1, [("q",)])
    with pytest.raises(ValueError, match="need as many"):
        Taylor.search(points.where("abs(x) + abs(y) <= 1"), ["x", "y"], ["e"], {"x": 0, "y": 0}, 3)
    line = points.where("y = 0").unionByName(points.where("x = 0 AND y = 1"))
    with pytest.raises(ValueError, match="no stencil"):
        Taylor.search(line, ["x", "y"], ["e"], {"x": 0, "y": 0}, 1, [("x", "y")])
