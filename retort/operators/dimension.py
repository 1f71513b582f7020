"""Intrinsic dimensionality from gradients and Hessians."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thermal energy in hartree, the size of a change that matters.
KT = 4.75e-4
#: Displacements along a mode that are tried: 100 points from 1e-10 to 10, evenly in the logarithm.
POINTS = 100


def displacement_grid() -> np.ndarray:
    """The displacements that are tried."""
    return np.logspace(-10, 1, POINTS)


def bounds(modes: DataFrame, kt: float = KT) -> DataFrame:
    """Per mode how far it can go, to either side, until its energy changes by more than kt: adds ``low`` (<= 0) and ``high``.

    modes: ``g`` slope and ``h`` curvature along the mode. The first point of the grid that is beyond kt, or the last.
    """
    step = F.lit(11.0 / (POINTS - 1))
    grid = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda k: F.pow(F.lit(10.0), k * step - 10))
    reach = lambda s: F.coalesce(F.get(F.filter(grid, lambda x: F.abs(s * x * F.col("g") + x * x * F.col("h") / 2) > kt), 0), F.lit(10.0))
    return modes.withColumns({"low": -reach(1 * F.lit(-1.0)), "high": reach(F.lit(1.0))})


def mode_error(modes: DataFrame, key: list[str]) -> DataFrame:
    """Error of a property that leaving modes out costs, within their bounds: key, ``error``; modes: key, ``lam, low, high``.

    The double sum over modes of curvature products, with fifth powers of the bounds for a mode itself and third powers for
    two modes, written as single sums: the square of a sum holds every product.
    """
    width = F.col("high") - F.col("low")
    one = F.col("lam") * (F.pow("high", 3.0) - F.pow("low", 3.0)) / (3 * width)
    own = F.col("lam") * F.col("lam") * (F.pow("high", 5.0) - F.pow("low", 5.0)) / (5 * width)
    sums = modes.groupBy(*key).agg(F.sum(one).alias("_m"), F.sum(own - one * one).alias("_v"))
    return sums.select(*key, F.sqrt(F.greatest(F.col("_v") + F.col("_m") * F.col("_m"), F.lit(0.0))).alias("error"))


def best_by_dimension(tried: DataFrame, key: list[str], most: int) -> DataFrame:
    """The least error per dimension from 0 to ``most``, gaps taking the last one before them (0 before the first)."""
    least = tried.groupBy(*key, "dim").agg(F.min("error").alias("error"))
    every = tried.select(*key).distinct().withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(most))))
    order = Window.partitionBy(*key).orderBy("dim").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("error", ignorenulls=True).over(order), F.lit(0.0))
    return every.join(least, [*key, "dim"], "left").select(*key, "dim", filled.alias("error"))


def _reordered(x: np.ndarray) -> np.ndarray:
    """Coordinates in blocks of every fourth one: the third block first, then the first, the second and the last."""
    return np.concatenate((x[2::4], x[0::4], x[1::4], x[3::4]))


def property_modes(molecules: DataFrame) -> DataFrame:
    """The modes of each molecule's property: ``mol, mode, lam, g, h``; its arrays stay as they are in ``molecules``.

    molecules: ``mol`` and gradients and Hessians of energy and property, ``g_e, h_e, g_p, h_p``. ``lam`` is an eigenvalue of
    the property's Hessian, ``g`` and ``h`` slope and curvature of the energy along the row of the eigenvectors' matrix that
    has the mode's number (a row, as the published program has it, not a column). Constant gradients, or first rows of
    Hessians, are an error.
    """

    def one(batches):
        for batch in batches:
            out = []
            for mol, g_e, h_e, g_p, h_p in zip(*(batch[c] for c in ("mol", "g_e", "h_e", "g_p", "h_p")), strict=True):
                g_e, g_p = np.array(g_e, float), np.array(g_p, float)
                h_e, h_p = (np.array([list(r) for r in h], float) for h in (h_e, h_p))
                if any((x == x[0]).all() for x in (g_e, h_e[0], g_p, h_p[0])):
                    raise NotImplementedError(f"molecule {mol} has a constant gradient or Hessian")
                lam, vectors = np.linalg.eigh(h_p)
                for k, value in enumerate(lam):
                    way = _reordered(vectors[k])
                    out.append((mol, k, float(value), float(g_e @ way), float(way @ h_e @ way)))
            yield pd.DataFrame(out, columns=["mol", "mode", "lam", "g", "h"])

    return molecules.mapInPandas(one, "mol long, mode int, lam double, g double, h double")


def greedy_modes(modes: DataFrame) -> DataFrame:
    """Per molecule the order in which modes are kept, each step the one that leaves the least error: ``mol, kept, errors``.

    modes: ``mol, mode, lam, low, high``. ``errors`` starts with that of keeping nothing. A step in which no mode brings the
    error below 1 keeps none, null, and counts error 1. A fold over the steps of one molecule, whose modes are few.
    """
    width = F.col("high") - F.col("low")
    one = F.col("lam") * (F.pow("high", 3.0) - F.pow("low", 3.0)) / (3 * width)
    own = F.col("lam") * F.col("lam") * (F.pow("high", 5.0) - F.pow("low", 5.0)) / (5 * width)
    rows = modes.groupBy("mol").agg(F.array_sort(F.collect_list(F.struct("mode", one.alias("m"), (own - one * one).alias("v")))).alias("left"))
    total = lambda left, name: F.aggregate(left, F.lit(0.0), lambda a, x: a + x[name])
    error = lambda m, v: F.sqrt(F.greatest(v + m * m, F.lit(0.0)))
    whole = F.struct(total("left", "m").alias("m"), total("left", "v").alias("v"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<int>").alias("kept"), F.array(error(whole["m"], whole["v"])).alias("errors"))

    def step(state, _):
        left = state["left"]
        m, v = total(left, "m"), total(left, "v")
        tried = F.transform(left, lambda x: F.struct(F.when(F.size(left) > 1, error(m - x["m"], v - x["v"])).otherwise(0.0).alias("error"), x["mode"].alias("mode")))
        best = F.array_min(F.filter(tried, lambda t: t["error"] < 1))
        return F.struct(
            F.filter(left, lambda x: ~x["mode"].eqNullSafe(best["mode"])).alias("left"), F.concat(state["kept"], F.array(best["mode"])).alias("kept"),
            F.concat(state["errors"], F.array(F.coalesce(best["error"], F.lit(1.0)))).alias("errors"))

    done = F.aggregate(F.sequence(F.lit(1), F.size("left")), start, step)
    return rows.select("mol", done.alias("d")).select("mol", "d.kept", "d.errors")


def _degenerate(lam: np.ndarray, vectors: np.ndarray, kept: list[int], gap: float, scaled: np.ndarray) -> int:
    """The most neighbouring eigenvalues that are closer than ``gap``, of the kept modes' Hessian under 101 scalings of some coordinates."""
    values = np.where(np.isin(np.arange(len(lam)), kept), lam, 0.0)
    count = int((np.abs(values) > 0).sum())
    hessian = (vectors * values) @ np.linalg.inv(vectors)
    most = 0
    for s in {1.0} if not scaled.any() else {1.0, *np.linspace(0.01, 10, 100).tolist()}:
        by = np.where(scaled, s, 1.0)
        found = np.sort(np.abs(np.linalg.eigvalsh(np.outer(by, by) * hessian)))[::-1][:count]
        most = max(most, int((np.abs(np.diff(found)) < gap).sum()))
    return most


def dimension_steps(molecules: DataFrame, chosen: DataFrame, gap: float, groups: list[bool] | None) -> DataFrame:
    """``mol, dim, error``: each step's dimension. It is the number of kept modes, one more unless these hold the property's

    gradient (sum of absolute cosines of 0.95), less the degeneracy. The steps of all molecules are rows, so they run apart.
    """
    steps = chosen.select("mol", "kept", "errors", F.explode(F.sequence(F.lit(0), F.size("kept"))).alias("step"))
    steps = steps.select("mol", "step", F.slice("kept", F.lit(1), F.col("step")).alias("kept"), F.get("errors", F.col("step")).alias("error"))
    rows = steps.join(molecules.select("mol", "g_p", "h_p"), "mol")

    def one(batches):
        for batch in batches:
            out = []
            for mol, step, kept, error, g, h in zip(*(batch[c] for c in ("mol", "step", "kept", "error", "g_p", "h_p")), strict=True):
                if step == 0:
                    out.append((mol, 0, error))
                    continue
                lam, vectors = np.linalg.eigh(np.array([list(r) for r in h], float))
                own = [int(k) for k in kept if k is not None and k == k]
                count = int((np.abs(np.where(np.isin(np.arange(len(lam)), own), lam, 0.0)) > 0).sum())
                g = np.array(g, float)
                unit = vectors[:count] / np.linalg.norm(vectors[:count], axis=1, keepdims=True)
                held = np.abs(unit @ (g / np.linalg.norm(g))).sum() >= 0.95
                out.append((mol, step + (0 if held else 1) - _degenerate(lam, vectors, own, gap, np.array(groups or [False] * len(lam))), error))
            yield pd.DataFrame(out, columns=["mol", "dim", "error"])

    return rows.mapInPandas(one, "mol long, dim int, error double")


def intrinsic_dimension(molecules: DataFrame, gap: float = 1e-4, groups: list[bool] | None = None, kt: float = KT) -> DataFrame:
    """Per molecule the least error by intrinsic dimension: ``mol, dim, error`` for every dimension from 0 to its number of coordinates.

    Gaps take the error of the dimension before; dimensions beyond the largest that a step reached have 0, as does a
    step that reaches one more than there are coordinates. ``groups`` marks coordinates that are scaled together when
    degeneracy is counted; ``gap`` is the difference below which two eigenvalues count as one.
    """
    modes = bounds(property_modes(molecules), kt)
    tried = dimension_steps(molecules, greedy_modes(modes), gap, groups)
    size = molecules.select("mol", F.size("g_e").alias("_n"))
    least = tried.groupBy("mol", "dim").agg(F.min("error").alias("error"))
    order = Window.partitionBy("mol").orderBy("dim").rowsBetween(Window.unboundedPreceding, 0)
    every = size.select("mol", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("dim")).join(least, ["mol", "dim"], "left")
    top = least.groupBy("mol").agg(F.max("dim").alias("_top"))
    filled = F.coalesce(F.last("error", ignorenulls=True).over(order), F.lit(0.0))
    return every.select("mol", "dim", filled.alias("error")).join(top, "mol").select("mol", "dim", F.when(F.col("dim") <= F.col("_top"), F.col("error")).otherwise(0.0).alias("error"))
