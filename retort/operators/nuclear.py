"""Derivatives of the repulsion between nuclei with respect to charges and places: sums over pairs within a molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")


def _pairs(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Every two different atoms of a molecule: both sides' columns, ``a_`` and ``b_``, and their distance ``r``; an equality join."""
    side = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key))
    met = side(one, "a").join(side(two, "b"), key).where("a_i <> b_i")
    return met.withColumn("r", F.sqrt(sum((F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2.0) for x in _AXES), F.lit(0.0))))


def repulsion(atoms: DataFrame, key: str = "mol") -> DataFrame:
    """The repulsion of each molecule's nuclei, ``key, value``. atoms: ``key, i, q, x, y, z``; each pair counts once."""
    pairs = _pairs(atoms, atoms, key).where("a_i < b_i")
    return _whole(atoms, pairs.groupBy(key).agg(F.sum(F.col("a_q") * F.col("b_q") / F.col("r")).alias("value")), key)


def _whole(atoms: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Sums with a 0 for molecules without pairs."""
    return atoms.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"))


def charge_derivative(atoms: DataFrame, changes: DataFrame, key: str = "mol") -> DataFrame:
    """First derivative when charges change: ``key, value``. changes: ``key, i, d``, by how much atom i's charge changes."""
    changed = atoms.join(changes, [key, "i"])
    return _whole(atoms, _pairs(atoms, changed, key).groupBy(key).agg(F.sum(F.col("a_q") * F.col("b_d") / F.col("r")).alias("value")), key)


def charge_second_derivative(atoms: DataFrame, changes: DataFrame, key: str = "mol") -> DataFrame:
    """Second derivative along the same changes of charges: twice the sum over pairs of changed atoms."""
    changed = atoms.join(changes, [key, "i"])
    return _whole(atoms, _pairs(changed, changed, key).where("a_i < b_i").groupBy(key).agg((2 * F.sum(F.col("a_d") * F.col("b_d") / F.col("r"))).alias("value")), key)


def gradient(atoms: DataFrame, key: str = "mol") -> DataFrame:
    """How the repulsion changes with each atom's place: ``key, i, gx, gy, gz``; atoms that are alone get 0."""
    return _by_axes(atoms, _pairs(atoms, atoms, key), F.col("a_q") * F.col("b_q"), key)


def gradient_charge_derivative(atoms: DataFrame, changes: DataFrame, key: str = "mol") -> DataFrame:
    """How the gradient changes with the charges: ``key, i, gx, gy, gz``; atoms that aren't among the changes keep theirs."""
    own = atoms.join(changes, [key, "i"], "left").na.fill(0.0, ["d"])
    return _by_axes(atoms, _pairs(own, own, key), F.col("a_q") * F.col("b_d") + F.col("b_q") * F.col("a_d"), key)


def _by_axes(atoms: DataFrame, pairs: DataFrame, factor, key: str) -> DataFrame:
    """Per atom b the sums over all others a of the factor times the unit vector from b to a over the squared distance."""
    sums = pairs.groupBy(key, F.col("b_i").alias("i")).agg(*(F.sum(factor * (F.col(f"a_{x}") - F.col(f"b_{x}")) / F.pow("r", F.lit(3.0))).alias(f"g{x}") for x in _AXES))
    return atoms.select(key, "i").join(sums, [key, "i"], "left").na.fill(0.0, [f"g{x}" for x in _AXES])
