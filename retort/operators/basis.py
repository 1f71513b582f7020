"""Basis sets as tables: the shells that a short text asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: letters of angular momenta, from 0 on.
LETTERS = "SPDFG"


def parse_shells(text: str) -> dict[int, int]:
    """How many shells of each angular momentum a text such as ``SPPD`` asks for; another letter is an error."""
    if unknown := sorted(set(text) - set(LETTERS)):
        raise ValueError(f"no such shells: {unknown}; there are {', '.join(LETTERS)}")
    return {l: text.count(letter) for l, letter in enumerate(LETTERS) if letter in text}


def select_shells(basis: DataFrame, text: str, whole: tuple[str, ...] = ("H",)) -> DataFrame:
    """Of every element the first shells of each angular momentum that the text asks for.

    basis: ``element, shell, l, exp, coef``, a row for each primitive; shells are in the order of their numbers. Elements in
    ``whole`` keep all of theirs. An element with too few of some kind is an error that names one. Adds ``place``, the
    shell's place in the selected basis, from 0, by angular momentum and then the old order.
    """
    wanted = parse_shells(text)
    number = F.coalesce(*(F.when(F.col("l") == l, n) for l, n in wanted.items()), F.lit(0)) if wanted else F.lit(0)
    shells = basis.select("element", "shell", "l").distinct()
    ranked = shells.withColumn("_r", F.row_number().over(Window.partitionBy("element", "l").orderBy("shell")))
    keeps = F.col("element").isin(*whole)
    lacking = shells.where(~keeps).groupBy("element").agg(*(F.count_if(F.col("l") == l).alias(f"n{l}") for l in wanted)) if wanted else None
    if lacking is not None:
        short = lacking.where(" OR ".join(f"n{l} < {n}" for l, n in wanted.items())).orderBy("element").first()
        if short:
            l = next(l for l, n in wanted.items() if short[f"n{l}"] < n)
            raise ValueError(f"element {short['element']} has {short[f'n{l}']} shells {LETTERS[l]}, {wanted[l]} are asked for")
    kept = ranked.where(keeps | (F.col("_r") <= number))
    order = F.struct(F.when(keeps, 0).otherwise(F.col("l")), "shell")
    placed = kept.select("element", "shell", (F.row_number().over(Window.partitionBy("element").orderBy(order)) - 1).alias("place"))
    return basis.join(placed, ["element", "shell"])
