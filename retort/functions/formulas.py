"""Stoichiometries and formulas as column functions.

A stoichiometry is ``array<struct<label string, valence int, count int>>``; a degree sequence ``array<struct<deg int, cnt int>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _merged(pairs: Column) -> Column:
    """Sums the counts of equal labels of an array of (label, count); by label."""
    labels = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["label"])))
    total = lambda label: F.aggregate(F.filter(pairs, lambda p: p["label"] == label), F.lit(0), lambda a, p: a + p["count"].cast("int"))
    return F.transform(labels, lambda label: F.struct(label.alias("label"), total(label).alias("count")))


def _written(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["label"], F.when(p["count"] == 1, "").otherwise(p["count"].cast("string")))), "")


def sum_formula(stoichiometry: Column) -> Column:
    """Element counts over all valences: C, then H, then by label; a count of 1 is not written, 0 drops out."""
    place = lambda p: F.when(p["label"] == "C", 0).when(p["label"] == "H", 1).otherwise(2)
    kept = F.filter(_merged(stoichiometry), lambda p: p["count"] > 0)
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(place(p).alias("place"), p["label"].alias("label"), p["count"].alias("count"))))
    return _written(ordered)


def parse_formula(formula: Column) -> Column:
    """(label, count) in the order written; no number means 1."""
    symbols = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]*)([0-9]*)"), F.lit(1))
    numbers = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]*)([0-9]*)"), F.lit(2))
    return F.zip_with(symbols, numbers, lambda s, n: F.struct(s.alias("label"), F.when(n == "", 1).otherwise(n.try_cast("int")).alias("count")))


def formula_counts(formula: Column) -> Column:
    """Map of the last count written for each symbol."""
    parts = parse_formula(formula)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda p: p["label"])), lambda s: F.struct(s.alias("label"), F.element_at(F.filter(parts, lambda p: p["label"] == s), -1)["count"].alias("count"))))


def ordered_formula(formula: Column) -> Column:
    """The formula by symbol, repeated symbols added up, every count written but 1."""
    return _written(_merged(parse_formula(formula)))


def criterion(formula: Column) -> Column:
    """The formula as a composition predicate, e.g. ``C = 8 & H = 10``."""
    return F.array_join(F.transform(F.map_entries(formula_counts(formula)), lambda e: F.concat_ws(" = ", e["key"], e["value"].cast("string"))), " & ")


def canonical_label(sequence: Column) -> Column:
    """The degree sequence by degree and then count."""
    return F.array_sort(sequence)


def label_text(sequence: Column) -> Column:
    """``deg.cnt`` joined by underscores."""
    return F.array_join(F.transform(sequence, lambda p: F.concat_ws(".", p["deg"].cast("string"), p["cnt"].cast("string"))), "_")


def parse_label(text: Column) -> Column:
    """The degree sequence of ``deg.cnt_deg.cnt``; entries of count 0 drop out."""
    parts = F.transform(F.split(text, "_"), lambda p: F.struct(F.split(p, r"\.")[0].cast("int").alias("deg"), F.split(p, r"\.")[1].cast("int").alias("cnt")))
    return F.filter(parts, lambda p: p["cnt"] > 0)


def pure_label(sequence: Column) -> Column:
    """The degree sequence with the counts of equal degrees added up."""
    degrees = F.array_sort(F.array_distinct(F.transform(sequence, lambda p: p["deg"])))
    total = lambda d: F.aggregate(F.filter(sequence, lambda p: p["deg"] == d), F.lit(0), lambda a, p: a + p["cnt"])
    return F.transform(degrees, lambda d: F.struct(d.alias("deg"), total(d).alias("cnt")))


def degrees_of(sequence: Column) -> Column:
    """Every atom's degree."""
    return F.flatten(F.transform(sequence, lambda p: F.array_repeat(p["deg"], p["cnt"])))


def feasible(sequence: Column) -> Column:
    """Whether a connected multigraph without loops can have these degrees: an even sum of at least 2 (n - 1), no degree above half of it."""
    total = F.aggregate(sequence, F.lit(0), lambda a, p: a + p["deg"] * p["cnt"])
    n = F.aggregate(sequence, F.lit(0), lambda a, p: a + p["cnt"])
    most = F.array_max(F.transform(F.filter(sequence, lambda p: p["cnt"] > 0), lambda p: p["deg"]))
    return (total % 2 == 0) & (2 * most <= total) & (total / 2 - (n - 1) >= 0)


# --- counting -----------------------------------------------------------------------------------------------------

# The fit of average path length against the logarithm of the count, and of its asymptotic form.
PATH_SLOPE, PATH_OFFSET = 1.22066271, -0.72953204
ASYMPTOTIC_SLOPE, ASYMPTOTIC_OFFSET = 0.75617982, -14.40107699


def let(value: Column, body) -> Column:
    """What ``body`` makes of a value that is worked out once, however often it uses the value."""
    return F.get(F.transform(F.array(value), body), 0)


def ln_factorial(n: Column) -> Column:
    """ln n!; a sum of logarithms, so that no number overflows."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))


def ln_multinomial(groups: Column) -> Column:
    """ln of the number of ways to deal sum(groups) things into groups of these sizes."""
    both = F.aggregate(groups, F.array(F.lit(0.0), F.lit(0.0)), lambda a, k: F.array(a[0] + k, a[1] + ln_factorial(k)))
    return let(both, lambda b: ln_factorial(b[0]) - b[1])


def size_of_path(length: Column) -> Column:
    """The count that an average path length stands for."""
    return F.exp(F.lit(PATH_SLOPE) * length + F.lit(PATH_OFFSET))


def path_of_size(size: Column) -> Column:
    """The average path length of a count."""
    return let(size, lambda s: F.when(s.isNotNull(), (F.greatest(F.ln(s), F.lit(1.0)) - F.lit(PATH_OFFSET)) / F.lit(PATH_SLOPE)))


def ln_asymptotic(sequence: Column) -> Column:
    """ln of the number of labelled loopless multigraphs with these degrees, in the sparse limit (Greenhill and McKay 2013)."""
    zeros = F.array(*(F.lit(0.0) for _ in range(4)))

    def added(m, p):
        d, n = p["deg"].cast("double"), p["cnt"]
        return F.array(m[0] + d * n, m[1] + d * (d - 1) * n, m[2] + d * (d - 1) * (d - 2) * n, m[3] + n * ln_factorial(p["deg"]))

    def counted(m):
        m1, m2, m3 = m[0], m[1], m[2]
        half = F.floor(m1 / 2)
        ways = ln_factorial(m1) - ln_factorial(half) - half * F.ln(F.lit(2.0)) - m[3]
        return ways - m2 / (2 * m1) + m2 * m2 / (4 * m1 * m1) + F.pow(m2, 4) / (4 * F.pow(m1, 5)) - m2 * m2 * m3 / (2 * F.pow(m1, 4)) + m3 * m3 / (6 * F.pow(m1, 3))

    return let(F.aggregate(sequence, zeros, added), counted)


def asymptotic_count(sequence: Column) -> Column:
    """The calibrated count of molecules of a long degree sequence."""
    return size_of_path(F.lit(ASYMPTOTIC_SLOPE) * ln_asymptotic(sequence) + F.lit(ASYMPTOTIC_OFFSET))


def pure_prefactor(sequence: Column) -> Column:
    """By how much a label's path exceeds its pure label's: 1 + sum over degrees of ln multinomial(counts) / sum of degrees."""
    degrees = F.array_distinct(F.transform(sequence, lambda p: p["deg"]))
    score = F.aggregate(F.transform(degrees, lambda d: ln_multinomial(F.transform(F.filter(sequence, lambda p: p["deg"] == d), lambda p: p["cnt"].cast("long")))), F.lit(0.0), lambda a, x: a + x)
    return F.lit(1.0) + score / F.aggregate(sequence, F.lit(0), lambda a, p: a + p["deg"] * p["cnt"])
