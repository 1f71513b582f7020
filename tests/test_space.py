"""Enumeration by levels, strict counting and draws in two stages."""

from __future__ import annotations

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retort.operators import sampling, space


def sequences(spark, natoms, text, pure=False):
    out = space.enumerate_sequences(spark.createDataFrame([(natoms,)], "natoms int"), space.parse_space(text), pure)
    return sorted([tuple(p) for p in r["sequence"]] for r in out.collect())


def test_published_sequences(spark):
    # fixed values: the published lists for carbon, fluorine and hydrogen
    wanted = {
        3: [[(4, 3)]],
        4: [[(4, 4)], [(1, 2), (4, 2)], [(1, 1), (1, 1), (4, 2)]],
        5: [[(4, 5)], [(1, 4), (4, 1)], [(1, 1), (1, 3), (4, 1)], [(1, 2), (1, 2), (4, 1)], [(1, 2), (4, 3)], [(1, 1), (1, 1), (4, 3)]],
    }
    for natoms, rows in wanted.items():
        assert sequences(spark, natoms, "C:4 F:1 H:1") == sorted(rows)
    assert sequences(spark, 5, "C:4 F:1 H:1", pure=True) == sorted([[(4, 5)], [(1, 4), (4, 1)], [(1, 2), (4, 3)]])


@pytest.mark.parametrize("text", ["C:4 H:1 N:3 O:2 F:1", "A:3 B:5 C:3 D:1", "X:2"])
def test_levels_equal_all_ways(spark, text):
    types = space.parse_space(text)
    for natoms in (1, 2, 5, 7):
        cases, degrees = set(), set()
        for counts in itertools.product(range(natoms + 1), repeat=len(types)):
            used = [(label, v, n) for (label, v), n in zip(types, counts, strict=True) if n]
            total = sum(v * n for _, v, n in used)
            if sum(counts) == natoms and total % 2 == 0 and 2 * max(v for _, v, _ in used) <= total and total // 2 >= natoms - 1:
                cases.add(frozenset(used))
                degrees.add(tuple(sorted((v, n) for _, v, n in used)))
        sizes = spark.createDataFrame([(natoms,), (0,)], "natoms int")
        made = [frozenset((t["label"], t["valence"], t["count"]) for t in r["stoichiometry"]) for r in space.enumerate_cases(sizes, types).collect()]
        assert len(made) == len(cases) and set(made) == cases
        assert sequences(spark, natoms, text) == sorted(map(list, degrees))


def test_many_atoms_make_no_array(spark):
    sizes = spark.createDataFrame([(30,)], "natoms int")
    rows = space.enumerate_sequences(sizes, space.parse_space("C:4 N:3 O:2 H:1 F:1"))
    plan = rows._jdf.queryExecution().toString()
    assert "flatten" not in plan and rows.count() > 8_000
    assert space.max_valence(space.parse_space("C:4 N:3,5")) == 5 and space.elements_of_valence(space.parse_space("H:1 C:4 F:1"), 1) == ["H", "F"]


def test_strict_counting(spark):
    cases = space.enumerate_cases(spark.createDataFrame([(4,)], "natoms int"), space.parse_space("C:4 H:1"))
    known = spark.createDataFrame([("4.4", 2.0)], "label string, n double")
    with pytest.raises(KeyError):
        space.count_cases(cases, known, strict=True)
    full = spark.createDataFrame([("4.4", 2.0), ("1.2_4.2", 1.0)], "label string, n double")
    assert sorted(r["n"] for r in space.count_cases(cases, full, strict=True).collect()) == [1.0, 2.0]


def test_draws_follow_the_weights(spark):
    case = lambda *t: [("C", 4, t[0]), ("P", 3, t[1]), ("P", 5, t[2])]
    rows = [(case(1, 1, 1), "a", 600.0), (case(1, 2, 0), "b", 200.0), (case(2, 1, 0), "c", 199.0), (case(9, 1, 0), "d", 0.0), (case(3, 1, 0), "e", 1.0)]
    counted = spark.createDataFrame(rows, "stoichiometry array<struct<label string, valence int, count int>>, label string, n double")
    drawn = space.draw_cases(counted, 20_000, "x").select("draw", "label", "formula").collect()
    assert sorted(r["draw"] for r in drawn) == list(range(20_000))
    times = Counter(r["label"] for r in drawn)
    for label, share in (("a", 0.6), ("b", 0.2), ("c", 0.199), ("e", 0.001)):
        assert abs(times[label] - 20_000 * share) < 5 * (20_000 * share) ** 0.5
    assert times["d"] == 0 and {r["formula"] for r in drawn if r["label"] in "ab"} == {"CP2"}
    with pytest.raises(ValueError):
        space.draw_cases(counted.where("n = 0"), 3)


def test_a_hot_stratum_goes_by_cells(spark):
    rows = spark.range(3000).withColumn("s", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("hot"))
    some = {r["s"]: r["count"] for r in sampling.stratified(rows, "id", "s", 200, cell=100).groupBy("s").count().collect()}
    assert some == {"hot": 180, None: 20}
    by_cell = sorted(r["id"] for r in sampling.stratified(rows, "id", "s", 200, cell=100).collect())
    assert by_cell == sorted(r["id"] for r in sampling.stratified(rows, "id", "s", 200).collect())
    assert sampling.fraction(rows, "id", 0.1).count() == 300


def test_enumeration_of_more_than_thirteen_atoms_is_whole(spark):
    # plain loops up to all atoms: no element has a limit of its own
    types = space.parse_space("C:4 H:1 O:2 F:1")
    for natoms in (14, 17):
        sizes, ways = spark.createDataFrame([(natoms,)], "natoms int"), []
        for c, h, o in itertools.product(range(natoms + 1), repeat=3):
            f = natoms - c - h - o
            total, most = 4 * c + 2 * o + h + f, 4 if c else 2 if o else 1
            if f >= 0 and total % 2 == 0 and 2 * most <= total and total // 2 >= natoms - 1:
                ways.append((c, h, o, f))
        assert any(max(w) > 13 for w in ways)
        assert space.enumerate_cases(sizes, types).count() == len(ways)
        assert len(sequences(spark, natoms, "C:4 H:1 O:2 F:1", pure=True)) == len({(c, o) for c, _, o, _ in ways})
        assert len(sequences(spark, natoms, "C:4 H:1 O:2 F:1")) == len({(c, o, min(h, f)) for c, h, o, f in ways})
