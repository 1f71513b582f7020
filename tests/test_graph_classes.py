"""Equal graphs, connectivity and summed representations against small searches of their own."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from retort.operators import graphs, molecules
from retort.plans.lineage import cut


def equal(a, b):
    """By trying every order of nodes; a graph: elements, {(u, v): bond}."""
    if sorted(a[0]) != sorted(b[0]) or len(a[1]) != len(b[1]):
        return False
    for order in itertools.permutations(range(len(a[0]))):
        if all(a[0][i] == b[0][order[i]] for i in range(len(order))) and all(b[1].get(tuple(sorted((order[u], order[v])))) == n for (u, v), n in a[1].items()):
            return True
    return False


def frames(spark, made):
    edges = [(g, *(e if k % 2 else e[::-1])) for g, (_, bonds) in made.items() for e, n in bonds.items() for k in range(n)]
    nodes = [(g, k, e) for g, (elements, _) in made.items() for k, e in enumerate(elements)]
    return spark.createDataFrame(edges, "g int, u int, v int"), spark.createDataFrame(nodes, "g int, node int, element string")


def test_classes_equal_a_search(spark):
    rng = random.Random(5)
    made = {}
    for g in range(60):
        n = rng.choice([1, 2, 4, 5])
        bonds = {e: rng.choice([1, 1, 2]) for e in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        made[g] = ([rng.choice("CCN") for _ in range(n)], bonds)
    for g in range(60, 80):  # renamed copies
        elements, bonds = made[g - 60]
        order = list(range(len(elements)))
        rng.shuffle(order)
        made[g] = ([elements[order.index(k)] for k in range(len(order))], {tuple(sorted((order[u], order[v]))): n for (u, v), n in bonds.items()})
    edges, nodes = frames(spark, made)
    got = {r["g"]: r["class"] for r in graphs.graph_classes(edges, nodes).collect()}
    assert got == {g: min(h for h in made if equal(made[g], made[h])) for g in made}
    pieces = {}
    for g, (elements, bonds) in made.items():
        label = list(range(len(elements)))
        for _ in label:
            for u, v in bonds:
                label[u] = label[v] = min(label[u], label[v])
        pieces[g] = len(set(label))
    assert {r["g"]: (r["pieces"], r["connected"]) for r in graphs.connected(edges, nodes).collect()} == {g: (n, n == 1) for g, n in pieces.items()}


def test_two_rings_and_long_chains(spark):
    ring = lambda a, b: {tuple(sorted((k, k + 1 if k < b else a))): 1 for k in range(a, b + 1)}
    fused = ring(0, 9) | {(0, 5): 1}  # two rings of six share a bond
    joined = ring(0, 4) | ring(5, 9) | {(0, 5): 1}  # a bond between two rings of five
    edges, nodes = frames(spark, {1: (["C"] * 10, fused), 2: (["C"] * 10, joined)})
    assert {r["g"]: r["class"] for r in graphs.graph_classes(edges, nodes).collect()} == {1: 1, 2: 2}
    assert {r["class"] for r in graphs.graph_classes(edges, nodes, individualise=False).collect()} == {1}
    chain = {0: (["C"] * 200, {(k, k + 1): 1 for k in range(199) if k != 120})}
    assert [tuple(r) for r in graphs.connected(*frames(spark, chain)).collect()] == [(0, 2, False)]
    assert graphs.connected(edges.limit(0), nodes.limit(0)).count() == 0


def test_weighted_sums(spark, monkeypatch):
    monkeypatch.setattr(molecules, "HELD", 3)
    rng = random.Random(1)
    rows = [(f"m{rng.choice([0, 0, 0, *range(9)])}", [float(rng.randrange(9)) for _ in range(4)], float(rng.randrange(5))) for _ in range(500)] + [("none", None, 1.0), ("none", [1.0] * 4, None)]
    frame = spark.createDataFrame(rows, "mol string, v array<double>, w double").repartition(5)
    for weight in (None, "w"):
        wanted: dict = {}
        for mol, v, w in rows:
            if v is not None and (weight is None or w is not None):
                wanted[mol] = [a + x * (w if weight else 1.0) for a, x in zip(wanted.get(mol, [0.0] * 4), v, strict=True)]
        assert {r["mol"]: r["v"] for r in molecules.weighted_sums(frame, "mol", weight=weight).collect()} == wanted
    with pytest.raises(Exception, match="differ in length"):
        molecules.weighted_sums(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "mol string, v array<double>"), "mol").collect()


def ring(nodes, n):
    """A ring in an order of nodes, closed every n."""
    return {tuple(sorted((nodes[k], nodes[k + 1 if (k + 1) % n else k + 1 - n]))): 1 for k in range(len(nodes))}


def test_small_graphs_are_written_once_and_large_ones_joined(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(df) or cut(df))
    mixed = random.Random(3).sample(range(70), 70)
    made = {5: (["C"] * 12, ring(range(12), 12)), 6: (["C"] * 12, ring(range(12), 6)), 7: (["C"] * 12, ring(range(11, -1, -1), 12))}
    assert {r["g"]: r["class"] for r in graphs.graph_classes(*frames(spark, made)).collect()} == {5: 5, 6: 6, 7: 5}
    assert {r["g"]: r["pieces"] for r in graphs.connected(*frames(spark, made)).collect()} == {5: 1, 6: 2, 7: 1}
    assert len(cuts) == 2
    made |= {1: (["C"] * 70, ring(range(70), 70)), 2: (["C"] * 70, ring(range(70), 35)), 3: (["C"] * 70, ring(mixed, 70)), 4: (["C"] * 64, ring(range(64), 64))}
    assert {r["g"]: r["class"] for r in graphs.graph_classes(*frames(spark, made)).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 5}
    assert {r["g"]: r["pieces"] for r in graphs.connected(*frames(spark, made)).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1}


def test_parts_of_a_graph_that_come_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HELD", 20)
    edges = spark.range(30_000).selectExpr("CAST(1 AS INT) AS g", "concat('n', id % 3) AS u", "concat('n', id % 3 + IF(id % 7 = 0, 1, 7)) AS v")
    nodes = spark.createDataFrame([(g, f"n{k}", "C") for g in (1, 2) for k in range(5)], "g int, node string, element string")
    assert sorted(map(tuple, graphs.connected(edges, nodes).collect())) == [(1, 2, False), (2, 5, False)]


def test_switches_of_a_graph_are_found_once_however_many_rows_meet_it(spark, monkeypatch):
    rng, found = random.Random(11), []
    for _ in range(40):  # all switches, tried one by one
        while True:
            degree = [rng.choice([1, 1, 2, 3, 4]) for _ in range(rng.randrange(2, 8))]
            try:
                edges = tuple(sorted(graphs.connected_multigraph(degree, rng)))
                break
            except ValueError:
                pass
        n, wanted = len(degree), Counter()
        for i, j in itertools.combinations(range(len(edges)), 2):
            (a, b), (c, d) = edges[i], edges[j]
            rest = [e for k, e in enumerate(edges) if k not in (i, j)]
            for new in (((a, c), (b, d)), ((a, d), (b, c))):
                if len({a, b, c, d}) == 4 and graphs.is_connected(n, [*rest, *new]):
                    wanted[edges[i], edges[j], tuple(sorted(new[0])), tuple(sorted(new[1]))] += 1
        moves, sums, _ = graphs.two_switches(n, edges)
        assert dict(zip(moves, [b - a for a, b in itertools.pairwise([0, *sums])], strict=True)) == wanted
    states = graphs._States(6)
    monkeypatch.setattr(graphs, "two_switches", lambda n, edges, f=graphs.two_switches: found.append(edges) or f(n, edges))
    for k in range(200):
        edges = graphs.mixed_graph(6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)], 50, random.Random(k), states)
        assert sorted(Counter(x for e in edges for x in e).items()) == [(k, 2) for k in range(6)]
    assert len(found) == len(set(found)) == len(states.known)
    monkeypatch.setattr(graphs, "SWITCHES", 100)  # forgetting changes nothing
    few = graphs._States(6)
    assert graphs.mixed_graph(6, edges, 50, random.Random(0), few) == graphs.mixed_graph(6, edges, 50, random.Random(0), states) and few.switches <= 200
    same = spark.createDataFrame([(g, [1, 1, 2, 4, 4]) for g in range(64)], "g long, degrees array<int>").coalesce(1)
    assert graphs.random_graphs(same).rdd.getNumPartitions() > 4
