"""The kernels of single networks against plain definitions."""

import itertools
import random

import pytest

from kinloom.operators import pedigrees, unrelated
from kinloom.operators.components import connected_components
from kinloom.operators.unrelated import best_set, maximal_sets


def independent_sets(near):
    nodes = sorted(near)
    every = [set(s) for k in range(len(nodes) + 1) for s in itertools.combinations(nodes, k) if not any(b in near[a] for a, b in itertools.combinations(s, 2))]
    return {frozenset(s) for s in every if all(near[v] & s for v in set(nodes) - s)}


@pytest.mark.parametrize("seed", range(15))
def test_maximal_sets(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    near = {v: set() for v in range(n)}
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < 0.4:
            near[a].add(b), near[b].add(a)
    want = independent_sets(near)
    assert set(maximal_sets(near)) == want
    traits = {v: (0.0, rng.randrange(3), rng.random()) for v in near}
    for criteria in (unrelated.SIZE_THEN_AFFECTED, (("", "size"), ("a", "low"), ("b", "high")), (("", "size"), ("a", "high"), ("b", "low_average")), (("x", "low"), ("a", "high_average"), ("b", "low_average")), (("x", "high"), ("a", "high"), ("", "size"))):
        kept = {v: t[: len(criteria)] for v, t in traits.items()}
        found, status = best_set(near, kept, criteria)
        assert status == "exact" and frozenset(found) == max(want, key=lambda s: unrelated.worth(s, kept, criteria)), criteria


@pytest.mark.parametrize("criteria", [unrelated.SIZE_THEN_AFFECTED, (("affected", "high_average"), ("", "size"))])
def test_handed_over_searches(spark, criteria):
    """Searches handed over after each few steps find what whole ones find."""
    rng = random.Random(7)
    near, rows = {}, []
    for net in range(6):
        people = [100 * net + k for k in range(14)]
        near[net] = {v: set() for v in people}
        for a, b in itertools.combinations(people, 2):
            if rng.random() < 0.3:
                near[net][a].add(b), near[net][b].add(a)
                rows.append((a, b))
    score = {v: rng.randrange(3) for n in near.values() for v in n}
    members = spark.createDataFrame([(net, v) for net, n in near.items() for v in n], "network_id long, iid long")
    edges = spark.createDataFrame(rows, "iid1 long, iid2 long")
    traits = spark.createDataFrame(list(score.items()), "iid long, affected int")
    got = {}
    for r in unrelated.unrelated_sets(members, edges, traits, criteria, turn=2).collect():
        got.setdefault(r["network_id"], set()).add(r["iid"])
    for net, n in near.items():
        at = [c for c, _ in criteria].index("affected")
        kept = {v: tuple(score[v] if k == at else 0.0 for k in range(2)) for v in n}
        assert got[net] == best_set(n, kept, criteria)[0]
    methods = unrelated.method_sets(members, edges, traits, criteria).toPandas()
    assert set(methods.method) == {"pruned", "greedy", "searched"} and methods[methods.chosen].method.nunique() == 1
    worth = {m: unrelated.worth(set(g.iid), {v: (0.0, score[v]) if at else (score[v], 0.0) for v in g.iid}, criteria)[:-1] for m, g in methods.groupby("method")}
    order = ["pruned", "greedy", "searched"]
    assert methods[methods.chosen].method.iloc[0] == max(order, key=lambda m: (worth[m], -order.index(m)))


def test_large_networks_are_broken_up():
    near = {v: set() for v in range(80)}
    for v in range(1, 80):
        near[0].add(v), near[v].add(0)
    found, status = best_set(near, {v: (0.0, 0.0) for v in near})
    assert status == "broken" and found == set(range(1, 80))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_closures_are_as_deep_as_the_pedigree(spark):
    # A line of 16 with a shorter way to its end, and a cycle of two with a child.
    rows = [(i, i - 1 if i > 1 else 0, 0) for i in range(1, 17)] + [(17, 16, 2), (30, 31, 0), (31, 30, 0), (32, 31, 5)]
    fam = spark.createDataFrame(rows, "iid long, pid long, mid long")
    levels = {r["iid"]: r["level"] for r in pedigrees.generations(fam).collect()}
    assert levels == {i: i - 1 for i in range(1, 18)} | {30: None, 31: None, 32: None}
    depth = {(r["iid"], r["ancestor"]): r["depth"] for r in pedigrees.ancestors(fam).collect()}
    want = {(i, j): i - j for i in range(1, 17) for j in range(1, i)} | {(17, j): 17 - j for j in range(3, 17)} | {(17, 2): 1, (17, 1): 2}
    want |= {(30, 31): 1, (31, 30): 1, (30, 30): 2, (31, 31): 2, (32, 31): 1, (32, 30): 2} | {(32, j): 6 - j for j in range(1, 6)}
    assert depth == want
    assert (17, 3) in {tuple(r) for r in pedigrees.relatives(fam).collect()}
