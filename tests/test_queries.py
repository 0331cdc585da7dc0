"""Every query with SQL gives the SQL's rows; the others give rows that keep their rules."""

import re

import numpy as np
import pandas as pd
import pytest
from conftest import DATA

from kinloom.operators import ancestry, relationships
from kinloom.plans import registry
from kinloom.sources.overlays import view

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    compare(registry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df(), name)


#: Queries whose rows at the smallest size may be none.
MAY_BE_EMPTY: set[str] = set()


def compare(got, want, name=""):
    assert len(want) or name in MAY_BE_EMPTY, "compares nothing with nothing"
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    for c in names:
        if str(got[c].dtype).lower().startswith("float") or str(want[c].dtype).lower().startswith("float"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].isna() == want[c].isna()).all(), c
            there = want[c].notna()
            assert (got[c][there] == want[c][there]).all(), c


def test_unrelated_sets_are_unrelated_and_maximal(spark):
    q = registry.queries()
    chosen = set(q["max_unrelated_set"](spark, DATA).toPandas().iid)
    edges = q["network_edges"](spark, DATA).toPandas()
    near = {}
    for a, b in zip(edges.iid1, edges.iid2):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert not any(near.get(v, set()) & chosen for v in chosen)
    assert all(near[v] & chosen for v in set(near) - chosen)


def test_the_comparison_sees_nulls():
    one, two = pd.DataFrame({"k": [1, 2], "v": [3, 4]}), pd.DataFrame({"k": [1, 2], "v": pd.array([3, None], "Int32")})
    with pytest.raises(AssertionError):
        compare(one, two)


def test_all_strand_actions_occur(spark):
    out = registry.queries()["strand_flip"](spark, DATA).toPandas()
    assert set(out.action) == {"keep", "flip", "ambiguous", "triallelic", "weird", "absent"}


def test_ancestry_prediction_covers_the_test_samples(spark):
    out = registry.queries()["ancestry_predict"](spark, DATA).toPandas()
    assert len(out) and out.probability.between(0, 1).all()


def test_ancestry_of_populations_apart(spark):
    """Populations well apart are told apart, in the test samples and in every fold."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.3, 10) + 3 * np.eye(10)[i % 3]).tolist(), ("CEU", "CHB", "YRI")[i % 3], i % 2 == 0) for i in range(240)]
    pcs = spark.createDataFrame(rows, "iid long, pcs array<double>, pop string, is_ref boolean")
    out = ancestry.predict(pcs).join(pcs, "iid").toPandas()
    assert len(out) == 120 and (out.predicted == out["pop"]).mean() > 0.95
    every = ancestry.probabilities(pcs).toPandas()
    assert len(every) == 360 and np.allclose(every.groupby("iid").probability.sum(), 1, atol=1e-5)
    folds = ancestry.cross_validated(pcs).toPandas()
    assert len(folds) == 5 and folds.n.sum() == 120 and folds.accuracy.min() > 0.9


def test_thresholds_and_degrees():
    assert [relationships.degree_of(relationships.threshold_of(d)) for d in (1, 2, 3)] == [1, 2, 3]


def test_connections(spark):
    out = registry.queries()["connection_best"](spark, DATA).toPandas()
    assert (out.net1 < out.net2).all() and out.p.between(0, 1).all()


def test_sigmoids_minimize_their_loss(spark):
    """The fitted sigmoids are where the loss with drawn-in targets is least, for easy, mixed and one-sided margins."""
    rng = np.random.default_rng(2)
    rows = []
    for label, gap in ((0, 1.0), (1, 0.2), (2, 20.0)):
        hit = rng.random(300) < 0.3
        rows += [(0, label, float(m), int(h)) for m, h in zip(rng.normal(gap * np.where(hit, 1, -1), 1.0), hit)]
    rows += [(1, 0, 3.0, 0)] * 5
    found = ancestry.sigmoids(spark.createDataFrame(rows, "fold int, label int, margin double, hit int"))
    assert set(found) == {(0, 0), (0, 1), (0, 2), (1, 0)}
    for key, (a, b) in found.items():
        m, h = (np.array([r[i] for r in rows if r[:2] == key], float) for i in (2, 3))
        t = np.where(h == 1, (h.sum() + 1) / (h.sum() + 2), 1 / (len(h) - h.sum() + 2))

        def loss(a, b):
            z = a * m + b
            return (np.logaddexp(0, z) - (1 - t) * z).sum()

        least = loss(a, b)
        for da in (-0.02, 0, 0.02):
            for db in (-0.02, 0, 0.02):
                assert loss(a + da, b + db) >= least - 1e-4, key


def test_pair_sums_by_small_blocks(spark):
    """Blocks of a few people and sites give the same sums as all pairs and sites."""
    from kinloom.operators.pair_blocks import dosage_sums, haploid_sums, pair_sums

    rng = np.random.default_rng(3)
    rows = [(i, s, int(rng.integers(0, 3)), float(s)) for i in range(23) for s in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "iid long, site long, code int, w double")
    values = {(i, s): c for i, s, c, _ in rows}
    for people, sites in ((4, 6), (100, 100)):
        got = {(r["iid1"], r["iid2"]): r for r in pair_sums(df, dosage_sums, ["n", "ibs0", "ibs1", "ibs2", "w"], ["w"], people, sites).collect()}
        half = {(r["iid1"], r["iid2"]): r for r in pair_sums(df, haploid_sums, ["n", "unknown", "diff"], (), people, sites).collect()}
        for a in range(23):
            for b in range(a + 1, 23):
                both = [(values[a, s], values[b, s], s) for s in range(40) if (a, s) in values and (b, s) in values]
                r, h = got[a, b], half[a, b]
                assert [r["n"], r["ibs0"], r["ibs1"], r["ibs2"], r["w"]] == [len(both), *(sum(abs(x - y) == 2 - k for x, y, _ in both) for k in (0, 1, 2)), sum(s for *_, s in both)]
                assert [h["n"], h["unknown"], h["diff"]] == [len(both), sum(not x or not y for x, y, _ in both), sum(bool(x and y) and x != y for x, y, _ in both)]


def test_models_of_links_are_computed_once(spark):
    """Degrees and nulls of links equal those of all models, and are read, not computed, when used."""
    from kinloom.operators import connections, pedigrees, segments
    from kinloom.sources.overlays import view

    seg, fam = view(spark, DATA, "ov_segments"), view(spark, DATA, "ov_fam")
    lnl, null = connections.degree_models(seg)
    m = segments.models(seg)
    compare(lnl.toPandas(), connections.degree_lnl(m).where("degree <= 9").toPandas())
    compare(null.toPandas(), m.select("id1", "id2", "ll_null").distinct().toPandas())
    for frame in (lnl, null):
        assert "FileScan" not in frame._jdf.queryExecution().toString()
    few = fam.where("iid % 7 = 0").select("iid")
    compare(pedigrees.ancestors(fam, few).toPandas(), pedigrees.ancestors(fam).join(few, "iid", "left_semi").toPandas())


def test_classes_are_worked_out_for_grid_points_not_for_pairs(spark):
    points = relationships.point_classes(relationships.synthetic_kde(spark)).toPandas()
    assert not points.duplicated(["g0", "g1", "high", "hard"]).any() and len(points) <= 8 * 101 * 101
    z = [(1, 2, 0.5, 0, 1000, 0), (1, 3, 0.5, 5, 0, 995), (1, 4, 0.2, 250, 700, 50), (1, 5, 0.0, None, None, 20), (1, 6, 0.0, 1300, -4, 0), (1, 7, 0.5, 8, 795, 197), (1, 8, 0.5, 200, 800, 0), (1, 9, 0.5, 200, 801, 0)]
    got = relationships.classify(spark.createDataFrame(z, "iid1 long, iid2 long, pi_hat double, z0 int, z1 int, z2 int"), relationships.synthetic_kde(spark)).toPandas().set_index("iid2").sort_index()
    assert len(got) == len(z) and list(got.mz) == [i == 3 for i in range(2, 10)]
    assert got.rel[2] == "PC" and got.rel[3] == "FS" and got.rel[6] == "UN" and got.rel[9] == "PC" and got.rel[8] != "PC"


@pytest.mark.parametrize("name", ["unrelated_methods", "unrelated_by_traits"])
def test_networks_come_from_one_pass_over_the_pairs(spark, monkeypatch, name):
    calls, classes = [], registry._kin_classes
    monkeypatch.setattr(registry, "_kin_classes", lambda s, d: calls.append(name) or classes(s, d))
    assert registry.queries()[name](spark, DATA).count() and len(calls) == 1


def test_pairs_of_families_are_dealt_out(spark):
    assert view(spark, DATA, "ov_kin_genome").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_relatives_are_dealt_to_tasks_by_the_number_of_people(spark, duck, monkeypatch):
    from kinloom.operators import pedigrees

    monkeypatch.setattr(pedigrees, "PEOPLE", 10)
    fam = view(spark, DATA, "ov_fam")
    out = registry.queries()["pedigree_degrees"](spark, DATA)
    tasks = -(-fam.count() // 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and plan.count(f", {tasks}), REPARTITION_BY_NUM") > 5
    # The rest are known parents, two rows a person at most.
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\w+)#[^)]*\), ENSURE", plan)) <= {("parent", "child")} and len(re.findall(r"hashpartitioning\([^)]*\), ENSURE", plan)) == len(re.findall(r"hashpartitioning\(parent#\w+, child#\w+, 4\), ENSURE", plan))
    compare(out.toPandas(), duck.execute(SQL["pedigree_degrees"]).df())
