"""Pedigree forms, pruning and lines against brute force; components against a decomposition; pruning by correlation by hand."""

import itertools
import random

import numpy as np

from kinloom.operators import forms, genotypes, segments

FAM = "fid long, iid long, pid long, mid long, sex int, name long"


def pedigree(rng, fid, n=7):
    """A random pedigree; founders are of both sexes, and names run within the pedigree."""
    rows = []
    for k in range(1, n + 1):
        fathers = [r[1] for r in rows if r[4] == 1]
        mothers = [r[1] for r in rows if r[4] == 2]
        born = k > 3 and fathers and mothers and rng.random() < 0.8
        rows.append([fid, fid * 100 + k, rng.choice(fathers) if born else 0, rng.choice(mothers) if born else 0, 1 + k % 2, k])
    return rows


def same(a, b, missing):
    """Whether some renaming of the missing people makes one pedigree the other."""
    def named(rows, names):
        return sorted((names[i], names.get(p, 0), names.get(m, 0), s if names[i] > 100 else 0) for _, i, p, m, s, _ in rows)

    hidden = [[r[1] for r in x if r[5] in missing] for x in (a, b)]
    if len(a) != len(b) or len(hidden[0]) != len(hidden[1]):
        return False
    known = [{r[1]: r[5] for r in x if r[5] not in missing} for x in (a, b)]
    first = named(a, known[0] | {i: 1000 + k for k, i in enumerate(hidden[0])})
    return any(named(b, known[1] | {i: 1000 + k for k, i in enumerate(p)}) == first for p in itertools.permutations(hidden[1]))


def test_forms_are_those_of_brute_force(spark):
    rng, missing = random.Random(3), {2, 3, 5, 6}
    every = [pedigree(rng, f) for f in range(1, 15)]
    for f in (15, 16):  # the first again, its placeholders called otherwise
        swap = dict(zip((2, 6, 3, 5), (6, 2, 5, 3)))
        move = lambda i: 0 if not i else f * 100 + (swap.get(i % 100, i % 100))
        every.append([[f, move(i), move(p), move(m), s, swap.get(n, n)] for _, i, p, m, s, n in every[f - 15]])
    fam = spark.createDataFrame([r for x in every for r in x], FAM)
    gone = fam.where(fam.name.isin(*missing)).select("iid")
    out = {r.fid: r.same_as for r in forms.form_classes(forms.pedigree_forms(fam, gone, "name")).collect()}
    want = {b[0][0]: min(a[0][0] for a in every if same(a, b, missing)) for b in every}
    assert out == want and out[15] == out[1] and out[16] == out[2]


def test_pruning_takes_what_tells_nothing(spark):
    rows = [[1, 1, 0, 0, 1, 1], [1, 2, 0, 0, 2, 2], [1, 3, 1, 2, 1, 3], [1, 4, 0, 0, 2, 4], [1, 5, 3, 4, 1, 5], [1, 6, 3, 4, 2, 6], [1, 7, 5, 8, 1, 7], [1, 8, 0, 0, 2, 8], [1, 9, 7, 6, 1, 9]]
    fam = spark.createDataFrame(rows, FAM)
    missing = spark.createDataFrame([(1,), (2,), (9,), (7,), (4,)], "iid long")
    left = {r.iid: (r.pid, r.mid) for r in forms.pruned(fam, missing).collect()}
    assert left == {3: (0, 0), 4: (0, 0), 5: (3, 4), 6: (3, 4), 8: (0, 0)}
    assert forms.pruned(fam.limit(0), missing).count() == 0
    samples = fam.where("name in (3, 5, 6, 8)").select("name")
    assert [tuple(r) for r in forms.expected_matches(fam, fam, samples).collect()] == [(1, 1)]
    other = spark.createDataFrame([r for r in rows if r[1] != 6 and r[1] != 9], FAM)
    assert forms.expected_matches(other, fam, samples).count() == 0


def test_lines_and_sexes(spark):
    rows = [[1, 1, 0, 0, 2, 1]] + [[1, k, 0, k - 1, 2, k] for k in range(2, 40)] + [[1, 50, 0, 51, 2, 50], [1, 51, 0, 50, 2, 51], [1, 60, 0, 99, 0, 60]]
    fam = spark.createDataFrame(rows, FAM)
    line = {r.iid: r.line for r in forms.haploid_lines(fam).collect()}
    assert all(line[k] == 1 for k in range(1, 40)) and line[50] is None and line[51] is None and line[60] == 99
    match = spark.createDataFrame([(2, 30, 0, 5, 10), (3, 4, 1, 0, 10), (5, 60, 0, 5, 10)], "iid1 long, iid2 long, match int, ndiff long, length long")
    assert [(r.iid1, r.iid2, r.line) for r in forms.haploid_conflicts(fam, match).collect()] == [(2, 30, 1)]
    unknown = spark.createDataFrame([[1, 1, 0, 0, 0, 1], [1, 2, 0, 0, 0, 2], [1, 3, 1, 2, 0, 3], [1, 4, 3, 2, 0, 4], [1, 5, 2, 3, 2, 5]], FAM)
    assert {r.iid: r.sex for r in forms.inferred_sexes(unknown).collect()} == {1: 1, 2: None, 3: None, 4: 0, 5: 2}


def test_components_are_those_of_a_decomposition(spark):
    rng = np.random.default_rng(5)
    base = rng.uniform(0.2, 0.8, (3, 120))
    dosage = np.array([rng.binomial(2, base[i % 3]) for i in range(60)])
    rows = [(i, v, int(dosage[i, v]) if (i * 7 + v) % 31 else None) for i in range(60) for v in range(120)]
    out = genotypes.genotype_components(spark.createDataFrame(rows, "iid long, vid long, dosage int"), k=2).toPandas().sort_values("iid")
    table = np.full((60, 120), np.nan)
    for i, v, d in rows:
        table[i, v] = np.nan if d is None else d
    p = np.round(np.nanmean(table, 0) / 2, 8)
    z = np.nan_to_num((table - 2 * p) / np.sqrt(2 * p * (1 - p)))
    u = np.linalg.svd(z, full_matrices=False)[0]
    got = np.array(out.pcs.tolist())
    assert np.allclose(np.abs((got * u[:, :2]).sum(0)), 1, atol=1e-3) and (got.max(0) > -got.min(0)).all()
    assert genotypes.genotype_components(spark.createDataFrame([], "iid long, vid long, dosage int")).count() == 0


def test_pruning_by_correlation(spark):
    g = [[0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 2, 2], [2, 0, 1, 1, 0, 2], [0, 0, 1, 1, 2, 1], [1, 0, 2, 0, 1, 2]]
    calls = spark.createDataFrame([(i, v, d) for v, row in enumerate(g) for i, d in enumerate(row)], "iid long, vid long, dosage int")
    at = spark.createDataFrame([(v, 1, 10 * v) for v in range(5)], "vid long, chrom int, pos long")
    out = {r.vid: r.kept for r in genotypes.ld_prune(at, calls).collect()}
    assert out[0] and not out[1] and out[2] and not out[3]
    assert all(r.kept for r in genotypes.ld_prune(at, calls, size=1).collect())


def test_placed_at_random(spark):
    rows = [(1, 2, 1, 0, 50_000_000, 50.0, 1), (1, 3, 1, 10_000_000, 40_000_000, 30.0, 1), (2, 3, 2, 0, 5_000_000, 5.0, 1)]
    out = {(r.id1, r.id2): r for r in segments.null_exceedances(spark.createDataFrame(rows, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int"), 200).collect()}
    assert out[1, 2].shared_cm == 30 and out[1, 2].n_exceed < 20 and out[2, 3].shared_cm == 0 and out[2, 3].n_exceed == 200
    assert 0 <= out[1, 3].expected_cm < 5


def test_segments_placed_at_random_are_shuffled_once(spark, monkeypatch):
    """Small coverages go to the segments; larger ones are joined by place, with the same rows (F16)."""
    rows = [(i % 7, 10 + i % 5, 1 + i % 3, i * 1_000_000, (i + 1 + i % 4) * 1_000_000, 1.0 + i % 4, 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int")
    out = segments.null_exceedances(frame, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(segments, "PLACES", 0)
    assert sorted(out.collect()) == sorted(segments.null_exceedances(frame, 3).collect()) and out.count() == 60
