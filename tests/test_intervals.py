"""Interval operators against plain loops, over bins of any width."""

import random

import pytest

from kinloom.operators import connections, forms, segments as sg


@pytest.mark.parametrize("width, gap", [(7, 0), (50, 3), (10**9, 1)])
def test_merge(spark, width, gap):
    rng = random.Random(width)
    rows = [(c, s, s + rng.randrange(60)) for c in (1, 2) for s in [rng.randrange(2000) for _ in range(60)]] + [(1, 5, 900), (3, 4, 4)]
    want = []
    for c, s, e in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2] + gap:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, s, e])
    got = sg.merge_intervals(spark.createDataFrame(rows, "chrom int, start_bp long, end_bp long"), gap, width).collect()
    assert sorted([r["chrom"], r["start_bp"], r["end_bp"]] for r in got) == want


@pytest.mark.parametrize("width", [9, 100, 10**9])
def test_clip(spark, width):
    rng = random.Random(3)
    mask = {1: [(10, 30), (60, 90), (200, 240), (241, 300)], 2: [(0, 500)]}
    rows = [(1, 2, rng.choice([1, 2, 3]), s, s + rng.randrange(1, 200), 10.0) for s in [rng.randrange(320) for _ in range(150)]]
    cross = 12

    def plain(c, b, e):
        for r0, r1 in mask.get(c, ()):
            if b <= r1 and e >= r0:
                if b > r0 - cross:
                    b = min(r1, e)
                if e < r1 + cross:
                    e = max(r0, b)
        return b, e

    segs = spark.createDataFrame(rows, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double")
    regions = spark.createDataFrame([(c, *r) for c, rs in mask.items() for r in rs], "chrom int, start_bp long, end_bp long")
    got = sorted((r["chrom"], r["start_bp"], r["end_bp"], r["new_begin"], r["new_end"], r["new_cm"]) for r in sg.clip_to_mask(segs, regions, cross, width).collect())
    want = sorted((c, s, e, *plain(c, s, e), round(10.0 * (plain(c, s, e)[1] - plain(c, s, e)[0]) / (e - s), 4)) for _, _, c, s, e, _ in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-4 for g, w in zip(got, want))
    assert any(w[3] == w[4] for w in want) and any((w[3], w[4]) == (w[1], w[2]) for w in want)


@pytest.mark.parametrize("width", [5, 64, 10**9])
def test_map(spark, width):
    rng = random.Random(4)
    points = {c: sorted({rng.randrange(1000): rng.random() * 100 for _ in range(25)}.items()) for c in (1, 2)}
    asked = [(c, p) for c in (1, 2, 3) for p in rng.sample(range(-5 if width > 100 else 0, 1100), 80)]

    def plain(c, p):
        at = points.get(c, [])
        low, high = [x for x in at if x[0] < p], [x for x in at if x[0] >= p]
        if low and high:
            return low[-1][1] + (p - low[-1][0]) / (high[0][0] - low[-1][0]) * (high[0][1] - low[-1][1])
        return low[-1][1] if low else high[0][1] if high and high[0][0] == p else 0.0

    frame = spark.createDataFrame([(c, p, m) for c, ps in points.items() for p, m in ps], "chrom int, pos long, cm double")
    got = {(r["chrom"], r["pos"]): r["cm"] for r in sg.map_position(spark.createDataFrame(asked, "chrom int, pos long"), frame, width).collect()}
    assert set(got) == set(asked) and all(abs(got[k] - plain(*k)) < 1e-5 for k in asked)


PEDS = "network_id long, pedigree int, iid string, pid string, mid string, sampled boolean, sex int, age int, lnl double"


def test_founders_stand_for_their_nearest_sampled_descendants(spark):
    rows = [
        (1, 1, "F", None, None, False, 1, None, 0.0), (1, 1, "M", None, None, True, 2, 80, 0.0), (1, 1, "C", "F", "M", False, 1, None, 0.0), (1, 1, "S", "F", "M", False, 2, None, 0.0),
        (1, 1, "G", "C", None, True, 1, 20, 0.0), (1, 1, "H", "S", None, True, 1, 22, 0.0), (1, 1, "K", "G", None, True, 1, 2, 0.0),
    ]
    down = connections.descents(spark.createDataFrame(rows, PEDS))
    assert {(r["iid"], r["depth"]) for r in down.where("founder = 'F'").collect()} == {("F", 0), ("C", 1), ("S", 1), ("G", 2), ("H", 2), ("K", 3)}
    near = {}
    for r in connections.nearest_sampled(down).collect():
        near.setdefault(r["founder"], set()).add((r["iid"], r["near"]))
    assert near == {"F": {("G", 2), ("H", 2)}, "M": {("M", 0)}}


def test_relations_and_measures_across_alternatives(spark):
    base = [("A", None, None, True, 1, 60), ("B", None, None, True, 2, 58), ("C", "A", "B", True, 1, 30)]
    other = [("A", None, None, True, 1, 60), ("B", None, None, True, 2, 58), ("?1", "A", None, False, 1, None), ("C", "?1", None, True, 1, 30)]
    rows = [(5, k, *r, -float(k)) for k, fam in ((1, base), (2, other)) for r in fam]
    peds = spark.createDataFrame(rows, PEDS)
    said = {(r["self"], r["rel"]): (r["rels"], r["n_most"], r["n_pedigrees"]) for r in forms.relations_across(peds).collect()}
    assert said == {("A", "C"): ("C,O", 1, 2), ("C", "A"): ("G,P", 1, 2), ("B", "C"): ("O,UN", 1, 2), ("C", "B"): ("P,UN", 1, 2)}
    # Thirty years are a parent's, and a grandparent's too; the alternatives differ in generations and placeholders.
    measured = {r["pedigree"]: (r["flags"], r["lnl"], r["generations"], r["dummies"]) for r in forms.pedigree_measures(peds).collect()}
    assert measured == {1: (0, -1.0, 2, 0), 2: (0, -2.0, 3, 1)}


def test_sweep_carries_segments_instead_of_joining(spark):
    """Random, nested, equal and empty segments give each piece its covering ones; pieces are not joined with segments."""
    rng = random.Random(8)
    rows = []
    for i in range(160):
        start = rng.randrange(40)
        rows.append((1, 2 + i % 3, rng.randrange(2), rng.randrange(2), i % 2, start, start + rng.choice((0, 1, 2, 5, 5, 9, 30)), float(rng.randrange(1, 9))))
    df = spark.createDataFrame(rows + rows[:40], "id1 long, id2 long, hap1 int, hap2 int, chrom int, start_bp long, end_bp long, cm double")
    out = sg.ibd2_sweep(df)
    want = {}
    for key in {(r[0], r[1], r[4]) for r in rows}:
        held = [r for r in rows if (r[0], r[1], r[4]) == key]
        ends = sorted({b for r in held for b in r[5:7]})
        for b, e in zip(ends, ends[1:]):
            over = [r for r in held if r[5] <= b and r[6] >= e]
            if over:
                s = min(over, key=lambda r: ((r[5], r[6]) != (b, e), r[5], r[6], r[2], r[3], r[7]))
                want[*key, b, e] = (round(s[7] * (e - b) / (s[6] - s[5]), 6), 2 if {2 * r[2] + r[3] for r in over} == {1, 2} else 1)
    got = {tuple(r[:5]): r[5:] for r in map(tuple, out.collect())}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    assert {v[1] for v in want.values()} == {1, 2}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
