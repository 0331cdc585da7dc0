"""Final estimates against plain loops over models and splits; chi-square tails against known values."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinloom.functions.likelihood import Settings, chi2_sf, ln_factorial
from kinloom.operators import segments as sg
from kinloom.plans.oracles import MODELS

S = Settings()
G, R, RATE = S.genome, S.recombinations, S.rate
SIB = 0.75 * 22 + G / 100 * 4 * 0.1875
LOW = -9999999999.0


def background(values, mean=S.pois_mean):
    return -mean + len(values) * math.log(mean) - math.lgamma(len(values) + 1) + sum(math.log(RATE) - (v - 2.5) * RATE for v in values)


def densities(values, e, mixed):
    out = 0.0
    for v in values:
        x = v - 2.5
        if mixed:
            speed = 2 / e
            out += math.log(sum(0.5**k * x ** (k - 1) * math.exp(-x * speed) * speed**k / math.factorial(k - 1) for k in range(1, 10)))
        else:
            out += -math.log(e) - x / e
    return out


def related(values, n, a, more=()):
    if a and n == 1:
        return LOW
    if a == 0:
        bins = G / 100 * (n - 1) + 22
        e = G / bins if n > 1 else 100 * R / 22
        lam = bins * math.exp(-2.5 / e) * 0.5 ** (n - 1)
    elif a == 1:
        bins = G / 100 * n + 22
        e = G / bins
        lam = bins * math.exp(-2.5 / e) * 0.5 ** (n - 1)
    elif n in (2, 3):
        lam, e = SIB, G * (0.75 if n == 2 else 0.5) / SIB
    else:
        e = 100 / n
        lam = 2 * (G / 100 * n + 22) * math.exp(-2.5 / e) * 0.5 ** (n - 1)
    return -lam + len(values) * math.log(lam) - math.lgamma(len(values) + 1) + densities([*values, *more], e, a == 2 and n == 2)


def plain(values, two=(), parts=(), away=0.0, use_ibd2=False):
    values, two = sorted(values, reverse=True), sorted(two, reverse=True)
    apart = densities(parts, 1 / RATE, False)
    models = {}
    for n in range(1, 41):
        for a in (0, 2, 1):
            if a == 0 or n > 1:
                models[a, n] = max(max(background(values[k:]) + apart + related(values[:k], n, a), background(values[k:]) + related(values[:k], n, a, parts)) for k in range(len(values) + 1))
    total, forced, null = sum(values) + away, "NONE", background(values) + apart
    mean = R * 75
    if use_ibd2 and two:
        chance = S.pois_mean * sum(values) / G
        sib = (G / 100 + 22) / 4 * math.exp(-0.1)
        best = max(background(two[k:], chance) - sib + k * math.log(sib) - math.lgamma(k + 1) + densities(two[:k], 25.0, False) for k in range(len(two) + 1))
        if best > background(two, chance) + S.margin:
            null = background(two, S.pois_mean * min(S.pois_mean * RATE / G, 1.0))
            return 2, 2, 1 if null + S.margin < best else None, best, null, "SIB2", (1, 1, None, None, None, None)
    usable = {k: v for k, v in models.items() if not (use_ibd2 and k == (2, 2))}
    if total > mean + S.sibling_z * math.sqrt(mean / 100 * 4 * 625):
        forced, usable = "PO", {(0, 1): models[0, 1]}
    elif not use_ibd2 and total / (R * 100) > 0.625:
        forced, usable = "SIB", {(2, 2): models[2, 2]}
    (a, n), lnl = max(usable.items(), key=lambda m: (round(m[1], 6), -m[0][1], (0, 2, 1).index(m[0][0]) * -1))
    bounds = []
    for c in (2, 1, 0):
        near = [m - (c == 2) for (x, m), v in models.items() if x == c and v + S.margin >= lnl and not (use_ibd2 and c == 2 and m == 2)]
        bounds += [min(near, default=None), max(near, default=None)]
    degree = n - 1 if a == 2 else n
    return a, n, degree if null + S.margin < lnl else None, lnl, null, forced, tuple(bounds)


PAIRS = {
    (1, 2): ([165.0] * 20, [], [], 0.0), (1, 3): ([150.0] * 15, [], [], 0.0), (1, 4): ([150.0] * 15, [], [], 1100.0), (1, 5): ([60.0] * 20, [40.0] * 15, [], 0.0),
    (2, 3): ([30.0, 20.0, 8.0, 6.0], [6.0], [], 0.0), (2, 4): ([5.5, 6.0], [], [9.0, 30.0], 0.0), (2, 5): ([80.0, 40.0, 33.0], [], [70.0, 3.0], 0.0), (3, 4): ([7.0], [], [], 0.0), (3, 5): ([120.0] * 18, [30.0, 20.0, 50.0], [2.6], 0.0),
}
_rng = random.Random(4)
for _k in range(12):
    PAIRS[10 + _k, 40] = ([round(5 + _rng.expovariate(1 / 20), 2) for _ in range(_rng.randrange(1, 25))], [round(5 + _rng.expovariate(1 / 20), 2) for _ in range(_rng.randrange(8))], [], 0.0)


@pytest.mark.parametrize("use_ibd2", [False, True])
def test_final_estimates(spark, use_ibd2):
    rows, parts, masked = [], [], []
    for (a, b), (one, two, cut, away) in PAIRS.items():
        rows += [(a, b, 1, 10 * k, 10 * k + 5, v, 1) for k, v in enumerate(one)] + ([(b, a, 2, 10 * k, 10 * k + 5, v, 2) for k, v in enumerate(two)] if use_ibd2 else [])
        parts += [(a, b, 3, 0, 1, v, 1) for v in cut]
        masked += [(a, b, away)] if away else []
    schema = "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int"
    out = sg.final_estimates(spark.createDataFrame(rows, schema), parts=spark.createDataFrame(parts, schema), masked=spark.createDataFrame(masked, "id1 long, id2 long, cm double"), use_ibd2=use_ibd2)
    got = {(r["id1"], r["id2"]): r for r in out.collect()}
    assert set(got) == set(PAIRS)
    seen = set()
    for pair, (one, two, cut, away) in PAIRS.items():
        a, n, degree, lnl, null, forced, bounds = plain(one, two if use_ibd2 else [], cut, away, use_ibd2)
        r = got[pair]
        assert (r["ancestors"], r["meioses"], r["degree"], r["forced"]) == (a, n, degree, forced), pair
        assert r["lnl"] == pytest.approx(lnl, abs=2e-5) and r["ll_null"] == pytest.approx(null, abs=2e-5), pair
        assert tuple(r[f"p{c}_{x}"] for c in (2, 1, 0) for x in ("low", "high")) == bounds, pair
        seen.add(forced)
    assert seen == ({"NONE", "PO", "SIB2"} if use_ibd2 else {"NONE", "PO", "SIB"})


def test_ancestors_can_be_fixed(spark):
    rows = [(1, 2, 1, 10 * k, 10 * k + 5, 165.0, 1) for k in range(20)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int")
    assert {a: (r := sg.final_estimates(df, ancestors=a).first())["ancestors"] == a and r["forced"] for a in (0, 1, 2)} == {0: "PO", 1: "NONE", 2: "SIB"}


def test_locus_is_split_ends_included(spark):
    schema = "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int"
    rows = [(1, 2, 6, 0, 100, 10.0, 1), (1, 2, 6, 50, 90, 4.0, 1), (1, 2, 6, 10, 50, 4.0, None), (1, 2, 6, 0, 100, 10.0, 2), (1, 2, 5, 0, 100, 10.0, 1), (1, 2, 6, 51, 90, 4.0, 1), (1, 2, 6, 50, 50, 0.0, 1)]
    rest, parts = sg.at_locus(spark.createDataFrame(rows, schema), 6, 50)
    assert sorted((r["start_bp"], r["end_bp"], r["cm"]) for r in parts.collect()) == [(0, 50, 5.0), (10, 50, 4.0), (50, 50, 0.0), (50, 50, 0.0), (50, 90, 4.0), (50, 100, 5.0)]
    assert sorted((r["chrom"], r["start_bp"], r["ibd"]) for r in rest.collect()) == [(5, 0, 1), (6, 0, 2), (6, 50, 1), (6, 51, 1)]


def test_masked_away(spark):
    clipped = spark.createDataFrame([(2, 1, 10.0, 4.0), (1, 2, 3.0, 3.0)], "id1 long, id2 long, cm double, new_cm double")
    assert [tuple(r) for r in sg.masked_away(clipped).collect()] == [(1, 2, 6.0)]


def test_chi_square_tails(spark):
    """Published quantiles, and large values at large degrees of freedom."""
    known = [(5.991465, 2, 0.05), (9.487729, 4, 0.05), (13.276704, 4, 0.01), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (29.588298, 10, 0.001), (0.0, 8, 1.0), (-3.0, 8, 1.0), (1401.0, 1600, 0.99988), (2000.0, 2000, 0.49579), (2500.0, 2, 0.0), (1e5, 1e5, 0.4994)]
    df = spark.createDataFrame([(float(x), int(d) // 2, p) for x, d, p in known], "x double, half long, p double")
    for r in df.withColumn("got", chi2_sf(F.col("x"), F.col("half"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-5), r


def test_equal_segments_split_once(spark):
    """Exact copies of segments come in any order, so every split counts each of them once."""
    from math import exp, lgamma, log

    kept = [(1, 2, c, 1_000_000 * k, 1_000_000 * (k + cm), float(cm), 1 + c % 2) for c in range(1, 4) for k, cm in enumerate((7, 20, 20, 33, 48, 9)) for _ in range(7)]
    df = spark.createDataFrame(kept, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int")
    got = {(r["ancestors"], r["meioses"]): (r["lnl"], r["ll_null"]) for r in sg.models(df.repartition(3)).collect()}
    g, rate, mean0 = 3525.48101, 1 / (3.197036753 - 2.5), 13.73
    x = sorted((r[5] - 2.5 for r in kept), reverse=True)

    def back(k):
        b = len(x) - k
        return -mean0 + b * log(mean0) - lgamma(b + 1) + b * log(rate) - sum(x[k:]) * rate

    for n in (2, 5, 12, 40):
        bins = n * g / 100 + 22
        mean = g / bins
        l1 = bins * exp(-2.5 / mean) * 0.5 ** (n - 1)
        want = max(back(k) - l1 + k * log(l1) - lgamma(k + 1) - k * log(mean) - sum(x[:k]) / mean for k in range(len(x) + 1))
        assert abs(got[1, n][0] - want) < 1e-6 and abs(got[1, n][1] - back(0)) < 1e-6, n
    two = [r for r in kept if r[6] == 2]
    out = sg.sibling_overrides(df.repartition(5)).first()
    y, r2 = sorted((r[5] - 2.5 for r in two), reverse=True), (g / 100 + 22) / 4 * exp(-0.1)
    lam = mean0 * sum(r[5] for r in kept if r[6] == 1) / g
    every = [-lam + (len(y) - k) * log(lam * rate) - lgamma(len(y) - k + 1) - sum(y[k:]) * rate - r2 + k * log(r2) - lgamma(k + 1) - k * log(25) - sum(y[:k]) / 25 for k in range(len(y) + 1)]
    assert abs(out["lnl"] - max(every)) < 2e-6


def test_last_digits_of_many_segments(spark, duck):
    """ln of n! is right to its last digit, and sums over many segments are made in the SQL's order (F2 to F8)."""
    n = [16, 17, 300, 1849, 25_000, 99_999]
    got = [r["v"] for r in spark.createDataFrame([(i,) for i in n], "n long").select(ln_factorial(F.col("n")).alias("v")).collect()]
    for i, v in zip(n, got):
        assert abs(v - duck.execute(f"SELECT lgamma({i + 1})").fetchone()[0]) <= math.ulp(v), i
    rows = [(1, 2 + i % 3, 1 + i % 22, i, 1_000_000 * i, float(5 + i * 7 % 45), 1) for i in range(3000)]
    seg = spark.createDataFrame(rows, "id1 long, id2 long, chrom int, start_bp long, end_bp long, cm double, ibd int")
    ours = {(r["id2"], r["ancestors"], r["meioses"]): r["lnl"] for r in sg.models(seg).collect()}
    con = duckdb.connect()
    con.register("ov_segments", seg.toPandas())
    theirs = con.execute(f"WITH {MODELS} SELECT id2, ancestors, meioses, lnl FROM models").fetchall()
    same = [ours[a, b, c] == v for a, b, c, v in theirs]
    assert len(same) == len(ours) == 3 * 118 and sum(same) > 0.9 * len(same)
