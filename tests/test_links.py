"""Links of pedigrees hold against all pairs of people added up one by one, and no pair is moved more than a few times."""

import itertools
import math
import random

import pytest
from conftest import DATA

from kinloom.functions.likelihood import Settings
from kinloom.operators import connections, segments
from kinloom.plans import registry
from kinloom.sources.overlays import view

PEDS = "network_id long, pedigree int, iid string, pid string, mid string, sampled boolean, lnl double"
LEAST, MOST = 4, 9


def depths(fam):
    """Least generations from each founder down to everybody below."""
    out = {}
    for f in (i for i, (p, m) in fam.items() if p is None and m is None):
        at, step = {f: 0}, [f]
        while step:
            step = [c for c, both in fam.items() if c not in at and set(both) & set(step)]
            at |= {c: max(at.values()) + 1 for c in step}
        out[f] = at
    return out


def plain(peds, pairs, own, sampled, mode):
    best = {}
    near = {k: {f: min(d for i, d in at.items() if i in sampled) for f, at in down.items() if set(at) & sampled} for k, down in peds.items()}
    for one, two in itertools.product(peds, peds):
        both = [(i, j) for i, j in itertools.product(sampled, sampled) if i[0] == str(one[0]) and j[0] == str(two[0]) and tuple(sorted((i, j))) in pairs]
        if one[0] >= two[0] or not both:
            continue
        found = [((0.0 + own[one] + own[two]), False, one[1], two[1], "", "", 0, None)]
        for f, g in itertools.product(near[one], near[two]):
            nn, a, b = near[one][f] + near[two][g], peds[one][f], peds[two][g]
            below = [(i, j) for i, j in both if i in a and j in b]
            for degree in range(max(1, LEAST - nn), MOST - nn + 1) if below else ():
                gains, few = [], []
                for i, j in below:
                    lnl, null = pairs[tuple(sorted((i, j)))]
                    total = degree + a[i] + b[j]
                    w = 0.5 ** max(total - MOST, 0)
                    v = lnl[total - 1] if total <= MOST else math.log(w * math.exp(lnl[MOST - 1]) + (1 - w) * math.exp(null))
                    gains.append(v - null)
                    if a[i] == near[one][f] and b[j] == near[two][g]:
                        few.append(-2 * (null - (lnl[total - 1] + 2)))
                gain = round(math.fsum(gains) * (-2 if mode == "aic" else 1), 5)
                found.append((gain + own[one] + own[two], True, one[1], two[1], f, g, degree, (len(few), round(math.fsum(few), 5)) if few else (None, None)))
        best.setdefault((one[0], two[0]), []).extend(found)
    sign = 1 if mode == "aic" else -1
    return {k: min(v, key=lambda r: (sign * round(r[0], 5), *r[1:7])) for k, v in best.items()}


@pytest.mark.parametrize("mode", ["composite", "aic"])
def test_links_of_deep_pedigrees(spark, mode):
    rng = random.Random(5)
    rows, peds, own, sampled = [], {}, {}, set()
    for net in range(1, 6):
        names = [f"{net}{c}" for c in "abcdefgh"]
        sampled |= {n for n in names if rng.random() < 0.7}
        for ped in (1, 2):
            fam = {n: (None, None) if k < 2 else (names[k - 1] if rng.random() < 0.8 else None, rng.choice([None, *names[max(k - 4, 0) : k - 1]])) for k, n in enumerate(names)}
            peds[net, ped], own[net, ped] = depths(fam), -float(rng.randrange(4))
            rows += [(net, ped, n, *fam[n], n in sampled, own[net, ped]) for n in names]
    people, pairs = sorted(sampled), {}
    for i, j in itertools.combinations(people, 2):
        if rng.random() < 0.4 and {i[0], j[0]} != {"1", "2"}:
            pairs[i, j] = ([rng.randrange(-900, 100) / 64 for _ in range(MOST)], rng.randrange(-700, 100) / 64)
    frame = spark.createDataFrame([(i, j, *v) for (i, j), v in pairs.items()], "id1 string, id2 string, lnl array<double>, ll_null double")
    got = {(r["net1"], r["net2"]): r for r in connections.link_pedigrees(spark.createDataFrame(rows, PEDS), frame, LEAST, MOST, mode).collect()}
    want = plain(peds, pairs, own, sampled, mode)
    assert got.keys() == want.keys() and len(want) == 9 and any(w[1] for w in want.values())
    for k, (total, linked, ped1, ped2, f1, f2, degree, few) in want.items():
        r = got[k]
        assert (r["ped1"], r["ped2"], r["f1"], r["f2"], r["degree"]) == (ped1, ped2, *((f1, f2, degree) if linked else (None,) * 3)), k
        assert abs(r["total"] - total) < 2e-5
        assert (r["n_pairs"], r["chi2"]) == (None, None) if not linked or few[0] is None else r["n_pairs"] == few[0] and abs(r["chi2"] - few[1]) < 2e-5
    assert max(d for down in peds.values() for at in down.values() for d in at.values()) > 3


@pytest.mark.parametrize("name", ["pedigree_links", "pedigree_links_aic"])
def test_a_pair_is_moved_as_one_row(spark, name):
    """Rows that shuffles write stay below those of inputs and pairs; they held each pair for all founders above it and all degrees (F1, F2)."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        held = store.stageList(spark._jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(held.apply, range(held.size()))}

    pairs = connections.degree_rows(view(spark, DATA, "ov_kin_segments"), LEAST).count()
    people, segs = view(spark, DATA, "ov_kin_peds").count(), view(spark, DATA, "ov_kin_segments").count()
    before = max(stages())
    registry.queries()[name](spark, DATA).collect()
    moved = sum(n for k, n in stages().items() if k > before)
    assert 0 < moved < 4 * pairs + 3 * segs + 20 * people, (moved, pairs, segs, people)


def test_models_that_are_not_asked_for_are_not_computed(spark):
    """A run meets as many terms as there are models left; the rest go before (F1, F2)."""
    seg = view(spark, DATA, "ov_segments")
    all_models, few = segments.models(seg, Settings(max_meioses=10)), connections.degree_rows(seg, LEAST, MOST)
    want = {(r["id1"], r["id2"]): (r["l"], r["ll_null"]) for r in connections.degree_lnl(all_models, "ll_null").where("degree between 4 and 9").groupBy("id1", "id2").agg({"lnl": "sum", "ll_null": "max"}).withColumnsRenamed({"sum(lnl)": "l", "max(ll_null)": "ll_null"}).collect()}
    got = {(r["id1"], r["id2"]): r for r in few.collect()}
    assert got.keys() == want.keys()
    for k, (total, null) in want.items():
        assert got[k]["lnl"][:3] == [None] * 3 and abs(sum(got[k]["lnl"][3:]) - total) < 1e-6 and got[k]["ll_null"] == null
    # One ancestor has degrees of as many meioses, two one less.
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 9" in plan and ">= 4" in plan and plan.index(">= 4") > plan.index("Join Cross")
