"""The pedigree search on simulated families whose truth is known, and its rules one by one."""

import random

import pytest

from kinloom.operators import reconstruct as rc
from kinloom.operators.pedigree_state import FAR, State
from kinloom.operators.reconstruct import Family, advance, search


def family(rng, n):
    """Founders, their children with mates, and grandchildren."""
    names = iter(f"p{i:02d}" for i in range(n))
    one, two = next(names), next(names)
    sex, parents, left = {one: 1, two: 2}, {}, n - 2
    second = [next(names) for _ in range(rng.choice([2, 3]) if n <= 10 else rng.choice([3, 4]))]
    left -= len(second)
    for c in second:
        sex[c], parents[c] = rng.choice([1, 2]), (one, two)
    couples = []
    for c in second:
        if left >= 2:
            mate, left = next(names), left - 1
            sex[mate] = 3 - sex[c]
            couples.append(tuple(sorted((c, mate))))
    for k in range(left):
        child = next(names)
        sex[child], parents[child] = rng.choice([1, 2]), couples[k % len(couples)]
    return State(parents, sex)


def observed(rng, true, hidden):
    """The family as far as it has data, with its related pairs up to the third degree."""
    hide = set(rng.sample(sorted(true.sex), hidden))
    names = {x: f"?{x}" if x in hide else x for x in true.sex}
    seen = State({names[c]: tuple(sorted(names[p] for p in ps)) for c, ps in true.parents.items()}, {names[x]: 0 if x in hide else s for x, s in true.sex.items()})
    seen.possible({})
    people = sorted(x for x in seen.sex if x[0] != "?")
    return seen, people, seen.relations(people)


def contradictions(state, people, said):
    now = state.relations(people)
    pairs = [(a, b) for i, a in enumerate(people) for b in people[i + 1 :]]
    return [(p, said.get(p, "UN"), now.get(p, "UN")) for p in pairs if said.get(p, "UN") != now.get(p, "UN") and not {said.get(p, "UN"), now.get(p, "UN")} <= FAR]


@pytest.mark.parametrize("n, seed", [(10, s) for s in range(24)] + [(17, s) for s in range(10)])
def test_simulated_families(n, seed):
    rng = random.Random(1000 * n + seed)
    seen, people, said = observed(rng, family(rng, n), rng.randrange(4))
    found, status = search([(*k, (r,)) for k, r in said.items() if r != "DR"], {x: seen.sex[x] for x in people}, {}, people=people)
    assert status == "ok" and seen.pruned().canonical().text() in {s.text() for s in found}
    assert not any(contradictions(s, people, said) for s in found)
    assert len({s.text() for s in found}) == len(found)


def test_handing_over_gives_the_same():
    """Searches that hand over after every few states find what one search finds."""
    rng = random.Random(3)
    seen, people, said = observed(rng, family(rng, 10), 3)
    fam = Family(people, {k: (r,) for k, r in said.items()}, {}, {})
    open_, finished = advance(fam, [(0, fam.start().canonical().text())], width=1 << 30, turn=1 << 30)
    assert not open_ and finished
    waiting, parts, rounds = [(0, fam.start().canonical().text())], [], 0
    while waiting:
        dealt = [waiting[i::3] for i in range(3)]
        waiting = []
        for states in dealt:
            more, done = advance(fam, states, width=2, turn=1)
            waiting, parts = waiting + more, parts + done
        waiting, rounds = sorted(set(waiting)), rounds + 1
    assert rounds > 3 and set(parts) == set(finished)


def test_parent_and_child_have_two_directions():
    found, status = search([("a", "b", ("PC",))], {"a": 1, "b": 2}, {})
    assert status == "ok" and len(found) == 2


def test_ages_settle_the_direction():
    found, _ = search([("a", "b", ("PC",))], {"a": 1, "b": 2}, {"a": 50, "b": 20})
    assert len(found) == 1 and "a" in found[0].parents["b"]


def test_trio_has_one_pedigree():
    found, _ = search([("c", "f", ("PC",)), ("c", "m", ("PC",))], {"f": 1, "m": 2}, {})
    assert [s.parents for s in found] == [{"c": ("f", "m")}]
    assert search([("c", "f", ("PC",)), ("c", "m", ("PC",))], {"f": 1, "m": 1}, {}) == ([], "no_pedigree")


def test_trio_with_sibs():
    pairs = [("c1", "f", ("PC",)), ("c2", "f", ("PC",)), ("c1", "m", ("PC",)), ("c2", "m", ("PC",)), ("c1", "c2", ("FS",))]
    found, status = search(pairs, {"f": 1, "m": 2}, {})
    assert status == "ok" and [s.parents for s in found] == [{"c1": ("f", "m"), "c2": ("f", "m")}]


def test_second_degree_ways():
    """Two people of the second degree alone: half sibs, grandparent or avuncular, either way round."""
    found, _ = search([("a", "b", ("HAG",))], {"a": 1, "b": 1}, {})
    assert len(found) == 5
    assert len(search([("a", "b", ("HAG",))], {"a": 1, "b": 1}, {"a": 70, "b": 5})[0]) == 3 + 1  # b is not a's grandparent
    third = search([("a", "b", ("CGH",))], {}, {})[0]
    assert len(third) == 1 + 3 * 2  # cousins; great-grandparent, great and half avuncular both ways


def test_maternal_lines_refute():
    """Half sibs whose mitochondria differ share their father, those whose Y differ their mother (the manual's case)."""
    pairs, people = [("a", "b", ("HAG",)), ("a", "f", ("PC",)), ("b", "f", ("PC",))], {"a": 1, "b": 1, "f": 1}
    found, _ = search(pairs, people, {"f": 60, "a": 20, "b": 20})
    assert len(found) == 1 and found[0].parents["a"] != found[0].parents["b"]
    assert search(pairs, people, {"f": 60, "a": 20, "b": 20}, y=[("a", "b")]) == ([], "no_pedigree")
    assert search(pairs, people, {"f": 60, "a": 20, "b": 20}, mito=[("a", "b")])[1] == "ok"
    pairs = [("a", "b", ("HAG",)), ("a", "m", ("PC",)), ("b", "m", ("PC",))]
    assert search(pairs, {"a": 1, "b": 1, "m": 2}, {"m": 60, "a": 20, "b": 20}, mito=[("a", "b")]) == ([], "no_pedigree")


def test_generations_are_bounded():
    pairs = [("a", "b", ("PC",)), ("b", "c", ("PC",)), ("a", "c", ("HAG",))]
    every = search(pairs, {}, {})[0]
    # a line of three either way, half sibs, and five ways for two relatives to have a child
    assert len(every) == 8 and {s.generations() for s in every} >= {2, 3}
    few = search(pairs, {}, {}, generations=2)[0]
    assert {s.text() for s in few} == {s.text() for s in every if s.generations() == 2}


def test_open_states_are_bounded():
    pairs = [(f"a{i}", f"b{i}", ("PC",)) for i in range(10)]
    assert search(pairs, {}, {}, max_states=50)[1] == "too_many_states"
    assert len(search(pairs, {}, {})[0]) == 2**10


def test_cutoffs():
    assert [round(c, 4) for c in rc.cutoffs()] == [0.3, 0.2, 0.1, 0.0333, 0.0111, 0.0037]
    assert rc.possible_classes([0.4, 0, 0.4, 0, 0, 0.2], 0.3) == ("PC",)
    assert rc.possible_classes([0, 0, 0.2, 0.5, 0.3, 0], 0.1) == ("HAG", "CGH", "DR")
    assert rc.possible_classes([0, 0, 0.2, 0.25, 0.2, 0.2], 0.3) == ("CGH",)
    assert len(rc.possible_classes([0] * 6, 0.3)) == 6


def test_names_of_placeholders_do_not_count():
    rng = random.Random(9)
    for n in range(8, 16):
        seen, _, _ = observed(rng, family(rng, n), 3)
        hidden = [x for x in seen.sex if x[0] == "?"]
        mixed = dict(zip(hidden, rng.sample([f"?z{k}" for k in range(len(hidden))], len(hidden))))
        name = lambda x: mixed.get(x, x)
        other = State({name(c): tuple(sorted(map(name, ps))) for c, ps in seen.parents.items()}, {name(x): s for x, s in seen.sex.items()})
        assert other.canonical().text() == seen.canonical().text()
        assert State.read(seen.text()).text() == seen.text()


COLUMNS = "iid1 long, iid2 long, pi_hat double, mz boolean, pc double, fs double, hag double, cgh double, dr double, un double"
SURE = {"PC": (0.5, 1, 0, 0, 0, 0, 0), "FS": (0.5, 0, 1, 0, 0, 0, 0), "HAG": (0.25, 0, 0, 1, 0, 0, 0), "CGH": (0.125, 0, 0, 0, 1, 0, 0), "UN": (0, 0, 0, 0, 0, 0, 1)}


def frames(spark, pairs, people):
    rows = []
    for a, b, rel in pairs:
        share, *v = (1.0, *([0, 1, 0, 0, 0, 0])) if rel == "MZ" else SURE[rel] if isinstance(rel, str) else rel
        rows.append((a, b, float(share), rel == "MZ", *map(float, v)))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(people, "iid long, sex int, age int")


def test_in_spark(spark, monkeypatch):
    """Networks apart, twins as one person, a lower cutoff where the first fits nothing, and a status where none does."""
    pairs = [(1, 3, "PC"), (2, 3, "PC"), (1, 2, "UN"), (3, 1, "PC")]
    pairs += [(10, 12, "PC"), (10, 13, "PC"), (12, 13, "MZ"), (11, 12, "PC"), (11, 13, "PC")]
    # 22 is 20's and 21's child, but its sib 23 looks like 20's grandchild rather than child
    pairs += [(20, 22, "PC"), (21, 22, "PC"), (22, 23, "FS"), (21, 23, "PC"), (20, 23, (0.4, 0.15, 0, 0.85, 0, 0, 0))]
    pairs += [(30, 31, "PC"), (31, 32, "PC"), (30, 32, "PC"), (30, 33, "PC"), (31, 33, "PC"), (32, 33, "PC")]
    people = [(i, 1 if i % 10 in (0, 2) else 2, None if i % 10 > 1 else 60) for i in (1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 33)]
    people[0], people[1] = (1, 1, 60), (2, 2, 60)
    classified, who = frames(spark, pairs, people)
    rows = rc.reconstruct(classified, who).collect()
    by_net = {}
    for r in rows:
        by_net.setdefault(r["network_id"], []).append(r)
    assert {k: {(r["status"], round(r["cutoff"], 4)) for r in v} for k, v in by_net.items()} == {1: {("ok", 0.3)}, 10: {("ok", 0.3)}, 20: {("ok", 0.1)}, 30: {("no_pedigree", 0.0037)}}
    assert {(r["iid"], r["pid"], r["mid"]) for r in by_net[1]} == {("1", None, None), ("2", None, None), ("3", "1", "2")}
    assert {(r["iid"], r["pid"], r["mid"]) for r in by_net[10]} == {("10", None, None), ("11", None, None), ("12:13", "10", "11")}
    best = [r for r in by_net[20] if r["pedigree"] == 1]
    assert {(r["iid"], r["pid"], r["mid"]) for r in best if r["iid"] in ("22", "23")} == {("22", "20", "21"), ("23", "20", "21")}
    assert [r["iid"] for r in by_net[30]] == [None]


def test_limit_and_lines_in_spark(spark, monkeypatch):
    monkeypatch.setattr(rc, "MAX_STATES", 3)
    pairs = [(1, k, "HAG") for k in range(2, 6)] + [(7, 8, "HAG"), (7, 9, "PC"), (8, 9, "PC")]
    people = [(k, 1, None) for k in range(1, 10)]
    classified, who = frames(spark, pairs, people)
    mismatch = spark.createDataFrame([(7, 8, 0), (1, 2, 1)], "iid1 long, iid2 long, match int")
    rows = rc.reconstruct(classified, who, y=mismatch, retry=False).collect()
    assert {(r["network_id"], r["status"]) for r in rows if r["network_id"] == 7} == {(7, "no_pedigree")}
    rows = rc.reconstruct(classified, who, retry=False).collect()
    assert {r["status"] for r in rows if r["network_id"] == 7} == {"ok"}


def test_nothing_in_nothing_out(spark):
    classified, who = frames(spark, [], [])
    assert rc.reconstruct(classified, who).count() == 0
    classified, who = frames(spark, [(1, 2, "UN")], [(1, 1, None)])
    assert rc.reconstruct(classified, who).count() == 0


def test_networks_alike_but_for_names_are_searched_once(spark, monkeypatch, tmp_path):
    """The smallest network of a form is searched; all get its pedigrees by their own names, with their own likelihoods."""
    import json

    def facts(iids, ages, pc):
        father, mother, child = iids
        said = [(father, child, [pc, 0.0, 0.0, 0.0, 0.0, 1 - pc]), (mother, child, [0.9, 0.0, 0.0, 0.0, 0.0, 0.1]), (father, mother, [0.0, 0.0, 0.0, 0.0, 0.1, 0.9])]
        people = [{"iid": i, "sex": s, "age": a} for i, s, a in zip(iids, (1, 2, 1), ages)]
        return people, json.dumps({"people": people, "pairs": [{"a": min(a, b), "b": max(a, b), "v": v} for a, b, v in said]})

    networks = {1: facts("123", (60, 58, 30), 0.9), 7: facts(("70", "71", "9"), (80, 75, 41), 0.8), 5: facts("567", (20, 58, 30), 0.9)}
    turn, folder = rc._turn, str(tmp_path)

    def noted(generations):
        run = turn(generations)

        def noting(batches):
            def seen():
                for batch in batches:
                    for network in batch.column("network_id").to_pylist():
                        open(f"{folder}/{network}", "a").close()
                    yield batch

            return run(seen())

        return noting

    monkeypatch.setattr(rc, "_turn", noted)
    frame = spark.createDataFrame([(k, f) for k, (_, f) in networks.items()], "network_id long, facts string")
    found = {}
    for r in rc.found_states(frame, retry=False).collect():
        found.setdefault(r.network_id, {})[r.state] = r.lnl
    assert {p.name for p in tmp_path.iterdir()} == {"1", "5"}
    for k, (people, text) in networks.items():
        read = json.loads(text)
        pairs = [(p["a"], p["b"], rc.possible_classes(p["v"], 0.3)) for p in read["pairs"]]
        states, status = search(pairs, {p["iid"]: p["sex"] for p in people}, {p["iid"]: p["age"] for p in people})
        assert {s.text() for s in states} == {s for s in found[k] if s} and status == ("ok" if k != 5 else "no_pedigree")
    assert found[1].values() != found[7].values() and len(found[1]) == len(found[7]) > 0
