"""Maximum unrelated sets, chosen by any list of traits.

A network is one problem, or several where its size asks to break it up.  A
problem's search is rows, each a part of its sets; a task works on a row for a
stated number of steps and hands over what is left as smaller rows, so that no
search is cut short and a hard network is spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinloom.operators.recovery import checkpointed

#: Largest network solved exactly, by edge density up to the first number.
CAPS = ((0.15, 60), (0.2, 65), (0.25, 70), (0.35, 100), (0.45, 130), (0.55, 170), (0.65, 230), (0.75, 330))
CAP_ABOVE = 500
#: Steps of a task on one row before it hands over the rest.
TURN = 20_000

#: What is wanted of a set, most important first: its size, a trait's sum high or low, its average high or low (of
#: quantities; of distances to the mean, low for people near it and high for the tails).
Criteria = tuple[tuple[str, str], ...]
SIZE_THEN_AFFECTED: Criteria = (("", "size"), ("affected", "high"))


def cap(density: float) -> int:
    return next((size for most, size in CAPS if density <= most), CAP_ABOVE)


def greedy_set(near: dict) -> set:
    """Take the person with the fewest relatives left, drop these, repeat."""
    left, out = {v: set(n) for v, n in near.items()}, set()
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        out.add(v)
        gone = left[v] | {v}
        for g in gone:
            left.pop(g, None)
        for n in left.values():
            n -= gone
    return out


def pruned_set(near: dict, score: dict) -> set:
    """Drop the less wanted of a related pair until none is left."""
    alive = set(near)
    for a in sorted(near):
        for b in sorted(near[a]):
            if a in alive and b in alive:
                alive.discard(min((a, b), key=lambda x: (score.get(x, 0), -len(near[x] & alive), -x)))
    return alive


def maximal_sets(near: dict, stack: list | None = None, turn: int | None = None) -> Iterator[frozenset]:
    """All maximal independent sets: cliques of the complement, with pivots.

    ``stack`` holds (taken, free, barred) still to do, the whole graph if none
    is given; what is left of it after ``turn`` steps stays in it.
    """
    nodes = set(near)
    free = {v: nodes - near[v] - {v} for v in nodes}
    stack = [(frozenset(), frozenset(nodes), frozenset())] if stack is None else stack
    steps = 0
    while stack and (turn is None or steps < turn):
        steps += 1
        r, p, x = stack.pop()
        if not p:
            if not x:
                yield r
            continue
        pivot = max(sorted(p | x), key=lambda v: len(free[v] & p))
        for v in sorted(p - free[pivot]):
            stack.append((r | {v}, p & free[v], x & free[v]))
            p, x = p - {v}, x | {v}


def parts_of(near: dict) -> list[dict]:
    """The connected parts of a network, the one with the smallest member first."""
    out, left = [], set(near)
    for v in sorted(near):
        if v in left:
            part, queue = set(), [v]
            while queue:
                x = queue.pop()
                if x not in part:
                    part.add(x)
                    queue += near[x] - part
            out.append({x: near[x] for x in part})
            left -= part
    return out


def without(near: dict, gone: set) -> dict:
    return {v: n - gone for v, n in near.items() if v not in gone}


def worth(found, traits: dict, criteria: Criteria) -> tuple:
    """A set's traits in the order of the criteria, more being better, then smaller ids."""
    out = []
    for k, (_, rule) in enumerate(criteria):
        total = len(found) if rule == "size" else sum(traits[v][k] for v in found)
        if rule.endswith("average"):
            total = total / len(found) if found else 0.0
        out.append(round(-total if rule.startswith("low") else total, 9))
    return (*out, tuple(-v for v in sorted(found)))


def gains(traits: dict, criteria: Criteria) -> dict | None:
    """What each person adds to a set's worth, or None where worths do not add up or somebody adds less than nothing.

    Where all add something, the worthiest set is maximal by itself and can be
    found by branching; else all maximal sets are compared.
    """
    if any(rule.endswith("average") for _, rule in criteria):
        return None
    out = {v: tuple(1.0 if rule == "size" else -t[k] if rule == "low" else t[k] for k, (_, rule) in enumerate(criteria)) for v, t in traits.items()}
    return out if all(g > (0.0,) * len(criteria) for g in out.values()) else None


class Unfinished(Exception):
    """A search that needs more steps than its turn has."""


def reduced(near: dict, gain: dict) -> tuple[set, dict]:
    """People that some best set holds, and the graph without them and their relatives: those without relatives, and
    those with one relative who adds no more."""
    taken: set = set()
    while True:
        v = next((v for v in sorted(near) if not near[v] or len(near[v]) == 1 and gain[v] >= gain[next(iter(near[v]))]), None)
        if v is None:
            return taken, near
        taken.add(v)
        near = without(near, near[v] | {v})


def hub_of(near: dict, gain: dict):
    """The person with most relatives, of several the one who adds least."""
    return max(near, key=lambda v: (len(near[v]), tuple(-g for g in gain[v]), -v))


def _total(found: set, gain: dict) -> tuple:
    return (*(round(sum(x), 9) for x in zip(*(gain[v] for v in found))), tuple(-v for v in sorted(found)))


def worthiest(near: dict, gain: dict, steps: list[int]) -> set:
    """The unrelated set that adds most, by branching; parts that no pair joins are solved apart."""
    taken, near = reduced(near, gain)
    if not near:
        return taken
    parts = parts_of(near)
    if len(parts) > 1:
        return taken.union(*(worthiest(p, gain, steps) for p in parts))
    steps[0] -= 1
    if steps[0] < 0:
        raise Unfinished
    hub = hub_of(near, gain)
    ways = worthiest(without(near, {hub}), gain, steps), {hub} | worthiest(without(near, near[hub] | {hub}), gain, steps)
    return taken | max(ways, key=lambda s: _total(s, gain))


def problems(near: dict, gain: dict) -> tuple[list[dict], str]:
    """The network, or the parts that are left of one above the size for its density without its hubs."""
    n, edges = len(near), sum(map(len, near.values())) / 2
    if n <= 60 or n <= cap(2 * edges / (n * (n - 1))):
        return [near], "exact"
    parts = parts_of(without(near, {hub_of(near, gain)}))
    return [q for p in parts for q in problems(p, gain)[0]], "broken"


def best_set(near: dict, traits: dict, criteria: Criteria = SIZE_THEN_AFFECTED) -> tuple[set, str]:
    """The worthiest unrelated set of one network in this process, and whether the network was broken up."""
    gain = gains(traits, criteria)
    weight = gain or {v: (1.0,) for v in near}
    parts, status = problems(near, weight)
    found: set = set()
    for part in parts:
        found |= worthiest(part, gain, [1 << 60]) if gain else set(max(maximal_sets(part), key=lambda s: worth(s, traits, criteria)))
    return found, status


# ----------------------------------------------------------------- searches as rows
PROBLEMS = "network_id long, part int, status string, graph string"
ROWS = "network_id long, part int, done boolean, worth array<double>, ties array<long>, taken array<long>, free array<long>, barred array<long>"


def _traits(row: dict) -> dict:
    return {v: tuple(t or 0.0 for t in values) for v, values in zip(row["iids"], row["traits"])}


def _broken_up(criteria: Criteria):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                traits = _traits(row)
                near = {v: set(n) for v, n in zip(row["iids"], row["near"])}
                parts, status = problems(near, gains(traits, criteria) or {v: (1.0,) for v in near})
                graphs = [json.dumps({"iids": sorted(p), "near": [sorted(p[v]) for v in sorted(p)], "traits": [traits[v] for v in sorted(p)]}) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([row["network_id"]] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([status] * len(parts)), pa.array(graphs)], ["network_id", "part", "status", "graph"])

    return run


def _searched(criteria: Criteria, turn: int):
    """Rows of one problem, worked on for one turn."""

    def step(near: dict, traits: dict, gain: dict | None, taken: set, free: set, barred: set) -> tuple[list[set], list[tuple]]:
        """(sets found, rows left) of the sets that hold ``taken`` and others of ``free``."""
        if gain is None:
            stack = [(frozenset(taken), frozenset(free), frozenset(barred))]
            best = max(maximal_sets(near, stack, turn), key=lambda s: worth(s, traits, criteria), default=None)
            return [set(best)] if best is not None else [], stack
        try:
            return [taken | worthiest({v: near[v] & free for v in free}, gain, [turn])], []
        except Unfinished:
            more, graph = reduced({v: near[v] & free for v in free}, gain)
            hub = hub_of(graph, gain)
            ways = (taken | more, set(graph) - {hub}), (taken | more | {hub}, set(graph) - graph[hub] - {hub})
            return [], [(t, f, set()) for t, f in ways]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = json.loads(row["graph"])
                near = {v: set(n) for v, n in zip(graph["iids"], graph["near"])}
                traits = _traits(graph)
                free = set(near) if row["free"] is None else set(row["free"])
                found, left = step(near, traits, gains(traits, criteria), set(row["taken"] or ()), free, set(row["barred"] or ()))
                out = [(True, *(lambda w: (list(w[:-1]), list(w[-1])))(worth(s, traits, criteria)), sorted(s), [], []) for s in found]
                out += [(False, [], [], sorted(t), sorted(f), sorted(b)) for t, f, b in left]
                longs = pa.list_(pa.int64())
                kinds = [pa.bool_(), pa.list_(pa.float64()), longs, longs, longs, longs]
                head = [pa.array([row["network_id"]] * len(out), pa.int64()), pa.array([row["part"]] * len(out), pa.int32())]
                if out:
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], [f.split()[0] for f in ROWS.split(", ")])

    return run


def _networks(members: DataFrame, edges: DataFrame, traits: DataFrame | None, criteria: Criteria) -> DataFrame:
    """(network_id, iid, near, traits): relatives and trait values of everybody, null relatives for people without."""
    a = edges.select(F.col("iid1").alias("iid"), F.col("iid2").alias("other"))
    both = a.unionByName(a.select(F.col("other").alias("iid"), F.col("iid").alias("other"))).distinct()
    near = members.join(both.groupBy("iid").agg(F.collect_list("other").alias("near")), "iid", "left")
    named = [c for c, rule in criteria if rule != "size"]
    if traits is not None and named:
        near = near.join(traits.select("iid", *dict.fromkeys(named)), "iid", "left")
    held = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if rule != "size" and traits is not None else F.lit(0.0) for c, rule in criteria]
    return near.select("network_id", "iid", "near", F.array(*held).alias("traits"))


def unrelated_sets(members: DataFrame, edges: DataFrame, traits: DataFrame | None = None, criteria: Criteria = SIZE_THEN_AFFECTED, turn: int = TURN) -> DataFrame:
    """(network_id, iid, status): the worthiest set of unrelated people in every network.

    ``criteria`` name columns of ``traits(iid, ...)`` and what is wanted of
    them, most important first; a null counts as 0, ties go to smaller ids.
    Where each person adds to a set's worth the set is found by branching, else
    all maximal sets are compared.  The status is ``single``, ``exact``, or
    ``broken`` where people were set aside because of the network's size, as
    published.  Nothing else ends a search: rounds go on until all rows are
    done.
    """
    return _solved(checkpointed(_networks(members, edges, traits, criteria)), criteria, turn)


def _solved(people: DataFrame, criteria: Criteria, turn: int = TURN) -> DataFrame:
    """:func:`unrelated_sets` of people as from :func:`_networks`."""
    spark = people.sparkSession
    single = people.where("near is null").select("network_id", "iid", F.lit("single").alias("status"))
    whole = people.where("near is not null").groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("iid", "near", "traits"))).alias("p"))
    whole = whole.select("network_id", F.col("p.iid").alias("iids"), F.col("p.near").alias("near"), F.col("p.traits").alias("traits"))
    # Few bytes and long searches: a stated number of partitions keeps Spark from joining them into few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    graphs = checkpointed(whole.mapInArrow(_broken_up(criteria), PROBLEMS))
    longs = [F.lit(None).cast("array<long>").alias(c) for c in ("taken", "free", "barred")]
    rows, done = graphs.select("network_id", "part", "graph", *longs), []
    while True:
        out = checkpointed(rows.repartition(parts).mapInArrow(_searched(criteria, turn), ROWS))
        done.append(out.where("done").groupBy("network_id", "part").agg(F.max_by("taken", F.struct("worth", "ties")).alias("taken"), F.max(F.struct("worth", "ties")).alias("worth")))
        left = out.where("not done")
        if left.isEmpty():
            break
        rows = left.join(graphs.select("network_id", "part", "graph"), ["network_id", "part"]).select("network_id", "part", "graph", "taken", "free", "barred")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    best = found.groupBy("network_id", "part").agg(F.max_by("taken", "worth").alias("taken"))
    solved = best.join(graphs.select("network_id", "part", "status"), ["network_id", "part"]).select("network_id", F.explode("taken").alias("iid"), "status")
    return single.unionByName(solved)


def _simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two simple ways' sets of each network."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            near = {v: set(n) for v, n in zip(row["iids"], row["near"])}
            first = {v: t[0] for v, t in zip(row["iids"], row["traits"])}
            out += [(row["network_id"], v, method) for method, found in (("pruned", pruned_set(near, first)), ("greedy", greedy_set(near))) for v in sorted(found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 3, (pa.int64(), pa.int64(), pa.string()))], ["network_id", "iid", "method"])


def method_sets(members: DataFrame, edges: DataFrame, traits: DataFrame | None = None, criteria: Criteria = SIZE_THEN_AFFECTED) -> DataFrame:
    """(method, network_id, iid, chosen): each way's set over all networks, and which way's is the best by the criteria.

    Ways: ``pruned`` drops one of each related pair, ``greedy`` takes who has
    fewest relatives left, ``searched`` is :func:`unrelated_sets`; on ties the
    first of these is chosen.
    """
    people = checkpointed(_networks(members, edges, traits, criteria))
    whole = people.where("near is not null").groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("iid", "near", "traits"))).alias("p"))
    whole = whole.select("network_id", F.col("p.iid").alias("iids"), F.col("p.near").alias("near"), F.col("p.traits").alias("traits"))
    alone = people.where("near is null").select("network_id", "iid", F.explode(F.array(F.lit("pruned"), F.lit("greedy"))).alias("method"))
    searched = _solved(people, criteria).select("network_id", "iid", F.lit("searched").alias("method"))
    sets = checkpointed(whole.mapInArrow(_simple, "network_id long, iid long, method string").unionByName(alone.select("network_id", "iid", "method")).unionByName(searched))
    at = sets.join(people.select("iid", "traits"), "iid")
    totals = []
    for k, (_, rule) in enumerate(criteria):
        total = F.count("*").cast("double") if rule == "size" else (F.avg if rule.endswith("average") else F.sum)(F.col("traits")[k])
        totals.append(F.round(-total if rule.startswith("low") else total, 9))
    order = F.when(F.col("method") == "pruned", 0).when(F.col("method") == "greedy", -1).otherwise(-2)
    worths = at.groupBy("method").agg(F.array(*totals).alias("worth")).withColumn("place", order)
    best = worths.agg(F.max_by("method", F.struct("worth", "place")).alias("best"))
    return sets.join(F.broadcast(best)).select("method", "network_id", "iid", (F.col("method") == F.col("best")).alias("chosen"))
