"""Pedigrees consistent with a network's relationship classes.

A state is a partial pedigree of one network.  Related pairs are settled
nearest first, each in every way its possible classes allow; what contradicts
any pair, related or not, goes at once, and states alike up to the names of
placeholders are kept once.  States are rows: each round deals them out to
tasks, which take them some way further, and the rest is dealt out again.
Networks that allow the same but for names are searched once.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.pedigree_state import DEGREE, FAR, State
from kinloom.operators.recovery import checkpointed
from kinloom.operators.relationships import CLASSES, networks, twin_nodes

#: Fixed value: most open states of a network.
MAX_STATES = 100_000
#: Open states that a task goes on with, states it settles, and states in one row, before it hands over what is left.
WIDTH, TURN, CHUNK = 256, 4000, 32

ROUND = "network_id long, cutoff double, step int, done boolean, state string"
NAMED = "network_id long, cutoff double, lnl double, state string"


def cutoffs(first: float = 0.3) -> list[float]:
    """The likelihoods from which a class is possible, one try after another."""
    out = [first]
    while out[-1] > 0.01:
        out.append(out[-1] / 3 if out[-1] <= 0.1 else round(out[-1] - 0.1, 10))
    return out


def possible_classes(likelihoods: list[float], cutoff: float) -> tuple[str, ...]:
    """Classes above the cutoff, else the likeliest; where nothing is known, all."""
    v = dict(zip(CLASSES, likelihoods))
    if v["PC"] > cutoff and v["HAG"] > cutoff:
        v["PC"], v["HAG"] = v["PC"] + v["HAG"], 0.0
    top = max(v.values())
    if not top:
        return CLASSES
    return tuple(c for c in CLASSES if v[c] > cutoff) or tuple(c for c in CLASSES if v[c] == top)


class Family:
    """What the data say about one network."""

    def __init__(self, people: list[str], allowed: dict, sex: dict, ages: dict, mito: list = (), y: list = (), generations: int | None = None):
        self.people = sorted(people)
        self.allowed = {tuple(sorted(k)): frozenset(v) for k, v in allowed.items()}
        self.sex, self.ages, self.mito, self.y, self.most = sex, ages, mito, y, generations
        nearest = lambda k: min((DEGREE[c], c == "FS") for c in self.allowed[k])
        self.order = sorted((k for k, v in self.allowed.items() if not v <= FAR), key=lambda k: (nearest(k), len(self.allowed[k]), k))

    def start(self) -> State:
        return State({}, {p: self.sex.get(p, 0) for p in self.people})

    def agrees(self, state: State, final: bool = False) -> bool:
        """No pair is nearer than the data allow, and in the end none is farther.

        People only get nearer in later steps, so a pair that is too near now
        stays so.  A pair that the data do not name is unrelated or distant.
        """
        said = state.relations(self.people)
        for pair, rel in said.items():
            allowed = self.allowed.get(pair, FAR)
            if rel in allowed or rel in FAR and allowed & FAR:
                continue
            if final or min(DEGREE[c] for c in allowed) >= DEGREE[rel]:
                return False
        return not final or all(pair in said or allowed & FAR for pair, allowed in self.allowed.items())

    def lines_agree(self, state: State) -> bool:
        """No two people whose sequences differ are on one maternal or paternal line."""
        for pairs, sex in ((self.mito, 2), (self.y, 1)):
            for a, b in pairs:
                if (sex == 2 or state.sex[a] == state.sex[b] == 1) and state.line(a, sex) == state.line(b, sex):
                    return False
        return True

    def settled(self, state: State, step: int) -> Iterator[State]:
        """The states in which one more pair is as one of its classes says."""
        a, b = self.order[step]
        now = state.relations([a, b]).get((a, b), "UN")
        seen = set()
        for rel in self.allowed[a, b]:
            if rel in FAR or rel == now:
                ways: Iterator[State] = iter([state]) if rel == now or now in FAR else iter(())
            elif DEGREE[now] <= DEGREE[rel]:
                continue
            else:
                ways = (s for s in state.related(a, b, rel) if s.relations([a, b]).get((a, b)) == rel)
            for s in ways:
                s = s.copy()
                if not s.possible(self.ages) or not self.agrees(s) or not self.lines_agree(s):
                    continue
                s = s.pruned()
                if self.most and s.generations() > self.most:
                    continue
                s = s.canonical()
                if (text := s.text()) not in seen:
                    seen.add(text)
                    yield s


def advance(family: Family, states: list[tuple[int, str]], width: int = WIDTH, turn: int = TURN) -> tuple[list[tuple[int, str]], list[str]]:
    """(open, finished) after settling pairs of these states, the least settled first, until too many are open."""
    waiting: dict[int, dict[str, None]] = {}
    for step, text in states:
        waiting.setdefault(step, {})[text] = None
    settled = 0
    while waiting:
        step = min(waiting)
        if step == len(family.order):
            break
        if sum(map(len, waiting.values())) > width or settled > turn:
            break
        for text in waiting.pop(step):
            settled += 1
            for s in family.settled(State.read(text), step):
                waiting.setdefault(step + 1, {})[s.text()] = None
    finished = [t for t in waiting.pop(len(family.order), ()) if family.agrees(State.read(t), True)]
    return [(step, t) for step, texts in waiting.items() for t in texts], finished


def search(pairs: list[tuple], sex: dict, ages: dict, people: list[str] = (), max_states: int = MAX_STATES, **lines) -> tuple[list[State], str]:
    """All pedigrees of one network in this process; pairs are (a, b, possible classes)."""
    people = sorted({*people, *(x for a, b, *_ in pairs for x in (a, b))})
    family = Family(people, {(a, b): possible for a, b, possible, *_ in pairs}, sex, ages, **lines)
    waiting, finished = [(0, family.start().canonical().text())], []
    while waiting:
        waiting, more = advance(family, waiting, width=max_states, turn=1 << 60)
        finished += more
        if len(waiting) > max_states:
            return [], "too_many_states"
    found = [State.read(t) for t in dict.fromkeys(finished)]
    return found, "ok" if found else "no_pedigree"


def _places(facts: dict) -> dict[str, str]:
    """The place of each person among the network's sorted names, as a name that sorts alike."""
    names = sorted(p["iid"] for p in facts["people"])
    return {n: str(k).zfill(len(str(len(names)))) for k, n in enumerate(names)}


def _family(facts: dict, cutoff: float, generations: int | None = None) -> Family:
    """The network with places for names, and ranks for ages, of which only the order counts."""
    at = _places(facts)
    ages = {at[p["iid"]]: p["age"] for p in facts["people"] if p.get("age") is not None}
    rank = {v: k for k, v in enumerate(sorted(set(ages.values())))}
    allowed = {(at[p["a"]], at[p["b"]]): possible_classes(p["v"], cutoff) for p in facts["pairs"]}
    lines = {k: sorted((at[p["a"]], at[p["b"]]) for p in facts.get(k) or ()) for k in ("mito", "y")}
    return Family(list(at.values()), allowed, {at[p["iid"]]: p.get("sex") or 0 for p in facts["people"]}, {n: rank[v] for n, v in ages.items()}, generations=generations, **lines)


def _form(facts: dict, cutoff: float) -> str:
    """A digest of all that a network's search depends on: equal for networks that differ in names, or in likelihoods and ages that allow the same."""
    f = _family(facts, cutoff)
    said = [f.people, sorted(f.sex.items()), sorted(f.ages.items()), sorted((*k, *sorted(v)) for k, v in f.allowed.items()), f.mito, f.y]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(network, form) of rows (network, facts, cutoff)."""
    for batch in batches:
        rows = [(r["network_id"], _form(json.loads(r["facts"]), r["cutoff"])) for r in batch.to_pylist()]
        yield _batch(rows, [pa.int64(), pa.string()], ["network_id", "form"])


def _turn(generations: int | None):
    """Rows (network, facts, cutoff, states of one chunk) to the states they lead to, people being called by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["network_id"], row["cutoff"])
                if last[0] != key:
                    last = (key, _family(json.loads(row["facts"]), row["cutoff"], generations))
                family = last[1]
                states = [(s["step"], s["state"]) for s in row["states"]] if row["states"] else [(0, family.start().canonical().text())]
                waiting, finished = advance(family, states)
                out = [(*key, step, False, t) for step, t in waiting] + [(*key, 0, True, t) for t in finished]
                if out:
                    yield _batch(out, [pa.int64(), pa.float64(), pa.int32(), pa.bool_(), pa.string()], ["network_id", "cutoff", "step", "done", "state"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (network, facts, cutoff, lead, chunk, states by places) to states by the network's names, with their likelihood."""
    last: tuple = (None, [])
    for batch in batches:
        for row in batch.to_pylist():
            facts, key = json.loads(row["facts"]), (row["lead"], row["chunk"])
            at = _places(facts)
            if last[0] != key:
                states = [State.read(t) for t in row["states"]]
                last = (key, [(s, s.relations(sorted(at.values()))) for s in states])
            names = {p: n for n, p in at.items()}
            pairs = [(tuple(sorted((at[p["a"]], at[p["b"]]))), dict(zip(CLASSES, p["v"]))) for p in facts["pairs"]]
            out = []
            for s, said in last[1]:
                total = 0.0
                for pair, v in pairs:
                    rel = said.get(pair, "UN")
                    total += math.log(max(v[rel], v["DR"], v["UN"], 1e-4) if rel in FAR else max(v[rel], 1e-4))
                own = State({names.get(c, c): tuple(sorted(names.get(p, p) for p in both)) for c, both in s.parents.items()}, {names.get(n, n): x for n, x in s.sex.items()})
                out.append((row["network_id"], row["cutoff"], round(total, 6), own.text()))
            yield _batch(out, [pa.int64(), pa.float64(), pa.float64(), pa.string()], ["network_id", "cutoff", "lnl", "state"])


def _facts(classified: DataFrame, people: DataFrame, mito: DataFrame | None, y: DataFrame | None, threshold: float) -> DataFrame:
    """(network_id, facts): people, pairs and refuted lines of each network of two or more, twins being one person."""
    names = [c.lower() for c in CLASSES]
    # Read twice, and dear to work out.
    classified = checkpointed(classified.select("iid1", "iid2", "pi_hat", "mz", *names))
    twins = twin_nodes(classified)

    def node(df: DataFrame, col: str) -> DataFrame:
        name = twins.select(F.col("iid").alias(col), F.col("node").alias(f"_{col}"))
        return df.join(name, col, "left").withColumn(col, F.coalesce(f"_{col}", F.col(col).cast("string"))).drop(f"_{col}")

    def pairs_of(df: DataFrame) -> DataFrame:
        df = node(node(df, "iid1"), "iid2").where("iid1 <> iid2")
        return df.withColumns({"a": F.least("iid1", "iid2"), "b": F.greatest("iid1", "iid2")})

    # Several rows of one pair, as of twins, are averaged.
    pairs = pairs_of(classified.select("iid1", "iid2", "pi_hat", *names)).groupBy("a", "b").agg(F.avg("pi_hat").alias("pi_hat"), *[F.avg(c).alias(c) for c in names])
    pairs = checkpointed(pairs)
    edges = pairs.where((F.col("pi_hat") > threshold) & (F.col("un") < F.greatest(*names[:-1]))).select(F.col("a").alias("iid1"), F.col("b").alias("iid2"))
    # A network is called by its smallest member, of twins by the smallest of them.
    parts = networks(edges.select(F.explode(F.array("iid1", "iid2")).alias("iid")).distinct(), edges).withColumnRenamed("network_id", "part")
    ids = parts.groupBy("part").agg(F.min(F.split("iid", ":")[0].cast("long")).alias("network_id"))
    members = checkpointed(parts.join(ids, "part").select("network_id", "iid"))

    def inside(df: DataFrame, *fields: Column) -> DataFrame:
        one, two = (members.select(F.col("network_id").alias(f"n{c}"), F.col("iid").alias(c)) for c in ("a", "b"))
        held = df.join(one, "a").join(two, "b").where("na = nb")
        return held.groupBy(F.col("na").alias("network_id")).agg(F.sort_array(F.collect_set(F.struct("a", "b", *fields))).alias("pairs"))

    about = node(people.select("iid", "sex", F.col("age").cast("double").alias("age")), "iid").groupBy("iid").agg(F.max("sex").alias("sex"), F.max("age").alias("age"))
    who = members.join(about, "iid", "left").groupBy("network_id").agg(F.sort_array(F.collect_set(F.struct("iid", "sex", "age"))).alias("people"))
    out = who.join(inside(pairs, F.array(*[F.round(c, 6) for c in names]).alias("v")), "network_id")
    for name, match in (("mito", mito), ("y", y)):
        if match is not None:
            refuted = pairs_of(match.where("match = 0").select("iid1", "iid2")).select("a", "b")
            out = out.join(inside(refuted).withColumnRenamed("pairs", name), "network_id", "left")
    fields = [c for c in ("people", "pairs", "mito", "y") if c in out.columns]
    return checkpointed(out.select("network_id", F.to_json(F.struct(*fields)).alias("facts")))


def found_states(facts: DataFrame, first: float = 0.3, retry: bool = True, max_states: int = MAX_STATES, generations: int | None = None) -> DataFrame:
    """(network_id, cutoff, status, lnl, state) of every pedigree; one row without a state where there is none.

    A network goes on alone with a lower cutoff when it fits no pedigree, and
    stops with a status when more than ``max_states`` are open.  Nothing else
    ends a search.  Of networks of one form (:func:`_form`) the smallest is
    searched, and all take its pedigrees by their own names, with their own
    likelihoods.  The driver sees counts only.
    """
    spark, turn = facts.sparkSession, _turn(generations)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, results = facts.select("network_id"), []
    tries = cutoffs(first)[: None if retry else 1]
    chunk_type = "array<struct<step:int,state:string>>"
    for cutoff in tries:
        formed = checkpointed(left.join(facts, "network_id").select("network_id", "facts", F.lit(cutoff).alias("cutoff")).repartition(parts).mapInArrow(_forms, "network_id long, form string"))
        alike = checkpointed(formed.join(formed.groupBy("form").agg(F.min("network_id").alias("lead")), "form").select("network_id", "lead"))
        rows = alike.where("network_id = lead").select("network_id", F.lit(cutoff).alias("cutoff"), F.lit(None).cast(chunk_type).alias("states"))
        here, stopped = [], []
        while True:
            dealt = rows.join(facts, "network_id").select("network_id", "cutoff", "facts", "states").repartition(parts)
            out = checkpointed(dealt.mapInArrow(turn, ROUND).distinct())
            here.append(out.where("done").select(F.col("network_id").alias("lead"), "state"))
            waiting = out.where("not done")
            many = checkpointed(waiting.groupBy("network_id").agg(F.count("*").alias("open")))
            if many.isEmpty():
                break
            stopped.append(many.where(F.col("open") > max_states).select("network_id"))
            held = waiting.join(many.where(F.col("open") <= max_states), "network_id")
            # Chunks of about CHUNK states, so that a network with many is dealt to many tasks.
            deal = F.pmod(F.xxhash64("state"), F.greatest(F.lit(1), F.expr(f"open div {CHUNK}")))
            rows = checkpointed(held.groupBy("network_id", "cutoff", deal.alias("chunk")).agg(F.collect_list(F.struct("step", "state")).alias("states")))
        done = here[0]
        for more in here[1:]:
            done = done.unionByName(more)
        done = done.distinct()
        over = facts.select("network_id").where("false")
        for more in stopped:
            over = over.unionByName(more)
        over = over.distinct().withColumnRenamed("network_id", "lead")
        done = checkpointed(done.join(over, "lead", "left_anti"))
        sizes = done.groupBy("lead").agg(F.count("*").alias("n"))
        deal = F.pmod(F.xxhash64("state"), F.greatest(F.lit(1), F.expr(f"n div {CHUNK}")))
        chunks = done.join(sizes, "lead").groupBy("lead", deal.alias("chunk")).agg(F.collect_list("state").alias("states"))
        dealt = alike.join(chunks, "lead").join(facts, "network_id").select("network_id", "facts", F.lit(cutoff).alias("cutoff"), "lead", "chunk", "states")
        # Rows of one form follow each other, as what their states say is worked out once.
        named = checkpointed(dealt.repartition(parts, "network_id").sortWithinPartitions("lead", "chunk").mapInArrow(_named, NAMED))
        results.append(named.select("network_id", "cutoff", F.lit("ok").alias("status"), "lnl", "state"))
        nothing = [F.lit(None).cast("double").alias("lnl"), F.lit(None).cast("string").alias("state")]
        results.append(checkpointed(alike.join(over, "lead").select("network_id", F.lit(cutoff).alias("cutoff"), F.lit("too_many_states").alias("status"), *nothing)))
        left = checkpointed(alike.join(done.select("lead").distinct(), "lead", "left_anti").join(over, "lead", "left_anti").select("network_id"))
        if cutoff == tries[-1]:
            results.append(left.select("network_id", F.lit(cutoff).alias("cutoff"), F.lit("no_pedigree").alias("status"), *nothing))
        elif left.isEmpty():
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each person of each pedigree."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            head, tail = (r["network_id"], r["pedigree"]), (r["lnl"], r["status"], r["cutoff"])
            if r["state"] is None:
                out.append((*head, None, None, None, None, *tail))
                continue
            state = State.read(r["state"])
            for n in sorted(state.sex):
                both = state.parents.get(n, ())
                by_sex = {state.sex[p]: p for p in both}
                father, mother = (by_sex.get(1), by_sex.get(2)) if len(both) < 2 or set(by_sex) == {1, 2} else both
                out.append((*head, n, father, mother, state.sex[n], *tail))
        yield _batch(out, [pa.int64(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.float64(), pa.string(), pa.float64()], OUT_NAMES)


OUT = "network_id long, pedigree int, iid string, pid string, mid string, sex int, lnl double, status string, cutoff double"
OUT_NAMES = [f.split()[0] for f in OUT.split(", ")]


def reconstruct(
    classified: DataFrame,
    people: DataFrame,
    mito: DataFrame | None = None,
    y: DataFrame | None = None,
    threshold: float = 0.09375,
    cutoff: float = 0.3,
    retry: bool = True,
    max_states: int = MAX_STATES,
    max_generations: int | None = None,
) -> DataFrame:
    """Every pedigree of every network, person by person.

    ``classified`` as from :func:`relationships.classify`, with all pairs of
    people, unrelated ones too; a pair that it lacks counts as unrelated.
    ``people(iid, sex, age)``; ``mito`` and ``y`` as from
    :func:`genotypes.haploid_match`, whose mismatches refute.  Twins are one
    person ``a:b``.  People without data are ``?1``, ``?2`` ...

    Columns: network_id (the smallest member), pedigree (1, 2 ... by
    likelihood), iid, pid, mid, sex, lnl, status, cutoff (the one that the
    network ended at).  Status: ``ok``, ``no_pedigree`` at any cutoff, or
    ``too_many_states``, with one row and no person.
    """
    found = found_states(_facts(classified, people, mito, y, threshold), cutoff, retry, max_states, max_generations)
    order = Window.partitionBy("network_id").orderBy(F.desc("lnl"), "state")
    ranked = found.withColumn("pedigree", F.when(F.col("state").isNull(), 0).otherwise(F.row_number().over(order)))
    return ranked.select("network_id", "pedigree", "lnl", "status", "cutoff", "state").mapInArrow(_rows, OUT)


def recovered(pedigrees: DataFrame, truth: DataFrame) -> DataFrame:
    """(network_id, found): whether one of a network's pedigrees gives all its people their true parents among those with data.

    ``truth(iid, pid, mid)`` names the people with data; parents that it does not hold count as unknown.
    """
    known = truth.select(F.col("iid").cast("string").alias("iid"))

    def shown(df: DataFrame) -> DataFrame:
        for c in ("pid", "mid"):
            df = df.withColumn(c, F.col(c).cast("string")).join(known.withColumnRenamed("iid", c).withColumn(f"_{c}", F.lit(True)), c, "left")
        both = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.col(c)) for c in ("pid", "mid")])))
        return df.withColumn("known", both)

    said = shown(pedigrees.join(known, "iid")).select("network_id", "pedigree", "iid", "known")
    true = shown(truth.withColumn("iid", F.col("iid").cast("string"))).select("iid", F.col("known").alias("true"))
    agree = said.join(true, "iid").groupBy("network_id", "pedigree").agg(F.min(F.col("known") == F.col("true")).alias("ok"))
    return pedigrees.select("network_id").distinct().join(agree.groupBy("network_id").agg(F.max("ok").alias("found")), "network_id", "left").select("network_id", F.coalesce("found", F.lit(False)).alias("found"))
