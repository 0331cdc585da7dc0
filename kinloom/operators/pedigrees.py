"""Relations, generations and plausibility of pedigrees (iid, pid, mid, sex, age; 0 = unknown parent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kinloom.operators.recovery import checkpointed

#: Years of a generation and largest gaps.
GENERATION_LOW, GENERATION_HIGH, SIBLING_GAP, AVUNCULAR_LOW, AVUNCULAR_HIGH, COUSIN_GAP = 13, 50, 25, -10, 50, 30


#: People of a task.
PEOPLE = 10_000


def tasks_for(fam: DataFrame) -> int:
    """Tasks for all pairs of relatives, as many as keep those of one task few."""
    return max(int(fam.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fam.count() // PEOPLE))


def parents(fam: DataFrame) -> DataFrame:
    """(parent, child), known parents only."""
    return fam.select(F.explode(F.array("pid", "mid")).alias("parent"), F.col("iid").alias("child")).where("parent <> 0").distinct()


def siblings(fam: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Full and half siblings as ordered pairs (a, b)."""
    p = parents(fam).repartition(tasks or tasks_for(fam), "parent")
    met = p.select("parent", F.col("child").alias("a")).join(p.select("parent", F.col("child").alias("b")), "parent").where("a <> b").repartition(tasks or tasks_for(fam), "b").groupBy("a", "b").agg(F.count("*").alias("k"))
    return met.where("k = 2").select("a", "b"), met.where("k = 1").select("a", "b")


def relations(fam: DataFrame) -> DataFrame:
    """(self, rel, code): what ``rel`` is to ``self``, the closest relation of each ordered pair.

    P parent, O offspring, F full sib, N child of full sib, H half sib, G grandparent,
    A full sib of parent, C grandchild, GC great-grandchild, HN child of half sib,
    HA half sib of parent, GG great-grandparent, 1C first cousin, GA full sib of
    grandparent, GN grandchild of full sib.  Every step lies by its last person,
    by whom the next one is joined, in tasks whose number grows with the people.
    """
    p, tasks = parents(fam), tasks_for(fam)
    up = p.select(F.col("child").alias("a"), F.col("parent").alias("b")).repartition(tasks, "b")
    down = p.select(F.col("parent").alias("a"), F.col("child").alias("b")).repartition(tasks, "b")
    full, half = (d.repartition(tasks, "b") for d in siblings(fam, tasks))

    def then(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("a").alias("b"), F.col("b").alias("c")).repartition(tasks, "b")
        return x.join(y, "b").select("a", F.col("c").alias("b")).where("a <> b").repartition(tasks, "b").distinct()

    grand, grandchild = then(up, up), then(down, down)
    # Parents lie otherwise than the rest, so that a task makes one kind, not a part of all of them at once.
    apart = p.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    kinds = [("P", apart), ("O", down), ("F", full), ("N", then(full, down)), ("H", half), ("G", grand), ("A", then(up, full)), ("C", grandchild), ("GC", then(grandchild, down)), ("HN", then(half, down)), ("HA", then(up, half)), ("GG", then(grand, up)), ("1C", then(then(up, full), down)), ("GA", then(grand, full)), ("GN", then(then(full, down), down))]
    every = reduce(DataFrame.unionByName, [d.select("a", "b", F.lit(code).alias("code"), F.lit(i).alias("place")) for i, (code, d) in enumerate(kinds)])
    return every.repartition(tasks, "b").groupBy("a", "b").agg(F.min_by("code", "place").alias("code")).select(F.col("a").alias("self"), F.col("b").alias("rel"), "code")


#: Degrees of the relations.
DEGREES = {1: ("P", "O", "F"), 2: ("N", "H", "G", "A", "C"), 3: ("GC", "HN", "HA", "GG", "1C", "GA", "GN")}


def pedigree_degrees(rel: DataFrame, tasks: int | None = None) -> DataFrame:
    """(iid1, iid2, degree) of every related pair of a pedigree, the nearest of both directions (G12); ``tasks`` as from :func:`tasks_for`."""
    degree = F.coalesce(*[F.when(F.col("code").isin(*codes), d) for d, codes in DEGREES.items()])
    pairs = rel.select(F.least("self", "rel").alias("iid1"), F.greatest("self", "rel").alias("iid2"), degree.alias("degree"))
    return (pairs.repartition(tasks, "iid1") if tasks else pairs).groupBy("iid1", "iid2").agg(F.min("degree").alias("degree"))


def relation_table(rel: DataFrame) -> DataFrame:
    """One row per unordered pair with the sorted relations of both directions."""
    one = rel.where("self < rel").select(F.col("self").alias("iid1"), F.col("rel").alias("iid2"), F.col("code").alias("to2"))
    two = rel.where("self > rel").select(F.col("rel").alias("iid1"), F.col("self").alias("iid2"), F.col("code").alias("to1"))
    j = one.join(two, ["iid1", "iid2"], "full").groupBy("iid1", "iid2")
    return j.agg(F.array_join(F.array_sort(F.collect_set("to2")), ",").alias("rels12"), F.array_join(F.array_sort(F.collect_set("to1")), ",").alias("rels21"))


def ancestors(fam: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(iid, ancestor, depth) closed over parents, least depth (G11, G14); ``of(iid)`` are the people asked for, all by default.

    Rounds go on until one finds no new pair, which also ends cycles.
    """
    p = parents(fam).select(F.col("child").alias("iid"), F.col("parent").alias("ancestor"))
    edge = p.select(F.col("iid").alias("ancestor"), F.col("ancestor").alias("next"))
    first = p if of is None else p.join(of.select("iid"), "iid", "left_semi")
    step = known = checkpointed(first.withColumn("depth", F.lit(1)))
    depth = 1
    while not step.isEmpty():
        depth += 1
        found = step.join(edge, "ancestor").select("iid", F.col("next").alias("ancestor")).distinct()
        step = checkpointed(found.join(known, ["iid", "ancestor"], "left_anti").select("iid", "ancestor", F.lit(depth).alias("depth")))
        known = known.unionByName(step)
    return known


def relatives(fam: DataFrame) -> DataFrame:
    """(iid, relative): ancestors, and all descendants of these and of oneself."""
    anc = ancestors(fam)
    up = anc.select("iid", "ancestor").unionByName(fam.select("iid", F.col("iid").alias("ancestor")))
    down = anc.select("ancestor", F.col("iid").alias("relative")).unionByName(fam.select(F.col("iid").alias("ancestor"), F.col("iid").alias("relative")))
    every = up.join(down, "ancestor").select("iid", "relative").unionByName(anc.select("iid", F.col("ancestor").alias("relative")))
    return every.where("iid <> relative").distinct()


def founders(fam: DataFrame) -> DataFrame:
    """(iid, founder, leaf): no known parent, no child."""
    has = parents(fam).select(F.col("parent").alias("iid")).distinct().withColumn("c", F.lit(1))
    return fam.join(has, "iid", "left").select("iid", ((F.col("pid") == 0) & (F.col("mid") == 0)).alias("founder"), F.col("c").isNull().alias("leaf"))


def generations(fam: DataFrame) -> DataFrame:
    """(iid, level): longest line of known ancestors; and the span is max - min + 1.

    The level is null where it has none: in a cycle, and below one.
    """
    depth = ancestors_longest(fam).withColumn("child", F.lit(True))
    return fam.join(depth, "iid", "left").select("iid", F.when(F.col("child"), F.col("level")).otherwise(0).alias("level"))


def ancestors_longest(fam: DataFrame) -> DataFrame:
    """(iid, level) of everyone with a known parent, null in and below cycles.

    Round k lets go of people whose parents have all gone; it is their level.
    """
    left = checkpointed(parents(fam).select(F.col("child").alias("iid"), F.col("parent").alias("at")))
    many, levels = left.count(), []
    none = left.select("iid", F.lit(None).cast("int").alias("level")).limit(0)
    while many:
        stay = checkpointed(left.join(left.select(F.col("iid").alias("at")).distinct(), "at", "left_semi").select("iid", "at"))
        now = stay.count()
        if now == many:  # no one went: what is left is in or below a cycle
            levels.append(left.select("iid", F.lit(None).cast("int").alias("level")).distinct())
            break
        levels.append(left.join(stay, "iid", "left_anti").select("iid", F.lit(len(levels) + 1).alias("level")).distinct())
        left, many = stay, now
    return reduce(DataFrame.unionByName, levels, none)


def age_flags(rel: DataFrame, fam: DataFrame) -> DataFrame:
    """Relations that ages make implausible, the last rule that applies."""
    a = fam.select(F.col("iid").alias("self"), F.col("age").alias("age1"))
    b = fam.select(F.col("iid").alias("rel"), F.col("age").alias("age2"))
    j = rel.join(a, "self").join(b, "rel").where("age1 is not null and age2 is not null")
    gap, code = F.col("age2") - F.col("age1"), F.col("code")
    flag = F.lit(None).cast("string")
    for times, older, younger, who in ((1, "P", "O", "parent"), (2, "G", "C", "grandparent"), (3, "GG", "GC", "great-grandparent")):
        ahead = F.when(code == older, gap).when(code == younger, -gap)
        flag = F.when(ahead < GENERATION_LOW * times, f"{who} too young").when(ahead > GENERATION_HIGH * times, f"{who} too old").otherwise(flag)
    ahead = F.when(code.isin("A", "HA"), gap).when(code.isin("N", "HN"), -gap)
    flag = F.when(ahead < AVUNCULAR_LOW, "avuncular too young").when(ahead > AVUNCULAR_HIGH, "avuncular too old").otherwise(flag)
    flag = F.when((code.isin("F", "H") & (F.abs(gap) > SIBLING_GAP)), "siblings too far apart").when((code == "1C") & (F.abs(gap) > COUSIN_GAP), "cousins too far apart").otherwise(flag)
    great = F.when(code == "GA", gap).when(code == "GN", -gap)
    flag = F.when(great < 2 * AVUNCULAR_LOW, "great-avuncular too young").when(great > 2 * AVUNCULAR_HIGH, "great-avuncular too old").otherwise(flag)
    return j.withColumn("reason", flag).where("reason is not null").select("self", "rel", "code", "reason")


def sex_conflicts(fam: DataFrame) -> DataFrame:
    """People named as a father who are not male, or as a mother who are not female."""
    named = fam.select(F.explode(F.array(F.struct(F.col("pid").alias("iid"), F.lit(1).alias("need")), F.struct(F.col("mid").alias("iid"), F.lit(2).alias("need")))).alias("x")).select("x.*").where("iid <> 0").distinct()
    return named.join(fam.select("iid", "sex"), "iid").where("sex <> 0 and sex <> need").select("iid", "sex", "need")


def pedigree_scores(rel: DataFrame, dens: DataFrame, fam: DataFrame, floor: float = 1e-4) -> DataFrame:
    """For each pedigree (``fid``), the sum over its compared pairs of the ln density of
    the class that the pedigree puts them in (A10).  ``dens`` as from :func:`relationships.densities`."""
    group = {"PC": ("P", "O"), "FS": ("F",), "HAG": ("N", "H", "G", "A", "C"), "CGH": ("GC", "HN", "HA", "GG", "1C", "GA", "GN")}
    named = rel.where("self < rel").select(F.col("self").alias("iid1"), F.col("rel").alias("iid2"), "code")
    home = fam.select("iid", "fid")
    j = dens.join(home.select(F.col("iid").alias("iid1"), "fid"), "iid1").join(home.select(F.col("iid").alias("iid2"), F.col("fid").alias("other")), "iid2").where("fid = other")
    j = j.join(named, ["iid1", "iid2"], "left")
    value = F.col("un")
    for c, codes in group.items():
        value = F.when(F.col("code").isin(*codes), F.col(c.lower())).otherwise(value)
    return j.groupBy("fid").agg(F.count("*").alias("n_pairs"), F.count("code").alias("n_related"), F.round(F.sum(F.ln(F.greatest(value, F.lit(floor)))), 4).alias("lnl"))


def rank_pedigrees(scores: DataFrame, key: list[str]) -> DataFrame:
    """Competition rank: fewest flags, highest lnL, fewest generations, fewest placeholders."""
    w = Window.partitionBy(*key).orderBy("flags", F.desc("lnl"), "generations", "dummies")
    return scores.withColumn("rank", F.rank().over(w))


def score_summary(scores: DataFrame, key: list[str]) -> DataFrame:
    """Least, largest, mean and median score, how many share the top, how many carry no flag."""
    top = F.max("lnl").over(Window.partitionBy(*key))
    return scores.withColumn("top", top).groupBy(*key).agg(F.min("lnl").alias("low"), F.max("lnl").alias("high"), F.round(F.avg("lnl"), 6).alias("mean"), F.round(F.percentile("lnl", 0.5), 6).alias("median"),
                                                          F.sum((F.col("lnl") == F.col("top")).cast("int")).alias("n_at_max"), F.sum((F.col("flags") == 0).cast("int")).alias("n_unflagged"))


def unnecessary_placeholders(fam: DataFrame, missing: DataFrame) -> DataFrame:
    """Couples of missing founders with one child."""
    m = missing.select("iid")
    free = fam.join(m, "iid", "left_semi").where("pid = 0 and mid = 0").select("iid")
    couples = fam.where("pid <> 0 and mid <> 0").groupBy("pid", "mid").agg(F.count("*").alias("children"), F.min("iid").alias("child")).where("children = 1")
    return couples.join(free.select(F.col("iid").alias("pid")), "pid", "left_semi").join(free.select(F.col("iid").alias("mid")), "mid", "left_semi").select("pid", "mid", "child")
