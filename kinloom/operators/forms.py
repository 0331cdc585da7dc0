"""Pedigrees as graphs: haploid lines, form up to the names of placeholders, and the expected pedigree.

Pedigrees are tables (fid, iid, pid, mid, sex); ids belong to one pedigree, 0 is an unknown parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinloom.operators.components import connected_components
from kinloom.operators.pedigrees import age_flags, parents, relations
from kinloom.operators.recovery import checkpointed, fresh_folder


def subpedigrees(fam: DataFrame) -> DataFrame:
    """(subpedigree, iid): people joined by any chain of parents and children, called by the smallest."""
    parts = connected_components(parents(fam), "parent", "child").select(F.col("id").alias("iid"), "component")
    return fam.select("iid").distinct().join(parts, "iid", "left").select(F.coalesce("component", "iid").alias("subpedigree"), "iid")


def haploid_lines(fam: DataFrame, parent: str = "mid") -> DataFrame:
    """(iid, line): the topmost known ancestor by mothers only (``mid``) or fathers only (``pid``).

    Each round jumps twice as far, so rounds grow with the logarithm of the
    longest line; who is in or below a cycle has a null line.
    """
    step = checkpointed(fam.select("iid", F.when(F.col(parent) == 0, F.col("iid")).otherwise(F.col(parent)).alias("line"), (F.col(parent) == 0).alias("done")))
    people, rounds = step.count(), 0
    while (1 << rounds) <= people and not step.where("not done").isEmpty():
        ahead = step.select(F.col("iid").alias("line"), F.col("line").alias("next"), F.col("done").alias("there"))
        found = step.where("not done").join(ahead, "line", "left")
        # an ancestor without a row of its own ends the line
        moved = found.select("iid", F.coalesce("next", "line").alias("line"), F.coalesce("there", F.lit(True)).alias("done"))
        step, rounds = checkpointed(step.where("done").unionByName(moved)), rounds + 1
    return step.select("iid", F.when(F.col("done"), F.col("line")).alias("line"))


def haploid_conflicts(fam: DataFrame, match: DataFrame, parent: str = "mid") -> DataFrame:
    """Pairs that the pedigree puts on one maternal or paternal line though their sequences differ.

    ``match`` as from :func:`genotypes.haploid_match`; only its mismatches (0)
    refute, as matches by chance are common.  Fathers' lines are those of males.
    """
    lines = haploid_lines(fam, parent).where("line is not null")
    if parent == "pid":
        lines = lines.join(fam.where("sex = 1").select("iid"), "iid", "left_semi")
    one, two = (lines.select(F.col("iid").alias(f"iid{i}"), F.col("line").alias(f"line{i}")) for i in (1, 2))
    return match.where("match = 0").join(one, "iid1").join(two, "iid2").where("line1 = line2").select("iid1", "iid2", F.col("line1").alias("line"), "ndiff", "length")


def inferred_sexes(fam: DataFrame) -> DataFrame:
    """(iid, sex): the known one, else that of the part taken as a parent; null where both parts are taken."""
    named = fam.select(F.explode(F.array(F.struct(F.col("pid").alias("iid"), F.lit(1).alias("part")), F.struct(F.col("mid").alias("iid"), F.lit(2).alias("part")))).alias("x")).select("x.*").where("iid <> 0")
    parts = named.groupBy("iid").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    taken = F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), F.col("low"))
    return fam.select("iid", "sex").join(parts, "iid", "left").select("iid", F.when(F.col("sex") != 0, F.col("sex")).otherwise(taken).alias("sex"))


def pruned(fam: DataFrame, missing: DataFrame) -> DataFrame:
    """The pedigree without placeholders that tell nothing: missing leaves, and couples of missing founders with one child.

    Rounds go on until one takes nobody away.
    """
    fam = checkpointed(fam)
    while True:
        children = parents(fam).groupBy(F.col("parent").alias("iid")).agg(F.count("*").alias("n"))
        at = fam.join(missing.select("iid").distinct(), "iid", "left_semi").join(children, "iid", "left").select("iid", "n", ((F.col("pid") == 0) & (F.col("mid") == 0)).alias("founder"))
        free = at.where("founder and n = 1").select("iid")
        couples = fam.where("pid <> 0 and mid <> 0").select("pid", "mid").distinct().join(free.select(F.col("iid").alias("pid")), "pid", "left_semi").join(free.select(F.col("iid").alias("mid")), "mid", "left_semi")
        gone = checkpointed(at.where("n is null").select("iid").union(couples.select(F.explode(F.array("pid", "mid")))).distinct())
        if gone.isEmpty():
            return fam
        rest = fam.join(gone, "iid", "left_anti")
        for c in ("pid", "mid"):
            here = gone.select(F.col("iid").alias(c), F.lit(True).alias("_gone"))
            rest = rest.join(here, c, "left").withColumn(c, F.when(F.col("_gone"), 0).otherwise(F.col(c))).drop("_gone")
        fam = checkpointed(rest.select(*fam.columns))


def pedigree_forms(fam: DataFrame, missing: DataFrame, name: str = "iid") -> DataFrame:
    """(fid, n, form): a digest that pedigrees share if they differ only in the ids of missing people.

    People start with their ``name``, placeholders with their sex, and every
    round adds the marks of father, mother and children, until a round tells no
    more people apart: then people are as different as their surroundings are.
    """
    hidden = missing.select("iid").distinct().withColumn("_hidden", F.lit(True))
    start = F.when(F.col("_hidden"), F.xxhash64(F.lit("missing"), "sex")).otherwise(F.xxhash64(F.lit("named"), name))
    nodes = checkpointed(fam.join(hidden, "iid", "left").select("fid", "iid", "pid", "mid", start.alias("mark")))
    kinds = nodes.select("fid", "mark").distinct().count()
    while True:
        mark = nodes.select("iid", "mark")
        up = nodes.join(mark.select(F.col("iid").alias("pid"), F.col("mark").alias("father")), "pid", "left").join(mark.select(F.col("iid").alias("mid"), F.col("mark").alias("mother")), "mid", "left")
        down = nodes.select(F.explode(F.array("pid", "mid")).alias("iid"), "mark").where("iid <> 0").groupBy("iid").agg(F.sort_array(F.collect_list("mark")).alias("children"))
        told = up.join(down, "iid", "left").select("fid", "iid", "pid", "mid", F.xxhash64("mark", F.coalesce("father", F.lit(0)), F.coalesce("mother", F.lit(0)), F.coalesce("children", F.array().cast("array<bigint>"))).alias("mark"))
        nodes = checkpointed(told)
        now = nodes.select("fid", "mark").distinct().count()
        if now == kinds:
            return nodes.groupBy("fid").agg(F.count("*").alias("n"), F.xxhash64(F.sort_array(F.collect_list("mark"))).alias("form"))
        kinds = now


def form_classes(forms: DataFrame) -> DataFrame:
    """(fid, n, same_as): the smallest pedigree of the same form."""
    least = forms.groupBy("form").agg(F.min("fid").alias("same_as"))
    return forms.join(least, "form").select("fid", "n", "same_as")


def expected_matches(candidates: DataFrame, expected: DataFrame, samples: DataFrame) -> DataFrame:
    """(fid, expected): candidates of the form of an expected pedigree.

    ``samples`` (iid) are those with data, in both tables by the same ``name``
    column; everybody else is a placeholder, pruned before the comparison.
    """
    sides = []
    for table in (candidates, expected):
        missing = table.join(samples.select("name").distinct(), "name", "left_anti").select("iid")
        sides.append((pruned(table.select("fid", "iid", "pid", "mid", "sex", "name"), missing), missing))
    # One table, so that both sides see the same rounds.
    both = [fam.select(F.struct(F.lit(k).alias("side"), F.col("fid").alias("of")).alias("fid"), *[F.when(F.col(c) == 0, 0).otherwise(2 * F.col(c) + k).alias(c) for c in ("iid", "pid", "mid")], "sex", "name") for k, (fam, _) in enumerate(sides)]
    gone = [missing.select((2 * F.col("iid") + k).alias("iid")) for k, (_, missing) in enumerate(sides)]
    forms = pedigree_forms(both[0].unionByName(both[1]), gone[0].unionByName(gone[1]), "name")
    mine = forms.where("fid.side = 0").select(F.col("fid.of").alias("fid"), "form")
    return mine.join(forms.where("fid.side = 1").select(F.col("fid.of").alias("expected"), "form"), "form").select("fid", "expected")


def generation_steps(fam: DataFrame) -> DataFrame:
    """(iid, generation): steps down less steps up from the smallest of those joined by parents and children.

    A round goes one step further, children before parents where both lead to
    one person, so a person who can be reached in several ways has the
    generation of the shortest.
    """
    p = parents(fam)
    moves = checkpointed(p.select(F.col("parent").alias("iid"), F.col("child").alias("next"), F.lit(1).alias("move")).unionByName(p.select(F.col("child").alias("iid"), F.col("parent").alias("next"), F.lit(-1).alias("move"))))
    spark, path, k = fam.sparkSession, f"{fresh_folder(fam.sparkSession)}/steps", 0
    step = subpedigrees(fam).where("iid = subpedigree").select("iid", F.lit(0).alias("generation"), F.lit(0).alias("round"))
    while True:
        step.write.mode("append").parquet(path)
        known = spark.read.schema(step.schema).parquet(path)
        last = known.where(F.col("round") == k)
        if last.isEmpty():
            return known.select("iid", "generation")
        k += 1
        reached = last.join(moves, "iid").select(F.col("next").alias("iid"), (F.col("generation") + F.col("move")).alias("generation")).groupBy("iid").agg(F.max("generation").alias("generation"))
        step = checkpointed(reached.join(known.select("iid"), "iid", "left_anti").select("iid", "generation", F.lit(k).alias("round")))


def separate(peds: DataFrame) -> DataFrame:
    """Alternatives of pedigrees as one table whose ids tell the alternatives apart: (iid, pid, mid, 0 unknown, network_id, pedigree, name, ...).

    ``peds(network_id, pedigree, iid, pid, mid, ...)`` with null for unknown parents.
    """
    node = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("network_id", "pedigree", c))
    more = [c for c in peds.columns if c not in ("iid", "pid", "mid")]
    return peds.select(*more, F.col("iid").alias("name"), node("iid").alias("iid"), node("pid").alias("pid"), node("mid").alias("mid"))


def relations_across(peds: DataFrame) -> DataFrame:
    """What two people of a network are to each other in its pedigrees.

    ``peds(network_id, pedigree, iid, pid, mid, sampled, sex)``.  One row for
    each ordered pair of sampled people that some pedigree relates: all
    relations of ``rel`` to ``self`` that occur, sorted, UN where one has none,
    and in how many pedigrees the commonest of them holds.
    """
    fam = checkpointed(separate(peds))
    who = fam.where("sampled").select("iid", "name", "sex", "network_id", "pedigree")
    said = relations(fam).join(who.select(F.col("iid").alias("self"), F.col("name").alias("name1"), F.col("sex").alias("sex1"), "network_id", "pedigree"), "self")
    said = said.join(who.select(F.col("iid").alias("rel"), F.col("name").alias("name2"), F.col("sex").alias("sex2")), "rel")
    many = peds.select("network_id", "pedigree").distinct().groupBy("network_id").agg(F.count("*").alias("many"))
    by_code = said.groupBy("network_id", "name1", "name2", "sex1", "sex2", "code").agg(F.count("*").alias("n"))
    held = by_code.groupBy("network_id", "name1", "name2", "sex1", "sex2").agg(F.collect_list("code").alias("codes"), F.max("n").alias("n_most"), F.sum("n").alias("n")).join(many, "network_id")
    codes = F.when(F.col("n") < F.col("many"), F.concat("codes", F.array(F.lit("UN")))).otherwise(F.col("codes"))
    return held.select("network_id", F.col("name1").alias("self"), F.col("name2").alias("rel"), "sex1", "sex2", F.array_join(F.array_sort(codes), ",").alias("rels"), F.greatest("n_most", F.col("many") - F.col("n")).alias("n_most"), F.col("many").alias("n_pedigrees"))


def pedigree_measures(peds: DataFrame) -> DataFrame:
    """(network_id, pedigree, flags, lnl, generations, dummies): what alternatives of a network are ranked by.

    ``peds(network_id, pedigree, iid, pid, mid, sampled, age, lnl)``; flags
    count implausible ages of sampled pairs, generations the span of the
    sampled people, dummies the others.
    """
    fam = checkpointed(separate(peds))
    home = fam.select("iid", "network_id", "pedigree", "sampled")
    key = ["network_id", "pedigree"]
    # Nobody knows the age of people without data.
    flagged = age_flags(relations(fam), fam.where("sampled")).where("self < rel").join(home.select(F.col("iid").alias("self"), *key), "self").groupBy(*key).agg(F.count("*").alias("flags"))
    span = generation_steps(fam).join(home.where("sampled"), "iid").groupBy(*key).agg((F.max("generation") - F.min("generation") + 1).alias("generations"))
    size = fam.groupBy(*key).agg(F.count(F.when(~F.col("sampled"), 1)).alias("dummies"), F.max("lnl").alias("lnl"))
    out = size.join(flagged, key, "left").join(span, key, "left")
    return out.select(*key, F.coalesce("flags", F.lit(0)).cast("long").alias("flags"), "lnl", "generations", "dummies")
