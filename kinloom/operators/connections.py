"""Distant connections between networks through their founders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.functions.likelihood import Settings, chi2_sf
from kinloom.operators.pedigrees import tasks_for
from kinloom.operators.recovery import checkpointed, fresh_folder, written
from kinloom.operators.segments import models


def degree_lnl(m: DataFrame, *more: str) -> DataFrame:
    """Best of one and two ancestors for each pair and degree, less the extra parameters; ties to two (A5, J15).  ``more`` are columns that all models of a pair share."""
    lnl = {a: F.max(F.when(F.col("ancestors") == a, F.col("lnl"))).alias(f"{a}") for a in (1, 2)}
    one = m.where("ancestors in (1, 2)").groupBy("id1", "id2", "degree").agg(lnl[1], lnl[2], *[F.first(c).alias(c) for c in more])
    best = F.when(F.col("1") > F.coalesce(F.col("2"), F.lit(-1e300)), F.col("1")).otherwise(F.col("2"))
    return one.select("id1", "id2", "degree", F.round(F.coalesce(best, F.col("1")) - 2, 6).alias("lnl"), *more)


def degree_models(segments: DataFrame, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """:func:`degree_lnl` up to ``most`` degrees and each pair's null, for links between founders.

    Links try no further degree, and take both several times, so the models
    are computed once, for as many meioses as these degrees have, and written.
    """
    held = checkpointed(degree_lnl(models(segments, Settings(max_meioses=most + 1)), "ll_null").where(F.col("degree") <= most))
    # Every pair has a model of the first degree.
    return held.drop("ll_null"), held.where("degree = 1").select("id1", "id2", "ll_null")


def degree_rows(segments: DataFrame, least: int = 1, most: int = 9, tasks: int | None = None) -> DataFrame:
    """(id1, id2, lnl, ll_null): :func:`degree_lnl` at degrees 1 to ``most`` of each pair in an array, so that a pair is one row.

    Degrees below ``least`` are null and not computed; ``tasks`` as in :func:`segments.runs`.
    """
    every = degree_lnl(models(segments, Settings(max_meioses=most + 1), tasks=tasks), "ll_null").where(F.col("degree").between(least, most))
    at = [F.max(F.when(F.col("degree") == d, F.col("lnl"))) for d in range(1, most + 1)]
    return every.groupBy("id1", "id2").agg(F.array(*at).alias("lnl"), F.first("ll_null").alias("ll_null"))


def candidates(founders: DataFrame, depth: DataFrame, lnl: DataFrame, most: int = 9) -> DataFrame:
    """Founder pairs of two networks and the degrees that may join them.

    ``founders(network_id, founder)``, ``depth(founder, iid, depth)``: how far below
    the founder a sampled person stands; ``lnl(id1, id2, ...)``: estimated pairs.
    Only founders above the two people of an estimated pair meet.
    """
    near = depth.groupBy("founder").agg(F.min("depth").alias("near"))
    f = founders.join(near, "founder").withColumnRenamed("network_id", "net")
    below = depth.join(f, "founder").select("founder", "iid", "net", "near")
    a, b = (below.select(F.col("net").alias(f"net{i}"), F.col("founder").alias(f"f{i}"), F.col("near").alias(f"near{i}"), F.col("iid").alias(f"i{i}")) for i in (1, 2))
    met = lnl.select("id1", "id2").distinct()
    both = met.select(F.col("id1").alias("i1"), F.col("id2").alias("i2")).unionByName(met.select(F.col("id2").alias("i1"), F.col("id1").alias("i2")))
    pairs = both.join(a, "i1").join(b, "i2").where("net1 < net2").select("net1", "net2", "f1", "f2", "near1", "near2").distinct()
    low, high = F.lit(1), F.lit(most) - F.col("near1") - F.col("near2")
    return pairs.where(high >= 1).select("net1", "net2", "f1", "f2", F.explode(F.sequence(low, high.cast("int"))).alias("degree"))


def _beyond(lnl: Column, null: Column, more: Column | int) -> Column:
    """lnL of a pair ``more`` degrees beyond the last, from its lnL there and its null: a segment comes through half as often with each."""
    w = F.pow(F.lit(0.5), more)
    top = F.greatest(lnl, null)
    return top + F.ln(w * F.exp(lnl - top) + (1 - w) * F.exp(null - top))


def _at_distance(most: int) -> Column:
    """lnL of a pair ``total`` degrees apart, from its ``lnl`` at that degree or at the last, and ``ll_null``."""
    return F.when(F.col("total") > most, _beyond(F.col("lnl"), F.col("ll_null"), F.greatest(F.col("total") - most, F.lit(0)))).otherwise(F.col("lnl"))


def composite(cand: DataFrame, depth: DataFrame, lnl: DataFrame, null_lnl: DataFrame, most: int = 9) -> DataFrame:
    """Sum of lnL over all sampled pairs under each founder link, and the AIC form."""
    d1, d2 = (depth.select(F.col("founder").alias(f"f{i}"), F.col("iid").alias(f"i{i}"), F.col("depth").alias(f"d{i}")) for i in (1, 2))
    p = cand.join(d1, "f1").join(d2, "f2").withColumn("total", F.col("degree") + F.col("d1") + F.col("d2"))
    p = p.withColumns({"id1": F.least("i1", "i2"), "id2": F.greatest("i1", "i2"), "at": F.least(F.col("total"), F.lit(most))})
    x = lnl.select("id1", "id2", F.col("degree").alias("at"), "lnl")
    j = p.join(x, ["id1", "id2", "at"]).join(null_lnl.select("id1", "id2", "ll_null"), ["id1", "id2"])
    value = _at_distance(most)
    return j.groupBy("net1", "net2", "f1", "f2", "degree").agg(F.round(F.sum(value), 5).alias("score"), F.round(F.sum(4 - 2 * value), 5).alias("aic"), F.round(F.sum(-2 * (F.col("ll_null") - (F.col("lnl") + 2))), 5).alias("chi2"), F.count("*").alias("n_pairs"),
        F.round(F.sum(value - F.col("ll_null")), 5).alias("gain"), F.round(F.sum(4 - 2 * value + 2 * F.col("ll_null")), 5).alias("aic_gain"))


def best_connections(scored: DataFrame, mode: str = "composite") -> DataFrame:
    """The best founder link of each network pair with its significance.

    Links are held against none at all: what a link adds to the likelihood of
    no relation counts, and where no link adds anything the degree is null.
    """
    gain = F.col("aic_gain") if mode == "aic" else -F.col("gain")
    best = scored.groupBy("net1", "net2").agg(F.min_by(F.struct("f1", "f2", "degree", "score", "aic", "chi2", "n_pairs", gain.alias("_g")), F.struct(gain, F.col("f1"), F.col("f2"), F.col("degree"))).alias("b"))
    none = F.col("b._g") >= 0
    rows = best.select("net1", "net2", "b.f1", "b.f2", F.when(~none, F.col("b.degree")).alias("degree"), "b.score", "b.aic", "b.chi2", "b.n_pairs")
    return rows.withColumn("p", F.round(chi2_sf(F.col("chi2"), F.col("n_pairs").cast("int")), 8))


def pair_significance(best: DataFrame) -> DataFrame:
    """p-value of each pair with two degrees of freedom."""
    x = -2 * (F.col("ll_null") - F.col("lnl"))
    return best.select("id1", "id2", F.round(F.when(x <= 0, 1.0).otherwise(F.exp(-x / 2)), 8).alias("p"))


def corrected_level(founders: DataFrame, n_unrelated: int, level: float = 0.05) -> DataFrame:
    """The level divided by all comparisons made."""
    n = founders.groupBy("network_id").agg(F.countDistinct("founder").alias("f")).agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"))
    u = F.lit(n_unrelated).cast("double")
    tests = 1 + (F.col("s") * F.col("s") - F.col("q")) / 2 + F.col("s") * u + u * u
    return n.select(tests.alias("comparisons"), (F.lit(level) / tests).alias("p_cut"))


def descents(peds: DataFrame, *more: str) -> DataFrame:
    """(network_id, pedigree, founder, iid, depth, sampled): generations from each founder down to everybody below.

    ``peds(network_id, pedigree, iid, pid, mid, sampled, ...)`` with null for unknown parents;
    ``more`` are columns that all people of a pedigree share.
    Across a link between founders, two people are as far apart as the link and both depths together.
    """
    key = ["network_id", "pedigree"]
    held = written(peds.select(*key, "iid", "pid", "mid", "sampled", *more))
    edge = held.select(*key, F.explode(F.array("pid", "mid")).alias("iid"), F.col("iid").alias("child"), F.col("sampled").alias("of_child")).where("iid is not null")
    path, depth = f"{fresh_folder(peds.sparkSession)}/depths", 0
    step = held.where("pid is null and mid is null").select(*key, F.col("iid").alias("founder"), "iid", F.lit(0).alias("depth"), "sampled", *more)
    while True:
        # Files are listed when a step is planned, so that it reads those of the steps before only.
        step.write.mode("append").parquet(path)
        known = peds.sparkSession.read.schema(step.schema).parquet(path)
        last = known.where(F.col("depth") == depth)
        if last.isEmpty():
            return known
        depth += 1
        below = last.drop("sampled").join(edge, [*key, "iid"]).select(*key, "founder", F.col("child").alias("iid"), F.lit(depth).alias("depth"), F.col("of_child").alias("sampled"), *more).distinct()
        step = below.join(known.select(*key, "founder", "iid"), [*key, "founder", "iid"], "left_anti").select(*step.columns)


def nearest_sampled(down: DataFrame) -> DataFrame:
    """The sampled people on the first level below a founder that has any; the founder itself if sampled."""
    key = ["network_id", "pedigree", "founder"]
    near = down.where("sampled").groupBy(*key).agg(F.min("depth").alias("near"))
    return down.where("sampled").join(near, key).where("depth = near").select(*key, "iid", "near")


def _above(peds: DataFrame, tasks: int) -> DataFrame:
    """(network_id, iid, over): for each sampled person all founders above it, with their pedigrees.

    ``near`` is how far below the founder its nearest sampled people stand and ``far`` how much further this person does.
    ``lnl`` is text, which a double's digits survive: arrays that hold doubles are rewritten for every row they group.
    """
    founder = Window.partitionBy("network_id", "pedigree", "founder")
    down = descents(peds, "lnl").where("sampled").repartition(tasks, "network_id").withColumn("near", F.min("depth").over(founder))
    over = F.struct(F.col("pedigree").alias("ped"), F.col("founder").alias("f"), "near", (F.col("depth") - F.col("near")).alias("far"), F.col("lnl").cast("string").alias("lnl"))
    return down.groupBy("network_id", "iid").agg(F.collect_list(over).alias("over"))


def link_pedigrees(peds: DataFrame, pairs: DataFrame, least: int = 4, most: int = 9, mode: str = "composite") -> DataFrame:
    """The best link of every two networks, over all their pedigrees, founders and degrees.

    ``peds`` holds alternatives of each network with their ``lnl``;
    ``pairs(id1, id2, lnl, ll_null)`` as from :func:`degree_rows`, from
    ``least`` at least, are the estimated pairs.  A founder stands for the nearest sampled people below it,
    so the degrees tried go from ``least`` to ``most`` less the levels down to
    these, 1 at least.  A link adds to the likelihood of no relation what its
    pairs gain; each pedigree's own lnL comes on top, and having no link, with a
    null degree, is one of the choices.  ``mode="aic"`` takes the least sum of
    AIC gains and lnL as published.  Significance counts only the pairs of
    nearest sampled people, at the degree of the link and both levels.

    Founders meet only through estimated pairs below them, never all by all.
    The two sides of a link are summed one after the other: first what all
    people below a founder gain with one person of the other network, then
    these sums below a founder there.  All of it is kept for degrees as they
    stand between the nearest people of both founders, in columns; a person
    further below reads it as many places on.  A pair is one row until it lies
    by its networks, and is not moved afterwards.
    Columns: net1, net2, ped1, ped2, f1, f2, degree, total, n_pairs, chi2, p.
    """
    tasks, least = tasks_for(peds), max(least, 1)
    above = written(_above(peds, tasks))
    far = above.select(F.max(F.array_max(F.transform("over", lambda o: o["far"])))).first()[0] or 0
    a, b = (above.select(F.col("network_id").alias(f"net_{k}"), F.col("iid").alias(f"id{k}"), F.col("over").alias(f"over_{k}")) for k in (1, 2))
    places = range(least, most + 1)
    at = {d: F.col(f"at{d}") for d in places}
    met = pairs.select("id1", "id2", "ll_null", *[F.get("lnl", F.lit(d - 1)).alias(f"at{d}") for d in places])
    met = met.join(a, "id1").join(b, "id2").where("net_1 <> net_2")
    first = F.col("net_1") < F.col("net_2")
    turned = {"net1": F.least("net_1", "net_2"), "net2": F.greatest("net_1", "net_2"), "i2": F.when(first, F.col("id2")).otherwise(F.col("id1"))}
    turned |= {"over1": F.when(first, F.col("over_1")).otherwise(F.col("over_2")), "over2": F.when(first, F.col("over_2")).otherwise(F.col("over_1"))}
    met = met.select(*[c.alias(n) for n, c in turned.items()], "ll_null", *at.values()).repartition(tasks, "net1", "net2")
    gains = F.array(*[at[d] - F.col("ll_null") for d in places], *[_beyond(at[most], F.col("ll_null"), d) - F.col("ll_null") for d in range(1, 2 * far + 1)])
    met = met.select("net1", "net2", "i2", "over1", "over2", gains.alias("gains"), *[(-2 * (F.col("ll_null") - (at[d] + 2))).alias(f"c{d}") for d in places])

    def summed(rows: DataFrame, side: int, keys: list[str], reach: int, number: Column) -> DataFrame:
        """Sums over the people of one side, ``reach`` places beyond the last degree."""
        rows = rows.withColumn("o", F.explode(f"over{side}"))
        own = {f"{c}{side}": F.col(f"o.{c}") for c in ("ped", "f", "near")} | {f"lnl{side}": F.col("o.lnl").cast("double")}
        nearest = F.col("o.far") == 0
        gain = [F.sum(F.get("gains", F.col("o.far") + d)).alias(f"g{d}") for d in range(len(places) + reach)]
        few = [F.sum(F.when(nearest, F.col(f"c{d}"))).alias(f"c{d}") for d in places]
        out = rows.groupBy(*keys, *[c.alias(n) for n, c in own.items()]).agg(*gain, *few, F.sum(F.when(nearest, number).otherwise(0)).alias("n"))
        return out.select(*keys, *own, F.array(*[f"g{d}" for d in range(len(places) + reach)]).alias("gains"), *[f"c{d}" for d in places], "n")

    one = summed(met, 1, ["net1", "net2", "i2", "over2"], far, F.lit(1))
    links = summed(one, 2, ["net1", "net2", "ped1", "f1", "near1", "lnl1"], 0, F.col("n"))
    nothing = F.lit(None).cast("int")

    def choice(gain: Column, degree: Column, n: Column, chi2: Column) -> Column:
        """A link, or none, with what it is chosen by in front."""
        total, linked = F.round(gain + F.col("lnl1") + F.col("lnl2"), 5), degree.isNotNull()
        order = [(total if mode == "aic" else -total).alias("order"), linked.alias("linked"), F.col("ped1"), F.col("ped2"), *[F.when(linked, F.col(f)).alias(f) for f in ("f1", "f2")]]
        return F.struct(*order, degree.alias("degree"), total.alias("total"), n.alias("n_pairs"), chi2.alias("chi2"))

    some, levels = F.when(F.col("n") > 0, F.col("n")), F.col("near1") + F.col("near2")
    # Sums of AIC gains are those of gains times -2.
    tried = [(d, F.get("gains", F.lit(d - least)), d - levels) for d in places]
    tried = [F.when((degree >= 1) & gain.isNotNull(), choice(F.round(-2 * gain if mode == "aic" else gain, 5), degree, some, F.round(f"c{d}", 5))) for d, gain, degree in tried]
    none = choice(F.lit(0.0), nothing, F.lit(None).cast("long"), F.lit(None).cast("double"))
    best = links.select("net1", "net2", F.array_min(F.array(none, *tried)).alias("b")).groupBy("net1", "net2").agg(F.min("b").alias("b"))
    out = best.select("net1", "net2", *[F.col(f"b.{c}") for c in ("ped1", "ped2", "f1", "f2", "degree", "total", "n_pairs", "chi2")])
    p = F.when(F.col("chi2").isNotNull(), F.round(chi2_sf(F.col("chi2"), F.col("n_pairs").cast("int")), 8))
    return out.withColumn("p", p)
