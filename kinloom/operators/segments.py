"""Shared segments: pair rollups, degree estimates, intervals and maps."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinloom.functions import likelihood as L
from kinloom.functions.likelihood import Settings
from kinloom.operators.recovery import checkpointed

PAIR = ["id1", "id2"]


def canonical(df: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Unordered pairs: the smaller id first (P10)."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def rollup(segments: DataFrame, min_cm: float = 5.0) -> DataFrame:
    """Segments per pair: how many, their sum, the longest, cM in both-homolog sharing."""
    kept = canonical(segments).where(F.round("cm", 2) >= min_cm)
    return kept.groupBy(*PAIR).agg(F.count("*").alias("n_segments"), F.sum("cm").alias("total_cm"), F.max("cm").alias("longest_cm"), F.sum(F.when(F.col("ibd") == 2, F.col("cm")).otherwise(0.0)).alias("ibd2_cm"))


def runs(segments: DataFrame, s: Settings = Settings(), tasks: int | None = None) -> DataFrame:
    """A pair's segments by length, for its splits into the longest, related ones and a background.

    Likelihoods depend on a split only by counts and sums, so segments of one
    length are one row: ``c`` of them, ``x`` cM above the least length, ``k0``
    longer ones with sums ``rx0`` and ``rm0``, and ``bx0`` cM of shorter ones.
    Which of several equal segments comes first makes no difference.
    ``tasks`` are as many as shuffles have, unless the number of pairs is known to need more.
    """
    held = canonical(segments).where((F.round("cm", 2) >= s.load_cm) & (F.abs("cm") >= s.min_cm)).select(*PAIR, (F.abs("cm") - s.min_cm).alias("x"))
    # Few rows make much work for each, so their number of tasks is kept.
    tasks = tasks or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.groupBy(*PAIR, "x").agg(F.count("*").alias("c")).repartition(tasks, *PAIR).withColumn("mix", L.mixture_ln(F.col("x"), s))
    whole, by_length = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR).orderBy("x")
    shorter, longer = by_length.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*PAIR).orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda value, w: F.coalesce(F.sum(value).over(w), F.lit(0.0))
    return rows.select(
        *PAIR, "x", "c", "mix", F.sum("c").over(whole).alias("s"), F.coalesce(F.sum("c").over(longer), F.lit(0)).alias("k0"),
        over(F.col("c") * F.col("x"), longer).alias("rx0"), over(F.col("c") * F.col("mix"), longer).alias("rm0"), over(F.col("c") * F.col("x"), shorter).alias("bx0"),
    )


def best_split(related: Column, chance: Column) -> Column:
    """How many segments are related in the likeliest split that ends within a run (:func:`runs`).

    ``related`` and ``chance`` are ln of rate times density of one segment of
    the run's length under either.  Segment ``j`` adds ln((s - j + 1) / j) and
    their difference, which falls with ``j``, so those that add anything are
    the first few, and their number is known without trying.
    """
    turn = F.ceil((F.col("s") + 1) / (1 + F.exp(chance - related))) - 1
    return F.greatest(F.col("k0"), F.least(F.col("k0") + F.col("c"), F.coalesce(turn, F.lit(0))))


def split_at(k: Column) -> dict[str, Column]:
    """Count, sums and ln factorials of both sides of a split after the ``k`` longest segments, within a run."""
    more, b = k - F.col("k0"), F.col("s") - k
    return {
        "k": k, "rx": F.col("rx0") + more * F.col("x"), "rm": F.col("rm0") + more * F.col("mix"), "rf": L.ln_factorial(k),
        "b": b, "bx": F.col("bx0") + (F.col("c") - more) * F.col("x"), "bf": L.ln_factorial(b),
    }


def model_terms(spark: SparkSession, s: Settings = Settings()) -> DataFrame:
    """One row for each model, ``ancestors`` and ``meioses``: rate and mean excess of its segments, their ln, and its form.

    Excesses that add up to ``rx`` take ``rx * times / over`` off the likelihood.
    """
    n, one = F.col("meioses"), F.lit(1.0)
    terms = {0: L.direct_terms(n, s), 1: L.one_ancestor_terms(n, s), 2: L.two_ancestor_terms(n, s)}
    rows = []
    for a, (rate, mean) in terms.items():
        # Lines of one or two ancestors have two meioses at least.
        held = spark.range(1 if a == 0 else 2, s.max_meioses + 1, 1, 1).select(F.lit(a).alias("ancestors"), F.col("id").cast("int").alias("meioses"))
        mixed, apart, far = (n == 2, n == 3, n > 3) if a == 2 else (F.lit(False),) * 3
        form = F.when(mixed, "mixed").when(apart, "apart").otherwise("plain").alias("form")
        times, over = F.when(far, n.cast("double")).otherwise(one), F.when(far, F.lit(100.0)).otherwise(mean)
        rows.append(held.select("*", rate.alias("rate"), F.ln(rate).alias("ln_rate"), mean.alias("mean"), F.ln(mean).alias("ln_mean"), times.alias("times"), over.alias("over"), form))
    return reduce(DataFrame.unionByName, rows)


def models(segments: DataFrame, s: Settings = Settings(), parts: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The best split's lnL for every pair, number of ancestors and meioses.

    ``parts`` are segments at an ascertained locus (:func:`at_locus`).  All of a
    pair's parts are background or all are related, whichever is likelier for
    the model; either way their number is given, and only their lengths count.
    As this does not depend on the split, it is added to each model's best.

    A model is a row of :func:`model_terms` that meets every run, so that models
    nobody asks for are left out before, and one expression serves all of them.
    ``tasks`` as in :func:`runs`.
    """
    x, key = F.col("x"), [*PAIR, "ancestors", "meioses"]
    chance = log(s.pois_mean) + log(s.rate) - x * s.rate
    mixed, apart = F.col("form") == "mixed", F.col("form") == "apart"
    rows = runs(segments, s, tasks).crossJoin(F.broadcast(model_terms(segments.sparkSession, s)))
    rows = rows.withColumn("k_", best_split(F.col("ln_rate") + F.when(mixed, F.col("mix")).otherwise(-F.col("ln_mean") - x / F.col("mean")), chance))
    at = split_at(F.col("k_"))
    k, rx = at["k"], at["rx"]
    # Terms are added from the left, background first, as the last digits depend on it.
    number = L.poisson_ln(F.col("rate"), k, at["rf"], L.background_ln(at["b"], at["bx"], at["bf"], s), F.col("ln_rate"))
    rows = rows.select(*key, "form", "ln_mean", "mean", "times", "over", k.alias("k"), rx.alias("rx"), at["rm"].alias("rm"), number.alias("number"), "k0", "s", "bx0", "c", "x")
    by_mean = F.col("k") * F.col("ln_mean")
    lnl = F.when(mixed, F.col("number") + F.col("rm")).when(apart, F.col("number") + (0.0 - by_mean - F.col("rx") / F.col("mean"))).otherwise(F.col("number") - by_mean - F.col("rx") * F.col("times") / F.col("over"))
    at = split_at(F.lit(0).cast("long"))
    null = F.when(F.col("k0") == 0, L.background_ln(at["b"], F.col("bx0") + F.col("c") * x, at["bf"], s))
    best = rows.groupBy(*key).agg(F.max(lnl).alias("lnl"), F.max(null).alias("ll_null"))
    if parts is not None:
        x = F.abs("cm") - s.min_cm
        held = canonical(parts).where(F.abs("cm") >= s.min_cm).groupBy(*PAIR).agg(F.count("*").alias("pc"), F.sum(x).alias("px"), F.sum(L.mixture_ln(x, s)).alias("pm"))
        best = best.join(held, PAIR, "left").fillna({"pc": 0, "px": 0.0, "pm": 0.0})
        away = F.col("pc") * F.log(F.lit(s.rate)) - F.col("px") * s.rate
        there = [L.ascertained_ln(F.col("meioses"), a, F.col("pc"), F.col("px"), F.col("pm"), s) for a in (0, 1, 2)]
        there = F.when(F.col("ancestors") == 0, there[0]).when(F.col("ancestors") == 1, there[1]).otherwise(there[2])
        best = best.withColumns({"lnl": F.col("lnl") + F.greatest(away, there), "ll_null": F.col("ll_null") + away})
    degree = F.when(F.col("ancestors") == 2, F.col("meioses") - 1).otherwise(F.col("meioses"))
    return best.select(*PAIR, "ancestors", "meioses", "lnl", "ll_null", degree.alias("degree"))


def best_model(m: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The likeliest model of each pair, the earliest on ties; no degree unless it beats the null."""
    place = F.col("meioses") * 3 + F.when(F.col("ancestors") == 0, 0).when(F.col("ancestors") == 2, 1).otherwise(2)
    top = m.groupBy(*PAIR).agg(F.max_by(F.struct("ancestors", "meioses", "degree", "lnl"), F.struct(F.round("lnl", 6), -place)).alias("b"), F.first("ll_null").alias("ll_null"))
    real = F.col("ll_null") + s.margin < F.col("b.lnl")
    return top.select(*PAIR, "b.ancestors", "b.meioses", F.round("b.lnl", 6).alias("lnl"), F.round("ll_null", 6).alias("ll_null"), F.when(real, F.col("b.degree")).alias("degree"))


def intervals(m: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Least and most meioses of each ancestor class within the confidence margin."""
    top = m.groupBy(*PAIR).agg(F.max("lnl").alias("top"))
    near = m.join(top, PAIR).where(F.col("lnl") + s.margin >= F.col("top"))
    out = []
    for a in (2, 1, 0):
        n = F.when(F.col("ancestors") == a, F.col("meioses") - (1 if a == 2 else 0))
        out += [F.min(n).alias(f"p{a}_low"), F.max(n).alias(f"p{a}_high")]
    return near.groupBy(*PAIR).agg(*out)


def overrides(segments: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Pairs whose total cM force parent-offspring or sibling."""
    total = canonical(segments).where(F.round("cm", 2) >= s.load_cm).groupBy(*PAIR).agg(F.sum("cm").alias("total_cm"))
    length = 100 * s.recombinations
    mean = 0.75 * length
    limit = mean + s.sibling_z * (mean / 100 * 4 * 625) ** 0.5
    forced = F.when(F.col("total_cm") > limit, "PO").when(F.col("total_cm") / length > 0.625, "SIB").otherwise("NONE")
    return total.select(*PAIR, "total_cm", forced.alias("forced"))


def bucket_weights(m: DataFrame) -> DataFrame:
    """Shares of the likelihood in degrees 2, 3, 4-7 and 8-40 (A4), scaled by the pair's largest term."""
    used = m.where("degree between 2 and 40")
    shifted = used.withColumn("w", F.exp(F.col("lnl") - F.max("lnl").over(Window.partitionBy(*PAIR))))
    part = lambda a, b: F.sum(F.when(F.col("degree").between(a, b), F.col("w")).otherwise(0.0)) / F.sum("w")
    return shifted.groupBy(*PAIR).agg(*[F.round(part(a, b), 6).alias(c) for c, a, b in (("p2", 2, 2), ("p3", 3, 3), ("p4_7", 4, 7), ("p8", 8, 40))])


def sibling_overrides(segments: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Pairs whose segments on both homologs fit full siblings better than chance.

    The longest k of them are a sibling's and the rest background, whose rate is
    scaled by the share of the genome in single sharing; the best k counts.
    """
    kept = canonical(segments).where((F.round("cm", 2) >= s.load_cm) & (F.abs("cm") >= s.min_cm))
    single = kept.where("ibd is null or ibd <> 2").groupBy(*PAIR).agg(F.sum("cm").alias("ibd1_cm"))
    two = runs(kept.where("ibd = 2"), s).join(single, PAIR)
    rate = s.pois_mean * F.col("ibd1_cm") / s.genome
    chance = F.ln(rate) + log(s.rate) - F.col("x") * s.rate
    two = two.withColumn("k", best_split(L.ibd2_sibling_ln(F.lit(1), F.col("x"), F.lit(0.0), s) - L.ibd2_sibling_ln(F.lit(0), F.lit(0.0), F.lit(0.0), s), chance))

    def back(at: dict[str, Column]) -> Column:
        return L.poisson_ln(rate, at["b"], at["bf"]) + at["b"] * log(s.rate) - at["bx"] * s.rate

    at, none = split_at(F.col("k")), split_at(F.lit(0).cast("long"))
    lnl = L.ibd2_sibling_ln(at["k"], at["rx"], at["rf"], s, base=back(at))
    best = two.groupBy(*PAIR).agg(F.max("s").alias("n_ibd2"), F.max(lnl).alias("lnl"), F.max(F.when(F.col("k0") == 0, back(none))).alias("ll_null"))
    return best.select(*PAIR, "n_ibd2", F.round("lnl", 6).alias("lnl"), F.round("ll_null", 6).alias("ll_null"), (F.col("lnl") > F.col("ll_null") + s.margin).alias("sibling"))


def split_at_locus(segments: DataFrame, chrom: int | str, position: int) -> DataFrame:
    """A segment that holds the ascertained locus, ends included, becomes two.

    cM are shared by length.  The two are ``ascertained``; segments shared on
    both homologs stay whole, and so does one without length.
    """
    over = (F.col("chrom") == chrom) & (F.col("start_bp") <= position) & (F.col("end_bp") >= position) & ~F.col("ibd").eqNullSafe(2) & (F.col("end_bp") > F.col("start_bp"))
    part = lambda a, b: F.struct(a.alias("start_bp"), b.alias("end_bp"))
    cut = F.lit(position).cast("long")
    parts = F.when(over, F.array(part(F.col("start_bp"), cut), part(cut, F.col("end_bp")))).otherwise(F.array(part(F.col("start_bp"), F.col("end_bp"))))
    rows = segments.withColumn("ascertained", over).withColumn("p", F.explode(parts))
    share = F.coalesce((F.col("p.end_bp") - F.col("p.start_bp")) / F.nullif(F.col("end_bp") - F.col("start_bp"), F.lit(0)), F.lit(1.0))
    return rows.select("id1", "id2", "chrom", F.col("p.start_bp").alias("start_bp"), F.col("p.end_bp").alias("end_bp"), F.round(F.col("cm") * share, 6).alias("cm"), "ibd", "ascertained")


def at_locus(segments: DataFrame, chrom: int | str, position: int) -> tuple[DataFrame, DataFrame]:
    """Segments off the ascertained locus, and the parts of those on it, for :func:`models`."""
    rows = split_at_locus(segments, chrom, position)
    return rows.where("not ascertained").drop("ascertained"), rows.where("ascertained").drop("ascertained")


def final_estimates(
    segments: DataFrame, s: Settings = Settings(), parts: DataFrame | None = None, masked: DataFrame | None = None, use_ibd2: bool = False, by_total: bool = True, ancestors: int | None = None
) -> DataFrame:
    """One estimate for each pair after all overrides.

    With ``use_ibd2`` segments shared on both homologs are kept apart: where
    they fit full siblings better than chance the pair is one (``SIB2``), and
    else the full siblings' model is out.  Then, with ``by_total``, cM (and
    those taken away by a mask, ``masked(id1, id2, cm)``) above what siblings
    share make parent and offspring (``PO``), and, without ``use_ibd2``, above
    0.625 of the genome siblings (``SIB``).  ``ancestors`` keeps models of 0, 1
    or 2 shared ancestors only.  ``degree`` is null where the estimate does not
    beat the null; bounds are meioses of models as likely as the estimate
    within the confidence margin, two ancestors' less one.
    """
    main = segments.where("ibd is null or ibd <> 2") if use_ibd2 else segments
    m = models(main, s, parts)
    total = canonical(main).where((F.round("cm", 2) >= s.load_cm) & (F.abs("cm") >= s.min_cm)).groupBy(*PAIR).agg(F.sum("cm").alias("total"))
    if masked is not None:
        away = canonical(masked).groupBy(*PAIR).agg(F.sum("cm").alias("away"))
        total = total.join(away, PAIR, "left").select(*PAIR, (F.col("total") + F.coalesce("away", F.lit(0.0))).alias("total"))
    length = 100 * s.recombinations
    limit = 0.75 * length + s.sibling_z * (0.75 * length / 100 * 4 * 625) ** 0.5
    nothing = F.lit(None).cast("string")
    forced = F.when(F.col("total") > limit, "PO") if by_total and ancestors in (None, 0) else F.when(F.lit(False), nothing)
    if by_total and not use_ibd2 and ancestors in (None, 2):
        forced = F.coalesce(forced, F.when(F.col("total") / length > 0.625, "SIB"))
    pairs = total.withColumn("forced", forced)
    if use_ibd2 and ancestors in (None, 2):
        # The null that a sibling is held against counts all IBD2 segments at the rate that chance sharing on both homologs has.
        twice = min(s.pois_mean * s.rate / s.genome, 1.0)
        two = canonical(segments).where((F.col("ibd") == 2) & (F.round("cm", 2) >= s.load_cm) & (F.abs("cm") >= s.min_cm))
        null = two.groupBy(*PAIR).agg(F.count("*").alias("s"), F.sum(F.abs("cm") - s.min_cm).alias("bx"))
        null = null.select(*PAIR, (L.poisson_ln(F.lit(s.pois_mean * twice), F.col("s"), L.ln_factorial(F.col("s"))) + F.col("s") * F.log(F.lit(s.rate)) - F.col("bx") * s.rate).alias("null2"))
        sib = sibling_overrides(segments, s).where("sibling").select(*PAIR, F.col("lnl").alias("lnl2")).join(null, PAIR)
        pairs = pairs.join(sib, PAIR, "left").withColumn("forced", F.when(F.col("lnl2").isNotNull(), "SIB2").otherwise(F.col("forced")))
    else:
        pairs = pairs.withColumns({"lnl2": F.lit(None).cast("double"), "null2": F.lit(None).cast("double")})
    j = m.join(pairs, PAIR)
    two_two = (F.col("ancestors") == 2) & (F.col("meioses") == 2)
    right = F.when(F.col("forced") == "PO", (F.col("ancestors") == 0) & (F.col("meioses") == 1)).when(F.col("forced").isin("SIB", "SIB2"), two_two).otherwise(~two_two if use_ibd2 else F.lit(True))
    if ancestors is not None:
        right = right & (F.col("ancestors") == ancestors)
    place = F.col("meioses") * 3 + F.when(F.col("ancestors") == 0, 0).when(F.col("ancestors") == 2, 1).otherwise(2)
    best = F.max_by(F.when(right, F.struct("ancestors", "meioses", "degree", "lnl")), F.when(right, F.struct(F.round("lnl", 6), -place)))
    model = F.struct(F.col("ancestors").alias("a"), F.col("meioses").alias("n"), F.col("lnl").alias("v"))
    top = j.groupBy(*PAIR).agg(best.alias("b"), F.collect_list(model).alias("all"), *[F.first(c).alias(c) for c in ("ll_null", "forced", "lnl2", "null2")])
    lnl, null = F.coalesce("lnl2", "b.lnl"), F.coalesce("null2", "ll_null")
    out = top.withColumns({"top": lnl, "null": null})
    bounds = []
    for a in (2, 1, 0):
        near = F.transform(F.filter("all", lambda x: (x["a"] == a) & (x["v"] + s.margin >= F.col("top")) & ~(F.lit(use_ibd2 and a == 2) & (x["n"] == 2))), lambda x: x["n"] - (1 if a == 2 else 0))
        # A sibling by IBD2 is compared with no other model.
        near = F.when(F.col("lnl2").isNotNull(), F.array(F.lit(1)) if a == 2 else F.array().cast("array<int>")).otherwise(near)
        bounds += [F.array_min(near).alias(f"p{a}_low"), F.array_max(near).alias(f"p{a}_high")]
    degree = F.when(F.col("null") + s.margin < F.col("top"), F.col("b.degree"))
    return out.select(*PAIR, "b.ancestors", "b.meioses", degree.alias("degree"), F.round("top", 6).alias("lnl"), F.round("null", 6).alias("ll_null"), F.coalesce("forced", F.lit("NONE")).alias("forced"), *bounds)


def masked_away(clipped: DataFrame) -> DataFrame:
    """(id1, id2, cm) that a mask took from each pair's segments, as cut by :func:`clip_to_mask` (A3)."""
    return canonical(clipped).groupBy(*PAIR).agg(F.round(F.sum(F.col("cm") - F.col("new_cm")), 6).alias("cm"))


def control_stats(segments: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Mean count per pair (pairs without segments too) and mean length of control segments."""
    kept = canonical(segments).where(F.abs("cm").between(s.min_cm, s.max_cm))
    people = segments.select(F.col("id1").alias("i")).unionByName(segments.select(F.col("id2").alias("i"))).distinct()
    totals = people.agg(F.count("*").alias("people"))
    seen = kept.agg(F.count("*").alias("n"), F.avg("cm").alias("mean_cm"))
    pairs = F.col("people") * (F.col("people") - 1) / 2
    return seen.join(F.broadcast(totals)).select("people", (F.col("n") / pairs).alias("pois_mean"), "mean_cm", (1 / (F.col("mean_cm") - s.min_cm)).alias("exp_rate"))


def overlap_density(segments: DataFrame, width: int = 1_000_000) -> DataFrame:
    """cM that other segments of the chromosome lay over each segment.

    No pair is formed: with C(x) and L(x), the starts less ends and the covered
    length to the left of x, a segment meets as many others as start up to its
    end and do not end before its start, over a length of L(end) - L(start) less
    its own.  Running sums are taken within bins of ``width``, on top of those
    of the bins before, so no task holds a chromosome.
    """
    s = segments.select("id1", "id2", "chrom", "start_bp", "end_bp", "cm", "ibd").distinct()
    met = _lain_over(s, _coverage(s, width))
    return met.select("id1", "id2", "chrom", "start_bp", "end_bp", "cm", "ibd", "n_over", "shared_cm").where("n_over > 0")


def _coverage(s: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(chrom, pos, ended, started, length) at every end of a segment: how many end before it, start up to it, and the length covered to its left."""
    one = lambda c, a, b: F.struct(F.col(c).alias("pos"), F.lit(a).alias("s"), F.lit(b).alias("e"))
    ends = s.select("chrom", F.explode(F.array(one("start_bp", 1, 0), one("end_bp", 0, 1))).alias("p")).select("chrom", "p.*")
    at = ends.groupBy("chrom", "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    at = at.select("chrom", "pos", F.expr(f"pos div {width}").alias("bin"), "s", "e", (F.col("pos") * (F.col("e") - F.col("s"))).alias("x"))
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = at.groupBy("chrom", "bin").agg(*[F.sum(c).alias(c) for c in "sex"])
    bins = bins.select("chrom", "bin", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "sex"])
    upto = Window.partitionBy("chrom", "bin").orderBy("pos")
    sums = at.join(bins, ["chrom", "bin"]).select("chrom", "pos", "e", *[(F.col(f"{c}0") + F.sum(c).over(upto)).alias(f"{c}s") for c in "sex"])
    length = F.col("pos") * (F.col("ss") - F.col("es")) + F.col("xs")
    return sums.select("chrom", "pos", (F.col("es") - F.col("e")).alias("ended"), F.col("ss").alias("started"), length.alias("length"))


def _lain_over(s: DataFrame, cover: DataFrame, chrom: str = "chrom", start: str = "start_bp", end: str = "end_bp", small: bool = False) -> DataFrame:
    """Segments with ``n_over`` and, where others lie over them, ``shared_cm``; a ``small`` coverage goes to all tasks, so that segments stay where they are."""
    left = cover.select(F.col("chrom").alias(chrom), F.col("pos").alias(start), "ended", F.col("length").alias("l0"))
    right = cover.select(F.col("chrom").alias(chrom), F.col("pos").alias(end), "started", F.col("length").alias("l1"))
    if small:
        left, right = F.broadcast(left), F.broadcast(right)
    met = s.join(left, [chrom, start]).join(right, [chrom, end])
    own, over = F.col(end) - F.col(start), F.col("started") - F.col("ended") - 1
    shared = F.when(over > 0, F.round(F.col("cm") * (F.col("l1") - F.col("l0") - own) / own, 4))
    return met.withColumns({"n_over": over, "shared_cm": shared}).drop("ended", "started", "l0", "l1")


#: Segments of a task, and places of a coverage that goes to all tasks.
SEGMENTS, PLACES = 250_000, 1_000_000


def null_exceedances(segments: DataFrame, iterations: int = 100, genome_cm: int = 3525) -> DataFrame:
    """How often segments placed at random are overlain as much as each one is.

    Each iteration lays every segment somewhere on a genome of ``genome_cm``, at
    a place drawn from a digest of the segment and the iteration, in hundredths
    of a cM, so reruns agree.  ``expected_cm`` is the mean overlap when placed so.
    Segments are shuffled by all their columns only, once for each of the two
    coverages and once for the result; coverages have few places, and only
    larger ones are joined by place.
    """
    tasks = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.count() // SEGMENTS)
    columns = ["id1", "id2", "chrom", "start_bp", "end_bp", "cm", "ibd"]
    s = segments.select(*columns).where("end_bp > start_bp").repartition(tasks, *columns).distinct()
    key = ["id1", "id2", "chrom", "start_bp", "end_bp", "ibd"]
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "iteration", *key)), 1, 8), 16, 10).cast("long")
    length = F.round(F.col("cm") * 100).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("at", drawn % F.greatest(F.lit(1), 100 * genome_cm - length))
        return rows.withColumns({"from_bp": F.col("at") * 10_000, "to_bp": (F.col("at") + length) * 10_000}).drop("at")

    def covered(rows: DataFrame) -> tuple[DataFrame, bool]:
        cover = checkpointed(_coverage(rows))
        return cover, cover.count() <= PLACES

    cover, small = covered(s)
    seen = _lain_over(s, cover, small=small).select(*columns, F.coalesce("shared_cm", F.lit(0.0)).alias("seen_cm"))
    cover, small = covered(placed(s).select(F.col("iteration").alias("chrom"), F.col("from_bp").alias("start_bp"), F.col("to_bp").alias("end_bp")))
    met = _lain_over(placed(seen), cover, "iteration", "from_bp", "to_bp", small).withColumnRenamed("shared_cm", "by_chance").withColumnRenamed("seen_cm", "shared_cm")
    sums = met.groupBy(*key, "cm", "shared_cm").agg(F.count("by_chance").alias("n"), F.count(F.when(F.col("by_chance") >= F.col("shared_cm"), 1)).alias("over"), F.coalesce(F.sum("by_chance"), F.lit(0.0)).alias("total"))
    none = F.when(F.col("shared_cm") <= 0, iterations - F.col("n")).otherwise(0)
    return sums.select(*key, "cm", "shared_cm", (F.col("over") + none).alias("n_exceed"), F.round(F.col("total") / iterations, 4).alias("expected_cm"))


#: Base pairs of a bin; what runs along a chromosome is taken within bins, on top of what the bins before bring.
BIN = 10_000_000


def merge_intervals(rows: DataFrame, gap: int = 0, width: int = BIN) -> DataFrame:
    """(chrom, start_bp, end_bp) with overlaps and gaps up to ``gap`` closed.

    No task holds a chromosome: the farthest end so far, and the number of
    islands so far, are carried from bin to bin as one row each.
    """
    at = rows.select("chrom", "start_bp", "end_bp", F.expr(f"start_bp div {width}").alias("bin"))
    before = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("chrom", "bin").orderBy("start_bp", "end_bp")
    tops = at.groupBy("chrom", "bin").agg(F.max("end_bp").alias("top")).select("chrom", "bin", F.max("top").over(before).alias("carried"))
    reach = F.greatest(F.max("end_bp").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    begun = at.join(tops, ["chrom", "bin"]).withColumn("new", F.when(reach.isNull() | (F.col("start_bp") > reach + gap), 1).otherwise(0))
    counts = begun.groupBy("chrom", "bin").agg(F.sum("new").alias("n")).select("chrom", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    islands = begun.join(counts, ["chrom", "bin"]).withColumn("island", F.col("earlier") + F.sum("new").over(inside))
    return islands.groupBy("chrom", "island").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp")).drop("island")


def clip_to_mask(segments: DataFrame, mask: DataFrame, cross: int = 1_000_000, width: int = BIN) -> DataFrame:
    """Segments cut by masked regions in order of position; cM shrink in proportion.

    A region that a segment touches cuts off each side on which the segment
    leaves it by less than ``cross``; where both sides go, nothing is left.
    Segments and regions meet in bins, so a segment sees the regions that it
    touches only.
    """
    held = checkpointed(segments).withColumn("_sid", F.monotonically_increasing_id())
    bins = lambda first, last: F.sequence(F.expr(f"{first} div {width}"), F.expr(f"{last} div {width}"))
    spread = held.select("_sid", "chrom", F.col("start_bp").alias("s0"), F.col("end_bp").alias("s1"), F.explode(bins("start_bp", "end_bp")).alias("bin"))
    regions = mask.select("chrom", F.col("start_bp").alias("r0"), F.col("end_bp").alias("r1"), F.explode(bins("start_bp", "end_bp")).alias("bin"))
    # Two that meet in several bins count in the first of these.
    met = spread.join(regions, ["chrom", "bin"]).where("r0 <= s1 and r1 >= s0").where(F.col("bin") == F.greatest(F.expr(f"s0 div {width}"), F.expr(f"r0 div {width}")))
    folded = met.groupBy("_sid").agg(F.array_sort(F.collect_list(F.struct(F.col("r0").alias("start_bp"), F.col("r1").alias("end_bp")))).alias("mask"))
    joined = held.join(folded, "_sid", "left").withColumn("mask", F.coalesce("mask", F.array().cast("array<struct<start_bp:bigint,end_bp:bigint>>")))

    def cut(acc, m):
        touched = (acc["b"] <= m["end_bp"]) & (acc["e"] >= m["start_bp"])
        b = F.when(touched & (acc["b"] > m["start_bp"] - cross), F.least(m["end_bp"], acc["e"])).otherwise(acc["b"])
        e = F.when(touched & (acc["e"] < m["end_bp"] + cross), F.greatest(m["start_bp"], b)).otherwise(acc["e"])
        return F.struct(b.alias("b"), e.alias("e"))

    out = joined.withColumn("kept", F.aggregate("mask", F.struct(F.col("start_bp").alias("b"), F.col("end_bp").alias("e")), cut))
    share = (F.col("kept.e") - F.col("kept.b")) / (F.col("end_bp") - F.col("start_bp"))
    return out.select("id1", "id2", "chrom", "start_bp", "end_bp", F.col("kept.b").alias("new_begin"), F.col("kept.e").alias("new_end"), F.round(F.col("cm") * share, 4).alias("new_cm"))


def map_position(positions: DataFrame, rec_map: DataFrame, width: int = BIN) -> DataFrame:
    """cM of each (chrom, pos) by the map point before it and the one at or after it.

    An as-of join as one sorted pass over positions and map points together,
    within bins; the last point of the bins before and the first one of the
    bins after are carried, one row for each bin.
    """
    rows = positions.select("chrom", "pos").distinct().select("chrom", "pos", F.lit(None).cast("double").alias("cm"), F.lit(1).alias("kind"))
    both = rows.unionByName(rec_map.select("chrom", "pos", "cm", F.lit(0).alias("kind"))).withColumn("bin", F.expr(f"pos div {width}"))
    point = F.when(F.col("kind") == 0, F.struct("pos", "cm"))
    along = Window.partitionBy("chrom").orderBy("bin")
    ends = both.groupBy("chrom", "bin").agg(F.max(point).alias("high"), F.min(point).alias("low"))
    ends = ends.select("chrom", "bin", F.last("high", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("low", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    w = Window.partitionBy("chrom", "bin").orderBy("pos", "kind")
    near = both.withColumns({"before": F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(point, True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("kind = 1")
    near = near.join(ends, ["chrom", "bin"]).withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    frac = (F.col("pos") - F.col("before.pos")) / (F.col("after.pos") - F.col("before.pos"))
    at = F.coalesce(F.col("before.cm") + frac * (F.col("after.cm") - F.col("before.cm")), F.col("before.cm"), F.lit(0.0))
    return near.select("chrom", "pos", F.round(at, 6).alias("cm"))


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the last in the given order."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ibd2_sweep(haploid: DataFrame) -> DataFrame:
    """Cut each pair's chromosome at all segment ends; a piece is IBD2 if exactly the
    two crossed haplotype pairs cover it (I1, J5, W6, W7).

    No piece meets its segments.  How many of each haplotype pair lie over a
    piece are running sums of starts less ends.  A piece has the cM of a segment
    that is just as long, or its part of the covering one that starts first, the
    shortest of these: from the place where a segment becomes that one it is
    carried along.  A start counts only if a segment from there reaches beyond
    all that start before.  Rows are shuffled once, by pair and chromosome.
    """
    key = ["id1", "id2", "chrom"]
    combo = F.col("hap1") * 2 + F.col("hap2")
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    places = haploid.repartition(*key).groupBy(*key, "start_bp", "end_bp").agg(has(combo == 1).alias("one"), has(combo == 2).alias("two"), has(~combo.isin(1, 2)).alias("rest"), F.min(F.struct("hap1", "hap2", "cm")).alias("first"))
    there = F.col("end_bp") > F.col("start_bp")
    same = Window.partitionBy(*key, "start_bp").orderBy("end_bp")
    earlier = Window.partitionBy(*key).orderBy("start_bp").rangeBetween(Window.unboundedPreceding, -1)
    places = places.withColumns({"reach": F.max("end_bp").over(earlier), "shorter": F.lag("end_bp").over(same)})
    led = there & (F.col("reach").isNull() | (F.col("end_bp") > F.col("reach")))
    segment = F.struct("start_bp", "end_bp", F.col("first.cm").alias("cm"))
    at = lambda pos, sign, starts, leads: F.struct(pos.alias("b"), *[F.when(there, sign * F.col(c)).otherwise(0).alias(c) for c in ("one", "two", "rest")], starts.alias("starts"), leads.alias("leads"))
    no = F.lit(None)
    events = F.array(at(F.col("start_bp"), 1, F.when(there, F.struct("end_bp", F.col("first.cm").alias("cm"))), no), at(F.col("end_bp"), -1, no, no), at(F.when(led, F.greatest("start_bp", "reach", "shorter")), 0, no, segment))
    cuts = places.select(*key, F.explode(events).alias("at")).select(*key, "at.*").where("b is not null")
    cuts = cuts.groupBy(*key, "b").agg(*[F.sum(c).alias(c) for c in ("one", "two", "rest")], F.min("starts").alias("starts"), F.max("leads").alias("leads"))
    along = Window.partitionBy(*key).orderBy("b")
    sums = {c: F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in ("one", "two", "rest")}
    pieces = cuts.withColumns(sums | {"e": F.lead("b").over(along), "over": F.last("leads", True).over(along.rowsBetween(Window.unboundedPreceding, 0))})
    pieces = pieces.where("e is not null and over.end_bp > b")
    scaled = F.col("over.cm") * (F.col("e") - F.col("b")) / (F.col("over.end_bp") - F.col("over.start_bp"))
    cm = F.when(F.col("starts.end_bp") == F.col("e"), F.col("starts.cm")).otherwise(scaled)
    crossed = (F.col("one") > 0) & (F.col("two") > 0) & (F.col("rest") == 0)
    return pieces.select(*key, F.col("b").alias("start_bp"), F.col("e").alias("end_bp"), F.round(cm, 6).alias("cm"), F.when(crossed, 2).otherwise(1).alias("ibd"))


def ibd2_table(segments: DataFrame, haploid: DataFrame, min_cm: float = 5.0) -> DataFrame:
    """Diploid segments and the pieces shared on both homologs, of ``min_cm`` or more; of
    segments at one place the last counts, that is the piece, then the longer one (I2, U1, W4)."""
    two = ibd2_sweep(haploid).where((F.col("ibd") == 2) & (F.col("cm") >= min_cm))
    one = segments.where(F.col("cm") >= min_cm).select(*two.columns[:-1], F.lit(1).alias("ibd"))
    return keep_last(one.unionByName(two), ["id1", "id2", "chrom", "start_bp", "end_bp"], ["ibd", "cm"])
