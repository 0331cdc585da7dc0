"""Variants and genotypes: quality control, frequencies, IBD estimates, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from kinloom.operators.pair_blocks import dosage_sums, haploid_sums, pair_sums
from kinloom.operators.recovery import checkpointed

#: Limits on missingness, rare alleles and ancestry markers.
MIND, GENO, MAF, AIM_P = 0.1, 0.05, 0.1, 1e-5
#: Most different and most unknown sites of haploid sequences that match.
HAPLOID_DIFFERENT, HAPLOID_UNKNOWN = 0.01, 0.05


def duplicates(variants: DataFrame) -> DataFrame:
    """Variants that repeat an id or a place."""
    by_id, by_place = Window.partitionBy("snp_id"), Window.partitionBy("chrom", "pos")
    out = variants.withColumns({"n_id": F.count("*").over(by_id), "n_place": F.count("*").over(by_place)})
    return out.where("n_id > 1 or n_place > 1").select("vid", "snp_id", "chrom", "pos", "n_id", "n_place")


def without_duplicates(variants: DataFrame) -> DataFrame:
    """Variants whose id and place are theirs alone; of those that share one, none stays (Q3)."""
    return variants.join(duplicates(variants).select("vid"), "vid", "left_anti")


def without_parents(fam: DataFrame) -> DataFrame:
    """Everybody as a founder, so that allele frequencies count all (Q2)."""
    return fam.withColumns({"pid": F.lit(0).cast(fam.schema["pid"].dataType), "mid": F.lit(0).cast(fam.schema["mid"].dataType)})


def autosomes(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("chrom").between(1, 22))


def strand_actions(data: DataFrame, ref: DataFrame) -> DataFrame:
    """keep, flip or remove for every variant, by its alleles and the reference's."""
    j = data.join(ref.select("vid", "r1", "r2"), "vid", "left")
    comp = lambda c: F.translate(c, "ACGT", "TGCA")
    mine, theirs = F.array_sort(F.array_distinct(F.array("a1", "a2"))), F.array_sort(F.array_distinct(F.array("r1", "r2")))
    turned = F.array_sort(F.array_distinct(F.array(comp(F.col("a1")), comp(F.col("a2")))))
    j = j.withColumns({"mine": mine, "theirs": theirs, "turned": turned}).withColumn("size", F.size(F.array_union("mine", "theirs")))
    ambiguous = (F.size("mine") == 2) & (F.col("mine") == F.col("turned"))
    action = (
        F.when(F.col("r1").isNull(), "absent").when(ambiguous, "ambiguous").when(F.col("size") <= 2, "keep")
        .when(F.size(F.array_union("turned", "theirs")) <= 2, "flip").when(F.col("size") == 3, "triallelic").otherwise("weird")
    )
    return j.select("vid", F.when(F.col("r1").isNotNull(), F.col("size")).alias("n_alleles"), action.alias("action"))


def frequencies(g: DataFrame) -> DataFrame:
    """Allele frequency and missingness of each variant."""
    return g.groupBy("vid").agg(F.count("*").alias("n"), F.count("dosage").alias("n_called"), F.round(F.sum("dosage") / (2 * F.count("dosage")), 8).alias("freq"), F.round(1 - F.count("dosage") / F.count("*"), 8).alias("missing"))


def sample_stats(g: DataFrame) -> DataFrame:
    """Missingness and heterozygosity of each sample."""
    return g.groupBy("iid").agg(F.round(1 - F.count("dosage") / F.count("*"), 8).alias("missing"), F.round(F.sum((F.col("dosage") == 1).cast("int")) / F.count("dosage"), 8).alias("het"))


def cleaned(g: DataFrame, mind: float = MIND, geno: float = GENO, maf: float = MAF) -> DataFrame:
    """Genotypes without samples and variants that miss too many calls or are too rare (Q2)."""
    good = frequencies(g).where((F.col("missing") <= geno) & F.least("freq", 1 - F.col("freq")).between(maf, 0.5)).select("vid")
    people = g.groupBy("iid").agg((1 - F.count("dosage") / F.count("*")).alias("m")).where(F.col("m") <= mind).select("iid")
    return g.join(good, "vid", "left_semi").join(people, "iid", "left_semi")


def ibs_pairs(g: DataFrame, min_common: int = 3) -> DataFrame:
    """Method-of-moments Z0, Z1, Z2 and PI_HAT of all pairs that share variants (Q10).

    Expected sharing given IBD comes from allele counts, with the published
    correction for small samples: where a frequency is multiplied, alleles are
    drawn without putting them back.  Variants with fewer than four known
    alleles, or one allele only, tell nothing.
    """
    n = 2 * F.count("dosage")
    x = F.sum("dosage")
    counts = g.groupBy("vid").agg(x.cast("double").alias("x"), (n - x).cast("double").alias("y"), n.cast("double").alias("t")).where("x > 0 and y > 0 and t >= 4")
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    all4, all3 = t * (t - 1) * (t - 2) * (t - 3), t * (t - 1) * (t - 2)
    x2, y2 = x * (x - 1), y * (y - 1)
    e00 = 2 * x2 * y2 / all4
    e10 = 4 * (x2 * (x - 2) * y + x * y2 * (y - 2)) / all4
    e11 = 2 * (x2 * y + x * y2) / all3
    d = g.where("dosage is not null").join(counts.select("vid", e00.alias("e00"), e10.alias("e10"), e11.alias("e11")), "vid")
    d = d.select("iid", F.col("vid").alias("site"), F.col("dosage").alias("code"), "e00", "e10", "e11")
    m = pair_sums(d, dosage_sums, ["n", "ibs0", "ibs1", "ibs2", "e00", "e10", "e11"], ["e00", "e10", "e11"])
    m = m.where(F.col("n") >= min_common).withColumn("z0", F.coalesce(F.least(F.lit(1.0), F.col("ibs0") / F.nullif("e00", F.lit(0.0))), F.lit(0.0)))
    m = m.withColumn("z1", F.greatest(F.lit(0.0), F.least(1 - F.col("z0"), F.coalesce((F.col("ibs1") - F.col("z0") * F.col("e10")) / F.nullif("e11", F.lit(0.0)), F.lit(0.0)))))
    m = m.withColumn("z2", 1 - F.col("z0") - F.col("z1"))
    whole = [F.col(c).cast("long").alias(c) for c in ("n", "ibs0", "ibs1", "ibs2")]
    return m.select("iid1", "iid2", *whole, F.round("z0", 6).alias("z0"), F.round("z1", 6).alias("z1"), F.round("z2", 6).alias("z2"), F.round(F.col("z1") / 2 + F.col("z2"), 6).alias("pi_hat"))


def aim_scan(g: DataFrame, pcs: DataFrame) -> DataFrame:
    """Slope, r2 and t of each variant's dosage on the first component (Q8)."""
    j = g.where("dosage is not null").join(pcs, "iid")
    out = j.groupBy("vid").agg(F.count("*").alias("n"), F.regr_slope("dosage", "pc1").alias("beta"), F.regr_r2("dosage", "pc1").alias("r2")).where("n > 2 and r2 < 1")
    return out.select("vid", "n", F.round("beta", 6).alias("beta"), F.round("r2", 6).alias("r2"), F.round(F.signum("beta") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))), 5).alias("t"))


def markers_to_remove(g: DataFrame, pcs: list[DataFrame], least_t: float = 4.4172) -> DataFrame:
    """Variants that mark any of the components: |t| beyond AIM_P's normal quantile (U4)."""
    found = [aim_scan(g, p).where(F.abs("t") > least_t).select("vid") for p in pcs]
    return reduce(DataFrame.union, found).distinct()


def merge_with_reference(g: DataFrame, ref: DataFrame, actions: DataFrame, geno: float = GENO, maf: float = MAF) -> DataFrame:
    """Data and reference genotypes at the variants of both that are kept or flipped, cleaned together (Q5).

    A flip renames alleles and leaves dosages; rare and ill-called variants go after the merge.
    """
    usable = actions.where(F.col("action").isin("keep", "flip")).select("vid")
    shared = ref.select("vid").distinct().join(usable, "vid", "left_semi")
    both = g.join(shared, "vid", "left_semi").select("iid", "vid", "dosage").unionByName(ref.join(g.select("vid").distinct(), "vid", "left_semi").join(usable, "vid", "left_semi").select("iid", "vid", "dosage"))
    good = frequencies(both).where((F.col("missing") <= geno) & F.least("freq", 1 - F.col("freq")).between(maf, 0.5)).select("vid")
    return both.join(good, "vid", "left_semi")


def haploid_match(h: DataFrame, rate: float = HAPLOID_DIFFERENT, unknown: float = HAPLOID_UNKNOWN) -> DataFrame:
    """Match (1), mismatch (0) or unknown (-1) of all pairs of haploid sequences."""
    code = F.when(F.col("allele") == "0", 0).otherwise(F.shiftrightunsigned(F.xxhash64("allele"), 2) + 1)
    m = pair_sums(h.select("iid", "site", code.alias("code")), haploid_sums, ["length", "nunknown", "ndiff"]).where("length > 0")
    match = F.when(F.col("nunknown") / F.col("length") > unknown, -1).when(F.col("ndiff") / F.col("length") <= rate, 1).otherwise(0)
    return m.select("iid1", "iid2", match.alias("match"), *[F.col(c).cast("long").alias(c) for c in ("ndiff", "nunknown", "length")])


def thin_by_distance(variants: DataFrame, gap: int = 2000) -> DataFrame:
    """One variant, the first, of every window of ``gap`` on a chromosome (Q6, Q9)."""
    w = Window.partitionBy("chrom", F.expr(f"pos div {gap}")).orderBy("pos", "vid")
    return variants.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("vid", "snp_id", "chrom", "pos")


#: Variants of a window and largest r2 within it; unrelated samples that need no reference.
LD_WINDOW, LD_R2, LEAST_UNRELATED = 10, 0.2, 50


def variant_windows(variants: DataFrame, size: int = LD_WINDOW, width: int = 1_000_000) -> DataFrame:
    """(vid, chrom, place, block): every ``size`` variants in a row on a chromosome.

    Places are counted in bins of ``width`` and added to the counts of the bins before.
    """
    at = variants.select("vid", "chrom", "pos", F.expr(f"pos div {width}").alias("bin"))
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy("chrom", "bin").count().select("chrom", "bin", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("chrom", "bin").orderBy("pos", "vid"))
    place = at.withColumn("k", inside - 1).join(before, ["chrom", "bin"]).withColumn("place", F.col("before") + F.col("k"))
    return place.select("vid", "chrom", "place", F.expr(f"place div {size}").alias("block"))


def ld_prune(variants: DataFrame, g: DataFrame, size: int = LD_WINDOW, limit: float = LD_R2, least: int = 3) -> DataFrame:
    """(vid, chrom, kept): windows of ``size`` variants side by side, pruned by correlation (Q6).

    Pairs of a window go in order of place; of two that still stand and whose
    dosages have r2 above ``limit`` over at least ``least`` people, the one with
    the rarer allele goes, the later one on ties.  Only pairs of a window are formed.
    """
    at = variant_windows(variants, size)
    rare = frequencies(g).select("vid", F.least("freq", 1 - F.col("freq")).alias("maf"))
    calls = g.where("dosage is not null").join(at.join(rare, "vid"), "vid")
    a, b = (calls.select("chrom", "block", "iid", F.col("vid").alias(f"v{i}"), F.col("place").alias(f"p{i}"), F.col("maf").alias(f"m{i}"), F.col("dosage").alias(f"d{i}")) for i in (1, 2))
    met = a.join(b, ["chrom", "block", "iid"]).where("p1 < p2")
    n, x, y, xx, yy, xy = F.count("*"), F.sum("d1"), F.sum("d2"), F.sum(F.col("d1") * F.col("d1")), F.sum(F.col("d2") * F.col("d2")), F.sum(F.col("d1") * F.col("d2"))
    sums = met.groupBy("chrom", "block", "p1", "p2", "v1", "v2", "m1", "m2").agg(n.alias("n"), (n * xy - x * y).alias("c"), (n * xx - x * x).alias("s1"), (n * yy - y * y).alias("s2"))
    # Whole numbers up to here, so the comparison is exact.
    tied = sums.where(F.col("n") >= least).where(F.col("c") * F.col("c") > F.lit(limit) * F.col("s1") * F.col("s2"))
    pairs = tied.groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct("p1", "p2", "v1", "v2", "m1", "m2"))).alias("pairs"))

    def fold(gone, p):
        loser = F.when(p["m1"] < p["m2"], p["v1"]).otherwise(p["v2"])
        return F.when(F.array_contains(gone, p["v1"]) | F.array_contains(gone, p["v2"]), gone).otherwise(F.concat(gone, F.array(loser)))

    gone = pairs.select(F.explode(F.aggregate("pairs", F.array().cast("array<bigint>"), fold)).alias("vid")).withColumn("_gone", F.lit(True))
    return at.join(gone, "vid", "left").select("vid", "chrom", F.col("_gone").isNull().alias("kept"))


def genotype_components(g: DataFrame, k: int = 10, extra: int = 5, rounds: int = 8) -> DataFrame:
    """(iid, pcs): the people's ``k`` principal components, of unit length each (Q7).

    Dosages are standardized by each variant's frequency; what is not called
    counts as the mean.  Subspace iteration: ``k + extra`` vectors over people go
    to variants and back, as two joins and sums a round, and are made orthogonal
    by their small matrix of products, the only thing the driver sees.  They
    start from hashes, so reruns agree to rounding.  Variants of one allele are
    left out; a component's largest entry is positive; with less rank than ``k``
    the rest are noise of no length in the data.
    """
    import numpy as np
    import pyarrow as pa


    p = frequencies(g).where("freq > 0 and freq < 1").select("vid", F.col("freq").alias("p"))
    z = checkpointed(g.where("dosage is not null").join(p, "vid").select("iid", "vid", ((F.col("dosage") - 2 * F.col("p")) / F.sqrt(2 * F.col("p") * (1 - F.col("p")))).alias("z")))
    people = z.select("iid").distinct()
    width = min(k + extra, people.count())
    if not width:
        return people.select("iid", F.array().cast("array<double>").alias("pcs"))
    names = [f"c{i}" for i in range(width)]
    x = people.select("iid", *[(F.xxhash64("iid", F.lit(i)) / F.lit(2.0**63)).alias(c) for i, c in enumerate(names)])

    def turned(x: DataFrame, by: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                out = np.column_stack([batch.column(c).to_numpy() for c in names]) @ by
                yield pa.RecordBatch.from_arrays([batch.column("iid"), *map(pa.array, out.T)], ["iid", *names[: out.shape[1]]])

        return x.select("iid", *names).mapInArrow(run, T.StructType([x.schema["iid"], *[T.StructField(c, T.DoubleType()) for c in names[: by.shape[1]]]]))

    def products(x: DataFrame) -> np.ndarray:
        """The vectors' products with each other, summed in tasks; a small matrix for each partition comes back."""

        def run(batches):
            total = np.zeros((width, width))
            for batch in batches:
                rows = np.column_stack([batch.column(c).to_numpy() for c in names])
                total += rows.T @ rows
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["p"])

        place = F.posexplode("p").alias("i", "v")
        sums = x.select(*names).mapInArrow(run, "p array<double>").select(place).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width * width)
        for r in sums:
            out[r["i"]] = r["v"]
        return out.reshape(width, width)

    for last in [False] * rounds + [True]:
        values, vectors = np.linalg.eigh(products(x))
        values = np.maximum(values, 1e-12 * max(values.max(), 1e-300))
        x = checkpointed(turned(x, vectors[:, ::-1] / np.sqrt(values[::-1])))
        y = checkpointed(z.join(x, "iid").groupBy("vid").agg(*[F.sum(F.col("z") * F.col(c)).alias(c) for c in names]))
        if last:
            # The rotation within the subspace that makes variants' scores orthogonal, by size.
            x = turned(x, np.linalg.eigh(products(y))[1][:, ::-1][:, :k])
        else:
            x = checkpointed(z.join(y, "vid").groupBy("iid").agg(*[F.sum(F.col("z") * F.col(c)).alias(c) for c in names]))
    names = names[:k]
    x = checkpointed(x)
    top = x.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in names]).first()
    return x.select("iid", F.array(*[F.col(c) * (1.0 if top[c] >= 0 else -1.0) for c in names]).alias("pcs"))


def analysis_branch(admixed: DataFrame, unrelated: DataFrame, remove_aims: bool = False, keep_aims: bool = False, least: int = LEAST_UNRELATED) -> DataFrame:
    """For each batch, whether ancestry markers go and whether its own unrelated samples give the frequencies (Q11).

    ``admixed``: (batch, admixed); ``unrelated``: (batch, iid), distinct people are counted.
    """
    n = unrelated.groupBy("batch").agg(F.countDistinct("iid").alias("n_unrelated"))
    j = admixed.join(n, "batch", "left").select("batch", "admixed", F.coalesce("n_unrelated", F.lit(0)).alias("n_unrelated"))
    drop = (F.col("admixed") | F.lit(remove_aims)) & ~F.lit(keep_aims)
    return j.select("batch", "n_unrelated", drop.alias("remove_markers"), F.when(F.col("n_unrelated") >= least, "own").otherwise("reference").alias("frequencies"))


#: Variants from which relatedness is first estimated, and the share above which two people are related.
THIN_COUNT, RELATED = 10_000, 0.09375


def thinned(g: DataFrame, count: int = THIN_COUNT) -> DataFrame:
    """Genotypes of ``count`` variants, drawn by a hash of the id so that reruns agree (Q9)."""
    drawn = g.select("vid").distinct().orderBy(F.xxhash64(F.lit(17), "vid"), "vid").limit(count)
    return g.join(drawn, "vid", "left_semi")


def unrelated_samples(g: DataFrame, count: int = THIN_COUNT, related: float = RELATED, mind: float = MIND, geno: float = GENO, maf: float = MAF) -> DataFrame:
    """(iid): a largest set of samples no two of which share more than ``related``, by estimates from thinned variants (Q9).

    Samples and variants are cleaned first, variants thinned, sharing is
    estimated for all pairs, and each network of related samples gives its
    largest unrelated set.
    """
    from kinloom.operators.relationships import networks
    from kinloom.operators.unrelated import unrelated_sets

    few = checkpointed(thinned(cleaned(g, mind, geno, maf), count))
    pairs = checkpointed(ibs_pairs(few).where(F.col("pi_hat") > related).select("iid1", "iid2", "pi_hat"))
    people = few.select("iid").distinct()
    return unrelated_sets(networks(people, pairs), pairs).select("iid")
