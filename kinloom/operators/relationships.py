"""Relationship classes from pairwise estimates, family networks and trait folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.operators.components import connected_components

#: Classes in their order; the first wins nothing on ties, the last does.
CLASSES = ("PC", "FS", "HAG", "CGH", "DR", "UN")


def related_edges(genome: DataFrame, threshold: float = 0.09375) -> DataFrame:
    """Pairs whose proportion shared exceeds the threshold."""
    return genome.where(F.col("pi_hat") > threshold).select("iid1", "iid2", "pi_hat")


#: Least proportion shared by relatives up to a degree.
DEGREE_THRESHOLDS = {1: 0.375, 2: 0.1875, 3: 0.09375}


def threshold_of(degree: int) -> float:
    """The threshold that keeps relatives up to a degree."""
    return DEGREE_THRESHOLDS[degree]


def degree_of(threshold: float) -> int:
    """The farthest degree that a threshold of one's own keeps."""
    return 3 if threshold < 0.1 else 2 if threshold < 0.2 else 1


def network_edges(classified: DataFrame, threshold: float = 0.09375) -> DataFrame:
    """Pairs above the threshold that join networks: not those that can only be unrelated."""
    return classified.where((F.col("pi_hat") > threshold) & (F.col("possible") != "UN")).select("iid1", "iid2", "pi_hat")


def synthetic_kde(spark: SparkSession, step: int = 10) -> DataFrame:
    """A stand-in for trained densities: Gaussians about each class's expected sharing.

    Fixed values: expected (k0, k1) in thousandths, widths, per class.
    """
    means = {"PC": (0, 1000, 40), "FS": (250, 500, 60), "HAG": (500, 500, 60), "CGH": (750, 250, 60), "DR": (900, 100, 50), "UN": (1000, 0, 40)}
    grid = spark.range(1000 // step + 1).select((F.col("id") * step).alias("k0"))
    grid = grid.withColumn("k1", F.explode(F.sequence(F.lit(0), F.lit(1000).cast("long") - F.col("k0"), F.lit(step).cast("long"))))
    def density(m0, m1, w):
        d2 = (F.col("k0") - m0) * (F.col("k0") - m0) + (F.col("k1") - m1) * (F.col("k1") - m1)
        return F.exp(-d2.cast("double") / (2 * w * w)) / (w * w) * 1000
    return grid.select("k0", "k1", *[density(*means[c]).alias(c.lower()) for c in CLASSES])


def grid_point(z0: Column, z1: Column, z2: Column) -> tuple[Column, Column, Column]:
    """Clamped grid coordinates with the inbreeding fold."""
    clamp = lambda z: F.greatest(F.lit(0), F.least(F.lit(1000), z.cast("int")))
    k0, k1, k2 = clamp(z0), clamp(z1), clamp(z2)
    fold = (k0 < 10) & (k1 > 900)
    return k0, F.when(fold, F.least(F.lit(1000), k1 + k2)).otherwise(k1), F.when(fold, 0).otherwise(k2)


def _limits(k0: Column, k1: Column, k2: Column) -> dict[str, Column]:
    """What decides on classes beside the grid point: much sharing of one allele, and the class of a pair that no density reaches (1 twins, 2 second degree, 3 unrelated)."""
    hard = F.when(k2 > 800, 1).when((k1 > 600) & (k1 < 800) & (k0 + k1 > 900), 2).when((k1 < 100) & (k0 + k2 > 900), 3).otherwise(0)
    return {"high": k1 > 800, "hard": hard}


def _at_point(points: DataFrame, *keep: str) -> DataFrame:
    """Density of every class, 0 where the grid has none, from the point's densities, ``high`` and ``hard``; and the twin flag."""
    names = [c.lower() for c in CLASSES]
    d = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}
    d["pc"] = d["pc"] + F.when(F.col("high"), 1.0).otherwise(0.0)
    j = points.select(*keep, "hard", *[c.alias(n) for n, c in d.items()])
    none = sum((F.col(c) for c in names), F.lit(0.0)) < 1e-6
    j = j.select(*keep, F.when(none, F.col("hard")).otherwise(0).alias("hard"), *names)
    add = {"fs": 1, "hag": 2, "un": 3}
    return j.select(*keep, (F.col("hard") == 1).alias("mz"), *[(F.col(c) + F.when(F.col("hard") == add[c], 100.0).otherwise(0.0)).alias(c) if c in add else F.col(c) for c in names])


def _points_of(genome: DataFrame, step: int) -> DataFrame:
    """Each pair's grid point and limits."""
    k0, k1, k2 = grid_point(F.col("z0"), F.col("z1"), F.col("z2"))
    g = genome.select("iid1", "iid2", "pi_hat", k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))
    limits = _limits(F.col("k0"), F.col("k1"), F.col("k2"))
    return g.select("iid1", "iid2", "pi_hat", F.expr(f"k0 div {step} * {step}").alias("g0"), F.expr(f"k1 div {step} * {step}").alias("g1"), *[v.alias(n) for n, v in limits.items()])


def densities(genome: DataFrame, kde: DataFrame, step: int = 10) -> DataFrame:
    """Density of every class at each pair's sharing, with hard limits where no density reaches, and twin flag."""
    at = kde.select(F.col("k0").alias("g0"), F.col("k1").alias("g1"), *[c.lower() for c in CLASSES])
    return _at_point(_points_of(genome, step).join(at, ["g0", "g1"], "left"), "iid1", "iid2", "pi_hat")


def point_classes(kde: DataFrame, cutoff: float = 0.3, step: int = 10) -> DataFrame:
    """What :func:`classify` says of every grid point and limits that a pair may have: at most 8 rows for each point of the square."""
    names = [c.lower() for c in CLASSES]
    at = kde.select(F.col("k0").alias("g0"), F.col("k1").alias("g1"), *names)
    square = kde.sparkSession.range(0, 1001, step).select(F.col("id").alias("g0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1000).cast("long"), F.lit(step).cast("long"))).alias("g1"))
    points = square.join(F.broadcast(at), ["g0", "g1"], "left").withColumn("high", F.explode(F.array(F.lit(False), F.lit(True)))).where(F.when(F.col("high"), F.col("g1") + step > 801).otherwise(F.col("g1") <= 800))
    key = ["g0", "g1", "high", "hard"]
    j = points.withColumn("hard", F.explode(F.array(*map(F.lit, range(4))))).withColumn("given", F.col("hard"))
    j = _at_point(j, "g0", "g1", "high", "given").withColumnRenamed("given", "hard")
    total = sum((F.col(c) for c in names), F.lit(0.0))
    j = j.withColumn("total", total).select(*key, "mz", *[F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0).alias(c) for c in names])
    both = (F.col("pc") > cutoff) & (F.col("hag") > cutoff)
    j = j.withColumns({"pc": F.when(both, F.col("pc") + F.col("hag")).otherwise(F.col("pc")), "hag": F.when(both, 0.0).otherwise(F.col("hag"))})
    rounded = {c: F.round(c, 6) for c in names}
    j = j.select(*key, "mz", *[v.alias(c) for c, v in rounded.items()])
    top, rel = F.greatest(*names), F.lit(CLASSES[0])
    for c, n in zip(names[1:], CLASSES[1:]):
        rel = F.when(F.col(c) == top, n).otherwise(rel)
    possible = F.concat_ws(",", *[F.when(F.col(c) > cutoff, n) for c, n in zip(names, CLASSES)])
    return j.select(*key, "mz", *names, F.when(top < cutoff, "FAIL").otherwise(rel).alias("rel"), possible.alias("possible"))


def classify(genome: DataFrame, kde: DataFrame, cutoff: float = 0.3, step: int = 10) -> DataFrame:
    """Likelihood vector, likeliest class, possible classes and twin flag of each pair.

    Classes follow from a pair's grid point and limits alone, so they are worked
    out once for each of these and joined; with fine grids, by shuffling.
    """
    said = point_classes(kde, cutoff, step)
    j = _points_of(genome, step).join(F.broadcast(said) if step >= 5 else said, ["g0", "g1", "high", "hard"])
    return j.select("iid1", "iid2", "pi_hat", "mz", *[c.lower() for c in CLASSES], "rel", "possible")


def fuse(classified: DataFrame, weights: DataFrame) -> DataFrame:
    """Distant classes reweighted by shared segments where the near ones are unlikely."""
    w = weights.select(F.col("id1").alias("iid1"), F.col("id2").alias("iid2"), "p2", "p3", "p4_7", "p8")
    j = classified.join(w, ["iid1", "iid2"], "left")
    near = F.col("pc") + F.col("fs")
    q = 1 - near
    absent = F.col("p2").isNull()
    new = {"hag": F.col("p2") * q, "cgh": F.col("p3") * q, "dr": F.col("p4_7") * q, "un": F.col("p8") * q}
    out = {c: F.when(near >= 0.4, F.col(c)).when(absent, 0.0 if c != "un" else 1.0).otherwise(v) for c, v in new.items()}
    for c in ("pc", "fs"):
        out[c] = F.when((near < 0.4) & absent, 0.0).otherwise(F.col(c))
    return j.select("iid1", "iid2", *[F.round(out[c.lower()], 6).alias(c.lower()) for c in CLASSES])


def networks(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, iid) for every person; a network is called by its smallest member."""
    parts = connected_components(edges, "iid1", "iid2").select(F.col("id").alias("iid"), "component")
    return people.join(parts, "iid", "left").select(F.coalesce("component", "iid").alias("network_id"), "iid")


def twin_nodes(classified: DataFrame) -> DataFrame:
    """(iid, node): identical twins, triplets ... are one node, named by all of them."""
    parts = connected_components(classified.where("mz"), "iid1", "iid2")
    names = parts.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda i: i.cast("string")), ":").alias("node"))
    return parts.join(names, "component").select(F.col("id").alias("iid"), "node")


def network_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """All unordered pairs inside a network, with what they share where it is above the threshold."""
    a, b = (members.select("network_id", F.col("iid").alias(f"iid{i}")) for i in (1, 2))
    return a.join(b, "network_id").where("iid1 < iid2").join(edges, ["iid1", "iid2"], "left").select("network_id", "iid1", "iid2", "pi_hat")


def sample_relatedness(best: DataFrame, members: DataFrame) -> DataFrame:
    """Every estimated pair by where its people stand: in one network, in two, one or both in none."""
    size = members.groupBy("network_id").agg(F.count("*").alias("n"))
    at = members.join(size, "network_id")
    one, two = (at.select(F.col("iid").alias(f"id{i}"), F.col("network_id").alias(f"net{i}"), (F.col("n") > 1).alias(f"in{i}")) for i in (1, 2))
    j = best.join(one, "id1").join(two, "id2")
    kind = F.when(F.col("net1") == F.col("net2"), "within").when(F.col("in1") & F.col("in2"), "between").when(F.col("in1") | F.col("in2"), "unrelated and network").otherwise("unrelated")
    return j.select("id1", "id2", "net1", "net2", kind.alias("kind"), "ancestors", "degree", "lnl", "ll_null")


def dataset_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """How many networks, people in and outside of them, and related pairs (K9)."""
    size = members.groupBy("network_id").agg(F.count("*").alias("n"))
    real = F.col("n") > 1
    sums = size.agg(F.count(F.when(real, 1)).alias("n_networks"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_related"), F.count(F.when(~real, 1)).alias("n_unrelated"), F.max("n").alias("largest"))
    return sums.join(edges.agg(F.count("*").alias("n_pairs"), F.round(F.avg("pi_hat"), 6).alias("mean_pi_hat")))


def possibility_counts(classified: DataFrame, members: DataFrame) -> DataFrame:
    """How many relationships the possible classes leave to each network, in all."""
    j = classified.join(members.select(F.col("iid").alias("iid1"), "network_id"), "iid1").join(members.select(F.col("iid").alias("iid2"), F.col("network_id").alias("other")), "iid2").where("network_id = other")
    return j.groupBy("network_id").agg(F.count("*").alias("n_pairs"), F.sum(F.size(F.split("possible", ","))).alias("n_possible"))


def attribute_gaps(people: DataFrame, attributes: DataFrame) -> DataFrame:
    """People who lack an attribute, and attributes of nobody (P20)."""
    have = attributes.select("iid").distinct()
    lack = people.select("iid").distinct()
    return lack.join(have, "iid", "left_anti").select("iid", F.lit("no attribute").alias("gap")).unionByName(have.join(lack, "iid", "left_anti").select("iid", F.lit("nobody").alias("gap")))


def known_networks(members: DataFrame, fam: DataFrame) -> DataFrame:
    """Networks that share a sample with a reference pedigree."""
    return members.join(fam.select("iid"), "iid", "left_semi").groupBy("network_id").agg(F.count("*").alias("n_shared"))


def density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, edges and edge density of each network."""
    size = members.groupBy("network_id").agg(F.count("*").alias("n"))
    inside = edges.join(members.select(F.col("iid").alias("iid1"), "network_id"), "iid1").groupBy("network_id").agg(F.count("*").alias("e"))
    return size.join(inside, "network_id", "left").where("n > 1").select("network_id", "n", F.coalesce("e", F.lit(0)).alias("e"), F.round(2 * F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1)), 6).alias("density"))


def fold_traits(traits: DataFrame) -> DataFrame:
    """Distance from the mean and recoded binary trait."""
    mean = traits.agg(F.avg("qtrait").alias("mean"))
    recoded = F.when(F.col("btrait") == 2, 1).when(F.col("btrait") == 1, 0)
    return traits.join(F.broadcast(mean)).select("iid", F.round(F.abs(F.col("qtrait") - F.col("mean")), 6).alias("fold"), recoded.alias("affected"))


def unresolved_relatives(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs above the threshold that a pedigree does not relate (R18); ``degrees`` as from :func:`pedigrees.pedigree_degrees`."""
    return edges.join(degrees, ["iid1", "iid2"], "left_anti").select("iid1", "iid2", "pi_hat")
