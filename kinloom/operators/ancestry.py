"""Ancestry from component scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from kinloom.operators.recovery import checkpointed

#: Population codes by continental group.
CONTINENTS = {
    "EAS": "CDX CHB CHS JPT KHV CHD",
    "EUR": "CEU FIN GBR IBS TSI",
    "AFR": "ACB ASW ESN GWD LWK MSL YRI MKK",
    "SAS": "BEB GIH ITU PJL STU",
    "AMR": "CLM MXL PEL PUR MEX",
}
#: Populations admixed in themselves, and those that make a mixture of continents.
ADMIXED = ("ACB", "ASW", "BEB", "CLM", "GIH", "ITU", "MXL", "PEL", "PJL", "PUR", "STU")
UNMIXED = {"EUR": "CEU FIN GBR IBS TSI", "AFR": "ESN GWD LWK MSL YRI", "EAS": "CDX CHB CHS JPT KHV"}


def continents(df: DataFrame, col: str = "pop") -> DataFrame:
    """Add ``continent``; unknown codes stay as they are."""
    known = [x for group, codes in CONTINENTS.items() for code in codes.split() for x in (F.lit(code), F.lit(group))]
    return df.withColumn("continent", F.coalesce(F.try_element_at(F.create_map(*known), F.col(col)), F.col(col)))


def split(pcs: DataFrame) -> DataFrame:
    """Reference samples train, the others are tested."""
    return continents(pcs).select("iid", "pop", "continent", F.when(F.col("is_ref"), "train").otherwise("test").alias("part"))


def scaled(pcs: DataFrame, n: int = 10) -> DataFrame:
    """The first components, standardized by the reference's mean and deviation (M1)."""
    flat = pcs.select("iid", "is_ref", F.posexplode(F.slice("pcs", 1, n)).alias("k", "x"))
    stats = flat.where("is_ref").groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    return flat.join(F.broadcast(stats), "k").select("iid", "k", F.round((F.col("x") - F.col("m")) / F.col("s"), 5).alias("z"))


def admixture(predicted: DataFrame, by: str = "pop", group: tuple[str, ...] = ()) -> DataFrame:
    """Whether the populations of each group call for care: one admixed in itself, or several continents' (P16, A17)."""
    flags = predicted.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_set(by)), ",").alias("pops"), F.max(F.col(by).isin(*ADMIXED).cast("int")).alias("own"),
        *[F.max(F.col(by).isin(*codes.split()).cast("int")).alias(c.lower()) for c, codes in UNMIXED.items()])
    return flags.select(*group, "pops", ((F.col("own") == 1) | (F.col("eur") + F.col("eas") + F.col("afr") > 1)).alias("admixed"))


def reference_samples(pcs: DataFrame, populations: DataFrame) -> DataFrame:
    """Reference samples of the populations named, by whole code."""
    return pcs.where("is_ref").join(populations.select("pop").distinct(), "pop", "left_semi").select("iid", "pop")


def _features(pcs: DataFrame, n: int, features: int, gamma: float, seed: int) -> DataFrame:
    """(iid, pop, is_ref, features): random Fourier features of the standardized components, which approximate the radial kernel."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    w = rng.normal(0, (2 * gamma) ** 0.5, (features, n)).tolist()
    b = rng.uniform(0, 2 * np.pi, features).tolist()
    rows = scaled(pcs, n).groupBy("iid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda p: p["z"]).alias("z"))
    dots = F.transform(F.arrays_zip(F.lit(w).alias("w"), F.lit(b).alias("b")), lambda f: F.cos(F.aggregate(F.zip_with(f["w"], F.col("z"), lambda p, q: p * q), f["b"], lambda a, v: a + v)))
    return rows.join(pcs.select("iid", "pop", "is_ref"), "iid").withColumn("features", array_to_vector(dots))


def _model():
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=30, regParam=0.01)


def sigmoids(margins: DataFrame, rounds: int = 30) -> dict[tuple, tuple[float, float]]:
    """(a, b) of 1 / (1 + exp(a margin + b)) for each (fold, label) of ``margins(fold, label, margin, hit)`` (M2).

    Newton's method on the likelihood of targets drawn in from 0 and 1, as
    published for margins of support vector machines; every round is one sum
    over all rows, of which the driver gets five numbers for each fold and label.
    """
    rows = checkpointed(margins)
    counts = {(r["fold"], r["label"]): (r["hits"], r["n"] - r["hits"]) for r in rows.groupBy("fold", "label").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).collect()}
    target = {k: ((p + 1) / (p + 2), 1 / (n + 2)) for k, (p, n) in counts.items()}
    at = {k: (0.0, math.log((n + 1) / (p + 1))) for k, (p, n) in counts.items()}
    loss: dict[tuple, float] = {}
    tried, steps = dict(at), {k: 1.0 for k in at}
    spark, moves = rows.sparkSession, {}
    for _ in range(rounds):
        table = spark.createDataFrame([(*k, *tried[k], *target[k]) for k in tried], "fold int, label int, a double, b double, hi double, lo double")
        j = rows.join(F.broadcast(table), ["fold", "label"])
        x, t = F.col("margin"), F.when(F.col("hit") == 1, F.col("hi")).otherwise(F.col("lo"))
        z = F.col("a") * x + F.col("b")
        p = 1 / (1 + F.exp(z))
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # ln(1 + exp(z)) without overflow
        w = p * (1 - p)
        sums = j.groupBy("fold", "label").agg(F.sum(soft - (1 - t) * z).alias("f"), F.sum(x * (t - p)).alias("ga"), F.sum(t - p).alias("gb"), F.sum(x * x * w).alias("haa"), F.sum(x * w).alias("hab"), F.sum(w).alias("hbb")).collect()
        again = {}
        for r in sums:
            k = (r["fold"], r["label"])
            if k in loss and r["f"] > loss[k] + 1e-9:  # too far: half the step
                steps[k] /= 2
                if steps[k] > 1e-6:
                    again[k] = tuple(u + steps[k] * v for u, v in zip(at[k], moves[k]))
                continue
            done = k in loss and loss[k] - r["f"] < 1e-9
            at[k], loss[k], steps[k] = tried[k], r["f"], 1.0
            haa, hbb = r["haa"] + 1e-12, r["hbb"] + 1e-12
            det = haa * hbb - r["hab"] ** 2
            if done or abs(det) < 1e-300:
                continue
            moves[k] = (-(hbb * r["ga"] - r["hab"] * r["gb"]) / det, -(haa * r["gb"] - r["hab"] * r["ga"]) / det)
            again[k] = tuple(u + v for u, v in zip(at[k], moves[k]))
        if not again:
            break
        tried = again
    return at


def probabilities(pcs: DataFrame, n: int = 10, features: int = 100, gamma: float = 0.05, seed: int = 4, folds: int = 5) -> DataFrame:
    """(iid, pop, probability) of every population for every test sample, calibrated.

    A model is fitted without each fold of the reference samples; its margins
    on that fold give a sigmoid for each population.  A test sample's sigmoids
    are brought to a sum of 1 for each model, and averaged over the models.
    """
    from functools import reduce

    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array

    data = _features(pcs, n, features, gamma, seed)
    known = data.where("is_ref")
    index = StringIndexer(inputCol="pop", outputCol="label").fit(known)
    # Every population is dealt to the folds in turn, so that each fold has all of them.
    turn = Window.partitionBy("pop").orderBy(F.xxhash64("iid"), "iid")
    known = checkpointed(index.transform(known).withColumn("fold", ((F.row_number().over(turn) - 1) % folds).cast("int")).select("iid", "label", "fold", "features"))
    known = index.transform(known.join(pcs.select("iid", "pop"), "iid").drop("label"))
    tests = checkpointed(data.where("not is_ref").select("iid", "features"))
    finite = lambda x: F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))

    def margins(df: DataFrame, k: int, *keep: str) -> DataFrame:
        rows = df.select(*keep, F.lit(k).alias("fold"), F.posexplode(vector_to_array("rawPrediction")).alias("at", "m"))
        return rows.select(*keep, "fold", F.col("at").alias("label_at"), finite(F.col("m")).alias("margin"))

    held, asked = [], []
    for k in range(folds):
        model = _model().fit(known.where(F.col("fold") != k).drop("fold"))
        held.append(margins(model.transform(known.where(F.col("fold") == k).drop("fold")), k, "label"))
        asked.append(margins(model.transform(tests), k, "iid"))
    held = reduce(DataFrame.unionByName, held).select("fold", F.col("label_at").alias("label"), "margin", (F.col("label_at") == F.col("label")).cast("int").alias("hit"))
    at = sigmoids(held)
    table = pcs.sparkSession.createDataFrame([(*k, *ab) for k, ab in at.items()], "fold int, label_at int, a double, b double")
    scored = reduce(DataFrame.unionByName, asked).join(F.broadcast(table), ["fold", "label_at"])
    p = 1 / (1 + F.exp(F.greatest(F.least(F.col("a") * F.col("margin") + F.col("b"), F.lit(700.0)), F.lit(-700.0))))
    scored = scored.withColumn("p", p)
    whole = scored.groupBy("iid", "fold").agg(F.sum("p").alias("whole"))
    shares = scored.join(whole, ["iid", "fold"]).groupBy("iid", "label_at").agg(F.avg(F.col("p") / F.col("whole")).alias("p"))
    names = F.array(*[F.lit(x) for x in index.labels])
    return shares.select("iid", F.element_at(names, F.col("label_at") + 1).alias("pop"), F.round("p", 6).alias("probability"))


def predict(pcs: DataFrame, n: int = 10, features: int = 100, gamma: float = 0.05, seed: int = 4) -> DataFrame:
    """The likeliest population of each test sample and its probability (M2-M4)."""
    every = probabilities(pcs, n, features, gamma, seed)
    best = every.groupBy("iid").agg(F.max_by(F.struct("pop", "probability"), F.struct("probability", "pop")).alias("b"))
    return best.select("iid", F.col("b.pop").alias("predicted"), "b.probability")


def cross_validated(pcs: DataFrame, folds: int = 5, n: int = 10, features: int = 100, gamma: float = 0.05, seed: int = 4) -> DataFrame:
    """Accuracy of the classifier on each fold of the reference samples, trained on the others (M3)."""
    from functools import reduce

    from pyspark.ml.feature import StringIndexer

    data = _features(pcs.where("is_ref"), n, features, gamma, seed)
    data = StringIndexer(inputCol="pop", outputCol="label").fit(data).transform(data).withColumn("fold", F.pmod(F.xxhash64("iid"), F.lit(folds)))
    parts = [_model().fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)).select("fold", (F.col("prediction") == F.col("label")).cast("int").alias("right")) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))
