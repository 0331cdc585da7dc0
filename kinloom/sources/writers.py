"""Results as files: tab-separated tables, pedigrees and graph drawings.

Tables are written by all tasks at once, so each output is a folder of parts;
``write_by_network`` makes one folder for each network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Names of the columns of the estimates' file and of the models' file.
ESTIMATE_NAMES = ("individual_1", "individual_2", "est_number_of_shared_ancestors", "est_degree_of_relatedness", "2p_lower", "2p_upper", "1p_lower", "1p_upper", "0p_lower", "0p_upper", "maxlnl_relatedness", "maxlnl_unrelatedness")
MODEL_NAMES = ("individual_1", "individual_2", "number_of_shared_ancestors", "degree_of_relatedness", "maxlnl")
#: Pedigree drawings mark men, women and others so.
DRAWN_SEX = {1: "7", 2: "1"}


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated parts with a header; nulls as NA."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def write_by_network(df: DataFrame, path: str, column: str = "network_id") -> None:
    """Parts in one folder for each network (K3)."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).csv(path, sep="\t", header=True, nullValue="NA")


def estimates_table(best: DataFrame, intervals: DataFrame) -> DataFrame:
    """The twelve columns of the estimates' file (K1).

    ``best(id1, id2, ancestors, degree, ll_max, ll_null)``; ``intervals(id1, id2,
    low2, high2, low1, high1, low0, high0)``.  A null degree is written as no_sig_rel.
    """
    j = best.join(intervals, ["id1", "id2"], "left")
    degree = F.coalesce(F.col("degree").cast("string"), F.lit("no_sig_rel"))
    return j.select("id1", "id2", "ancestors", degree, "low2", "high2", "low1", "high1", "low0", "high0", "ll_max", "ll_null").toDF(*ESTIMATE_NAMES)


def models_table(models: DataFrame) -> DataFrame:
    """The five columns of the models' file (K2)."""
    return models.select("id1", "id2", "ancestors", "degree", "lnl").toDF(*MODEL_NAMES)


def pedigree_table(fam: DataFrame, affected: Column | None = None) -> DataFrame:
    """Six columns of a pedigree, 0 where a parent is unknown; placeholders become Missing (K7)."""
    name = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "(?i)dummy", "Missing"), F.lit("0"))
    pheno = F.when(affected, 2).otherwise(1) if affected is not None else F.lit(0)
    return fam.select(F.coalesce(F.col("fid"), F.lit("0")).alias("FID"), name("iid").alias("IID"), name("pid").alias("PID"), name("mid").alias("MID"), F.coalesce("sex", F.lit(0)).alias("SEX"), pheno.alias("PHENOTYPE"))


def drawing_table(fam: DataFrame) -> DataFrame:
    """People for drawing: parents, sex mark and whether a placeholder (K7)."""
    sex = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DRAWN_SEX.items() for x in kv]), F.col("sex").cast("int")), F.lit("0"))
    return pedigree_table(fam.withColumn("sex", F.col("sex").cast("int"))).withColumn("SYMBOL", sex).drop("PHENOTYPE")


def network_dots(members: DataFrame, edges: DataFrame, more_than: int = 4) -> DataFrame:
    """Lines of a drawing of each network of more than ``more_than`` people (K5).

    Rows (network_id, part, line): part 0 opens the graph, 1 holds the edges, 2 closes it.
    """
    large = members.groupBy("network_id").count().where(F.col("count") > more_than).select("network_id")
    kept = members.join(large, "network_id", "left_semi")
    e = edges.join(kept.select(F.col("iid").alias("iid1"), "network_id"), "iid1").select("network_id", F.lit(1).alias("part"), F.format_string('\t"%s" -- "%s" [color=black];', F.col("iid1").cast("string"), F.col("iid2").cast("string")).alias("line"))
    opening = large.select("network_id", F.lit(0).alias("part"), F.format_string("graph network%s {", F.col("network_id").cast("string")).alias("line"))
    return opening.unionByName(e).unionByName(large.select("network_id", F.lit(2).alias("part"), F.lit("}").alias("line")))


def connection_dot(best: DataFrame) -> DataFrame:
    """Edges between networks labelled by degree; unrelated ones are left out."""
    return best.where("degree is not null").select("net1", F.format_string('\t"%s" -- "%s" [label="%s"];', *[F.col(c).cast("string") for c in ("net1", "net2", "degree")]).alias("line"))


def write_dots(dots: DataFrame, path: str) -> None:
    """Folders for each network and part of its drawing; their files one after the other, in order of names, are the drawing (K5)."""
    dots.repartition("network_id", "part").write.mode("overwrite").partitionBy("network_id", "part").text(path)
