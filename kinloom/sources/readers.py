"""Text inputs as frames.

Every reader takes a path that Spark reads (one file, a folder or a glob;
``.gz`` is unpacked by Spark) and gives typed columns.  Lines whose numbers do
not parse, such as headers wherever they stand, and empty lines are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinloom.operators.segments import map_position

#: Places of the columns of a table of pairwise estimates, from 1.
GENOME_COLUMNS = {"fid1": 1, "iid1": 2, "fid2": 3, "iid2": 4, "z0": 7, "z1": 8, "z2": 9, "pi_hat": 10}
#: Places of the columns of a table of one attribute of each person.
ATTRIBUTE_COLUMNS = {"fid": 1, "iid": 2, "value": 3}
_LINE = ["_path", "_block", "_line"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and three columns that order the lines of a file.

    Lines of one block stay in one task, so the running number orders them
    there, and the block's start orders the blocks.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return raw.withColumn("_line", F.monotonically_increasing_id())


def fields(spark: SparkSession, path: str) -> DataFrame:
    """``f``, the words of each line that has any, beside the columns that order lines.

    The one array is exploded, as Spark would otherwise put the split in place
    of ``f`` in the conditions that follow, and split a line once for each.
    """
    t = lines(spark, path).withColumn("value", F.trim(F.translate("value", "\t", " "))).where("value <> ''")
    return t.select("*", F.explode(F.array(F.split("value", r"\s+"))).alias("f"))


def at(place: int, to: str = "string") -> Column:
    """Word number ``place``, from 1; null if absent or not of the type."""
    return F.get("f", place - 1).try_cast(to)


def plain_id(c: Column) -> Column:
    """An id without its family's prefix and without ``.hap`` at the end."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*__", ""), r"\.hap$", "")


def last_token(c: Column) -> Column:
    """What follows the last underscore."""
    return F.element_at(F.split(c, "_"), -1)


def read_segments(spark: SparkSession, path: str, min_cm: float = 5.0) -> DataFrame:
    """Shared segments of either layout, at least ``min_cm`` long after rounding to hundredths.

    Lines of 11 tab-separated fields hold two ids with suffixes, the chromosome,
    both ends in one field, and the length in the seventh; others hold id1, id2,
    start, end, length, chromosome and, if there are seven, the state (1 or 2).
    """
    t = lines(spark, path).select(F.split("value", "\t").alias("f"), F.split(F.trim(F.translate("value", "\t", " ")), r"\s+").alias("w"))
    tab, word = (lambda i: F.get("f", i)), (lambda i: F.get("w", i))
    old, head = F.size("f") == 11, lambda i, k=0: F.get(F.split(tab(i), " "), k)
    pick = lambda a, b, to: F.when(old, a).otherwise(b).try_cast(to)
    out = t.select(
        pick(head(0), word(0), "string").alias("id1"), pick(head(1), word(1), "string").alias("id2"), pick(tab(2), word(5), "string").alias("chrom"),
        pick(head(3), word(2), "long").alias("start_bp"), pick(head(3, 1), word(3), "long").alias("end_bp"),
        F.round(pick(tab(6), word(4), "double"), 2).alias("cm"), F.when(~old & (F.size("w") == 7), word(6)).try_cast("int").alias("ibd"))
    return out.where(F.col("start_bp").isNotNull() & F.col("end_bp").isNotNull() & (F.col("cm") >= min_cm))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Segments of six words, or of twelve or more with the unit in the twelfth.

    A line of twelve words whose unit is not cM raises an error.
    """
    wide = F.size("f") >= 12
    unit = F.when(wide & (at(12) != "cM"), F.raise_error(F.concat(F.lit("length not in cM: "), at(12)))).otherwise(at(12))
    t = fields(spark, path).where(~F.col("value").startswith("#"))
    pick = lambda a, b, to: F.when(wide, at(a, to)).otherwise(at(b, to))
    out = t.select(
        pick(2, 1, "string").alias("id1"), pick(4, 2, "string").alias("id2"), pick(5, 6, "string").alias("chrom"), pick(6, 3, "long").alias("start_bp"), pick(7, 4, "long").alias("end_bp"),
        pick(11, 5, "double").alias("cm"), F.when(wide & (at(14) == "2") & (at(15) == "2"), 2).when(wide, 1).cast("int").alias("ibd"), unit.alias("unit"))
    return out.where("start_bp is not null and cm is not null and (unit is null or unit = 'cM')").drop("unit")


def read_recombination(spark: SparkSession, path: str) -> DataFrame:
    """A recombination map: chrom, pos, rate (cM for each Mb), cm."""
    return fields(spark, path).select(at(1).alias("chrom"), at(2, "long").alias("pos"), at(3, "double").alias("rate"), at(4, "double").alias("cm")).where("pos is not null and cm is not null")


def read_marker_segments(spark: SparkSession, path: str, markers: DataFrame, rec_map: DataFrame, chrom: str) -> DataFrame:
    """Segments given by marker numbers on one chromosome, in bp and cM.

    ``markers(chrom, marker, pos)``; lengths come from the map at both ends.
    """
    s = fields(spark, path).where(F.size("f") == 5).select(at(1).alias("id1"), at(2).alias("id2"), at(3, "long").alias("m1"), at(4, "long").alias("m2")).where("m1 is not null")
    place = markers.where(F.col("chrom") == chrom).select("chrom", "marker", "pos")
    cm = map_position(place.select("chrom", "pos").distinct(), rec_map).select("chrom", "pos", "cm").dropDuplicates(["chrom", "pos"])
    ends = place.join(cm, ["chrom", "pos"])
    first, last = (ends.select(F.col("marker").alias(f"m{i}"), F.col("pos").alias(p), F.col("cm").alias(f"cm{i}"), "chrom") for i, p in ((1, "start_bp"), (2, "end_bp")))
    return s.join(first, "m1").join(last.drop("chrom"), "m2").select("id1", "id2", "chrom", "start_bp", "end_bp", (F.col("cm2") - F.col("cm1")).alias("cm"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Wanted pairs, smaller id first."""
    return fields(spark, path).select(F.least(at(1), at(2)).alias("id1"), F.greatest(at(1), at(2)).alias("id2")).where("id2 is not null").distinct()


def restrict(df: DataFrame, pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """The rows of wanted pairs, whichever way round."""
    want = pairs.select(F.least("id1", "id2").alias("_lo"), F.greatest("id1", "id2").alias("_hi"))
    return df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)}).join(want, ["_lo", "_hi"], "left_semi").drop("_lo", "_hi")


def read_mask(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Masked regions, and the background means in the lines after them."""
    t = fields(spark, path)
    regions = t.select(at(1).alias("chrom"), at(2, "long").alias("start_bp"), at(3, "long").alias("end_bp")).where("start_bp is not null and end_bp is not null and chrom <> '#'")
    means = t.where("f[0] = '#'").select(at(2).alias("name"), at(3, "double").alias("value")).where("value is not null")
    return regions, means


def read_genome(spark: SparkSession, path: str, columns: Mapping[str, int] = GENOME_COLUMNS) -> DataFrame:
    """Pairwise estimates; ``columns`` gives each column's place, and absent shares are null."""
    places = GENOME_COLUMNS | dict(columns)
    out = fields(spark, path).select(*[at(places[c], "double" if c[0] in "zp" else "string").alias(c) for c in GENOME_COLUMNS])
    return out.where("pi_hat is not null and iid2 is not null")


def read_likelihoods(spark: SparkSession, path: str) -> DataFrame:
    """Likelihood vectors made before, one column for each class."""
    v = F.split(at(6), ",")
    out = fields(spark, path).select(at(1).alias("fid1"), at(2).alias("iid1"), at(3).alias("fid2"), at(4).alias("iid2"), at(5).alias("rel"), *[F.get(v, i).try_cast("double").alias(n) for i, n in enumerate(("pc", "fs", "hag", "cgh", "dr", "un"))], at(10, "double").alias("pi_hat"))
    return out.where("pc is not null")


def read_attributes(spark: SparkSession, path: str, columns: Mapping[str, int] = ATTRIBUTE_COLUMNS, recode: Mapping[str, str] | None = None) -> DataFrame:
    """One attribute (sex, age, state) of each person; the last line of an id counts."""
    places = ATTRIBUTE_COLUMNS | dict(columns)
    t = fields(spark, path).select(*[at(places[c]).alias(c) for c in ATTRIBUTE_COLUMNS], F.struct(*_LINE).alias("o")).where("iid is not null and upper(iid) <> 'IID'")
    if recode:
        t = t.replace(dict(recode), subset=["value"])
    return t.groupBy("iid").agg(F.max_by("fid", "o").alias("fid"), F.max_by("value", "o").alias("value"))


def read_haploid_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of mitochondria or Y of pairs, in both directions; the last line of a pair counts."""
    t = fields(spark, path).select(at(2).alias("iid1"), at(4).alias("iid2"), at(5, "int").alias("match"), F.struct(*_LINE).alias("o")).where("match in (-1, 0, 1)")
    both = t.unionByName(t.select(F.col("iid2").alias("iid1"), F.col("iid1").alias("iid2"), "match", "o"))
    # Rows are sorted by pair, so a task's memory grows with them: tasks grow with the input, eight for each of its splits.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * t.rdd.getNumPartitions())
    return both.repartition(tasks, "iid1", "iid2").groupBy("iid1", "iid2").agg(F.max_by("match", "o").alias("match"))


def read_traits(spark: SparkSession, path: str, binary: bool, missing: str = "0") -> DataFrame:
    """A trait of each person; binary ones go from 2 and 1 to 1 and 0, others raise an error."""
    raw, v = at(3), at(3, "double")
    known = F.when(raw.isin(missing, "NA"), None)
    value = known.when(v.isin(1.0, 2.0), v - 1).otherwise(F.raise_error(F.concat(F.lit("not a binary trait: "), raw)).cast("double")) if binary else known.otherwise(v)
    return fields(spark, path).where(at(2).isNotNull() & (F.upper(at(2)) != "IID")).select(at(1).alias("fid"), at(2).alias("iid"), value.cast("double").alias("value"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """A variant table: chrom, snp_id, cm, pos, a1, a2."""
    return fields(spark, path).select(at(1).alias("chrom"), at(2).alias("snp_id"), at(3, "double").alias("cm"), at(4, "long").alias("pos"), at(5).alias("a1"), at(6).alias("a2")).where("pos is not null")


def read_eigenvec(spark: SparkSession, path: str) -> DataFrame:
    """Component scores as one array, with or without a header."""
    t = fields(spark, path).where(~F.col("value").startswith("#"))
    pcs = F.transform(F.slice("f", 3, 1000), lambda x: x.try_cast("double"))
    return t.select(at(1).alias("fid"), at(2).alias("iid"), pcs.alias("pcs")).where("pcs[0] is not null")


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """Population of each reference sample."""
    return fields(spark, path).select(at(1).alias("iid"), at(2).alias("pop")).where("pop is not null")


def read_kde_grid(spark: SparkSession, path: str, rel: str) -> DataFrame:
    """A class's densities: line number is k1, place in the line is k0.

    The grid has as many lines as steps (1001 as published), which bounds the
    one sort that numbers them.
    """
    t = fields(spark, path).withColumn("k1", F.row_number().over(Window.partitionBy("_path").orderBy("_block", "_line")) - 1)
    return t.select(F.lit(rel).alias("rel"), "k1", F.posexplode("f").alias("k0", "d")).select("rel", "k0", "k1", F.col("d").try_cast("double").alias("density"))


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """People and their parents; ids lose the family's prefix, no parent is null."""
    parent = lambda i: F.nullif(plain_id(at(i)), F.lit("0"))
    missing = at(2).rlike("(?i)dummy|missing")
    t = fields(spark, path).where((F.size("f") >= 5) & (F.upper(at(2)) != "IID"))
    return t.select(at(1).alias("fid"), plain_id(at(2)).alias("iid"), parent(3).alias("pid"), parent(4).alias("mid"), at(5, "int").alias("sex"), at(6).alias("pheno"), missing.alias("is_missing"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Likelihood of each pair, number of ancestors and degree."""
    t = fields(spark, path).where(~F.col("value").startswith("#"))
    return t.select(at(1).alias("id1"), at(2).alias("id2"), at(3, "int").alias("ancestors"), at(4, "int").alias("degree"), at(5, "double").alias("lnl")).where("degree is not null and lnl is not null")


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """Degree of each pair and both likelihoods; no significant relation is a null degree."""
    t = fields(spark, path).where(~F.col("value").startswith("#"))
    return t.select(at(1).alias("id1"), at(2).alias("id2"), at(3, "int").alias("ancestors"), at(4, "int").alias("degree"), at(11, "double").alias("ll_max"), at(12, "double").alias("ll_null")).where("ll_null is not null")


def read_haploid_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of single haplotypes, ids as ``name.0`` or ``name_1``: the haplotypes apart from the names."""
    t = fields(spark, path).select(*[at(i).alias(f"r{i}") for i in (1, 2)], at(3, "long").alias("start_bp"), at(4, "long").alias("end_bp"), at(5, "double").alias("cm"), at(6).alias("chrom")).where("start_bp is not null and cm is not null")
    split = {f"{k}{i}": F.regexp_extract(f"r{i}", r"^(.*)[._]([01])(?:\.hap)?$", g) for i in (1, 2) for k, g in (("n", 1), ("h", 2))}
    t = t.withColumns(split).where("n1 <> n2 and h1 <> '' and h2 <> ''")
    swap = F.col("n1") > F.col("n2")
    return t.select(F.least("n1", "n2").alias("id1"), F.greatest("n1", "n2").alias("id2"), F.when(swap, F.col("h2")).otherwise(F.col("h1")).cast("int").alias("hap1"), F.when(swap, F.col("h1")).otherwise(F.col("h2")).cast("int").alias("hap2"), "chrom", "start_bp", "end_bp", "cm")
