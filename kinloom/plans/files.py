"""Queries of the readers and writers: an overlay's rows as a file of each layout, read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.operators import segments
from kinloom.operators.recovery import fresh_folder
from kinloom.sources import readers, writers
from kinloom.sources.overlays import view


def line(*parts: str | Column, sep: str = " ") -> Column:
    """Column names and columns as the words of a line; nulls as NA."""
    return F.concat_ws(sep, *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("NA")) for p in parts])


def word(text: str) -> Column:
    return F.lit(text)


def written(df: DataFrame, value: Column, head: str = "", compression: str = "none") -> str:
    """A folder that holds a line for each row, after a header."""
    path, rows = fresh_folder(df.sparkSession), df.select(value.alias("value"))
    rows = df.sparkSession.createDataFrame([(head,)], "value string").union(rows) if head else rows
    rows.write.text(path, compression=compression)
    return path


def _file(name: str, value: Callable[[], Column], read: Callable, head: str = "", where: str = "true", compression: str = "none"):
    return lambda s, d: read(s, written(view(s, d, name).where(where), value(), head, compression))


def _estimates(s: SparkSession, d: str) -> DataFrame:
    final = segments.final_estimates(view(s, d, "ov_segments"))
    best = final.select("id1", "id2", "ancestors", "meioses", F.col("lnl").alias("ll_max"), "ll_null", "degree")
    bounds = final.selectExpr("id1", "id2", *[f"p{a}_{x} AS {x}{a}" for a in (2, 1, 0) for x in ("low", "high")])
    path = fresh_folder(s)
    writers.write_table(writers.estimates_table(best, bounds), path)
    return readers.read_estimates(s, path)


def _models(s: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(s)
    writers.write_table(writers.models_table(segments.models(view(s, d, "ov_segments"))), path)
    return readers.read_models(s, path).select("id1", "id2", "ancestors", "degree", F.round("lnl", 6).alias("lnl"))


def _pedigree(s: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(s)
    writers.write_table(writers.pedigree_table(view(s, d, "ov_fam").withColumn("fid", F.col("fid").cast("string"))), path)
    return readers.read_pedigree(s, path).select("fid", "iid", "pid", "mid", "sex")


def _tabs() -> Column:
    return line(line("id1", word("x")), line("id2", word("x")), "chrom", line("start_bp", "end_bp"), word("r"), word("r"), "cm", word("cM"), word("0"), word("0"), word("0"), sep="\t")


QUERIES = {
    "read_segments": _file("ov_segments", lambda: line("id1", "id2", "start_bp", "end_bp", "cm", "chrom", "ibd"), readers.read_segments, "id1 id2 start end cm chrom ibd"),
    "read_segments_tabs_gz": _file("ov_segments", _tabs, lambda s, p: readers.read_segments(s, p).drop("ibd"), compression="gzip"),
    "read_matches": _file("ov_segments", lambda: line(word("f"), "id1", word("f"), "id2", "chrom", "start_bp", "end_bp", word("a"), word("b"), word("9"), "cm", word("cM"), word("0"), "ibd", "ibd"), readers.read_matches),
    "read_haploid_segments": _file("ov_diploid", lambda: line(F.concat_ws(".", "id1", "hap1"), F.concat_ws("_", "id2", "hap2"), "start_bp", "end_bp", "cm", "chrom"), readers.read_haploid_segments),
    "read_genome": _file("ov_genome", lambda: line(word("0"), "iid1", word("0"), "iid2", word("OT"), word("0"), "z0", "z1", "z2", "pi_hat", word("-1"), word("0.7"), word("1"), word("2")), readers.read_genome, " FID1 IID1 FID2 IID2 RT EZ Z0 Z1 Z2 PI_HAT PHE DST PPC RATIO"),
    "read_likelihoods": _file("ov_genome", lambda: line(word("0"), "iid1", word("0"), "iid2", word("PC"), F.concat_ws(",", "z0", "z1", "z2", "pi_hat", "z0", "z1"), "z0", "z1", "z2", "pi_hat"), readers.read_likelihoods),
    "read_pairs": _file("ov_genome", lambda: line("iid2", "iid1"), readers.read_pairs),
    "read_mask": _file("ov_segments", lambda: line("chrom", "start_bp", "end_bp"), lambda s, p: readers.read_mask(s, p)[0], "chrom begin end", "cm >= 45"),
    "read_recombination": _file("ov_map", lambda: line("chrom", "pos", word("1.5"), "cm"), readers.read_recombination, "chrom pos rate cm"),
    "read_attributes": _file("ov_fam", lambda: line("fid", "iid", "sex"), lambda s, p: readers.read_attributes(s, p, recode={"1": "M", "2": "F"}), "FID IID SEX"),
    "read_haploid_matches": _file("ov_genome", lambda: line(word("0"), "iid1", word("0"), "iid2", F.col("z0") % 3 - 1), readers.read_haploid_matches),
    "read_traits": _file("ov_traits", lambda: line(word("0"), "iid", "btrait"), lambda s, p: readers.read_traits(s, p, True), "FID IID TRAIT"),
    "read_variants": _file("ov_variants", lambda: line("chrom", "snp_id", word("0"), "pos", "a1", "a2"), readers.read_variants),
    "read_eigenvec": _file("ov_pcs", lambda: line(word("0"), "iid", F.array_join("pcs", " ")), lambda s, p: readers.read_eigenvec(s, p).select("iid", F.size("pcs").alias("n"), F.round(F.col("pcs")[1], 5).alias("pc2")), "#FID IID PC1"),
    "read_populations": _file("ov_pcs", lambda: line("iid", "pop", sep="\t"), readers.read_populations, where="is_ref"),
    "estimates_file": _estimates,
    "models_file": _models,
    "pedigree_file": _pedigree,
}


def sql(models: str) -> dict[str, str]:
    """The same rows in SQL, from the overlays themselves; numbers that a file holds as text stay text."""
    t = lambda *names: ", ".join(f"CAST({n} AS VARCHAR) AS {n.split('.')[-1]}" for n in names)
    return {
        "read_segments": f"SELECT {t('id1', 'id2', 'chrom')}, start_bp, end_bp, cm, ibd FROM ov_segments WHERE cm >= 5",
        "read_segments_tabs_gz": f"SELECT {t('id1', 'id2', 'chrom')}, start_bp, end_bp, cm FROM ov_segments WHERE cm >= 5",
        "read_matches": f"SELECT {t('id1', 'id2', 'chrom')}, start_bp, end_bp, cm, ibd FROM ov_segments",
        "read_haploid_segments": """SELECT least(CAST(id1 AS VARCHAR), CAST(id2 AS VARCHAR)) AS id1, greatest(CAST(id1 AS VARCHAR), CAST(id2 AS VARCHAR)) AS id2, CASE WHEN CAST(id1 AS VARCHAR) > CAST(id2 AS VARCHAR) THEN hap2 ELSE hap1 END AS hap1,
 CASE WHEN CAST(id1 AS VARCHAR) > CAST(id2 AS VARCHAR) THEN hap1 ELSE hap2 END AS hap2, CAST(chrom AS VARCHAR) AS chrom, start_bp, end_bp, cm FROM ov_diploid""",
        "read_genome": f"SELECT '0' AS fid1, {t('iid1')}, '0' AS fid2, {t('iid2')}, CAST(z0 AS DOUBLE) AS z0, CAST(z1 AS DOUBLE) AS z1, CAST(z2 AS DOUBLE) AS z2, pi_hat FROM ov_genome",
        "read_likelihoods": f"SELECT '0' AS fid1, {t('iid1')}, '0' AS fid2, {t('iid2')}, 'PC' AS rel, CAST(z0 AS DOUBLE) AS pc, CAST(z1 AS DOUBLE) AS fs, CAST(z2 AS DOUBLE) AS hag, pi_hat AS cgh, CAST(z0 AS DOUBLE) AS dr, CAST(z1 AS DOUBLE) AS un, pi_hat FROM ov_genome",
        "read_pairs": "SELECT DISTINCT least(CAST(iid1 AS VARCHAR), CAST(iid2 AS VARCHAR)) AS id1, greatest(CAST(iid1 AS VARCHAR), CAST(iid2 AS VARCHAR)) AS id2 FROM ov_genome",
        "read_mask": f"SELECT {t('chrom')}, start_bp, end_bp FROM ov_segments WHERE cm >= 45",
        "read_recombination": f"SELECT {t('chrom')}, pos, CAST(1.5 AS DOUBLE) AS rate, cm FROM ov_map",
        "read_attributes": f"SELECT {t('fid', 'iid')}, CASE sex WHEN 1 THEN 'M' ELSE 'F' END AS value FROM ov_fam",
        "read_haploid_matches": f"SELECT {t('iid1', 'iid2')}, CAST(z0 % 3 - 1 AS INT) AS match FROM ov_genome UNION ALL SELECT CAST(iid2 AS VARCHAR), CAST(iid1 AS VARCHAR), CAST(z0 % 3 - 1 AS INT) FROM ov_genome",
        "read_traits": f"SELECT '0' AS fid, {t('iid')}, CAST(CASE btrait WHEN 0 THEN NULL ELSE btrait - 1 END AS DOUBLE) AS value FROM ov_traits",
        "read_variants": f"SELECT {t('chrom')}, snp_id, CAST(0 AS DOUBLE) AS cm, pos, a1, a2 FROM ov_variants",
        "read_eigenvec": f"SELECT {t('iid')}, CAST(len(pcs) AS INT) AS n, round(CAST(pcs[2] AS DOUBLE), 5) AS pc2 FROM ov_pcs",
        "read_populations": f"SELECT {t('iid')}, pop FROM ov_pcs WHERE is_ref",
        "models_file": f"WITH {models} SELECT {t('id1', 'id2')}, ancestors, CAST(degree AS INT) AS degree, round(lnl, 6) AS lnl FROM models",
        "pedigree_file": f"SELECT {t('fid', 'iid')}, CAST(nullif(pid, 0) AS VARCHAR) AS pid, CAST(nullif(mid, 0) AS VARCHAR) AS mid, sex FROM ov_fam",
    }
