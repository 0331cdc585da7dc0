"""Genetic tables derived from the test tables by integer arithmetic.

The same text runs in Spark (table names in braces are frames) and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

VIEWS = {
    "ov_segments": """
SELECT CAST(LEAST(a,b) AS BIGINT) AS id1, CAST(GREATEST(a,b) AS BIGINT) AS id2, chrom, start_bp, start_bp + CAST(cm*1000000 AS BIGINT) AS end_bp, cm, ibd FROM (
 SELECT 1 + l_orderkey % 60 AS a, 1 + (l_partkey * 7 + l_suppkey) % 60 AS b, CAST(1 + (l_orderkey + l_linenumber) % 22 AS INT) AS chrom,
 CAST(((l_partkey * 7919 + l_linenumber * 31) % 200) * 1000000 AS BIGINT) AS start_bp, CAST(l_quantity AS DOUBLE) AS cm,
 CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS ibd FROM {lineitem}) t WHERE a <> b""",
    "ov_genome": """
SELECT i AS iid1, j AS iid2, z0, z1, 1000 - z0 - z1 AS z2, (z1 + 2*(1000 - z0 - z1)) / CAST(2000 AS DOUBLE) AS pi_hat FROM (
 SELECT i, j, CASE WHEN h % 211 = 0 THEN 10 ELSE z0 END AS z0, CASE WHEN h % 211 = 0 THEN 50 WHEN h2 % 4 = 0 THEN (1000 - z0) - (1000 - z0) % 4 ELSE 1000 - z0 END AS z1 FROM (
 SELECT x.c_custkey + 1 AS i, y.c_custkey + 1 AS j, CASE WHEN (x.c_custkey*7919 + y.c_custkey*104729) % 97 < 3 THEN (x.c_custkey*31+y.c_custkey*17) % 900 ELSE 1000 - (x.c_custkey*13+y.c_custkey*29) % 90 END AS z0,
 x.c_custkey*3+y.c_custkey*5 AS h2, x.c_custkey*7919 + y.c_custkey*104729 AS h
 FROM {customer} x JOIN {customer} y ON x.c_custkey - x.c_custkey % 40 = y.c_custkey - y.c_custkey % 40 AND x.c_custkey < y.c_custkey) a) b""",
    "ov_fam": """
SELECT b + k AS iid, CASE WHEN k < 5 OR k BETWEEN 61 AND 70 THEN 0 WHEN k BETWEEN 140 AND 144 THEN b + 61 + 2*(k - 140) ELSE b + 2*c + 1 END AS pid,
 CASE WHEN k < 5 OR k BETWEEN 61 AND 70 THEN 0 WHEN k BETWEEN 140 AND 144 THEN b + 62 + 2*(k - 140) WHEN k >= 16 AND k % 11 = 0 THEN b + 2*c ELSE b + 2*c + 2 END AS mid,
 CASE WHEN k % 23 = 0 THEN 1 + k % 2 WHEN k % 2 = 1 THEN 1 ELSE 2 END AS sex, 20 + k % 70 AS age, b AS fid FROM (
 SELECT c_custkey - c_custkey % 200 AS b, c_custkey % 200 + 1 AS k, CAST((c_custkey % 200 + 1 - (c_custkey % 200 + 1) % 8) / 8 AS BIGINT) AS c FROM {customer}) t""",
    "ov_kin_fam": """
SELECT b + k + 1 AS iid, f AS fid, k, CASE WHEN k < 2 OR k IN (5, 6) THEN 0 WHEN k < 5 THEN b + 1 WHEN k < 9 THEN b + 3 WHEN k < 11 THEN b + 7 ELSE b + 5 END AS pid,
 CASE WHEN k < 2 OR k IN (5, 6) THEN 0 WHEN k < 5 THEN b + 2 WHEN k < 9 THEN b + 6 WHEN k < 11 THEN b + 4 ELSE 0 END AS mid,
 CASE WHEN k IN (1, 3, 5) OR k >= 7 AND (f + k) % 2 = 0 THEN 2 ELSE 1 END AS sex, CASE WHEN k < 2 THEN 80 + k WHEN k < 7 THEN 50 + k ELSE 15 + k END AS age,
 CASE WHEN k < 2 THEN 0 WHEN k IN (5, 6) THEN 3 WHEN k < 5 THEN 1 ELSE 2 END AS gen, NOT (k = f % 13 OR k = (5 * f + 3) % 29) AS sampled FROM (
 SELECT c_custkey - c_custkey % 12 AS b, c_custkey % 12 AS k, CAST((c_custkey - c_custkey % 12) / 12 AS BIGINT) AS f FROM {customer}) t""",
    "ov_kin_genome": """
SELECT iid1, iid2, z0, z1, 1000 - z0 - z1 AS z2, (z1 + 2 * (1000 - z0 - z1)) / CAST(2000 AS DOUBLE) AS pi_hat FROM (
 SELECT iid1, iid2, CASE rel WHEN 1 THEN h WHEN 2 THEN 245 + h WHEN 3 THEN 495 + h WHEN 4 THEN 745 + h WHEN 5 THEN 640 WHEN 6 THEN 650 ELSE 1000 - h END AS z0,
 CASE rel WHEN 1 THEN 1000 - h WHEN 2 THEN 505 - h WHEN 3 THEN 505 - h WHEN 4 THEN 255 - h WHEN 5 THEN 360 WHEN 6 THEN 350 ELSE h END AS z1 FROM (
 SELECT x.iid AS iid1, y.iid AS iid2, (x.iid * 31 + y.iid * 17) % 10 AS h, CASE
 WHEN x.k = 2 AND y.k = 9 AND x.fid % 7 = 3 THEN 5 WHEN x.k = 2 AND y.k = 9 AND x.fid % 7 = 5 THEN 6
 WHEN y.pid = x.iid OR y.mid = x.iid THEN 1 WHEN x.gen = 1 AND y.gen = 1 OR x.gen = 2 AND y.gen = 2 AND x.pid = y.pid THEN 2
 WHEN x.gen = 0 AND y.gen = 2 OR x.gen = 1 AND y.gen = 2 THEN 3 WHEN x.gen = 2 AND y.gen = 2 THEN 4 ELSE 0 END AS rel
 FROM ov_kin_fam x JOIN ov_kin_fam y ON x.fid = y.fid AND x.iid < y.iid WHERE x.sampled AND y.sampled) a) b""",
    "ov_kin_peds": """
SELECT fid AS network_id, pedigree, iid, CASE WHEN pid = 0 OR k = 11 AND pedigree = 2 THEN NULL ELSE pid END AS pid, CASE WHEN k = 11 AND pedigree = 2 THEN iid - 8 WHEN mid = 0 THEN NULL ELSE mid END AS mid, sampled,
 CAST(0 AS DOUBLE) - CAST(CASE pedigree WHEN 1 THEN fid % 5 ELSE fid * 3 % 5 END AS DOUBLE) AS lnl FROM ov_kin_fam x CROSS JOIN (SELECT 1 AS pedigree UNION ALL SELECT 2 AS pedigree) y""",
    "ov_kin_segments": """
SELECT CAST(LEAST(a, b) AS BIGINT) AS id1, CAST(GREATEST(a, b) AS BIGINT) AS id2, chrom, start_bp, start_bp + CAST(cm * 1000000 AS BIGINT) AS end_bp, cm, 1 AS ibd FROM (
 SELECT x.iid AS a, 12 * (x.fid + 1 - 2 * (x.fid % 2)) + l_suppkey % 12 + 1 AS b, CAST(1 + (l_orderkey + l_linenumber) % 22 AS INT) AS chrom, CAST(((l_partkey * 7919 + l_linenumber * 31) % 200) * 1000000 AS BIGINT) AS start_bp, CAST(l_quantity AS DOUBLE) AS cm
 FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey JOIN ov_kin_fam x ON x.iid = o_custkey + 1 WHERE x.sampled AND l_quantity < 5 + x.fid % 45) t JOIN ov_kin_fam y ON y.iid = b AND y.sampled""",
    "ov_traits": """
SELECT c_custkey + 1 AS iid, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS qtrait,
 CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS btrait FROM {customer}""",
    "ov_variants": """
SELECT p_partkey AS vid, CONCAT('rs', CAST(p_partkey - p_partkey % 40 % 3 AS STRING)) AS snp_id, 1 + p_partkey % 26 AS chrom, CAST(p_size AS BIGINT) * 1000 + p_partkey % 7 AS pos,
 SUBSTRING('AACG0A', CAST(p_partkey % 6 + 1 AS INT), 1) AS a1, SUBSTRING('CGTAAT', CAST(p_partkey % 6 + 1 AS INT), 1) AS a2 FROM {part}""",
    "ov_ref_variants": """
SELECT p_partkey AS vid, CONCAT('rs', CAST(p_partkey - p_partkey % 40 % 3 AS STRING)) AS snp_id, SUBSTRING('ATCGAG', CAST((p_partkey - p_partkey % 6) / 6 AS INT) % 6 + 1, 1) AS r1, SUBSTRING('CGTATT', CAST((p_partkey - p_partkey % 6) / 6 AS INT) % 6 + 1, 1) AS r2 FROM {part} WHERE p_partkey % 7 <> 1""",
    "ov_genotypes": """
SELECT iid, vid, CASE WHEN MIN(h) % 23 = 0 THEN NULL ELSE CAST(MIN(h) % 3 AS INT) END AS dosage FROM (
 SELECT l_orderkey % 200 AS iid, l_partkey % 500 AS vid, l_linenumber + l_suppkey % 11 AS h FROM {lineitem}) t GROUP BY iid, vid""",
    "ov_haploid": """
SELECT l_suppkey % 40 AS iid, l_partkey % 300 AS site, MIN(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE '0' END) AS allele FROM {lineitem} GROUP BY l_suppkey % 40, l_partkey % 300""",
    "ov_map": """
SELECT chrom, MIN(p_size) AS cm_step, pos_mb * CAST(1000000 AS BIGINT) AS pos, CAST(SUM(SUM(p_size)) OVER (PARTITION BY chrom ORDER BY pos_mb) AS DOUBLE) / 50 AS cm FROM (
 SELECT CAST(1 + p_partkey % 22 AS INT) AS chrom, p_partkey % 250 AS pos_mb, p_size FROM {part}) t GROUP BY chrom, pos_mb""",
    "ov_pcs": """
SELECT vec_id AS iid, embedding AS pcs, CASE label WHEN 0 THEN 'CEU' WHEN 1 THEN 'CHB' WHEN 2 THEN 'YRI' WHEN 3 THEN 'GIH' WHEN 4 THEN 'PUR' WHEN 5 THEN 'FIN' WHEN 6 THEN 'JPT' WHEN 7 THEN 'LWK' WHEN 8 THEN 'XXX' ELSE 'ASW' END AS pop, vec_id % 2 = 0 AS is_ref FROM {embeddings}""",
    "ov_diploid": """
SELECT CAST(LEAST(a,b) AS BIGINT) AS id1, CAST(GREATEST(a,b) AS BIGINT) AS id2, hap1, hap2, chrom, start_bp, start_bp + CAST(cm*1000000 AS BIGINT) AS end_bp, cm FROM (
 SELECT 1 + l_orderkey % 60 AS a, 1 + (l_partkey * 7 + l_suppkey) % 60 AS b, l_suppkey % 2 AS hap1, l_partkey % 2 AS hap2, CAST(1 + (l_orderkey + l_linenumber) % 22 AS INT) AS chrom,
 CAST(((l_partkey * 7919 + l_linenumber * 31) % 200) * 1000000 AS BIGINT) AS start_bp, CAST(l_quantity AS DOUBLE) AS cm FROM {lineitem}) t WHERE a <> b""",
}


def _inlined(text: str) -> str:
    """An overlay's text with the overlays that it names in place of their names."""
    return re.sub(r"\b(FROM|JOIN) (ov_\w+)\b", lambda m: f"{m[1]} ({_inlined(VIEWS[m[2]])})", text)


#: A table that a view multiplies, and what its rows meet by: they are dealt out by it first, as a few small files would leave all pairs to a few tasks.
DEALT = {"ov_genome": ("customer", "c_custkey - c_custkey % 40"), "ov_kin_genome": ("customer", "CAST((c_custkey - c_custkey % 12) / 12 AS BIGINT)")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An overlay as a frame over the tables in ``sf_dir``."""
    text = _inlined(VIEWS[name])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    if name in DEALT:
        table, by = DEALT[name]
        frames[table] = frames[table].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.expr(by))
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """DuckDB text with the overlays that it names as common tables."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    tables = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', _inlined(VIEWS[n]))})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {tables}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {tables}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {tables} {body}"
