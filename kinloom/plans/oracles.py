"""The queries in DuckDB's SQL, over the overlay views."""

from __future__ import annotations

from kinloom.plans import files

G = 3525.48101
RATE = 1 / (3.197036753 - 2.5)
SIB = 0.75 * 22 + G / 100 * 4 * 0.1875
SPEED = 2 * SIB / (G * 0.75)
_MIX = " + ".join(f"{0.5 * SPEED!r} * pow(x * {0.5 * SPEED!r}, {k}) / {__import__('math').factorial(k)}" for k in range(9))

#: Every model's lnL by an explicit split of each pair's sorted segments.
MODELS = f"""
x AS (SELECT id1, id2, cm - 2.5 AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY id1, id2) AS s, sum(cm - 2.5) OVER (PARTITION BY id1, id2) AS tx
  FROM ov_segments WHERE cm >= 5 WINDOW w AS (PARTITION BY id1, id2 ORDER BY cm DESC, chrom DESC, start_bp DESC, end_bp DESC)),
cum AS (SELECT id1, id2, k, s, tx, sum(x) OVER v AS rx, sum(ln({_MIX}) - x * {SPEED!r}) OVER v AS rm FROM x WINDOW v AS (PARTITION BY id1, id2 ORDER BY k)
  UNION ALL SELECT DISTINCT id1, id2, 0, s, tx, 0.0, 0.0 FROM x),
sp AS (SELECT *, -13.73 + (s - k) * ln(13.73) - lgamma(s - k + 1) + (s - k) * ln({RATE!r}) - (tx - rx) * {RATE!r} AS bg, lgamma(k + 1) AS lf FROM cum),
m AS (SELECT sp.*, n, ({G / 100!r} * (n - 1) + 22) AS b0, CASE WHEN n > 1 THEN {G!r} / ({G / 100!r} * (n - 1) + 22) ELSE 3525.48101 / 22 END AS e0,
  ({G / 100!r} * n + 22) AS b1, {G!r} / ({G / 100!r} * n + 22) AS e1 FROM sp, (SELECT unnest(generate_series(1, 40)) AS n) t),
r AS (SELECT *, b0 * exp(-2.5 / e0) * pow(0.5, n - 1) AS l0, b1 * exp(-2.5 / e1) * pow(0.5, n - 1) AS l1, 2 * b1 * exp(-2.5 * n / 100) * pow(0.5, n - 1) AS l2,
  CASE WHEN n = 2 THEN {G * .75 / SIB!r} ELSE {G * .5 / SIB!r} END AS en FROM m),
v AS (SELECT id1, id2, n, k, bg, bg - l0 + k * ln(l0) - lf - k * ln(e0) - rx / e0 AS v0,
  bg - l1 + k * ln(l1) - lf - k * ln(e1) - rx / e1 AS v1,
  CASE WHEN n IN (2, 3) THEN bg - {SIB!r} + k * ln({SIB!r}) - lf + CASE WHEN n = 2 THEN rm ELSE -k * ln(en) - rx / en END
       ELSE bg - l2 + k * ln(l2) - lf - k * ln(100.0 / n) - rx * n / 100 END AS v2 FROM r),
best AS (SELECT id1, id2, n, max(v0) AS v0, max(v1) AS v1, max(v2) AS v2, max(CASE WHEN k = 0 THEN bg END) AS ll_null FROM v GROUP BY id1, id2, n),
models AS (SELECT id1, id2, 0 AS ancestors, n AS meioses, v0 AS lnl, ll_null, n AS degree FROM best
  UNION ALL SELECT id1, id2, 1, n, v1, ll_null, n FROM best WHERE n > 1 UNION ALL SELECT id1, id2, 2, n, v2, ll_null, n - 1 FROM best WHERE n > 1)
"""
MARGIN = 2.995732273553991
BEST = f"""
top AS (SELECT id1, id2, ancestors, meioses, degree, lnl, ll_null, row_number() OVER (PARTITION BY id1, id2 ORDER BY round(lnl, 6) DESC, meioses, CASE ancestors WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END) AS rn FROM models),
best_model AS (SELECT id1, id2, ancestors, meioses, round(lnl, 6) AS lnl, round(ll_null, 6) AS ll_null, CASE WHEN ll_null + {MARGIN} < lnl THEN degree END AS degree FROM top WHERE rn = 1)
"""
WEIGHTS = """
w AS (SELECT *, exp(lnl - max(lnl) OVER (PARTITION BY id1, id2)) AS e FROM models WHERE degree BETWEEN 2 AND 40),
weights AS (SELECT id1, id2, round(sum(CASE WHEN degree = 2 THEN e ELSE 0 END) / sum(e), 6) AS p2, round(sum(CASE WHEN degree = 3 THEN e ELSE 0 END) / sum(e), 6) AS p3,
  round(sum(CASE WHEN degree BETWEEN 4 AND 7 THEN e ELSE 0 END) / sum(e), 6) AS p4_7, round(sum(CASE WHEN degree >= 8 THEN e ELSE 0 END) / sum(e), 6) AS p8 FROM w GROUP BY id1, id2)
"""
_KDE = ", ".join(f"exp(-((g0 - {a}) * (g0 - {a}) + (g1 - {b}) * (g1 - {b})) / (2.0 * {w} * {w})) / ({w} * {w}) * 1000 AS {c}" for c, (a, b, w) in {"pc": (0, 1000, 40), "fs": (250, 500, 60), "hag": (500, 500, 60), "cgh": (750, 250, 60), "dr": (900, 100, 50), "un": (1000, 0, 40)}.items())
CLASSES = f"""
g AS (SELECT iid1, iid2, pi_hat, z0 AS k0, CASE WHEN z0 < 10 AND z1 > 900 THEN least(1000, z1 + z2) ELSE z1 END AS k1, CASE WHEN z0 < 10 AND z1 > 900 THEN 0 ELSE z2 END AS k2 FROM ov_genome),
gg AS (SELECT *, k0 // 10 * 10 AS g0, k1 // 10 * 10 AS g1 FROM g),
dens AS (SELECT iid1, iid2, pi_hat, k0, k1, k2, {_KDE} FROM gg),
adj AS (SELECT *, pc + CASE WHEN k1 > 800 THEN 1.0 ELSE 0.0 END AS pc1 FROM dens),
none AS (SELECT *, (pc1 + fs + hag + cgh + dr + un) < 1e-6 AS nil FROM adj),
hard AS (SELECT iid1, iid2, pi_hat, nil AND k2 > 800 AS mz, pc1 AS pc, fs + CASE WHEN nil AND k2 > 800 THEN 100.0 ELSE 0.0 END AS fs,
  hag + CASE WHEN nil AND NOT k2 > 800 AND k1 > 600 AND k1 < 800 AND k0 + k1 > 900 THEN 100.0 ELSE 0.0 END AS hag, cgh, dr,
  un + CASE WHEN nil AND NOT k2 > 800 AND k1 < 100 AND k0 + k2 > 900 THEN 100.0 ELSE 0.0 END AS un FROM none),
nrm AS (SELECT iid1, iid2, pi_hat, mz, pc / t AS pc, fs / t AS fs, hag / t AS hag, cgh / t AS cgh, dr / t AS dr, un / t AS un FROM (SELECT *, pc + fs + hag + cgh + dr + un AS t FROM hard)),
mv AS (SELECT iid1, iid2, pi_hat, mz, CASE WHEN pc > .3 AND hag > .3 THEN pc + hag ELSE pc END AS pc, fs, CASE WHEN pc > .3 AND hag > .3 THEN 0.0 ELSE hag END AS hag, cgh, dr, un FROM nrm),
rd AS (SELECT iid1, iid2, pi_hat, mz, round(pc, 6) AS pc, round(fs, 6) AS fs, round(hag, 6) AS hag, round(cgh, 6) AS cgh, round(dr, 6) AS dr, round(un, 6) AS un FROM mv),
classes AS (SELECT *, CASE WHEN greatest(pc, fs, hag, cgh, dr, un) < .3 THEN 'FAIL' WHEN un >= greatest(pc, fs, hag, cgh, dr) THEN 'UN' WHEN dr >= greatest(pc, fs, hag, cgh) THEN 'DR' WHEN cgh >= greatest(pc, fs, hag) THEN 'CGH'
  WHEN hag >= greatest(pc, fs) THEN 'HAG' WHEN fs >= pc THEN 'FS' ELSE 'PC' END AS rel,
  concat_ws(',', CASE WHEN pc > .3 THEN 'PC' END, CASE WHEN fs > .3 THEN 'FS' END, CASE WHEN hag > .3 THEN 'HAG' END, CASE WHEN cgh > .3 THEN 'CGH' END, CASE WHEN dr > .3 THEN 'DR' END, CASE WHEN un > .3 THEN 'UN' END) AS possible FROM rd)
"""
COMPONENTS = CLASSES + """,
ed AS (SELECT iid1, iid2, pi_hat FROM classes WHERE pi_hat > 0.09375 AND possible <> 'UN'),
e AS (SELECT iid1 AS a, iid2 AS b FROM ed UNION SELECT iid2, iid1 FROM ed),
p AS (SELECT DISTINCT iid1 AS iid FROM ov_genome UNION SELECT iid2 FROM ov_genome),
reach(a, b) AS (SELECT iid, iid FROM p UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
members AS (SELECT a AS iid, min(b) AS network_id FROM reach GROUP BY a)
"""
PO = """
po AS (SELECT pid AS p, iid AS c FROM ov_fam WHERE pid <> 0 UNION SELECT mid, iid FROM ov_fam WHERE mid <> 0)
"""
RELATIONS = PO + """,
sib AS MATERIALIZED (SELECT x.c AS a, y.c AS b, count(*) AS k FROM po x JOIN po y ON x.p = y.p AND x.c <> y.c GROUP BY ALL),
fs AS MATERIALIZED (SELECT a, b FROM sib WHERE k = 2), hs AS MATERIALIZED (SELECT a, b FROM sib WHERE k = 1),
gp AS MATERIALIZED (SELECT DISTINCT x.c AS a, y.p AS b FROM po x JOIN po y ON x.p = y.c), gc AS MATERIALIZED (SELECT b AS a, a AS b FROM gp),
av AS MATERIALIZED (SELECT DISTINCT po.c AS a, fs.b FROM po JOIN fs ON po.p = fs.a WHERE po.c <> fs.b), nn AS MATERIALIZED (SELECT DISTINCT fs.a, po.c AS b FROM fs JOIN po ON fs.b = po.p WHERE fs.a <> po.c),
allr AS MATERIALIZED (SELECT c AS a, p AS b, 'P' AS code, 0 AS o FROM po UNION ALL SELECT p, c, 'O', 1 FROM po UNION ALL SELECT a, b, 'F', 2 FROM fs UNION ALL SELECT a, b, 'N', 3 FROM nn UNION ALL SELECT a, b, 'H', 4 FROM hs
 UNION ALL SELECT a, b, 'G', 5 FROM gp UNION ALL SELECT a, b, 'A', 6 FROM av UNION ALL SELECT a, b, 'C', 7 FROM gc
 UNION ALL SELECT gc.a, po.c, 'GC', 8 FROM gc JOIN po ON gc.b = po.p UNION ALL SELECT hs.a, po.c, 'HN', 9 FROM hs JOIN po ON hs.b = po.p UNION ALL SELECT po.c, hs.b, 'HA', 10 FROM po JOIN hs ON po.p = hs.a
 UNION ALL SELECT gp.a, po.p, 'GG', 11 FROM gp JOIN po ON gp.b = po.c UNION ALL SELECT av.a, po.c, '1C', 12 FROM av JOIN po ON av.b = po.p UNION ALL SELECT gp.a, fs.b, 'GA', 13 FROM gp JOIN fs ON gp.b = fs.a
 UNION ALL SELECT nn.a, po.c, 'GN', 14 FROM nn JOIN po ON nn.b = po.p),
rel AS MATERIALIZED (SELECT a AS self, b AS rel, arg_min(code, o) AS code FROM allr WHERE a <> b GROUP BY a, b)
"""
MERGED = """
mk AS (SELECT chrom, start_bp, start_bp + 8000000 AS end_bp FROM ov_segments WHERE cm >= 49 AND ibd = 2),
mn AS (SELECT *, max(end_bp) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mk),
mi AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_bp > reach + 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp) AS island FROM mn),
mask AS (SELECT chrom, min(start_bp) AS start_bp, max(end_bp) AS end_bp FROM mi GROUP BY chrom, island)
"""

SQL = {
    "segment_pair_rollup": "SELECT id1, id2, count(*) AS n_segments, sum(cm) AS total_cm, max(cm) AS longest_cm, sum(CASE WHEN ibd = 2 THEN cm ELSE 0.0 END) AS ibd2_cm FROM ov_segments WHERE cm >= 5 GROUP BY id1, id2",
    "segment_degree_mle": f"WITH {MODELS}, {BEST} SELECT * FROM best_model",
    "degree_ci": f"""WITH {MODELS}, t AS (SELECT *, max(lnl) OVER (PARTITION BY id1, id2) AS top FROM models)
SELECT id1, id2, {', '.join(f'{f}(CASE WHEN ancestors = {a} THEN degree END) AS p{a}_{n}' for a in (2, 1, 0) for f, n in (('min', 'low'), ('max', 'high')))} FROM t WHERE lnl + {MARGIN} >= top GROUP BY id1, id2""",
    "degree_override": "SELECT id1, id2, sum(cm) AS total_cm, CASE WHEN sum(cm) > 0.75 * 3525.48101 + 2.33 * sqrt(0.75 * 3525.48101 / 100 * 4 * 625) THEN 'PO' WHEN sum(cm) / 3525.48101 > 0.625 THEN 'SIB' ELSE 'NONE' END AS forced FROM ov_segments WHERE cm >= 5 GROUP BY id1, id2",
    "degree_bucket_weights": f"WITH {MODELS}, {WEIGHTS} SELECT * FROM weights",
    "vector_fusion": f"""WITH {MODELS}, {WEIGHTS}, {CLASSES}, j AS (SELECT iid1, iid2, pc, fs, hag, cgh, dr, un, pc + fs AS near, p2, p3, p4_7, p8 FROM classes LEFT JOIN weights ON iid1 = id1 AND iid2 = id2)
SELECT iid1, iid2, round(CASE WHEN near < .4 AND p2 IS NULL THEN 0.0 ELSE pc END, 6) AS pc, round(CASE WHEN near < .4 AND p2 IS NULL THEN 0.0 ELSE fs END, 6) AS fs,
 {', '.join(f"round(CASE WHEN near >= .4 THEN {c} WHEN p2 IS NULL THEN {d} ELSE {p} * (1 - near) END, 6) AS {c}" for c, p, d in (('hag', 'p2', '0.0'), ('cgh', 'p3', '0.0'), ('dr', 'p4_7', '0.0'), ('un', 'p8', '1.0')))} FROM j""",
    "control_stats": "WITH s AS (SELECT count(*) AS n, avg(cm) AS mean_cm FROM ov_segments WHERE cm BETWEEN 2.5 AND 10), p AS (SELECT count(*) AS people FROM (SELECT id1 FROM ov_segments UNION SELECT id2 FROM ov_segments)) SELECT people, n / (people * (people - 1) / 2.0) AS pois_mean, mean_cm, 1 / (mean_cm - 2.5) AS exp_rate FROM s, p",
    "overlap_density": """WITH s AS (SELECT DISTINCT id1, id2, chrom, start_bp, end_bp, cm, ibd FROM ov_segments) SELECT a.id1, a.id2, a.chrom, a.start_bp, a.end_bp, a.cm, a.ibd, count(*) AS n_over,
 round(sum(a.cm * (least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp)) / (a.end_bp - a.start_bp)), 4) AS shared_cm FROM s a JOIN s b ON a.chrom = b.chrom AND a.start_bp <= b.end_bp AND b.start_bp <= a.end_bp
 AND (a.id1, a.id2, a.start_bp, a.end_bp, a.cm, a.ibd) IS DISTINCT FROM (b.id1, b.id2, b.start_bp, b.end_bp, b.cm, b.ibd) GROUP BY ALL""",
    "mask_merge": f"WITH {MERGED} SELECT * FROM mask",
    "map_interpolate": """WITH q AS (SELECT DISTINCT chrom, start_bp + 500000 AS pos FROM ov_segments)
SELECT q.chrom, q.pos, round(coalesce(b.cm + (q.pos - b.pos) * 1.0 / (a.pos - b.pos) * (a.cm - b.cm), b.cm, 0.0), 6) AS cm FROM q ASOF LEFT JOIN ov_map b ON q.chrom = b.chrom AND q.pos > b.pos ASOF LEFT JOIN ov_map a ON q.chrom = a.chrom AND q.pos <= a.pos""",
    "dedup_keep_last": "SELECT id1, id2, chrom, start_bp, end_bp, cm, ibd FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2, chrom, start_bp ORDER BY cm DESC, ibd DESC) AS rn FROM ov_segments) WHERE rn = 1",
    "ibd2_sweep": """WITH c AS (SELECT DISTINCT id1, id2, chrom, unnest([start_bp, end_bp]) AS b FROM ov_diploid), p AS (SELECT *, lead(b) OVER (PARTITION BY id1, id2, chrom ORDER BY b) AS e FROM c),
 m AS (SELECT p.id1, p.id2, p.chrom, b, e, hap1, hap2, d.start_bp, d.end_bp, cm FROM p JOIN ov_diploid d ON p.id1 = d.id1 AND p.id2 = d.id2 AND p.chrom = d.chrom AND d.start_bp <= b AND d.end_bp >= e WHERE e IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, chrom, b ORDER BY CASE WHEN start_bp = b AND end_bp = e THEN 0 ELSE 1 END, start_bp, end_bp, hap1, hap2, cm) AS rn FROM m)
SELECT id1, id2, chrom, b AS start_bp, e AS end_bp, round(max(CASE WHEN rn = 1 THEN CASE WHEN start_bp = b AND end_bp = e THEN cm ELSE cm * (e - b) / (end_bp - start_bp) END END), 6) AS cm,
 CASE WHEN list_sort(list(DISTINCT hap1 * 2 + hap2)) = [1, 2] THEN 2 ELSE 1 END AS ibd FROM r GROUP BY id1, id2, chrom, b, e""",
    "related_edges": "SELECT iid1, iid2, pi_hat FROM ov_genome WHERE pi_hat > 0.09375",
    "relationship_class": f"WITH {CLASSES} SELECT * FROM classes",
    "mz_pairs": f"WITH {CLASSES} SELECT iid1, iid2 FROM classes WHERE mz",
    "family_networks": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM members",
    "network_density": f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT network_id, count(*) AS n FROM members GROUP BY 1), k AS (SELECT network_id, count(*) AS e FROM ed JOIN members ON iid = iid1 GROUP BY 1)
SELECT network_id, n, coalesce(k.e, 0) AS e, round(2.0 * coalesce(k.e, 0) / (n * (n - 1)), 6) AS density FROM s LEFT JOIN k USING (network_id) WHERE n > 1""",
    "trait_fold": "SELECT iid, round(abs(qtrait - (SELECT avg(qtrait) FROM ov_traits)), 6) AS fold, CASE btrait WHEN 2 THEN 1 WHEN 1 THEN 0 END AS affected FROM ov_traits",
    "pedigree_relations": f"WITH {RELATIONS} SELECT * FROM rel",
    "relation_table": f"""WITH {RELATIONS} SELECT least(self, rel) AS iid1, greatest(self, rel) AS iid2, coalesce(max(code) FILTER (self < rel), '') AS rels12, coalesce(max(code) FILTER (self > rel), '') AS rels21 FROM rel GROUP BY 1, 2""",
    "pedigree_degrees": f"""WITH {RELATIONS} SELECT least(self, rel) AS iid1, greatest(self, rel) AS iid2, CAST(min(CASE WHEN code IN ('P', 'O', 'F') THEN 1 WHEN code IN ('N', 'H', 'G', 'A', 'C') THEN 2 ELSE 3 END) AS INT) AS degree FROM rel GROUP BY 1, 2""",
    "ancestor_closure": f"WITH RECURSIVE {PO}, anc(iid, ancestor, depth) AS (SELECT c, p, 1 FROM po UNION SELECT anc.iid, po.p, depth + 1 FROM anc JOIN po ON anc.ancestor = po.c) SELECT iid, ancestor, CAST(min(depth) AS INT) AS depth FROM anc GROUP BY 1, 2",
    "genetic_relatives": f"""WITH RECURSIVE {PO}, anc(iid, ancestor) AS (SELECT iid, iid FROM ov_fam UNION SELECT anc.iid, po.p FROM anc JOIN po ON anc.ancestor = po.c)
SELECT DISTINCT x.iid, y.iid AS relative FROM anc x JOIN (SELECT * FROM anc UNION SELECT p, p FROM po) y ON x.ancestor = y.ancestor WHERE x.iid <> y.iid""",
    "founders_leafs": f"WITH {PO} SELECT iid, pid = 0 AND mid = 0 AS founder, iid NOT IN (SELECT p FROM po) AS leaf FROM ov_fam",
    "generation_levels": f"WITH RECURSIVE {PO}, l(iid, anc, level) AS (SELECT iid, iid, 0 FROM ov_fam UNION SELECT l.iid, po.p, level + 1 FROM l JOIN po ON l.anc = po.c) SELECT iid, CAST(max(level) AS INT) AS level FROM l GROUP BY iid",
    "sex_conflicts": "WITH n AS (SELECT pid AS iid, 1 AS need FROM ov_fam UNION SELECT mid, 2 FROM ov_fam) SELECT iid, sex, need FROM n JOIN ov_fam f USING (iid) WHERE iid <> 0 AND sex <> 0 AND sex <> need",
    "age_flags": f"""WITH {RELATIONS}, j AS (SELECT self, rel.rel, code, b.age - a.age AS gap FROM rel JOIN ov_fam a ON a.iid = self JOIN ov_fam b ON b.iid = rel.rel),
f AS (SELECT self, rel, code, CASE
 WHEN code IN ('P', 'O') THEN CASE WHEN CASE code WHEN 'P' THEN gap ELSE -gap END < 13 THEN 'parent too young' WHEN CASE code WHEN 'P' THEN gap ELSE -gap END > 50 THEN 'parent too old' END
 WHEN code IN ('G', 'C') THEN CASE WHEN CASE code WHEN 'G' THEN gap ELSE -gap END < 26 THEN 'grandparent too young' WHEN CASE code WHEN 'G' THEN gap ELSE -gap END > 100 THEN 'grandparent too old' END
 WHEN code IN ('GG', 'GC') THEN CASE WHEN CASE code WHEN 'GG' THEN gap ELSE -gap END < 39 THEN 'great-grandparent too young' WHEN CASE code WHEN 'GG' THEN gap ELSE -gap END > 150 THEN 'great-grandparent too old' END
 WHEN code IN ('A', 'HA', 'N', 'HN') THEN CASE WHEN CASE WHEN code IN ('A', 'HA') THEN gap ELSE -gap END < -10 THEN 'avuncular too young' WHEN CASE WHEN code IN ('A', 'HA') THEN gap ELSE -gap END > 50 THEN 'avuncular too old' END
 WHEN code IN ('GA', 'GN') THEN CASE WHEN CASE code WHEN 'GA' THEN gap ELSE -gap END < -20 THEN 'great-avuncular too young' WHEN CASE code WHEN 'GA' THEN gap ELSE -gap END > 100 THEN 'great-avuncular too old' END
 WHEN code IN ('F', 'H') AND abs(gap) > 25 THEN 'siblings too far apart' WHEN code = '1C' AND abs(gap) > 30 THEN 'cousins too far apart' END AS reason FROM j) SELECT * FROM f WHERE reason IS NOT NULL""",
    "pedigree_score": f"""WITH {RELATIONS}, {CLASSES}, n AS (SELECT x.fid, code, CASE WHEN code IN ('P', 'O') THEN pc WHEN code = 'F' THEN fs WHEN code IN ('N', 'H', 'G', 'A', 'C') THEN hag
 WHEN code IN ('GC', 'HN', 'HA', 'GG', '1C', 'GA', 'GN') THEN cgh ELSE un END AS v FROM hard JOIN ov_fam x ON x.iid = iid1 JOIN ov_fam y ON y.iid = iid2 AND y.fid = x.fid LEFT JOIN (SELECT self, rel AS other, code FROM rel WHERE self < rel) r ON iid1 = self AND iid2 = other)
SELECT fid, count(*) AS n_pairs, count(code) AS n_related, round(sum(ln(greatest(v, 1e-4))), 4) AS lnl FROM n GROUP BY fid""",
    "unnecessary_placeholders": """WITH f AS (SELECT iid FROM ov_fam WHERE iid % 5 <> 0 AND pid = 0 AND mid = 0) SELECT pid, mid, min(iid) AS child FROM ov_fam WHERE pid <> 0 AND mid <> 0 GROUP BY pid, mid
 HAVING count(*) = 1 AND pid IN (SELECT iid FROM f) AND mid IN (SELECT iid FROM f)""",
    "degree_lnl": f"""WITH {MODELS}, o AS (SELECT id1, id2, degree, max(CASE WHEN ancestors = 1 THEN lnl END) AS a, max(CASE WHEN ancestors = 2 THEN lnl END) AS b FROM models WHERE ancestors > 0 GROUP BY 1, 2, 3)
SELECT id1, id2, degree, round(CASE WHEN a > coalesce(b, -1e300) THEN a ELSE coalesce(b, a) END - 2, 6) AS lnl FROM o""",
    "connection_significance": f"WITH {MODELS}, {BEST} SELECT id1, id2, round(CASE WHEN lnl <= ll_null THEN 1.0 ELSE exp(ll_null - lnl) END, 8) AS p FROM best_model",
    "bonferroni": f"""WITH RECURSIVE {COMPONENTS}, u AS (SELECT count(*)::DOUBLE AS u FROM (SELECT network_id FROM members GROUP BY 1 HAVING count(*) = 1)), n AS (SELECT 2 * fid + iid % 2 AS network_id, count(DISTINCT iid) AS f FROM ov_fam WHERE pid = 0 AND mid = 0 GROUP BY 1), t AS (SELECT 1 + (sum(f) * sum(f) - sum(f * f)) / 2.0 + sum(f) * any_value(u) + any_value(u) * any_value(u) AS comparisons FROM n, u)
SELECT CAST(comparisons AS DOUBLE) AS comparisons, CAST(0.05 / comparisons AS DOUBLE) AS p_cut FROM t""",
    "variant_dups": "SELECT vid, snp_id, chrom, pos, n_id, n_place FROM (SELECT *, count(*) OVER (PARTITION BY snp_id) AS n_id, count(*) OVER (PARTITION BY chrom, pos) AS n_place FROM ov_variants) WHERE n_id > 1 OR n_place > 1",
    "autosomes": "SELECT * FROM ov_variants WHERE chrom BETWEEN 1 AND 22",
    "strand_flip": """WITH j AS (SELECT v.vid, list_distinct([a1, a2]) AS m, list_distinct([r1, r2]) AS r, list_distinct([translate(a1, 'ACGT', 'TGCA'), translate(a2, 'ACGT', 'TGCA')]) AS t, r1 FROM ov_variants v LEFT JOIN ov_ref_variants USING (vid)),
k AS (SELECT vid, r1, CASE WHEN r1 IS NOT NULL THEN len(list_distinct(list_concat(m, r))) END AS n, len(m) = 2 AND list_sort(m) = list_sort(t) AS amb, len(list_distinct(list_concat(t, r))) AS nt FROM j)
SELECT vid, n AS n_alleles, CASE WHEN r1 IS NULL THEN 'absent' WHEN amb THEN 'ambiguous' WHEN n <= 2 THEN 'keep' WHEN nt <= 2 THEN 'flip' WHEN n = 3 THEN 'triallelic' ELSE 'weird' END AS action FROM k""",
    "thin_variants": "SELECT vid, snp_id, chrom, pos FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos // 2000 ORDER BY pos, vid) AS rn FROM ov_variants) WHERE rn = 1",
    "allele_freq": "SELECT vid, count(*) AS n, count(dosage) AS n_called, round(sum(dosage) / (2.0 * count(dosage)), 8) AS freq, round(1 - count(dosage) / count(*), 8) AS missing FROM ov_genotypes GROUP BY vid",
    "sample_stats": "SELECT iid, round(1 - count(dosage) / count(*), 8) AS missing, round(count(*) FILTER (dosage = 1) / count(dosage), 8) AS het FROM ov_genotypes GROUP BY iid",
    "genotype_qc": """WITH f AS (SELECT vid FROM ov_genotypes GROUP BY vid HAVING round(1 - count(dosage) / count(*), 8) <= .2 AND least(round(sum(dosage) / (2.0 * count(dosage)), 8), 1 - round(sum(dosage) / (2.0 * count(dosage)), 8)) BETWEEN .1 AND .5),
p AS (SELECT iid FROM ov_genotypes GROUP BY iid HAVING 1 - count(dosage) / count(*) <= .1) SELECT * FROM ov_genotypes WHERE vid IN (SELECT vid FROM f) AND iid IN (SELECT iid FROM p)""",
    "ibs_pairs": """WITH f AS (SELECT vid, sum(dosage)::DOUBLE AS x, (2 * count(dosage) - sum(dosage))::DOUBLE AS y, (2 * count(dosage))::DOUBLE AS t FROM ov_genotypes GROUP BY vid), c AS (SELECT vid, t / (t - 1) AS k1, t / (t - 1) * t / (t - 2) AS k2, t / (t - 1) * t / (t - 2) * t / (t - 3) AS k3, x / t AS p, y / t AS q, x, y FROM f WHERE x > 0 AND y > 0 AND t >= 4),
d AS (SELECT g.iid, g.vid, dosage, 2*p*p*q*q * (x-1)/x * (y-1)/y * k3 AS e00, (4*p*p*p*q * (x-1)/x * (x-2)/x + 4*p*q*q*q * (y-1)/y * (y-2)/y) * k3 AS e10, (2*p*p*q * (x-1)/x + 2*p*q*q * (y-1)/y) * k2 AS e11
 FROM ov_genotypes g JOIN c USING (vid) WHERE dosage IS NOT NULL),
m AS (SELECT a.iid AS iid1, b.iid AS iid2, count(*) AS n, count(*) FILTER (abs(a.dosage - b.dosage) = 2) AS ibs0, count(*) FILTER (abs(a.dosage - b.dosage) = 1) AS ibs1, count(*) FILTER (a.dosage = b.dosage) AS ibs2, sum(a.e00) AS e00, sum(a.e10) AS e10, sum(a.e11) AS e11
 FROM d a JOIN d b ON a.vid = b.vid AND a.iid < b.iid GROUP BY 1, 2 HAVING count(*) >= 3), z AS (SELECT *, coalesce(least(1.0, ibs0 / nullif(e00, 0)), 0.0) AS z0 FROM m), y AS (SELECT *, greatest(0.0, least(1 - z0, coalesce((ibs1 - z0 * e10) / nullif(e11, 0), 0.0))) AS z1 FROM z)
SELECT iid1, iid2, n, ibs0, ibs1, ibs2, round(z0, 6) AS z0, round(z1, 6) AS z1, round(1 - z0 - z1, 6) AS z2, round(z1 / 2 + 1 - z0 - z1, 6) AS pi_hat FROM y""",
    "aim_scan": """WITH o AS (SELECT vid, count(*) AS n, regr_slope(dosage, CAST(pcs[1] AS DOUBLE)) AS beta, regr_r2(dosage, CAST(pcs[1] AS DOUBLE)) AS r2 FROM ov_genotypes JOIN ov_pcs USING (iid) WHERE dosage IS NOT NULL GROUP BY vid)
SELECT vid, n, round(beta, 6) AS beta, round(r2, 6) AS r2, round(sign(beta) * sqrt(r2 * (n - 2) / (1 - r2)), 5) AS t FROM o WHERE n > 2 AND r2 < 1""",
    "haploid_match": """WITH m AS (SELECT a.iid AS iid1, b.iid AS iid2, count(*) AS length, count(*) FILTER (a.allele = '0' OR b.allele = '0') AS nunknown, count(*) FILTER (a.allele <> '0' AND b.allele <> '0' AND a.allele <> b.allele) AS ndiff
 FROM ov_haploid a JOIN ov_haploid b ON a.site = b.site AND a.iid < b.iid GROUP BY 1, 2) SELECT iid1, iid2, CASE WHEN nunknown / length > .2 THEN -1 WHEN ndiff / length <= .3 THEN 1 ELSE 0 END AS match, ndiff, nunknown, length FROM m""",
    "ancestry_split": """SELECT iid, pop, CASE pop WHEN 'CEU' THEN 'EUR' WHEN 'FIN' THEN 'EUR' WHEN 'CHB' THEN 'EAS' WHEN 'JPT' THEN 'EAS' WHEN 'YRI' THEN 'AFR' WHEN 'LWK' THEN 'AFR' WHEN 'ASW' THEN 'AFR' WHEN 'GIH' THEN 'SAS' WHEN 'PUR' THEN 'AMR' ELSE pop END AS continent,
 CASE WHEN is_ref THEN 'train' ELSE 'test' END AS part FROM ov_pcs""",
    "ancestry_scale": """WITH f AS (SELECT iid, is_ref, CAST(unnest(generate_series(0, 9)) AS INT) AS k, CAST(unnest(pcs[1:10]) AS DOUBLE) AS x FROM ov_pcs), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM f WHERE is_ref GROUP BY k) SELECT iid, k, round((x - m) / s, 5) AS z FROM f JOIN s USING (k)""",
    "admixture_flag": """SELECT iid % 50 - iid % 2 AS batch, string_agg(DISTINCT pop, ',' ORDER BY pop) AS pops, bool_or(pop IN ('ASW', 'ACB', 'MXL', 'CLM', 'PEL', 'PUR', 'GIH', 'BEB', 'ITU', 'PJL', 'STU')) OR
 CAST(bool_or(pop IN ('CEU', 'TSI', 'FIN', 'GBR', 'IBS')) AS INT) + CAST(bool_or(pop IN ('YRI', 'LWK', 'GWD', 'MSL', 'ESN')) AS INT) + CAST(bool_or(pop IN ('CHB', 'CHS', 'JPT', 'CDX', 'KHV')) AS INT) > 1 AS admixed
 FROM ov_pcs WHERE is_ref GROUP BY 1""",
    "network_edges": f"WITH {CLASSES} SELECT iid1, iid2, pi_hat FROM classes WHERE pi_hat > 0.09375 AND possible <> 'UN'",
    "network_pairs": f"WITH RECURSIVE {COMPONENTS} SELECT a.network_id, a.iid AS iid1, b.iid AS iid2, pi_hat FROM members a JOIN members b ON a.network_id = b.network_id AND a.iid < b.iid LEFT JOIN ed ON iid1 = a.iid AND iid2 = b.iid",
    "sample_relatedness": f"""WITH RECURSIVE {COMPONENTS}, {MODELS}, {BEST}, stand AS (SELECT iid, network_id, count(*) OVER (PARTITION BY network_id) > 1 AS inn FROM members)
SELECT id1, id2, a.network_id AS net1, b.network_id AS net2, CASE WHEN a.network_id = b.network_id THEN 'within' WHEN a.inn AND b.inn THEN 'between' WHEN a.inn OR b.inn THEN 'unrelated and network' ELSE 'unrelated' END AS kind, ancestors, degree, lnl, ll_null
 FROM best_model JOIN stand a ON a.iid = id1 JOIN stand b ON b.iid = id2""",
    "dataset_summary": f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT network_id, count(*) AS n FROM members GROUP BY 1) SELECT count(*) FILTER (n > 1) AS n_networks, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_related, count(*) FILTER (n = 1) AS n_unrelated, max(n) AS largest,
 (SELECT count(*) FROM ed) AS n_pairs, (SELECT round(avg(pi_hat), 6) FROM ed) AS mean_pi_hat FROM s""",
    "possibility_counts": f"""WITH RECURSIVE {COMPONENTS} SELECT a.network_id, count(*) AS n_pairs, CAST(sum(len(string_split(possible, ','))) AS BIGINT) AS n_possible FROM classes JOIN members a ON a.iid = iid1 JOIN members b ON b.iid = iid2 AND a.network_id = b.network_id GROUP BY 1""",
    "twin_nodes": f"""WITH RECURSIVE {CLASSES}, t AS (SELECT iid1 AS a, iid2 AS b FROM classes WHERE mz UNION SELECT iid2, iid1 FROM classes WHERE mz), w(a, b) AS (SELECT a, a FROM t UNION SELECT w.a, t.b FROM w JOIN t ON w.b = t.a)
SELECT a AS iid, string_agg(CAST(b AS VARCHAR), ':' ORDER BY b) AS node FROM w GROUP BY a""",
    "attribute_gaps": """WITH p AS (SELECT iid1 AS iid FROM ov_genome UNION SELECT iid2 FROM ov_genome), t AS (SELECT iid FROM ov_traits WHERE btrait <> 0)
SELECT iid, 'no attribute' AS gap FROM p WHERE iid NOT IN (SELECT iid FROM t) UNION ALL SELECT iid, 'nobody' FROM t WHERE iid NOT IN (SELECT iid FROM p)""",
    "known_networks": f"WITH RECURSIVE {COMPONENTS} SELECT network_id, count(*) AS n_shared FROM members WHERE iid IN (SELECT iid FROM ov_fam WHERE age > 80) GROUP BY 1",
    "reference_samples": "SELECT iid, pop FROM ov_pcs WHERE is_ref AND pop IN ('CEU', 'ASW', 'JP')",
    "ascertained_split": """SELECT id1, id2, chrom, start_bp, end_bp, cm, ibd, false AS ascertained FROM ov_segments WHERE NOT (chrom = 6 AND start_bp <= 32500000 AND end_bp >= 32500000 AND ibd <> 2)
 UNION ALL SELECT id1, id2, chrom, start_bp, 32500000, round(cm * (32500000 - start_bp) / (end_bp - start_bp), 6), ibd, true FROM ov_segments WHERE chrom = 6 AND start_bp <= 32500000 AND end_bp >= 32500000 AND ibd <> 2
 UNION ALL SELECT id1, id2, chrom, 32500000, end_bp, round(cm * (end_bp - 32500000) / (end_bp - start_bp), 6), ibd, true FROM ov_segments WHERE chrom = 6 AND start_bp <= 32500000 AND end_bp >= 32500000 AND ibd <> 2""",
    "markers_to_remove": """WITH o AS (SELECT vid, k, count(*) AS n, regr_slope(dosage, x) AS beta, regr_r2(dosage, x) AS r2 FROM (SELECT vid, dosage, unnest([1, 2]) AS k, CAST(unnest(pcs[1:2]) AS DOUBLE) AS x FROM ov_genotypes JOIN ov_pcs USING (iid) WHERE dosage IS NOT NULL) GROUP BY vid, k)
SELECT DISTINCT vid FROM o WHERE n > 2 AND r2 < 1 AND round(sqrt(r2 * (n - 2) / (1 - r2)), 5) > 1.5""",
}
SQL["ibd2_table"] = f"""WITH sweep AS ({SQL["ibd2_sweep"]}), u AS (SELECT id1, id2, chrom, start_bp, end_bp, cm, 1 AS ibd FROM ov_segments WHERE cm >= 5 UNION ALL SELECT * FROM sweep WHERE ibd = 2 AND cm >= 5)
SELECT id1, id2, chrom, start_bp, end_bp, cm, ibd FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2, chrom, start_bp, end_bp ORDER BY ibd DESC, cm DESC) AS rn FROM u) WHERE rn = 1"""
_LINES = "up(iid, top) AS (SELECT iid, iid FROM ov_fam UNION ALL SELECT up.iid, f.{0} FROM up JOIN ov_fam f ON top = f.iid WHERE f.{0} <> 0), line AS (SELECT up.iid, top AS line FROM up JOIN ov_fam f ON top = f.iid WHERE f.{0} = 0)"
for _name, _parent, _male in (("maternal_conflicts", "mid", ""), ("paternal_conflicts", "pid", " AND iid1 IN (SELECT iid FROM ov_fam WHERE sex = 1) AND iid2 IN (SELECT iid FROM ov_fam WHERE sex = 1)")):
    SQL[_name] = f"WITH RECURSIVE {_LINES.format(_parent)}, hm AS ({SQL['haploid_match'].replace('> .2 THEN', '> .99 THEN').replace('<= .3 THEN', '<= .01 THEN')}) SELECT iid1, iid2, a.line, ndiff, length FROM hm JOIN line a ON a.iid = iid1 JOIN line b ON b.iid = iid2 AND a.line = b.line WHERE match = 0{_male}"
SQL["subpedigrees"] = f"WITH RECURSIVE {PO}, e AS (SELECT p AS a, c AS b FROM po UNION SELECT c, p FROM po), reach(a, b) AS (SELECT iid, iid FROM ov_fam UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT min(b) AS subpedigree, a AS iid FROM reach GROUP BY a"
SQL["inferred_sexes"] = """WITH f AS (SELECT iid, CASE WHEN iid % 3 = 0 THEN 0 ELSE sex END AS sex, iid IN (SELECT pid FROM ov_fam) AS father, iid IN (SELECT mid FROM ov_fam) AS mother FROM ov_fam)
SELECT iid, CASE WHEN sex <> 0 THEN sex WHEN father AND mother THEN NULL WHEN father THEN 1 WHEN mother THEN 2 ELSE 0 END AS sex FROM f"""
_LISTED = "l AS (SELECT fid, count(*) AS n, string_agg(concat_ws(',', iid - fid, CASE WHEN pid = 0 THEN 0 ELSE pid - fid END, CASE WHEN mid = 0 THEN 0 ELSE mid - fid END, sex), ';' ORDER BY iid) AS listed FROM ov_fam GROUP BY fid)"
SQL["pedigree_forms"] = f"WITH {_LISTED} SELECT fid, n, min(fid) OVER (PARTITION BY listed) AS same_as FROM l"
SQL["expected_pedigrees"] = f"WITH {_LISTED} SELECT a.fid, b.fid AS expected FROM l a JOIN l b ON a.listed = b.listed WHERE b.fid = 0"
SQL["unresolved_relatives"] = f"WITH {CLASSES}, {RELATIONS} SELECT iid1, iid2, pi_hat FROM classes WHERE pi_hat > 0.09375 AND possible <> 'UN' AND (iid1, iid2) NOT IN (SELECT (least(self, rel), greatest(self, rel)) FROM rel)"
SQL["analysis_branch"] = f"""WITH adm AS ({SQL["admixture_flag"]}), n AS (SELECT iid % 50 - iid % 2 AS batch, count(DISTINCT iid) AS n FROM ov_pcs WHERE NOT is_ref GROUP BY 1)
SELECT batch, coalesce(n, 0) AS n_unrelated, admixed AS remove_markers, CASE WHEN coalesce(n, 0) >= 50 THEN 'own' ELSE 'reference' END AS frequencies FROM adm LEFT JOIN n USING (batch)"""
SQL["ld_prune"] = """WITH RECURSIVE at_ AS (SELECT vid, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos, vid) - 1 AS place FROM ov_variants),
f AS (SELECT vid, round(sum(dosage) / (2.0 * count(dosage)), 8) AS q FROM ov_genotypes GROUP BY vid),
c AS (SELECT chrom, place // 10 AS block, place, iid, g.vid, least(q, 1 - q) AS maf, dosage AS d FROM ov_genotypes g JOIN at_ USING (vid) JOIN f USING (vid) WHERE dosage IS NOT NULL),
s AS (SELECT a.chrom, a.block, a.place AS p1, b.place AS p2, a.vid AS v1, b.vid AS v2, a.maf AS m1, b.maf AS m2, count(*) AS n, count(*) * sum(a.d * b.d) - sum(a.d) * sum(b.d) AS cv, count(*) * sum(a.d * a.d) - sum(a.d) * sum(a.d) AS s1, count(*) * sum(b.d * b.d) - sum(b.d) * sum(b.d) AS s2
 FROM c a JOIN c b ON a.chrom = b.chrom AND a.block = b.block AND a.iid = b.iid AND a.place < b.place GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY chrom, block ORDER BY p1, p2) AS k FROM s WHERE n >= 3 AND CAST(cv AS DOUBLE) * CAST(cv AS DOUBLE) > CAST(0.2 AS DOUBLE) * CAST(s1 AS DOUBLE) * CAST(s2 AS DOUBLE)),
fold(chrom, block, k, gone) AS (SELECT DISTINCT chrom, block, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM pr
 UNION ALL SELECT pr.chrom, pr.block, pr.k, CASE WHEN list_contains(gone, v1) OR list_contains(gone, v2) THEN gone ELSE list_append(gone, CASE WHEN m1 < m2 THEN v1 ELSE v2 END) END FROM fold JOIN pr ON pr.chrom = fold.chrom AND pr.block = fold.block AND pr.k = fold.k + 1)
SELECT vid, chrom, vid NOT IN (SELECT unnest(gone) FROM fold) AS kept FROM at_"""
SQL["null_exceedances"] = """WITH s AS (SELECT DISTINCT id1, id2, chrom, start_bp, end_bp, cm, ibd FROM ov_segments WHERE end_bp > start_bp), k AS (SELECT *, row_number() OVER (ORDER BY id1, id2, chrom, start_bp, end_bp, ibd) AS id FROM s),
o AS (SELECT a.id, sum(a.cm * (least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp)) / (a.end_bp - a.start_bp)) AS shared FROM k a JOIN k b ON a.chrom = b.chrom AND a.start_bp <= b.end_bp AND b.start_bp <= a.end_bp WHERE a.id <> b.id GROUP BY a.id),
t AS (SELECT id, i, CAST(concat('0x', substr(md5(concat_ws('|', i, id1, id2, chrom, start_bp, end_bp, ibd)), 1, 8)) AS BIGINT) % greatest(1, 352500 - CAST(round(cm * 100) AS BIGINT)) AS x, CAST(round(cm * 100) AS BIGINT) AS w FROM k, (SELECT unnest([1, 2]) AS i)),
z AS (SELECT a.id, a.i, sum(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / 100.0 AS chance FROM t a JOIN t b ON a.i = b.i AND a.x <= b.x + b.w AND b.x <= a.x + a.w WHERE a.id <> b.id GROUP BY a.id, a.i)
SELECT id1, id2, chrom, start_bp, end_bp, ibd, cm, round(coalesce(o.shared, 0), 4) AS shared_cm, count(*) FILTER (coalesce(round(chance, 4), 0) >= round(coalesce(o.shared, 0), 4)) AS n_exceed, round(coalesce(sum(chance), 0) / 2, 4) AS expected_cm
FROM k LEFT JOIN o USING (id) JOIN (SELECT id, i FROM t) USING (id) LEFT JOIN z USING (id, i) GROUP BY ALL"""
SQL["merge_with_reference"] = f"""WITH act AS ({SQL["strand_flip"]}), both_ AS (SELECT vid FROM ov_genotypes WHERE vid IN (SELECT vid FROM act WHERE action IN ('keep', 'flip')) GROUP BY vid HAVING bool_or(iid % 2 = 0) AND bool_or(iid % 2 = 1)),
f AS (SELECT vid FROM ov_genotypes WHERE vid IN (SELECT vid FROM both_) GROUP BY vid HAVING round(1 - count(dosage) / count(*), 8) <= .2 AND least(round(sum(dosage) / (2.0 * count(dosage)), 8), 1 - round(sum(dosage) / (2.0 * count(dosage)), 8)) BETWEEN .1 AND .5)
SELECT iid, vid, dosage FROM ov_genotypes WHERE vid IN (SELECT vid FROM f)"""
SQL["sibling_override"] = f"""WITH k AS (SELECT * FROM ov_segments WHERE cm >= 5), one AS (SELECT id1, id2, sum(cm) AS t FROM k WHERE ibd <> 2 GROUP BY 1, 2),
x AS (SELECT id1, id2, cm - 2.5 AS x, row_number() OVER (PARTITION BY id1, id2 ORDER BY cm DESC, chrom DESC, start_bp DESC, end_bp DESC) AS k FROM k WHERE ibd = 2),
c AS (SELECT id1, id2, k, sum(x) OVER (PARTITION BY id1, id2 ORDER BY k) AS rx FROM x UNION ALL SELECT DISTINCT id1, id2, 0, 0.0 FROM x),
w AS (SELECT c.*, max(k) OVER (PARTITION BY id1, id2) AS s, max(rx) OVER (PARTITION BY id1, id2) AS tx, 13.73 * t / {G!r} AS l FROM c JOIN one USING (id1, id2)),
v AS (SELECT id1, id2, k, s, -l + (s - k) * ln(l) - lgamma(s - k + 1) + (s - k) * ln({RATE!r}) - (tx - rx) * {RATE!r} AS bg, {(G / 100 + 22) / 4 * 2.718281828459045 ** -0.1!r} AS r, rx FROM w)
SELECT id1, id2, max(s) AS n_ibd2, round(max(bg - r + k * ln(r) - lgamma(k + 1) - k * ln(25.0) - rx / 25.0), 6) AS lnl, round(max(CASE WHEN k = 0 THEN bg END), 6) AS ll_null,
 max(bg - r + k * ln(r) - lgamma(k + 1) - k * ln(25.0) - rx / 25.0) > max(CASE WHEN k = 0 THEN bg END) + {MARGIN} AS sibling FROM v GROUP BY 1, 2"""
_COMPOSITE = f"""{MODELS}, {PO}, anc(iid, ancestor, depth) AS (SELECT c, p, 1 FROM po UNION SELECT anc.iid, po.p, depth + 1 FROM anc JOIN po ON anc.ancestor = po.c),
dl AS (SELECT id1, id2, degree, max(CASE WHEN ancestors = 1 THEN lnl END) AS a, max(CASE WHEN ancestors = 2 THEN lnl END) AS b FROM models WHERE ancestors > 0 GROUP BY 1, 2, 3),
dg AS (SELECT id1, id2, degree, round(CASE WHEN a > coalesce(b, -1e300) THEN a ELSE coalesce(b, a) END - 2, 6) AS lnl FROM dl), nul AS (SELECT id1, id2, any_value(ll_null) AS ll_null FROM models GROUP BY 1, 2),
dep AS (SELECT a.ancestor AS f, a.iid, min(a.depth) AS d, any_value(2 * fid + f.iid % 2) AS net FROM anc a JOIN ov_fam f ON f.iid = a.ancestor AND f.pid = 0 AND f.mid = 0 WHERE a.iid IN (SELECT id1 FROM ov_segments UNION SELECT id2 FROM ov_segments) GROUP BY 1, 2),
dn AS (SELECT *, min(d) OVER (PARTITION BY f) AS near FROM dep),
cand AS (SELECT DISTINCT x.net AS net1, y.net AS net2, x.f AS f1, y.f AS f2, x.near + y.near AS nn FROM dn x JOIN dn y ON x.net < y.net JOIN nul ON id1 = least(x.iid, y.iid) AND id2 = greatest(x.iid, y.iid)),
cd AS (SELECT net1, net2, f1, f2, unnest(generate_series(1, 9 - nn)) AS degree FROM cand WHERE nn <= 8),
pr AS (SELECT cd.*, least(x.iid, y.iid) AS id1, greatest(x.iid, y.iid) AS id2, degree + x.d + y.d AS total FROM cd JOIN dep x ON x.f = f1 JOIN dep y ON y.f = f2),
vl AS (SELECT pr.*, lnl, ll_null, CASE WHEN total > 9 THEN greatest(lnl, ll_null) + ln(pow(.5, total - 9) * exp(lnl - greatest(lnl, ll_null)) + (1 - pow(.5, total - 9)) * exp(ll_null - greatest(lnl, ll_null))) ELSE lnl END AS v
 FROM pr JOIN dg ON dg.id1 = pr.id1 AND dg.id2 = pr.id2 AND dg.degree = least(total, 9) JOIN nul ON nul.id1 = pr.id1 AND nul.id2 = pr.id2),
composite AS (SELECT net1, net2, f1, f2, degree, round(sum(v), 5) AS score, round(sum(4 - 2 * v), 5) AS aic, round(sum(-2 * (ll_null - (lnl + 2))), 5) AS chi2, count(*) AS n_pairs, round(sum(v - ll_null), 5) AS gain, round(sum(4 - 2 * v + 2 * ll_null), 5) AS aic_gain FROM vl GROUP BY 1, 2, 3, 4, 5)"""
SQL["connection_composite"] = f"WITH RECURSIVE {_COMPOSITE} SELECT * FROM composite"
SQL["connection_best"] = f"""WITH RECURSIVE {_COMPOSITE}, b AS (SELECT *, row_number() OVER (PARTITION BY net1, net2 ORDER BY gain DESC, f1, f2, degree) AS rn FROM composite)
SELECT net1, net2, f1, f2, CASE WHEN gain > 0 THEN degree END AS degree, score, aic, chi2, n_pairs, CASE WHEN chi2 <= 0 THEN 1.0
 ELSE round(least(1.0, list_sum(list_transform(generate_series(0, n_pairs - 1), lambda i: exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2)))), 8) END AS p FROM b WHERE rn = 1"""
SQL |= files.sql(MODELS)
SQL["mask_clip"] = f"""WITH RECURSIVE {MERGED}, k AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_bp, end_bp) AS i FROM mask), g AS (SELECT row_number() OVER () AS sid, id1, id2, chrom, start_bp, end_bp, cm FROM ov_segments),
w(sid, chrom, i, b, e) AS (SELECT sid, chrom, 0, start_bp, end_bp FROM g UNION ALL
 SELECT sid, chrom, i, b2, CASE WHEN t AND e < k1 + 1000000 THEN greatest(k0, b2) ELSE e END FROM (SELECT sid, w.chrom, k.i, e, k.start_bp AS k0, k.end_bp AS k1, b <= k.end_bp AND e >= k.start_bp AS t,
 CASE WHEN b <= k.end_bp AND e >= k.start_bp AND b > k.start_bp - 1000000 THEN least(k.end_bp, e) ELSE b END AS b2 FROM w JOIN k ON k.chrom = w.chrom AND k.i = w.i + 1)),
l AS (SELECT sid, arg_max(b, i) AS b, arg_max(e, i) AS e FROM w GROUP BY sid)
SELECT id1, id2, chrom, start_bp, end_bp, b AS new_begin, e AS new_end, round(cm * (e - b) / (end_bp - start_bp), 4) AS new_cm FROM g JOIN l USING (sid)"""
SQL["pedigree_recovery"] = "SELECT min(iid) AS network_id, true AS found FROM ov_kin_fam WHERE sampled AND gen <> 3 GROUP BY fid"
SQL["pedigree_cutoffs"] = """SELECT min(iid) AS network_id, 'ok' AS status, CASE WHEN count(*) FILTER (k IN (2, 9)) < 2 THEN 0.3 WHEN fid % 7 = 3 THEN 0.1 WHEN fid % 7 = 5 THEN 0.1::DOUBLE / 3 / 3 ELSE 0.3 END AS cutoff
  FROM ov_kin_fam WHERE sampled AND gen <> 3 GROUP BY fid"""


def _final(where: str, ibd2: bool) -> str:
    """One estimate for each pair after the overrides by total and, with ibd2, by sharing on both homologs."""
    kept = MODELS.replace("FROM ov_segments WHERE cm >= 5", f"FROM ov_segments WHERE cm >= 5 {where}")
    sib = f"""sib AS (SELECT * FROM ({SQL["sibling_override"]}) WHERE sibling),
nul AS (SELECT id1, id2, count(*) AS s, sum(cm - 2.5) AS bx FROM ov_segments WHERE cm >= 5 AND ibd = 2 GROUP BY 1, 2),
two AS (SELECT id1, id2, sib.lnl AS lnl2, -(13.73 * 13.73 * {RATE / G!r}) + s * ln(13.73 * 13.73 * {RATE / G!r}) - lgamma(s + 1) + s * ln({RATE!r}) - bx * {RATE!r} AS null2 FROM sib JOIN nul USING (id1, id2)),"""
    none = "two AS (SELECT id1, id2, lnl AS lnl2, lnl AS null2 FROM models WHERE false),"
    free = "NOT (ancestors = 2 AND meioses = 2)" if ibd2 else "true"
    by_total = "NULL" if ibd2 else "CASE WHEN t / 3525.48101 > 0.625 THEN 'SIB' END"
    near = lambda a: f"ancestors = {a} AND lnl + {MARGIN} >= mx" + (" AND meioses <> 2" if ibd2 and a == 2 else "")
    bounds = ", ".join(f"CASE WHEN lnl2 IS NOT NULL THEN {1 if a == 2 else 'NULL'} ELSE {f}(degree) FILTER ({near(a)}) END AS p{a}_{n}" for a in (2, 1, 0) for f, n in (("min", "low"), ("max", "high")))
    return f"""WITH {kept}, {sib if ibd2 else none}
tot AS (SELECT id1, id2, sum(cm) AS t FROM ov_segments WHERE cm >= 5 {where} GROUP BY 1, 2),
fo AS (SELECT tot.id1, tot.id2, lnl2, null2, CASE WHEN lnl2 IS NOT NULL THEN 'SIB2' WHEN t > 0.75 * 3525.48101 + 2.33 * sqrt(0.75 * 3525.48101 / 100 * 4 * 625) THEN 'PO' ELSE {by_total} END AS forced FROM tot LEFT JOIN two ON two.id1 = tot.id1 AND two.id2 = tot.id2),
j AS (SELECT models.*, lnl2, null2, coalesce(forced, 'NONE') AS forced, CASE WHEN forced = 'PO' THEN ancestors = 0 AND meioses = 1 WHEN forced IN ('SIB', 'SIB2') THEN ancestors = 2 AND meioses = 2 ELSE {free} END AS ok FROM models JOIN fo USING (id1, id2)),
pick AS (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY NOT ok, round(lnl, 6) DESC, meioses, CASE ancestors WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END) AS rn FROM j),
mx AS (SELECT *, max(CASE WHEN rn = 1 THEN coalesce(lnl2, lnl) END) OVER (PARTITION BY id1, id2) AS mx, coalesce(null2, ll_null) AS nl FROM pick)
SELECT id1, id2, max(ancestors) FILTER (rn = 1) AS ancestors, max(meioses) FILTER (rn = 1) AS meioses, max(degree) FILTER (rn = 1 AND nl + {MARGIN} < mx) AS degree, round(max(mx), 6) AS lnl, round(max(nl), 6) AS ll_null, max(forced) AS forced,
 {bounds} FROM mx GROUP BY id1, id2, lnl2"""


SQL["segment_degree_final"] = _final("AND ibd <> 2", True)
SQL["segment_degree_by_total"] = _final("", False)
_LOCUS = "chrom = 6 AND start_bp <= 32500000 AND end_bp >= 32500000 AND ibd <> 2"
SQL["ascertained_models"] = f"""WITH {MODELS.replace("WHERE cm >= 5", f"WHERE cm >= 5 AND NOT ({_LOCUS})")},
pt AS (SELECT id1, id2, c - 2.5 AS x FROM (SELECT id1, id2, unnest([round(cm * (32500000 - start_bp) / (end_bp - start_bp), 6), round(cm * (end_bp - 32500000) / (end_bp - start_bp), 6)]) AS c FROM ov_segments WHERE {_LOCUS}) WHERE c >= 2.5),
pp AS (SELECT id1, id2, count(*) AS c, sum(x) AS x, sum(ln({_MIX}) - x * {SPEED!r}) AS mix FROM pt GROUP BY 1, 2),
z AS (SELECT models.*, coalesce(c, 0) AS c, coalesce(x, 0) AS x, coalesce(mix, 0) AS mix,
 CASE WHEN ancestors = 0 THEN CASE WHEN meioses > 1 THEN {G!r} / ({G / 100!r} * (meioses - 1) + 22) ELSE 3525.48101 / 22 END WHEN ancestors = 1 THEN {G!r} / ({G / 100!r} * meioses + 22) WHEN meioses = 3 THEN {G * .5 / SIB!r} ELSE 100.0 / meioses END AS e
 FROM models LEFT JOIN pp USING (id1, id2))
SELECT id1, id2, ancestors, meioses, degree, round(lnl + greatest(c * ln({RATE!r}) - x * {RATE!r}, CASE WHEN ancestors = 2 AND meioses = 2 THEN mix ELSE -c * ln(e) - x / e END), 6) AS lnl, round(ll_null + c * ln({RATE!r}) - x * {RATE!r}, 6) AS ll_null FROM z"""
SQL["estimates_file"] = f"SELECT CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, ancestors, degree, lnl AS ll_max, ll_null FROM ({SQL['segment_degree_by_total']})"


def _links(mode: str) -> str:
    """The best link over pedigrees, founders and degrees, and its significance."""
    kept = MODELS.replace("ov_segments", "ov_kin_segments")
    total = "aic_gain" if mode == "aic" else "gain"
    order = "total" if mode == "aic" else "-total"
    return f"""WITH RECURSIVE {kept}, peds AS MATERIALIZED (SELECT * FROM ov_kin_peds), lk AS MATERIALIZED (SELECT id1, id2, degree, round(CASE WHEN a > coalesce(b, -1e300) THEN a ELSE coalesce(b, a) END - 2, 6) AS lnl FROM (SELECT id1, id2, degree, max(lnl) FILTER (ancestors = 1) AS a, max(lnl) FILTER (ancestors = 2) AS b FROM models WHERE ancestors > 0 GROUP BY 1, 2, 3)),
nul AS MATERIALIZED (SELECT id1, id2, any_value(ll_null) AS ll_null FROM models GROUP BY 1, 2),
dn(net, ped, f, iid, depth) AS (SELECT network_id, pedigree, iid, iid, 0 FROM peds WHERE pid IS NULL AND mid IS NULL UNION SELECT net, ped, f, c.iid, depth + 1 FROM dn JOIN peds c ON c.network_id = net AND c.pedigree = ped AND (c.pid = dn.iid OR c.mid = dn.iid)),
dp AS (SELECT net, ped, f, dn.iid, min(depth) AS depth FROM dn JOIN peds p ON p.network_id = net AND p.pedigree = ped AND p.iid = dn.iid AND p.sampled GROUP BY 1, 2, 3, 4),
nr AS MATERIALIZED (SELECT *, min(depth) OVER (PARTITION BY net, ped, f) AS near FROM dp),
pr AS MATERIALIZED (SELECT x.net AS net1, y.net AS net2, x.ped AS ped1, y.ped AS ped2, x.f AS f1, y.f AS f2, nul.id1, nul.id2, ll_null, x.depth + y.depth AS dd, x.near + y.near AS nn FROM nul JOIN nr x ON x.iid IN (id1, id2) JOIN nr y ON y.iid = id1 + id2 - x.iid WHERE x.net < y.net),
tr AS (SELECT *, unnest(generate_series(greatest(1, 4 - nn), 9 - nn)) AS degree FROM pr),
vl AS (SELECT tr.*, lnl, degree + dd AS total FROM (SELECT tr.*, least(degree + dd, 9) AS at_ FROM tr) tr JOIN (SELECT id1, id2, degree AS at_, lnl FROM lk) lk USING (id1, id2, at_)),
vv AS (SELECT *, CASE WHEN total > 9 THEN greatest(lnl, ll_null) + ln(pow(.5, total - 9) * exp(lnl - greatest(lnl, ll_null)) + (1 - pow(.5, total - 9)) * exp(ll_null - greatest(lnl, ll_null))) ELSE lnl END AS v FROM vl),
sc AS (SELECT net1, net2, ped1, ped2, f1, f2, degree, round(sum(v - ll_null), 5) AS gain, round(sum(2 * ll_null - 2 * v), 5) AS aic_gain FROM vv GROUP BY ALL UNION ALL SELECT DISTINCT net1, net2, ped1, ped2, NULL, NULL, NULL, 0.0, 0.0 FROM pr),
own AS (SELECT DISTINCT network_id, pedigree, lnl FROM peds),
al AS (SELECT sc.*, round({total} + a.lnl + b.lnl, 5) AS total FROM sc JOIN own a ON a.network_id = net1 AND a.pedigree = ped1 JOIN own b ON b.network_id = net2 AND b.pedigree = ped2),
bs AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY net1, net2 ORDER BY {order}, degree IS NOT NULL, ped1, ped2, f1, f2, degree) AS rn FROM al) WHERE rn = 1),
few AS (SELECT bs.net1, bs.net2, count(*) AS n_pairs, round(sum(-2 * (ll_null - (lk.lnl + 2))), 5) AS chi2 FROM bs JOIN nr x ON x.net = net1 AND x.ped = ped1 AND x.f = f1 AND x.depth = x.near JOIN nr y ON y.net = net2 AND y.ped = ped2 AND y.f = f2 AND y.depth = y.near
 JOIN nul ON id1 = least(x.iid, y.iid) AND id2 = greatest(x.iid, y.iid) JOIN lk ON lk.id1 = nul.id1 AND lk.id2 = nul.id2 AND lk.degree = bs.degree + x.near + y.near GROUP BY 1, 2)
SELECT net1, net2, ped1, ped2, f1, f2, degree, total, n_pairs, chi2, CASE WHEN chi2 <= 0 THEN 1.0 WHEN chi2 IS NOT NULL THEN round(least(1.0, list_sum(list_transform(generate_series(0, n_pairs - 1), lambda i: exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2)))), 8) END AS p FROM bs LEFT JOIN few USING (net1, net2)"""


SQL["pedigree_links"], SQL["pedigree_links_aic"] = _links("composite"), _links("aic")
SQL["unrelated_by_traits"] = f"""WITH {CLASSES.replace("ov_genome", "ov_kin_genome")}, ed AS MATERIALIZED (SELECT iid1, iid2 FROM classes WHERE pi_hat > 0.09375 AND possible <> 'UN'),
near AS (SELECT iid, other, 1 << (other - 1) % 12 AS bit FROM (SELECT iid1 AS iid, iid2 AS other FROM ed UNION SELECT iid2, iid1 FROM ed)), nm AS (SELECT iid, sum(bit)::BIGINT AS nm FROM near GROUP BY 1),
kin AS MATERIALIZED (SELECT f.iid, fid, 1::BIGINT << k AS bit, age, CASE WHEN f.iid % 3 = 0 THEN 1 ELSE 0 END AS cs, nm FROM ov_kin_fam f LEFT JOIN nm USING (iid) WHERE sampled),
al AS (SELECT fid, sum(bit)::BIGINT AS al, min(iid) AS network_id FROM kin WHERE nm IS NOT NULL GROUP BY 1), ms AS (SELECT fid, network_id, m FROM al, (SELECT unnest(generate_series(1, 4095)) AS m) WHERE m | al = al),
st AS (SELECT ms.fid, network_id, m, sum(cs) FILTER (m & bit <> 0) AS cs, round(avg(age) FILTER (m & bit <> 0), 9) AS age, count(*) FILTER (m & bit <> 0) AS n, list(iid ORDER BY iid) FILTER (m & bit <> 0) AS ids
 FROM ms JOIN kin ON kin.fid = ms.fid AND nm IS NOT NULL GROUP BY 1, 2, 3 HAVING bool_and((m & nm = 0) = (m & bit <> 0))),
bs AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY cs DESC, age, n DESC, ids) AS rn FROM st)
SELECT network_id, unnest(ids) AS iid, 'exact' AS status FROM bs WHERE rn = 1 UNION ALL SELECT iid, iid, 'single' FROM kin WHERE nm IS NULL"""
_KP = "kp AS MATERIALIZED (SELECT 4 * p.iid + pedigree AS iid, coalesce(4 * p.pid + pedigree, 0) AS pid, coalesce(4 * p.mid + pedigree, 0) AS mid, network_id, pedigree, p.iid AS name, p.sampled, lnl, sex, age FROM ov_kin_peds p JOIN ov_kin_fam f ON f.iid = p.iid)"
_KREL = RELATIONS.replace("ov_fam", "kp")
SQL["network_relations"] = f"""WITH {_KP}, {_KREL}, sd AS (SELECT a.network_id, a.name AS self, b.name AS rel, a.sex AS sex1, b.sex AS sex2, code, count(*) AS n FROM rel JOIN kp a ON a.iid = rel.self AND a.sampled JOIN kp b ON b.iid = rel.rel AND b.sampled GROUP BY ALL)
SELECT network_id, self, rel, sex1, sex2, CASE WHEN sum(n) < 2 THEN array_to_string(list_sort(list_append(list(code), 'UN')), ',') ELSE array_to_string(list_sort(list(code)), ',') END AS rels, CAST(greatest(max(n), 2 - sum(n)) AS BIGINT) AS n_most, CAST(2 AS BIGINT) AS n_pedigrees FROM sd GROUP BY ALL"""
_STEPS = "kpo AS MATERIALIZED (SELECT pid AS p, iid AS c FROM {t} WHERE pid <> 0 UNION SELECT mid, iid FROM {t} WHERE mid <> 0), kmv AS MATERIALIZED (SELECT p AS a, c AS b, 1 AS m FROM kpo UNION ALL SELECT c, p, -1 FROM kpo), kco(iid, low) AS (SELECT iid, iid FROM {t} UNION SELECT kmv.b, low FROM kco JOIN kmv ON kmv.a = kco.iid), kst AS (SELECT iid, min(low) AS low FROM kco GROUP BY 1), kgn(iid, g) AS (SELECT iid, 0 FROM kst WHERE iid = low UNION SELECT kmv.b, g + m FROM kgn JOIN kmv ON kmv.a = kgn.iid)"
SQL["generation_steps"] = f"WITH RECURSIVE {_STEPS.format(t='ov_kin_fam')} SELECT iid, CAST(min(g) AS INT) AS generation FROM kgn GROUP BY 1"
_FLAGS = SQL["age_flags"].replace("ov_fam", "(SELECT * FROM kp WHERE sampled)")
_FLAGS = _FLAGS[_FLAGS.index("j AS (SELECT self"):].replace("f AS (SELECT self", "fl AS (SELECT self").replace(" FROM j) SELECT * FROM f WHERE reason IS NOT NULL", " FROM j)")
RANKS = f"""{_KP}, {_KREL}, {_FLAGS}, {_STEPS.format(t='kp')},
fc AS (SELECT network_id, pedigree, count(*) AS flags FROM fl JOIN kp ON kp.iid = self WHERE reason IS NOT NULL AND self < rel GROUP BY 1, 2), sn AS (SELECT network_id, pedigree, CAST(max(g) - min(g) + 1 AS INT) AS generations FROM kgn JOIN kp USING (iid) WHERE sampled GROUP BY 1, 2),
rk AS (SELECT network_id, pedigree, coalesce(any_value(flags), 0) AS flags, max(lnl) AS lnl, any_value(generations) AS generations, count(*) FILTER (NOT sampled) AS dummies FROM kp LEFT JOIN fc USING (network_id, pedigree) LEFT JOIN sn USING (network_id, pedigree) GROUP BY 1, 2)"""
SQL["pedigree_rank"] = f"WITH RECURSIVE {RANKS} SELECT *, CAST(rank() OVER (PARTITION BY network_id ORDER BY flags, lnl DESC, generations, dummies) AS INT) AS rank FROM rk"
SQL["score_summary"] = f"""WITH RECURSIVE {RANKS}, t AS (SELECT *, max(lnl) OVER (PARTITION BY network_id) AS top FROM rk) SELECT network_id, min(lnl) AS low, max(lnl) AS high, round(avg(lnl), 6) AS mean, round(median(lnl), 6) AS median,
 count(*) FILTER (lnl = top) AS n_at_max, count(*) FILTER (flags = 0) AS n_unflagged FROM t GROUP BY network_id"""
SQL["variants_once"] = "SELECT vid, snp_id, chrom, pos, a1, a2 FROM (SELECT *, count(*) OVER (PARTITION BY snp_id) AS n, count(*) OVER (PARTITION BY chrom, pos) AS m FROM ov_variants) WHERE n = 1 AND m = 1"
SQL["all_founders"] = "SELECT iid, CAST(0 AS BIGINT) AS pid, CAST(0 AS BIGINT) AS mid, sex FROM ov_fam"
