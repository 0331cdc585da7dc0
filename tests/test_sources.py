"""Readers and writers on small files."""

import numpy as np

from kinloom.sources import readers as R, writers as W
from kinloom.sources.bed import BedSource


def put(tmp_path, text, name="x.txt"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_segments_of_both_layouts(spark, tmp_path):
    path = put(tmp_path, "id1\tid2\tstart\tend\tlength\tchrom\tibd\na\tb\t1\t9\t5.004\t3\t2\nb\tc\t1\t9\t4.99\t3\t1\n" + "a 0\tc 1\t7\t10 20\tr s\t9\t8.5\tcM\t0\t0\t0\n\n")
    assert rows(R.read_segments(spark, path)) == [("a", "b", "3", 1, 9, 5.0, 2), ("a", "c", "7", 10, 20, 8.5, None)]


def test_matches(spark, tmp_path):
    path = put(tmp_path, "F a F b 2 5 9 r s 7 6.5 cM 0 2 2\na c 1 4 3.25 9\n")
    assert rows(R.read_matches(spark, path)) == [("a", "b", "2", 5, 9, 6.5, 2), ("a", "c", "9", 1, 4, 3.25, None)]


def test_genome_with_inner_headers_and_other_places(spark, tmp_path):
    head = " FID1 IID1 FID2 IID2 RT EZ Z0 Z1 Z2 PI_HAT\n"
    path = put(tmp_path, head + "  0 a  0 b OT 0 0.5 0.25 0.25 0.375\n" + head + " 0 a 0 c OT 0 1 0 0 0\n")
    assert [(r.iid1, r.iid2, r.z0, r.pi_hat) for r in R.read_genome(spark, path).orderBy("iid2").collect()] == [("a", "b", 0.5, 0.375), ("a", "c", 1.0, 0.0)]
    assert R.read_genome(spark, path, {"pi_hat": 7}).agg({"pi_hat": "sum"}).first()[0] == 1.5


def test_last_attribute_counts(spark, tmp_path):
    path = put(tmp_path, "FID IID SEX\nf a 1\nf b M\nf a 2\n")
    assert rows(R.read_attributes(spark, path, recode={"M": "1"})) == [("a", "f", "2"), ("b", "f", "1")]


def test_mask_pairs_traits_matches(spark, tmp_path):
    regions, means = R.read_mask(spark, put(tmp_path, "chrom begin end\n1 5 9\n# pois_mean 13.5\n# exp_mean 3\n"))
    assert rows(regions) == [("1", 5, 9)] and rows(means) == [("exp_mean", 3.0), ("pois_mean", 13.5)]
    pairs = R.read_pairs(spark, put(tmp_path, "b a\na b\n", "p"))
    assert rows(R.restrict(spark.createDataFrame([("b", "a", 1), ("a", "c", 2)], "id1 string, id2 string, x int"), pairs)) == [("b", "a", 1)]
    assert rows(R.read_traits(spark, put(tmp_path, "f a 2\nf b 1\nf c 0\n", "t"), binary=True)) == [("f", "a", 1.0), ("f", "b", 0.0), ("f", "c", None)]
    assert rows(R.read_haploid_matches(spark, put(tmp_path, "f a f b 0\nf b f a 1\n", "m"))) == [("a", "b", 1), ("b", "a", 1)]


def test_grid_pedigree_models_components(spark, tmp_path):
    grid = R.read_kde_grid(spark, put(tmp_path, "1 2\n3 4\n"), "PC")
    assert rows(grid.where("k0 = 1 and k1 = 0")) == [("PC", 1, 0, 2.0)] and grid.count() == 4
    fam = R.read_pedigree(spark, put(tmp_path, "f f__a f__Missing1 0 1 2\nf Missing1 0 0 1 0\n", "f"))
    assert rows(fam.select("iid", "pid", "mid", "is_missing")) == [("Missing1", None, None, True), ("a", "Missing1", None, False)]
    assert rows(R.read_models(spark, put(tmp_path, "# v\nindividual_1 individual_2 n d maxlnl\na b 1 3 -4.5\n", "m"))) == [("a", "b", 1, 3, -4.5)]
    assert rows(R.read_eigenvec(spark, put(tmp_path, "#FID IID PC1 PC2\nf a 0.5 1\n", "e"))) == [("f", "a", [0.5, 1.0])]


def test_haploid_segments(spark, tmp_path):
    path = put(tmp_path, "b.0 a.1 1 9 6.5 3\na.0 a.1 1 9 6.5 3\n")
    assert rows(R.read_haploid_segments(spark, path)) == [("a", "b", 1, 0, "3", 1, 9, 6.5)]


def test_empty_files(spark, tmp_path):
    path = put(tmp_path, "")
    for read in (R.read_segments, R.read_matches, R.read_genome, R.read_attributes, R.read_pedigree, R.read_models, R.read_eigenvec):
        assert read(spark, path).count() == 0


def test_bed(spark, tmp_path):
    codes = np.array([[0, 1, 2, 3, 0], [3, 3, 2, 0, 1], [2, 2, 2, 2, 2]])
    put(tmp_path, "".join(f"f p{i} 0 0 1 0\n" for i in range(5)), "g.fam")
    put(tmp_path, "".join(f"1 v{i} 0 {i} A C\n" for i in range(3)), "g.bim")
    packed = bytes(sum(int(c) << 2 * k for k, c in enumerate(row[j : j + 4])) for row in codes for j in (0, 4))
    (tmp_path / "g.bed").write_bytes(b"\x6c\x1b\x01" + packed)
    spark.dataSource.register(BedSource)
    got = {(r.snp_id, r.iid): r.dosage for r in spark.read.format("bed").option("stem", str(tmp_path / "g")).option("variants_per_task", 2).load().collect()}
    assert got == {(f"v{i}", f"p{j}"): {0: 2, 1: None, 2: 1, 3: 0}[int(codes[i, j])] for i in range(3) for j in range(5)}


def test_written_tables_and_drawings(spark, tmp_path):
    out = str(tmp_path / "out")
    W.write_table(spark.createDataFrame([("a", None), ("b", 2)], "x string, y int"), out)
    assert rows(spark.read.csv(out, sep="\t", header=True)) == [("a", "NA"), ("b", "2")]
    members = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 7), (2, 8)], "network_id long, iid long")
    edges = spark.createDataFrame([(i, i + 1) for i in (0, 1, 2, 3, 7)], "iid1 long, iid2 long")
    W.write_dots(W.network_dots(members, edges), str(tmp_path / "dots"))
    text = [line for file in sorted((tmp_path / "dots" / "network_id=1").glob("part=*/*.txt")) for line in file.read_text().splitlines()]
    assert text[0] == "graph network1 {" and text[-1] == "}" and len(text) == 6 and not (tmp_path / "dots" / "network_id=2").exists()
    fam = spark.createDataFrame([("f", "a", "Dummy1", None, 1)], "fid string, iid string, pid string, mid string, sex int")
    assert rows(W.pedigree_table(fam)) == [("f", "a", "Missing1", "0", 1, 0)] and W.drawing_table(fam).first().SYMBOL == "7"


def test_marker_segments(spark, tmp_path):
    markers = spark.createDataFrame([("4", 1, 100), ("4", 2, 200), ("4", 3, 300), ("5", 1, 7)], "chrom string, marker long, pos long")
    rec_map = spark.createDataFrame([("4", 100, 0.0), ("4", 300, 4.0)], "chrom string, pos long, cm double")
    path = put(tmp_path, "a b 1 3 x\nc d 2 3 x\nhead of it no number\na b 1 3\n")
    assert rows(R.read_marker_segments(spark, path, markers, rec_map, "4")) == [("a", "b", "4", 100, 300, 4.0), ("c", "d", "4", 200, 300, 2.0)]


def test_unrelated_samples(spark):
    """Copies of samples are related, others are not; one of each group of copies stays."""
    from kinloom.operators import genotypes

    rng = np.random.default_rng(8)
    p = rng.uniform(0.2, 0.8, 600)
    own = {i: rng.binomial(2, p) for i in range(14)}
    people = {**own, **{100 + i: own[i] for i in range(4)}, 200: own[0]}
    g = spark.createDataFrame([(int(i), v, int(d)) for i, x in people.items() for v, d in enumerate(x)], "iid long, vid long, dosage int")
    found = {r["iid"] for r in genotypes.unrelated_samples(g, 500, 0.3).collect()}
    assert len(found) == 14 and all(len(found & {i, 100 + i, *((200,) if i == 0 else ())}) == 1 for i in range(4)) and set(range(4, 14)) <= found
    assert {r["vid"] for r in genotypes.thinned(g, 50).select("vid").distinct().collect()} == {r["vid"] for r in genotypes.thinned(g, 50).select("vid").distinct().collect()}


def test_pairs_of_a_small_table_are_dealt_out(spark):
    """Pairs made from one small file come from several tasks, not from one."""
    from pyspark.sql import functions as F

    from kinloom.sources.overlays import view

    assert view(spark, "/root/testdata/sf0.01", "ov_genome").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_line_is_split_once(spark, tmp_path):
    """Conditions on the words of a line do not split it again."""
    (tmp_path / "m").write_text("a b 1 2 6 1\n")
    for read in (R.read_matches, R.read_genome, R.read_haploid_matches):
        plan = read(spark, str(tmp_path / "m"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == (2 if read is R.read_haploid_matches else 1), plan


def test_tasks_of_matches_grow_with_the_input(spark, tmp_path):
    """Matches are dealt to eight tasks for each split of the input, not to a fixed number."""
    for i in range(3):
        (tmp_path / f"{i}").write_text("0 a 0 b 1\n" * (i + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    try:
        found = R.read_haploid_matches(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 8 * 3
        assert sorted(map(tuple, found.collect())) == [("a", "b", 1), ("b", "a", 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
