"""Golden cases whose results were derived by hand, and unit tests of predicates and formats."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from varispark.functions import cigar, names, seq, tags
from varispark.operators import annotate, calls, indels, matrix, reads
from varispark.sinks import text as sinks
from varispark.sources import binary, paths
from varispark.sources import text as sources


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("counts,call,loh,diff", [((5, 0, 5, 10), "G", "LOH_reference", 0.5), ((5, 10, 5, 0), "G", "LOH_variant", -0.5), ((1, 1, 0, 1), "0", "0", 0.5), ((20, 0, 0, 20), "S", "", 1.0)])
def test_loh(spark, counts, call, loh, diff):
    r = one(spark, **calls.loh_call(*map(F.lit, counts)))
    assert (r["call"], r["loh"], r["ratio_diff"]) == (call, loh, diff)


def test_strand_skew(spark):
    skew, fails = calls.strand_skew(*map(F.lit, (26, 38, 12, 0)))
    r = one(spark, skew=skew, fails=fails)
    assert r["skew"] == 1.0 and r["fails"]


def test_joint_score_is_in_decades(spark):
    r = one(spark, p=calls.joint_score(F.lit(5), F.lit(9)))
    assert 0.9 < r["p"] <= 1


def test_fisher(spark):
    t = spark.createDataFrame([(8, 2, 1, 5), (3, 1, 1, 3), (0, 5, 5, 0)], "a int, b int, c int, d int")
    p = [r["p"] for r in t.select(calls.fisher_two_tailed("a", "b", "c", "d").alias("p")).collect()]
    assert [round(x, 6) for x in p] == [0.034965, 0.485714, 0.007937]


def test_sliding_window(spark):
    rows = [(1, p, "A", "C", 30) for p in (5, 11, 25, 28, 29, 31)]
    b = spark.createDataFrame(rows, "read_id long, pos_at int, ref string, base string, q int")
    assert reads.densest_window(b, 10, 15).first()["best"] == 4


def test_pad_map(spark):
    m = one(spark, m=annotate.pad_map(F.lit("ac*gG***t")))["m"]
    assert len(m) == 5 and m[2] == 4 and m[4] == 9


def test_chromosomes(spark):
    for raw, name in [("1", "chr1"), ("chr1", "chr1"), ("Chr1", "chr1"), ("CHR1", "chr1"), ("x", "chrX"), ("mt", "chrM"), ("NM_12345", "NM_12345")]:
        assert one(spark, n=names.chromosome(F.lit(raw)))["n"] == name
    assert one(spark, a=names.alternates(F.lit("MT")))["a"] == ["MT", "chrMT", "M", "chrM"]


def test_cigar_blocks_and_clips(spark):
    c, p = F.lit("3S5M2D4M1I3M"), F.lit(100)
    r = one(spark, b=cigar.blocks(c, p), u=cigar.unclipped_start(c, p), i=cigar.indels(c, p), n=cigar.blocks(F.lit("*"), p))
    assert [tuple(x) for x in r["b"]] == [(3, 100, 5), (8, 107, 4), (13, 111, 3)] and r["u"] == 97 and r["n"] == []
    assert [tuple(x) for x in r["i"]] == [("deletion", 105, 2, 8), ("insertion", 111, 1, 12)]


def test_ids_labels_and_dates(spark):
    assert one(spark, x=names.id_level(F.lit("TCGA.02.0069.01A.01D.00193.01"), 3))["x"] == "TCGA-02-0069"
    assert one(spark, x=names.fuzzy_id(F.lit("TCGA-29-1688-01A-01D")))["x"] == one(spark, x=names.fuzzy_id(F.lit("TCGA-29-1688-01A")))["x"]
    label = one(spark, x=names.megabase_label(F.lit("chr3:215.4-215.6MB")))["x"]
    assert tuple(label) == ("chr3", 215400000, 215600000)
    assert one(spark, a=names.standard_date(F.lit("3/9/07")), b=names.standard_date(F.lit("n/a")))[:] == ("2007-03-09", "n/a")
    assert tuple(one(spark, x=names.data_scale(F.lit("-4:0<=v<0.3")))["x"]) == (-4, 0.0, False, 0.3, True)


def test_comparators_and_tags(spark):
    for value in ("1", 1):
        assert one(spark, a=tags.compare_number(F.lit(value), ">=", 1), b=tags.compare_number(F.lit("x"), "!=", 1))[:] == (True, False)
    m = F.create_map(F.lit("XQ"), F.lit("7"))
    assert one(spark, a=tags.tag_filter(m, "XQ>5", True), b=tags.tag_filter(m, "ZZ=1", True), c=tags.tag_filter(m, "ZZ=1", False))[:] == (True, False, True)
    with pytest.raises(ValueError):
        tags.parse_tag_filter("nonsense")


def test_poly_x_and_codons(spark):
    s = "AC" + "T" * 9 + "G" * 8 + "A" * 12
    assert one(spark, m=seq.poly_x_mask(F.lit(s)))["m"] == "AC" + "!" * 9 + "G" * 8 + "!" * 12
    assert one(spark, a=seq.amino_acid(F.lit("atg")), b=seq.amino_acid(F.lit("TAA")), c=seq.amino_acid(F.lit("NNN")))[:] == ("M", "!", "?")


def test_statistics_of_a_list(spark):
    m = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 10, 20, 300)], "k int, value int")
    r = matrix.statistics(m, "k").first()
    assert r["median"] == 4 and math.isclose(r["mean"], 48.571, abs_tol=1e-3)


def test_pearson_of_constants_is_null(spark):
    a = F.array(*[F.lit(2)] * 4)
    assert one(spark, r=matrix.pearson(a, a))["r"] is None


def test_merging_stops_at_the_limit():
    import numpy as np

    d = np.array([[9, 1, 5, 9], [1, 9, 2, 9], [5, 2, 9, 9], [9, 9, 9, 9.0]])
    np.fill_diagonal(d, np.inf)
    assert matrix.merge(d, 2, "complete") == [[0, 1], [2], [3]]
    assert matrix.merge(d, 2, "minimum") == [[0, 1, 2], [3]]


@pytest.mark.parametrize("linkage,limit", [("complete", 2.3), ("mean", 2.3), ("minimum", 1.2)])
def test_rounds_join_what_the_closest_pair_rule_joins(spark, linkage, limit):
    import numpy as np

    values = np.random.default_rng(5).integers(0, 4, (14, 3))
    m = spark.createDataFrame([(i, j, int(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "sample long, col int, value int")
    d = matrix.block_euclidean(values.astype(float), values.astype(float))
    np.fill_diagonal(d, np.inf)
    want = sorted(g for g in matrix.merge(d, limit, linkage) if len(g) > 1)
    got = {}
    for r in matrix.cluster(m, "euclidean", limit, linkage, driver_clusters=2).collect():
        got.setdefault(r["cluster"], []).append(r["sample"])
    assert sorted(map(sorted, got.values())) == want and len(want) > 1
    assert [len(got[k]) for k in sorted(got)] == sorted(map(len, want), reverse=True)


def test_initial_clusters_stay_together(spark):
    m = spark.createDataFrame([(i, 0, v) for i, v in enumerate((0, 9, 1, 30, 50))], "sample long, col int, value int")
    given = spark.createDataFrame([(0, "p"), (1, "p"), (4, None)], "sample long, label string")
    got = matrix.cluster(m, "euclidean", 1.5, "minimum", given).collect()
    assert {(r["sample"], r["cluster"]) for r in got} == {(0, 0), (1, 0), (2, 0)}  # a patient alone is no cluster
    assert matrix.cluster(m, "euclidean", 1.5, "complete", given).collect() == []


def test_places_are_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    got = matrix.numbered(df, [F.desc("x")], "place").collect()
    assert sorted((r["place"], r["x"]) for r in got) == [(1000 - x, x) for x in range(999, -1, -1)]
    assert matrix.numbered(df.where("x < 0"), [F.asc("x")], "place").collect() == []


def test_calls_do_not_depend_on_order_or_partitions(spark):
    from varispark.plans.fixtures import observations

    o = observations(spark, "/root/testdata/sf0.001").withColumn("chrom", F.lit("chr1"))
    a = sorted(map(tuple, calls.call_snps(o).collect()))
    b = sorted(map(tuple, calls.call_snps(o.repartition(7).orderBy("qual")).collect()))
    assert a == b and a


def test_insertion_touching_a_run_is_masked(spark):
    row = [(1, "chr1", "T", "r", 0, 9, 100, "10M1I12M", "A" * 23, [40] * 23)]
    r = spark.createDataFrame(row, "read_id long, rname string, tn string, qname string, flag int, mapq int, pos int, cigar string, seq string, qual array<int>")
    assert [tuple(x) for x in indels.observed(r).select("kind", "site", "narrow_ok").collect()] == [("insertion", 110, False)]


def test_genomes_and_traces_round_trip(spark, tmp_path):
    text = {"chr1": "ACGTNNacgtTTGA" * 700, "chr2": "nnnAC"}
    (tmp_path / "g.2bit").write_bytes(binary.encode_2bit(text))
    got = {}
    for r in binary.genome_2bit(spark, f"{tmp_path}/g.2bit").orderBy("chrom", "chunk_start").collect():
        got[r["chrom"]] = got.get(r["chrom"], "") + r["bases"]
    assert got == text
    (tmp_path / "t.scf").write_bytes(binary.encode_scf([[0, 5, 9, 2], [1, 1, 1, 1], [9, 0, 0, 7], [3, 4, 5, 6]], "AC", [1, 3]))
    t = binary.scf(spark, f"{tmp_path}/t.scf").first()
    assert t["a"] == [0, 5, 9, 2] and t["g"] == [9, 0, 0, 7] and (t["bases"], t["places"]) == ("AC", [1, 3])


def test_bam_round_trip(spark, tmp_path):
    rows = [("r1", 16, 0, 100, 60, [(3, "S"), (2, "M")], "ACGTN", [1, 2, 3, 4, 5]), ("r2", 4, -1, 0, 0, [], "AC", [9, 9])]
    (tmp_path / "a.bam").write_bytes(binary.encode_bam([("chr1", 1000)], rows))
    got = sorted(tuple(r) for r in binary.bam(spark, f"{tmp_path}/a.bam").collect())
    assert got == [("r1", 16, "chr1", 100, 60, "3S2M", 0, "ACGTN", [1, 2, 3, 4, 5]), ("r2", 4, "*", 0, 0, None, 0, "AC", [9, 9])]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#k=v\nid\ta\tb\ts1\nx\t1\tNA\t300\ny\t-2.6\t0\t7\n")
    got = {(r["sample"], r["marker"]): r["value"] for r in sources.matrix(spark, f"{tmp_path}/m.txt").collect()}
    assert got == {("x", "a"): 1, ("x", "b"): None, ("x", "s1"): 98, ("y", "a"): -3, ("y", "b"): 0, ("y", "s1"): 7}
    (tmp_path / "p.phd").write_text("BEGIN_SEQUENCE tr1\nBEGIN_DNA\na 20 5\nc 30 17\nEND_DNA\n")
    assert [tuple(r) for r in sources.phd(spark, f"{tmp_path}/p.phd").collect()] == [("tr1", 0, "a", 20, 5), ("tr1", 1, "c", 30, 17)]
    (tmp_path / "g.txt").write_text("GBM,+,0.001,chr1:5-90,m1,m2,_Zsc,4.5\nLUNG,-,0,chr2:1-2,m3\n")
    g = sources.gistic_lines(spark, f"{tmp_path}/g.txt").orderBy("chrom").collect()
    assert (g[0]["markers"], g[0]["z"], g[0]["end"], g[1]["markers"], g[1]["z"]) == (["m1", "m2"], 4.5, 90, ["m3"], None)
    assert sources.tracks("1-3:2,7") == [(1, 3, 2), (7, 7, None)]


def test_assembly(spark, tmp_path):
    (tmp_path / "a.ace").write_text("AS 1 2\n\nCO c1 5 2 1 U\nAC*\nGT\n\nBQ\n9 9 9 9\n\nAF r1 U 1\nAF r2 C -2\nBS 1 5 r1\n\nRD r1 4 0 0\nACGT\n\nRD r2 3 0 0\nGGT\n")
    got = {r["name"]: (r["kind"], r["complemented"], r["start"], r["bases"]) for r in sources.assembly(spark, f"{tmp_path}/a.ace").collect()}
    assert got == {"c1": ("CO", None, None, "AC*GT"), "r1": ("RD", False, 1, "ACGT"), "r2": ("RD", True, -2, "GGT")}


def test_sinks_reject_bad_rows(spark, tmp_path):
    bad = spark.createDataFrame([("r", 0, "ACG", [1, 2])], "qname string, flag int, seq string, qual array<int>")
    with pytest.raises(Exception, match="bad sequence"):
        sinks.fastq(bad).collect()
    with pytest.raises(ValueError, match="no column"):
        sinks.report(bad, ["qname"], f"{tmp_path}/r")


def test_other_sources(spark, tmp_path):
    from varispark.sources import other

    (tmp_path / "x.markup").write_text("title\tHello\n# no\nsam\ta.bam\tT\n")
    assert [(r["kind"], r["fields"]) for r in other.markup(spark, f"{tmp_path}/x.markup").collect()] == [("title", ["Hello"]), ("sam", ["a.bam", "T"])]
    (tmp_path / "g.tsv").write_text("tp53\t17\t1\t9\nEGFR\tchr7\t5\t6\n")
    assert [tuple(r) for r in other.gene_list(spark, f"{tmp_path}/g.tsv").collect()] == [("TP53", "chr17", 1, 9), ("EGFR", "chr7", 5, 6)]
    (tmp_path / "p.tsv").write_text("p1\tfirst\ta\tb\np2\tsecond\tc\n")
    assert [r["gene"] for r in other.pathways(spark, f"{tmp_path}/p.tsv").collect()] == ["a", "b", "c"]
    (tmp_path / "e.txt").write_text("TYPE\tx\nFEATURES\tSystematicName\tLogRatio\nDATA\tchr1:1-2\t0.5\nDATA\tctl\t9\n")
    assert [tuple(r) for r in other.expression_report(spark, f"{tmp_path}/e.txt").collect()] == [("chr1:1-2", 0.5)]
    (tmp_path / "t.poly").write_text("tr1 2006 1 1 1 1\nA 10 5.0 1.0 N -1 -1 -1\nC 20 nan 1.0 T 21 2.5 0.5\n")
    got = other.poly_peaks(spark, f"{tmp_path}/t.poly").collect()
    assert [(r["base"], r["area"], r["alt"], r["alt_area"]) for r in got] == [("A", 5.0, "N", -1.0), ("C", 0.0, "T", 2.5)]
    (tmp_path / "m.bin").write_bytes(b"\x00\x00\x00\x03")
    (tmp_path / "h.txt").write_text("#a=b\n")
    assert other.is_binary_matrix(spark, f"{tmp_path}/m.bin") and not other.is_binary_matrix(spark, f"{tmp_path}/h.txt")
    assert other.newest_snp_table(["snp129", "snp130", "genes"]) == "snp130"
    region = other.genes_in_region(spark.createDataFrame([("chr1", 1, 5), ("chr1", 9, 12)], "chrom string, tx_start int, tx_end int"), "chr1", 5, 8)
    assert region.count() == 1


def test_matrix_blocks_nib_and_dbsnp(spark, tmp_path):
    import struct

    block = lambda kind, body: struct.pack(">ii", kind, len(body)) + body
    (tmp_path / "m.bin").write_bytes(block(3, b"s1") + block(4, bytes([1, 0x9D, 255])) + block(3, b"s2") + block(5, bytes([7, 3, 254, 2])))
    got = sorted(tuple(r) for r in binary.matrix_binary(spark, f"{tmp_path}/m.bin").collect() if r["value"] is not None)
    assert got == [("s1", 0, 1), ("s1", 2, -1), ("s2", 0, 7), ("s2", 1, 7), ("s2", 2, 7), ("s2", 3, -2), ("s2", 4, -2)]
    (tmp_path / "chrZ.nib").write_bytes(struct.pack("<II", 0x6BE93D3A, 5) + bytes([0x01, 0x23, 0x8F]))
    assert binary.genome_nib(spark, f"{tmp_path}/chrZ.nib").first()["bases"] == "TCAGt"
    (tmp_path / "d.blob").write_bytes(b"CdDF" + bytes(4) + bytes([4]) + b"chr1" + struct.pack(">i", 1) + struct.pack(">iib", 77, 9, 5))
    assert [tuple(r) for r in binary.dbsnp_blob(spark, f"{tmp_path}/d.blob").collect()] == [("chr1", 10, 77, 5)]
    with pytest.raises(ValueError, match="no BAM"):
        next(binary.decode_bam("x", gzip.compress(b"nope")))


def test_distances_go_by_column_not_by_place_in_a_list(spark):
    cells = [("A", 0, 1), ("A", 1, 2), ("B", 0, 7), ("B", 2, 9), ("C", 5, 3), ("D", 0, None), ("E", 0, 1), ("E", 1, 3), ("E", 2, 5)]
    m = spark.createDataFrame(cells, "sample string, col int, value int")
    got = {(r["a"], r["b"]): r["d"] for r in matrix.pair_distances(m, "euclidean").collect()}
    assert got[("A", "B")] == 6.0 and got[("A", "E")] == 1.0 and got[("B", "E")] == pytest.approx(52**0.5)
    assert len(got) == 10 and got[("A", "C")] is None and got[("A", "D")] is None


def test_matrix_text_keeps_columns_and_samples_that_look_like_the_header(spark, tmp_path):
    m = spark.createDataFrame([("a", 0, 1), ("a", 2, 3), ("b", 1, 2)], "sample string, col int, value int")
    assert sorted(r["value"] for r in sinks.matrix_lines(m).collect()) == ["a\t1\tNA\t3", "b\tNA\t2\tNA"]
    (tmp_path / "m.txt").write_text("#k=v\nid\tm1\nx\t1\nid\tm1\ny\t2\nid\tm1\n")
    got = sorted((r["sample"], r["value"]) for r in sources.matrix(spark, f"{tmp_path}/m.txt").collect() if r["value"] is not None)
    assert got == [("x", 1), ("y", 2)]
    assert sources.matrix(spark, f"{tmp_path}/m.txt").where("sample = 'id'").count() == 2


def test_gistic_lines_keep_every_marker(spark, tmp_path):
    (tmp_path / "g.txt").write_text("all,+,0.1,chr1:5-9," + ",".join(f"m{i}" for i in range(3000)) + ",_Zsc,2.5\n")
    row = sources.gistic_lines(spark, f"{tmp_path}/g.txt").first()
    assert len(row["markers"]) == 3000 and row["z"] == 2.5


def test_scratch_folders_are_refused_off_a_local_master():
    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:  # noqa: E742
                            @staticmethod
                            def isDefined():
                                return False

                        return O

                return S

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        paths.scratch(Session(), "x")


def test_only_near_pairs_leave_their_task_whatever_the_blocks(spark):
    import numpy as np

    values = np.random.default_rng(8).integers(-98, 99, (40, 6)).astype(float)
    values[np.random.default_rng(9).random(values.shape) < 0.2] = np.nan
    m = spark.createDataFrame([(i, j, None if np.isnan(v) else int(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "sample long, col int, value int")
    for metric, within in (("pearson", 0.5), ("euclidean", 120.0)):
        d = matrix.DISTANCES[metric](values, values, None)
        near = d >= within if metric == "pearson" else d <= within
        want = {(i, j): d[i, j] for i in range(40) for j in range(i + 1, 40) if near[i, j]}
        for block in (None, 7, 1):
            got = {(r["a"], r["b"]): r["d"] for r in matrix.pair_distances(m, metric, block=block, within=within).collect()}
            assert got == pytest.approx(want) and len(want) > 5


def test_a_sample_is_copied_for_a_bounded_number_of_blocks(spark):
    """All pairs of 20,000 samples: 16 to 17 copies of each are shuffled, not one for every 512 samples."""
    m = spark.range(20000).select(F.col("id").alias("sample"), F.lit(0).alias("col"), (F.col("id") % 7).alias("value"))
    plan = matrix.pair_distances(m, "euclidean", within=-1.0)
    dealt = plan._jdf.queryExecution().optimizedPlan().children().head()
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, dealt).count() <= 17 * 20000


def test_mean_linkage_compares_within_components_alone(spark):
    m = spark.createDataFrame([(i, 0, v) for i, v in enumerate((0, 1, 3, 100, 101, 500))], "sample long, col int, value int")
    got = sorted(map(tuple, matrix.cluster(m, "euclidean", 2.0, "mean", driver_clusters=1).collect()))
    assert got == [(0, 0), (1, 0), (3, 1), (4, 1)]
    groups = spark.createDataFrame([(0, "x"), (1, "x"), (3, "y"), (4, "y")], "sample long, group string")
    assert sorted((r["a"], r["b"]) for r in matrix.pair_distances(m, "euclidean", groups=groups).collect()) == [(0, 1), (3, 4)]


def test_sites_that_cannot_be_called_are_left_out(spark):
    from varispark.config import VariantConfig

    cell = lambda pos, base, n, name: [("chr1", pos, base, "A", f"{name}{i}") for i in range(n)]
    rows = cell(1, "A", 96, "r") + cell(1, "C", 4, "v") + cell(2, "A", 90, "r") + cell(2, "C", 10, "v") + cell(3, "A", 76, "r") + cell(3, "C", 4, "v")
    obs = spark.createDataFrame(rows, "chrom string, pos int, base string, ref string, qname string")
    pos = lambda per_name: sorted(r["pos"] for r in calls.candidate_sites(obs, VariantConfig(), per_name).collect())
    assert pos(None) == [1, 2, 3] and pos(1) == [2, 3] and pos(2) == [2, 3]  # 4 names may take 4 * 1 of the 96 with them: 4 / 96 still is under 5 %
    assert pos(6) == [1, 2, 3]


@pytest.mark.parametrize("has", ["a", "ac", "t", "gt"])
def test_traces_without_all_channels_are_turned_whole(spark, has):
    from varispark.operators import traces

    cells = [f"array({k}, 2, 3, 9) as {c}" if c in has else f"cast(null as array<int>) as {c}" for k, c in enumerate("acgt")]
    r = traces.turned(spark.range(1).selectExpr("'t0' as name", *cells, "'AC' as bases", "array(0, 3) as places")).first()
    assert r["places"] == [0, 3] and (r["t"] is not None) == ("a" in has)
