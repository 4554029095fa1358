"""Calls from groups of observations against calls from single ones."""

import random

import pytest
from pyspark.sql import functions as F

from varispark.config import VariantConfig
from varispark.operators import calls
from varispark.plans import caller

CFG = VariantConfig(min_quality=5, min_flanking_quality=3, flanking_window=2, min_alt_allele_count=1, min_minor_allele_frequency=0.0, min_coverage=1, min_mapq=0, mismatch_max_lq=5, mismatch_max_hq=4, end_mismatch_windows=((4, 3), (3, 2)))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    text = {c: "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=150)) for c in "ab"}
    ref = spark.createDataFrame([(c, k + 1, t[k : k + 16]) for c, t in text.items() for k in range(0, 150, 16) if k != 48], "chrom string, chunk_start int, bases string")
    rows = []
    for i in range(900):
        c, pos, cigar = rng.choice("ab"), rng.randrange(1, 140), rng.choice(["12M", "12M", "3S9M", "4M2D8M", "5M3I4M", "6M40N6M"])
        seq, at, j = "", pos, 0
        for n, op in {"12M": [(12, "M")], "3S9M": [(3, "S"), (9, "M")], "4M2D8M": [(4, "M"), (2, "D"), (8, "M")], "5M3I4M": [(5, "M"), (3, "I"), (4, "M")], "6M40N6M": [(6, "M"), (40, "N"), (6, "M")]}[cigar]:
            own = (text[c][at - 1 : at - 1 + n] + "A" * n)[:n] if op == "M" else "C" * n if op in "SI" else ""
            seq += "".join(rng.choice("ACGTN") if rng.random() < 0.1 else x for x in own)
            at += n if op in "MDN" else 0
        qual = [rng.choice([2, 8, 20, 30, 35]) if rng.random() < 0.2 else 30 for _ in range(12)]
        rows.append((i, c, pos, cigar, seq, qual if rng.random() < 0.97 else None, rng.choice([0, 16]), rng.choice([10, 20]), rng.choice("NT"), rng.choice([None, f"r{i // 4}", f"r{i // 4}", f"u{i}"])))
    reads = spark.createDataFrame(rows, "read_id long, rname string, pos int, cigar string, seq string, qual array<int>, flag int, mapq int, tn string, qname string").repartition(3)
    return reads, ref


def test_calls_are_those_of_single_observations(spark, data):
    reads, ref = data
    none = spark.createDataFrame([], "chrom string, pos int, rs long, mask tinyint")
    found = [caller.call_variants(reads, ref, 16, CFG, k).drop("dbsnp") for k in (None, none)]
    a, b = (sorted(map(str, x.select(found[0].columns).collect())) for x in found)
    assert a == b and len(a) > 100
    assert {"SNP", "insertion", "deletion"} == {r["type"] for r in found[0].select("type").distinct().collect()}


def test_reads_alone_leave_sums(spark, data):
    reads, ref = data
    alone = reads.withColumn("qname", F.concat(F.lit("q"), "read_id")).where("cigar <> '6M40N6M'")
    groups = caller.site_groups(alone, ref, 16, CFG, salts=1).where("n > 0").cache()
    assert groups.count() < 0.6 * groups.agg(F.sum("n")).first()[0]
    assert groups.where("base = ref").groupBy("chrom", "pos", "tn", "strand", "near").count().where("count > 2").count() == 0  # reads from two chunks reach a site


@pytest.fixture(scope="module")
def observed(spark):
    """Sites with and without names that occur twice, mates that disagree, and observations without a name."""
    rng, rows = random.Random(5), []
    for pos in range(120):
        ref, alt = rng.sample("ACGT", 2)
        for k in range(rng.choice([4, 12, 40])):
            name = f"q{pos}-{k}" if pos % 2 else rng.choice([None, f"q{rng.randrange(12)}", f"u{k}"])
            rows.append(("a", pos, rng.choice([ref, alt, alt, rng.choice("ACGT")]), ref, rng.choice("NT"), rng.choice("+-"), rng.choice([12, 25, 38]), name, rng.choice([None, 1, 2, 3]), rng.randrange(60), rng.randrange(25)))
    return spark.createDataFrame(rows, "chrom string, pos int, base string, ref string, tn string, strand string, qual int, qname string, unclipped_start int, mapq int, flank int").repartition(3)


def test_sites_without_repeated_names_are_called_as_by_name(spark, observed):
    own = {"alone": F.lit(False), "n": F.lit(1), "decades": F.floor(F.col("qual") / 10), "flanked": (F.col("flank") >= 10).cast("int"), "mapq_sum": F.col("mapq"), "named": F.col("qname").isNotNull(), "near": F.col("flank") < 10}
    cfg = VariantConfig(min_alt_allele_count=1, min_minor_allele_frequency=0.0)
    gone = spark.createDataFrame([("a", 30, 20)], "chrom string, start int, len int")
    by_name = calls.call_groups(observed.withColumns(own), calls.candidate_sites(observed, cfg), cfg, gone)
    a, b = (sorted(map(str, x.collect())) for x in (calls.call_snps(observed, cfg, gone), by_name))
    assert a == b and len(a) > 80


def test_only_sites_with_repeated_names_are_sorted_by_name(observed):
    plan = calls.call_snps(observed)._jdf.queryExecution().executedPlan().toString().splitlines()
    by_name = [k for k, x in enumerate(plan) if "windowspecdefinition" in x and "qname" in x]
    scans = [next(x for x in plan[k:] if "Scan" in x) for k in by_name]
    assert scans and not any("ExistingRDD" in x for x in scans) and not any("collect_set" in x for x in plan)
