"""Mismatches held by read against the rows of pieces, for reads within two chunks and longer ones."""

import random

import pytest
from pyspark.sql import functions as F

from varispark.config import VariantConfig
from varispark.functions import names
from varispark.operators import reads as ops

SCHEMA = "read_id long, rname string, pos int, cigar string, seq string, qual array<int>"


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(7)
    text = {c: "".join(rng.choices("ACGTNacgt", [9, 9, 9, 9, 1, 1, 1, 1, 1], k=210)) for c in "ab"}
    ref = spark.createDataFrame([(c, k + 1, t[k : k + 16]) for c, t in text.items() for k in range(0, 210, 16) if k != 48], "chrom string, chunk_start int, bases string")
    rows = []
    for i in range(120):
        cigar = rng.choice(["12M", "3S9M", "4M2D8M", "5M3I4M", "6M40N6M", "2M1I30N9M", "6M4S", "*", None])
        rows.append((i, rng.choice("abz"), rng.randrange(1, 230), cigar, "".join(rng.choices("ACGTa", k=12)), [rng.randrange(40) for _ in range(12)]))
    reads = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return ops.mismatch_bases(ops.aligned_pieces(reads, ref, 16)).cache(), ops.read_mismatches(reads, ref, 16).cache(), rows


def plain(df):
    return sorted(map(tuple, df.select("read_id", "pos_at", "read_i", "base", "q", "ref").collect()))


def test_rows_are_those_of_pieces(both):
    rows, judged, reads = both
    assert plain(ops.mismatch_rows(judged)) == plain(rows)
    assert sorted(r["read_id"] for r in judged.collect()) == [r[0] for r in reads]


def test_verdicts_by_read_are_those_of_groups(both):
    rows, judged, _ = both
    cfg = VariantConfig(mismatch_max_lq=4, mismatch_max_hq=2, end_mismatch_windows=((5, 2), (3, 1)))
    want = {r["read_id"]: r["passed"] for r in ops.mismatch_counts(rows, cfg).collect()}
    got = {r["read_id"]: r["p"] for r in judged.where(F.size("mm") > 0).select("read_id", ops.passes(cfg).alias("p")).collect()}
    assert got == want
    assert plain(ops.near_bad_ends(judged, cfg)) == plain(ops.end_blacklist(rows, cfg))
    best = {r["read_id"]: r["best"] for r in ops.densest_window(rows, 6, 10).collect()}
    assert {r["read_id"]: r["b"] for r in judged.select("read_id", ops.densest(6, 10).alias("b")).where("b > 0").collect()} == best


def test_reads_are_not_grouped_to_be_judged(both, spark):
    text = lambda f: f("/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    from varispark.plans import readsets

    assert "collect_list(CASE" not in text(lambda d: readsets.ends(spark, d))
    join = text(lambda d: readsets.deletions_filter(spark, d)).split("Join LeftOuter")[1]
    assert join.index("Aggregate") < join.index("ArrowEvalPython")  # counts meet the deletions, not bases


def test_plain_names_are_told_as_others(spark):
    given = [f"chr{x}" for x in (*range(0, 30), "X", "Y", "M", "MT", "Z")] + ["1", "x", "CHR7", " chr3 ", "chr1_random", None]
    df = spark.createDataFrame([(x,) for x in given], "s string")
    slow = names.chromosome_number(F.concat(F.col("s"), F.lit("")))
    assert [(r["a"], r["b"]) for r in df.select(names.is_canonical(F.col("s")).alias("a"), slow.isNotNull().alias("b")).collect()] == [(r["b"], r["b"]) for r in df.select(slow.isNotNull().alias("b")).collect()]
