"""Bases counted in batches of reads against bases laid out as rows."""

import random

import pytest
from pyspark.sql import functions as F

from varispark.functions import batches
from varispark.operators import coverage, reads as ops


@pytest.fixture(scope="module")
def reads(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        n = rng.choice([12, 12, 12, 9])
        qual = [rng.choice([None, 1, 9, 20, 30, 40, 40]) for _ in range(n)] if i % 11 else None
        rows.append((rng.choice(["a", "b", None]), rng.choice(["12M", "3S9M", "4M2D8M", "5M3I4M", "6M40N6M", "*", None]), rng.choice([None, 1, 5, 60]), "".join(rng.choices("ACGTn", k=rng.choice([12, 10]))), qual))
    return spark.createDataFrame(rows, "rname string, cigar string, pos int, seq string, qual array<int>").repartition(3)


def test_depth(reads):
    b = ops.aligned_bases(reads).where("q >= 10").groupBy("rname", "pos_at").count()
    assert sorted(map(str, map(tuple, coverage.depth(reads, 10).collect()))) == sorted(map(str, map(tuple, b.collect())))


@pytest.mark.parametrize("window", [0, 2, 5])
def test_flanks(reads, window):
    b = ops.aligned_bases(reads).where("q >= 10").where(ops.flanking_quality(window, 8)).groupBy("rname", "base").count()
    assert sorted(map(str, map(tuple, ops.flanked_bases(reads, 10, window, 8).collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_batches_leave_a_row_for_a_place(reads):
    table = reads.where("rname is not null").coalesce(1).toArrow().to_batches(max_chunksize=20)
    for most, more in ((1 << 20, False), (40, True)):
        out = [tuple(r.values()) for b in batches.depth_counts(iter(table), 10, most) for r in b.to_pylist()]
        assert (len(out) > len({r[:2] for r in out})) == more
        assert sum(r[2] for r in out) == ops.aligned_bases(reads.where("rname is not null")).where("q >= 10").count()


def test_wig_of_all_chromosomes(spark, reads):
    from varispark.sinks import text

    c = spark.createDataFrame([(x, p, p) for x in "ab" for p in (1, 2, 4)], "chrom string, pos int, coverage long")
    assert [r["value"] for r in text.wig_lines(c).collect()] == [f for x in "ab" for f in (f"fixedStep chrom={x} start=1 step=1\n1", "2", f"fixedStep chrom={x} start=4 step=1\n4")]
