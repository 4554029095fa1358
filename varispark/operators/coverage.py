"""Coverage by base, over a region, over targets; splice junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches, cigar
from .reads import aligned_bases


def by_base(bases: DataFrame) -> DataFrame:
    """(rname, pos_at, coverage, A, C, G, T). Counts are summed in each task before the shuffle."""
    return bases.groupBy("rname", "pos_at").agg(F.count(F.lit(1)).alias("coverage"), *[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])


def depth(reads: DataFrame, least: int) -> DataFrame:
    """(chrom, pos, coverage) of every position on which a base of quality `least` lies.

    Bases are counted in the batches of reads that hold them and never become rows.
    """
    n = reads.select("rname", "cigar", "pos", "qual").mapInArrow(lambda r: batches.depth_counts(r, least), "chrom string, pos int, n long")
    return n.groupBy("chrom", "pos").agg(F.sum("n").alias("coverage"))


def region(reads: DataFrame, chrom: str, start: int, end: int, least: int) -> DataFrame:
    """(pos, coverage) of every position of a region, 0 where no base of quality `least` lies."""
    near = reads.where((F.col("rname") == chrom) & (F.col("pos") <= end) & (cigar.end_position(F.col("cigar"), F.col("pos")) >= start))
    n = aligned_bases(near).where((F.col("q") >= least) & F.col("pos_at").between(start, end)).groupBy(F.col("pos_at").alias("pos")).agg(F.count(F.lit(1)).alias("coverage"))
    every = reads.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("pos"))
    return every.join(n, "pos", "left").select("pos", F.coalesce("coverage", F.lit(0)).alias("coverage"))


def targets(reads: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(name, bases, covered, size) of targets (name, chrom, start, end): an equi-join on their positions.

    Coverage is summed by position first, so each position meets its targets once.
    """
    n = depth(reads, least).withColumnRenamed("coverage", "k")
    at = wanted.select("name", "chrom", F.explode(F.sequence("start", "end")).alias("pos"))
    out = at.join(n, ["chrom", "pos"], "left").groupBy("name")
    return out.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("bases"), F.count("k").alias("covered"), F.count(F.lit(1)).cast("int").alias("size"))


def junctions(reads: DataFrame) -> DataFrame:
    """(rname, start, end) of each skipped region (N) of each read."""
    ops = cigar.operations(F.col("cigar"))
    zero = F.struct(F.col("pos").cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s, x):  # noqa: ANN001, ANN202
        skip = F.array(F.struct(s["at"].alias("start"), (s["at"] + x["len"] - 1).alias("end")))
        return F.struct((s["at"] + F.when(x["op"].isin(cigar.ON_REFERENCE), x["len"]).otherwise(0)).alias("at"), F.when(x["op"] == "N", F.concat(s["out"], skip)).otherwise(s["out"]).alias("out"))

    found = reads.select("rname", F.explode(F.aggregate(ops, zero, step, lambda s: s["out"])).alias("j"))
    return found.select("rname", "j.start", "j.end")
