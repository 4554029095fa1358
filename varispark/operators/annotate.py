"""Genes, introns, builds, samples and layouts: interval joins, codons, naming conventions, coordinate maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq


def interval_overlaps(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of rows of a and b (id, chrom, s, e) that overlap, ends included; ids as id_a and id_b.

    Both are put into bins of `size` positions and joined on the bin; a pair that shares several is taken from the
    first of them alone, so nothing is made distinct afterwards.
    """
    binned = lambda t, p: t.select(*[F.col(c).alias(f"{c}_{p}") for c in ("id", "s", "e")], "chrom", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor(F.col("e") / size))).alias("bin"))
    j = binned(a, "a").join(binned(b, "b"), ["chrom", "bin"])
    first = F.floor(F.greatest("s_a", "s_b") / size) == F.col("bin")
    return j.where(first & (F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a"))).select("id_a", "id_b", "chrom")


def codons(transcripts: DataFrame) -> DataFrame:
    """(name, chrom, strand, codon_no, places): the three coding positions of each codon, in transcript order.

    Transcripts have cds_start and cds_end and arrays of exon starts and ends, all 1-based and inclusive.
    """
    exon = F.explode(F.arrays_zip("exon_starts", "exon_ends")).alias("x")
    e = transcripts.select("name", "chrom", "strand", "cds_start", "cds_end", exon)
    lo, hi = F.greatest("x.exon_starts", "cds_start"), F.least("x.exon_ends", "cds_end")
    at = e.where(lo <= hi).select("name", "chrom", "strand", F.explode(F.sequence(lo, hi)).alias("pos"))
    w = Window.partitionBy("name").orderBy(F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos")))
    n = at.withColumn("i", F.row_number().over(w) - 1)
    c = n.groupBy("name", "chrom", "strand", F.floor(F.col("i") / 3).cast("int").alias("codon_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pos"))), lambda x: x["pos"]).alias("places"))
    return c.where(F.size("places") == 3)


def coding_changes(variants: DataFrame, codon_table: DataFrame, base_at: DataFrame) -> DataFrame:
    """variants (chrom, pos, alt) in codons: old and new codon and amino acid, and change 0 silent, 2 stop gained or lost, 1 other.

    base_at: (chrom, pos, ref) of coding positions. Bases and the variant are complemented on the minus strand.
    """
    c = codon_table.select("name", "chrom", "strand", "codon_no", F.posexplode("places").alias("k", "pos"))
    spelled = c.join(base_at, ["chrom", "pos"]).withColumn("b", F.when(F.col("strand") == "-", seq.complement(F.col("ref"))).otherwise(F.col("ref")))
    text = spelled.groupBy("name", "codon_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "").alias("codon"))
    hit = variants.join(c, ["chrom", "pos"]).join(text, ["name", "codon_no"])
    alt = F.when(F.col("strand") == "-", seq.complement(F.col("alt"))).otherwise(F.col("alt"))
    new = F.concat(F.col("codon").substr(F.lit(1), F.col("k")), alt, F.col("codon").substr(F.col("k") + 2, F.lit(3)))
    out = hit.withColumn("new_codon", new).withColumn("old_aa", seq.amino_acid(F.col("codon"))).withColumn("new_aa", seq.amino_acid(F.col("new_codon")))
    change = F.when(F.col("old_aa") == F.col("new_aa"), 0).when((F.col("old_aa") == "!") | (F.col("new_aa") == "!"), 2).otherwise(1)
    return out.select("name", "chrom", "pos", "codon_no", "codon", "new_codon", "old_aa", "new_aa", change.alias("change"))


def dictionary_check(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, status) of sequences (name, length): missing on either side, or of another length."""
    j = reads.select("name", F.col("length").alias("a")).join(reference.select("name", F.col("length").alias("b")), "name", "full_outer")
    status = F.when(F.col("b").isNull(), "not_in_reference").when(F.col("a").isNull(), "not_in_reads").when(F.col("a") != F.col("b"), "length_differs").otherwise("same")
    return j.select("name", status.alias("status"))


def identify_build(lengths: DataFrame, builds: DataFrame) -> DataFrame:
    """(build) of builds (build, chrom, length) with a length in common and none that differs; empty if several are."""
    j = lengths.select("chrom", F.col("length").alias("own")).join(builds, "chrom")
    ok = j.groupBy("build").agg(F.count_if(F.col("own") == F.col("length")).alias("hits"), F.count_if(F.col("own") != F.col("length")).alias("misses")).where("hits > 0 and misses = 0")
    return ok.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).where("n = 1").select("build")


# Sample type codes of public cancer barcodes, with T for tumor and N for normal tissue.
SAMPLE_TYPES = {"01": ("T", "primary solid tumor"), "02": ("T", "recurrent solid tumor"), "03": ("T", "primary blood cancer"), "06": ("T", "metastasis"), "10": ("N", "blood normal"), "11": ("N", "solid tissue normal"), "12": ("N", "buccal cell normal")}


def parse_convention(text: str) -> dict:
    """'name,regex,code,T|N,description,code,...' as a naming convention; the regex's first group is the code."""
    name, rx, *rest = text.split(",")
    re.compile(rx)
    if len(rest) % 3 or any(t not in "TN" for t in rest[1::3]):
        raise ValueError("after the pattern come code, T or N, description, again and again")
    return {"name": name, "regex": rx, "codes": {c: (t, d) for c, t, d in zip(rest[::3], rest[1::3], rest[2::3], strict=True)}}


TCGA = {"name": "TCGA", "regex": r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-([0-9]{2})[A-Z]?", "codes": SAMPLE_TYPES}


def sample_type(s: Column, conventions: list[dict]) -> Column:
    """struct<convention, code, tn, description> by the first convention that fits; '?' for unknown codes."""
    out = F.lit(None).cast("struct<convention:string,code:string,tn:string,description:string>")
    for c in reversed(conventions):
        code = F.regexp_extract(s, c["regex"], 1)
        pick = lambda k, c=c: F.element_at(F.create_map(*[F.lit(x) for key, v in c["codes"].items() for x in (key, v[k])]), code)  # noqa: E731, B023
        hit = F.struct(F.lit(c["name"]).alias("convention"), code.alias("code"), F.coalesce(pick(0), F.lit("?")).alias("tn"), pick(1).alias("description"))
        out = F.when(code != "", hit).otherwise(out)
    return out


def islands(at: DataFrame, least: int, keep: int) -> DataFrame:
    """(grp, start, end) of runs of `least` or more neighbouring positions (grp, pos), less `keep` at either side."""
    w = Window.partitionBy("grp").orderBy("pos")
    runs = at.distinct().withColumn("k", F.col("pos") - F.row_number().over(w)).groupBy("grp", "k").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.where(F.col("end") - F.col("start") + 1 >= least).select("grp", (F.col("start") + keep).alias("start"), (F.col("end") - keep).alias("end")).where("start <= end")


def shifted(places: DataFrame, cuts: DataFrame) -> DataFrame:
    """places (grp, pos) with new_pos after the cuts (grp, start, end) are taken out; null inside a cut.

    Cuts get running totals; one window over places and cut ends then carries the total forward.
    """
    w = Window.partitionBy("grp").orderBy("start")
    total = cuts.withColumn("gone", F.sum(F.col("end") - F.col("start") + 1).over(w))
    marks = total.select("grp", F.col("start").alias("pos"), F.col("end").alias("cut_end"), "gone", F.lit(0).alias("kind"))
    rows = places.select("grp", "pos", F.lit(None).cast("long").alias("cut_end"), F.lit(None).cast("long").alias("gone"), F.lit(1).alias("kind"))
    v = Window.partitionBy("grp").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    j = rows.unionByName(marks).withColumn("gone", F.last("gone", True).over(v)).withColumn("cut_end", F.last("cut_end", True).over(v)).where("kind = 1")
    inside = F.coalesce(F.col("pos") <= F.col("cut_end"), F.lit(False))
    return j.select("grp", "pos", F.when(~inside, F.col("pos") - F.coalesce("gone", F.lit(0))).alias("new_pos"))


def pad_map(s: Column) -> Column:
    """array<int>: for each unpadded base, from 1, its place in a padded sequence."""
    chars = F.transform(F.split(s, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("at")))
    return F.transform(F.filter(chars, lambda x: (x["c"] != "*") & (x["c"] != "")), lambda x: x["at"])


def gap_plan(insertions: DataFrame) -> DataFrame:
    """(chrom, pos, pads): the longest insertion at a place, and the pads that it needs there."""
    return insertions.groupBy("chrom", "pos").agg(F.max("len").alias("len")).select("chrom", "pos", F.expr("repeat('*', len)").alias("pads"))


def genome_layout(chroms: DataFrame, columns: int) -> DataFrame:
    """chroms (chrom, size, k) with first and last column of each when lengths are scaled to `columns`."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = chroms.withColumn("upto", F.sum("size").over(w)).withColumn("total", F.sum("size").over(Window.partitionBy()))
    first = F.floor((F.col("upto") - F.col("size")) * columns / F.col("total")) + 1
    return t.select("chrom", first.alias("first"), F.floor(F.col("upto") * columns / F.col("total")).alias("last"))


def infill(peaks: DataFrame, bins: DataFrame, slack: int) -> DataFrame:
    """(peak, bin): bins (bin, chrom, marker) of a peak's markers (peak, marker), and those between on one chromosome.

    Bins between the least and the greatest hit are filled in where no gap is longer than `slack`.
    """
    hit = peaks.join(bins, "marker").select("peak", "chrom", "bin").distinct()
    w = Window.partitionBy("peak", "chrom").orderBy("bin")
    gap = F.coalesce(F.lead("bin").over(w) - F.col("bin") - 1, F.lit(0))
    upto = F.when(gap <= slack, F.coalesce(F.lead("bin").over(w) - 1, F.col("bin"))).otherwise(F.col("bin"))
    return hit.withColumn("upto", upto).select("peak", "chrom", F.explode(F.sequence("bin", "upto")).alias("bin"))


def orientation(s: Column) -> Column:
    """Whether a contig should be flipped: a poly-T tail comes before a reversed poly-A signal."""
    return s.rlike("[TNX]{13}.{9,35}TTTATT")
