"""Queries that write a format, read it back and digest what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, reads as ops
from ..sinks import text as sinks
from ..sources import bam, other
from ..sources import text as sources
from ..sources.paths import scratch
from .fixtures import BASES_SQL, CHUNK, MATRIX_SQL, READS_SQL, matrix, reads, ref_index, reference


def _write(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = scratch(spark, name)
    df.write.text(path)
    return path


def sam(spark: SparkSession, sf: str) -> DataFrame:
    back = sources.sam_reads(spark, _write(sinks.sam_lines(reads(spark, sf)), spark, "sam"))
    return back.groupBy("rname", "cigar").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flags"), F.sum("pos").alias("places"), F.sum(F.size("qual")).alias("qualities"), F.sum(F.col("tags")["XQ"].cast("long")).alias("xq"))


def fastq(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.text(_write(sinks.fastq(reads(spark, sf), as_sequenced=True), spark, "fastq"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").rlike("^@r[0-9]+ rc_fixed$")).alias("turned"), F.count_if(F.col("value") == "+").alias("records"), F.count_if(F.col("value").rlike("^[ACGT]{32}$")).alias("sequences"))


def fasta(spark: SparkSession, sf: str) -> DataFrame:
    whole = reference(spark, sf).select(F.concat_ws("_", "chrom", F.col("chunk_start").cast("string")).alias("name"), "bases")
    back = sources.fasta(spark, _write(sinks.fasta(whole), spark, "fasta"))
    return sources.chunked(back, 100).groupBy("chunk_start").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bases")).alias("bases"), F.sum(F.length(F.regexp_replace("bases", "[^A]", ""))).alias("a"))


def report(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "report")
    t = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("note"))
    sinks.report(t, ["o_orderkey", "o_orderstatus", "note"], path)
    return sources.delimited(spark, path).groupBy("o_orderstatus", "note").agg(F.count(F.lit(1)).alias("n"))


def wig(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of whole chromosomes, a folder of files for each of the reads' chromosomes; it is counted once."""
    held, path = scratch(spark, "depth"), scratch(spark, "wig")
    c = coverage.depth(reads(spark, sf).where(~ops.has(ops.DUPLICATE) & ~ops.has(ops.UNMAPPED)), 10)
    c.write.parquet(held)
    sinks.wig_lines(spark.read.schema(c.schema).parquet(held)).write.partitionBy("chrom").text(path)
    lines = spark.read.schema("value string, chrom string").text(path)
    return lines.agg(F.count_if(F.col("value").startswith("fixed")).alias("runs"), F.count_if(~F.col("value").startswith("fixed")).alias("values"), F.sum(F.when(~F.col("value").startswith("fixed"), F.col("value").cast("long"))).alias("total"))


def matrix_text(spark: SparkSession, sf: str, encoding: str | None = None) -> DataFrame:
    m = matrix(spark, sf).withColumnRenamed("vec_id", "sample")
    head = "\t".join(["id", *[f"m{i}" for i in range(64)]])
    first = [f"#sample_data_encoding={encoding}" if encoding else "#title=x", head]
    top = spark.range(1).select(F.posexplode(F.array(*map(F.lit, first))).alias("k", "value"))
    every = top.union(sinks.matrix_lines(m, encoding).select(F.lit(2).alias("k"), "value"))
    path = scratch(spark, "matrix")
    every.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # one file, as the format has it
    back = sources.matrix(spark, path)
    return back.groupBy("marker").agg(F.count("value").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def partitioned(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "places")
    sinks.by_place(reads(spark, sf).select("rname", "pos", "read_id"), 500, path)
    return spark.read.parquet(path).groupBy("rname", "bucket").agg(F.count(F.lit(1)).alias("n")).select("rname", F.col("bucket").cast("long").alias("bucket"), "n")


def clipped_fasta(spark: SparkSession, sf: str) -> DataFrame:
    r = ops.usable_reads(reads(spark, sf)).withColumn("c", F.explode(ops.soft_clips(4, 15.0)))
    r = r.select(F.col("qname").alias("name"), F.col("seq").substr(F.col("c.start") + 1, F.col("c.len")).alias("bases"), "rname", "pos")
    back = sources.fasta(spark, _write(sinks.described_fasta(r, ["rname", "pos"]), spark, "clips"))
    return back.groupBy(F.length("bases").alias("len"), F.regexp_extract("description", r"rname=(\w+)", 1).alias("rname")).agg(F.count(F.lit(1)).alias("n"))


def markup(spark: SparkSession, sf: str) -> DataFrame:
    """A markup file of samples, titles and comments, by keyword."""
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    lines = n.select(F.concat_ws("\t", F.lit("sample2id"), "n_name", "n_nationkey").alias("value")).union(r.select(F.concat_ws("\t", F.lit("title"), "r_name")))
    lines = lines.union(r.select(F.concat(F.lit("# "), "r_name"))).union(r.select(F.lit("")))
    back = other.markup(spark, _write(lines, spark, "markup"))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fields")).alias("fields"), F.min(F.get("fields", F.lit(0))).alias("least"))


def gene_list(spark: SparkSession, sf: str) -> DataFrame:
    """A gene list whose names are found without regard to case and whose chromosomes lack their prefix."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    lines = p.select(F.concat_ws("\t", F.concat(F.lit("gene"), "p_partkey"), F.col("p_size") % 22 + 1, "p_partkey", F.col("p_partkey") + F.col("p_size")).alias("value"))
    back = other.gene_list(spark, _write(lines, spark, "genes"))
    return back.where(F.col("name").startswith("GENE")).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def pathway_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged rows of a pathway and its genes, turned into genes and how many pathways hold them."""
    ps = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.concat(F.lit("g"), F.col("o_custkey") % 40).alias("gene"), (F.col("o_orderkey") % 97).alias("path")).distinct()
    lines = ps.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("gene")), "\t").alias("genes")).select(F.concat_ws("\t", F.concat(F.lit("p"), "path"), F.lit("a pathway"), "genes").alias("value"))
    back = other.pathways(spark, _write(lines, spark, "pathways"))
    return back.groupBy("gene").agg(F.count(F.lit(1)).alias("pathways"))


BAM_REFS = [(f"chr{c}", 250_000_000) for c in (1, 2, 3)]


def _bam(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "bam")
    bam.write_bam(reads(spark, sf), path, BAM_REFS, step=1 << 14)
    return path


def bam_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written as indexed BAM files and read in ranges of their blocks."""
    back = bam.bam(spark, _bam(spark, sf), split=1 << 16)
    return back.groupBy("rname", "cigar").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flags"), F.sum("pos").alias("places"), F.sum(F.size("qual")).alias("qualities"), F.sum(F.length("seq")).alias("bases"), F.sum(F.col("tags")["XQ"].cast("long")).alias("xq"))


def bam_region(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that touch a region, with three of their columns, from the blocks that can hold them."""
    back = bam.bam(spark, _bam(spark, sf), ["rname", "pos", "cigar"], "2:160-195", split=1 << 16).where("pos >= 120")
    return back.groupBy("rname", "pos", "cigar").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "s01_bam_splits": bam_splits,
    "s02_bam_region": bam_region,
    "s16_markup": markup,
    "s20_gene_list": gene_list,
    "s28_pathway_file": pathway_file,
    "s01_k03_sam_round_trip": sam,
    "k02_k10_fastq": fastq,
    "s11_s14_fasta_round_trip": fasta,
    "k01_k09_s26_report": report,
    "k05_wig": wig,
    "s21_matrix_text": matrix_text,
    "s22_matrix_rle": lambda s, d: matrix_text(s, d, "rle"),
    "k04_partitioned_by_place": partitioned,
    "k08_soft_clip_fasta": clipped_fasta,
}

_M = f"WITH {MATRIX_SQL} SELECT 'm' || col AS marker, count(value) AS n, CAST(sum(value) AS BIGINT) AS total FROM matrix GROUP BY col"
_USE = "flag & 1024 = 0 AND flag & 4 = 0"
ORACLE = {
    "s01_bam_splits": f"WITH {READS_SQL} SELECT rname, cigar, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags, CAST(sum(pos) AS BIGINT) AS places, count(*) * 32 AS qualities, count(*) * 32 AS bases, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS xq FROM reads GROUP BY ALL",
    "s02_bam_region": f"WITH {READS_SQL} SELECT rname, pos, cigar, count(*) AS n FROM reads WHERE rname = 'chr2' AND pos BETWEEN 120 AND 195 AND pos - 1 + CASE kind WHEN 2 THEN 34 WHEN 3 THEN 27 WHEN 4 THEN 29 WHEN 5 THEN 132 WHEN 6 THEN 28 ELSE 32 END >= 160 GROUP BY ALL",
    "s16_markup": "SELECT 'sample2id' AS kind, count(*) AS n, count(*) * 2 AS fields, min(n_name) AS least FROM nation UNION ALL SELECT 'title', count(*), count(*), min(r_name) FROM region",
    "s20_gene_list": "SELECT 'chr' || (p_size % 22 + 1) AS chrom, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS starts, CAST(sum(p_partkey + p_size) AS BIGINT) AS ends FROM part GROUP BY 1",
    "s28_pathway_file": "SELECT 'g' || (o_custkey % 40) AS gene, count(DISTINCT o_orderkey % 97) AS pathways FROM orders GROUP BY 1",
    "k05_wig": f"WITH {BASES_SQL}, c AS (SELECT rname, q, count(*) AS k FROM bases WHERE aligned AND {_USE} AND qual >= 10 GROUP BY ALL) SELECT count(*) FILTER (p.q IS NULL) AS runs, count(*) AS values, CAST(sum(k) AS BIGINT) AS total FROM c LEFT JOIN (SELECT rname, q FROM c) p ON c.rname = p.rname AND p.q = c.q - 1",
    "k08_soft_clip_fasta": f"WITH {BASES_SQL}, c AS (SELECT read_id, rname, CAST(count(*) AS INT) AS len FROM bases WHERE {_USE} AND flag & 256 = 0 AND mapq >= 1 AND ((kind = 3 AND i < 5) OR (kind = 6 AND i >= 28)) GROUP BY ALL HAVING avg(qual) >= 15) SELECT len, rname, count(*) AS n FROM c GROUP BY ALL",
    "s01_k03_sam_round_trip": f"WITH {READS_SQL} SELECT rname, cigar, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags, CAST(sum(pos) AS BIGINT) AS places, count(*) * 32 AS qualities, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS xq FROM reads GROUP BY ALL",
    "k02_k10_fastq": f"WITH {READS_SQL} SELECT count(*) * 4 AS lines, count(*) FILTER (flag & 16 > 0) AS turned, count(*) AS records, count(*) AS sequences FROM reads",
    "s11_s14_fasta_round_trip": f"WITH c AS (SELECT unnest(range(1, 4)) AS c), k AS (SELECT unnest(range(CAST((SELECT max(p_partkey) + 400 FROM part) // {CHUNK} + 1 AS BIGINT))) AS k), b AS (SELECT c, i // 100 * 100 + 1 AS chunk_start, k, {ref_index(f'(k * {CHUNK} + 1 + i)', 'c', False)} = 0 AS a FROM c, k, (SELECT unnest(range({CHUNK})) AS i)) SELECT CAST(chunk_start AS INT) AS chunk_start, count(DISTINCT (c, k)) AS n, count(*) AS bases, count(*) FILTER (a) AS a FROM b GROUP BY 1",
    "k01_k09_s26_report": "SELECT o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS note, count(*) AS n FROM orders GROUP BY ALL",
    "s21_matrix_text": _M,
    "s22_matrix_rle": _M,
    "k04_partitioned_by_place": f"WITH {READS_SQL} SELECT rname, CAST(pos // 500 AS BIGINT) AS bucket, count(*) AS n FROM reads GROUP BY ALL",
}
