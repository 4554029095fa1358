"""Further queries: site filters, extraction with mates, scales, masks and small encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VariantConfig
from ..functions import cigar, scales, seq
from ..operators import calls, indels, reads as ops
from .fixtures import BASES_SQL, CHUNK, OBS_SQL, READS_SQL, observations, reads, reference

_W = f"WITH {BASES_SQL}"
_USABLE = "flag & 1024 = 0 AND flag & 4 = 0 AND flag & 256 = 0 AND mapq >= 1"


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).withColumn("chrom", F.lit("chr1"))


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    return ops.bases(ops.aligned_pieces(ops.usable_reads(reads(spark, sf)), reference(spark, sf), CHUNK))


def _mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return ops.mismatch_bases(ops.aligned_pieces(ops.usable_reads(reads(spark, sf)), reference(spark, sf), CHUNK))


def quality_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with runs of the quality that a platform gives to doubtful ends."""
    low = F.transform("qual", lambda q: F.when(q < 20, 2).otherwise(q))
    return reads(spark, sf).groupBy("rname").agg(F.count_if(scales.quality_runs(low, 2, 2)).alias("n"))


def clipped_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Good mismatches inside soft clips, had the clipped bases been aligned, by end as sequenced."""
    r = ops.usable_reads(reads(spark, sf)).withColumn("c", F.explode(ops.soft_clips(1, 0.0)))
    # A clip is laid onto the reference beside the alignment and read like an aligned block.
    start = F.when(F.col("c.side") == "start", F.col("pos") - F.col("c.len")).otherwise(cigar.end_position(F.col("cigar"), F.col("pos")) + 1)
    part = lambda c: F.col(c).substr(F.col("c.start") + 1, F.col("c.len")) if c == "seq" else F.slice(c, F.col("c.start") + 1, F.col("c.len"))
    laid = r.select("read_id", "rname", "flag", start.cast("int").alias("pos"), F.concat(F.col("c.len").cast("string"), F.lit("M")).alias("cigar"), part("seq").alias("seq"), part("qual").alias("qual"), F.col("c.side").alias("side"))
    b = ops.bases(ops.aligned_pieces(laid, reference(spark, sf), CHUNK)).where((F.col("base") != F.col("ref")) & (F.col("q") >= 15))
    end = F.when(ops.has(ops.REVERSE), F.when(F.col("side") == "start", "end").otherwise("start")).otherwise(F.col("side"))
    return b.groupBy("rname", end.alias("end")).agg(F.count(F.lit(1)).alias("n"))


def broad_indels(spark: SparkSession, sf: str) -> DataFrame:
    i = indels.observed(ops.usable_reads(reads(spark, sf))).where("broad_ok")
    return i.groupBy("rname", "kind", "len", "tn", ops.strand().alias("strand")).agg(F.count(F.lit(1)).alias("n"))


def broad_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of reference and variant at the looser quality, by normal and tumor, and the coverage they make."""
    o = _obs(spark, sf).where("qual >= 15")
    ref = F.col("base") == F.col("ref")
    n = {f"{k}_{t}": F.count_if(c & (F.col("tn") == t.upper())) for k, c in (("ref", ref), ("alt", ~ref)) for t in "nt"}
    return o.groupBy("pos").agg(*[v.alias(k) for k, v in n.items()], F.count(F.lit(1)).alias("coverage"))


def loh(spark: SparkSession, sf: str) -> DataFrame:
    c = calls.loh_call(F.col("ref_n"), F.col("ref_t"), F.col("alt_n"), F.col("alt_t"))
    return broad_coverage(spark, sf).select("pos", c["call"].alias("call"), c["loh"].alias("loh"), F.round(c["ratio_diff"], 9).alias("diff"))


def site_filters(spark: SparkSession, sf: str) -> DataFrame:
    """What each filter says of a site's variant: count and share, support away from ends, different starts, names."""
    o, alt = _obs(spark, sf).where("qual >= 10"), F.col("base") != F.col("ref")
    s = o.groupBy("pos").agg(F.count_if(alt).alias("alt"), F.count(F.lit(1)).alias("n"), F.count_if(alt & (F.col("flank") >= 10)).alias("flanked"))
    d = o.where(alt).groupBy("pos").agg(F.count_distinct("unclipped_start").alias("starts"), F.count_distinct("qname").alias("names"))
    many = F.col("alt") >= 6
    return s.join(d, "pos").select("pos", ((F.col("alt") >= 3) & (F.col("alt") / F.col("n") >= 0.05)).alias("frequent"), (~many | (F.col("flanked") >= 1)).alias("supported"), (~many | (F.col("starts") >= 2)).alias("independent"), "names")


def mismap_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Variants whose good mismatches come for the most part from reads that fail the mismatch filter."""
    judged = ops.read_mismatches(ops.usable_reads(reads(spark, sf)), reference(spark, sf), CHUNK).withColumn("passed", ops.passes(VariantConfig(mismatch_max_hq=1)))
    n = ops.mismatch_rows(judged).where(F.col("q") >= 15).groupBy("rname", "pos_at", "base").agg(F.count_if(~F.col("passed")).alias("suspicious"), F.count_if("passed").alias("alt"))
    return n.where((F.col("alt") > 0) & (F.col("suspicious") / F.col("alt") >= 0.5)).groupBy("rname").agg(F.count(F.lit(1)).alias("rejected"))


def minor_allele_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with their most frequent base as reference, which then isn't counted unless it was read."""
    o = _obs(spark, sf).where("qual >= 10").drop("ref")
    n = o.groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("ref"))
    return calls.candidate_sites(o.join(top, "pos")).select("pos", "ref", "coverage", "alt")


def reference_join(spark: SparkSession, sf: str) -> DataFrame:
    return _bases(spark, sf).groupBy("ref", "base").agg(F.count(F.lit(1)).alias("n"))


def first_reads(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded look at the first reads by id: how many of them are mapped."""
    return reads(spark, sf).select("read_id", "flag").orderBy("read_id").limit(1000).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ops.has(ops.UNMAPPED)).alias("mapped"))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Unmapped reads and reads with an unmapped mate, and all others of their names, each once."""
    r = reads(spark, sf)
    want = r.where(ops.has(ops.UNMAPPED) | ops.has(ops.MATE_UNMAPPED)).select("qname").distinct()
    return r.join(want, "qname", "left_semi").groupBy("rname", ops.strand().alias("strand")).agg(F.count(F.lit(1)).alias("n"))


def phred(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("int").alias("q")).distinct().select("q", F.round(scales.phred_probability(F.col("q")), 9).alias("p"))


def flanks(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty bases to either side of places in their chunk of the reference."""
    at = spark.read.parquet(f"{sf}/supplier.parquet").select(F.lit("chr1").alias("chrom"), (F.col("s_suppkey") * 11 + 1).cast("int").alias("pos"))
    at = at.withColumn("chunk_start", (F.floor((F.col("pos") - 1) / CHUNK) * CHUNK + 1).cast("int"))
    j = at.join(reference(spark, sf), ["chrom", "chunk_start"])
    text = lambda before: seq.flanking(F.col("bases"), F.col("chunk_start"), F.col("pos"), 20, before)
    return j.select("pos", F.length(text(True)).alias("before"), F.length(text(False)).alias("after"), F.concat(text(True), F.lit("["), F.col("bases").substr(F.col("pos") - F.col("chunk_start") + 1, F.lit(1)), F.lit("]"), text(False)).alias("text")).drop("text")


def scale_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("k", F.col("n_nationkey"))
    b = scales.gradient_bucket(F.col("k") - 12, [2, 5, 9])
    o = scales.comment_option(F.concat(F.lit("#key"), F.col("k").cast("string"), F.lit("=v")))
    return n.select("k", b.alias("bucket"), scales.bucket_intensity(b, 3).alias("intensity"), F.round(scales.shaded(F.col("k"), F.lit(20)), 9).alias("shade"), scales.allele_mask(F.col("n_name")).alias("mask"), o["key"].alias("key"), scales.neutral_level(F.concat_ws(",", F.col("k").cast("string"), F.lit("4"))).alias("neutral"), scales.normalised_alleles(F.lit("A/G"), F.when(F.col("k") % 2 == 0, "-").otherwise("+")).alias("alleles"))


def intensities(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    return scales.intensity_by_level(c, "c_mktsegment").groupBy("c_mktsegment").agg(F.round(F.max("intensity"), 9).alias("intensity"), F.count(F.lit(1)).alias("n"))


def binary_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of 500 neighbouring places as packed 16-bit values."""
    p = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey").agg((F.count(F.lit(1)) * 900).alias("n"))
    packed = p.groupBy(F.floor(F.col("l_partkey") / 500).alias("block")).agg(scales.saturated_bytes(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "n"))), lambda x: x["n"])).alias("data"))
    return packed.select("block", F.length("data").alias("bytes"), F.lower(F.hex(F.substring("data", 1, 8))).alias("head"))


def masked_ranges(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).select("rname", F.size(scales.masked_range(F.col("qual"), F.lit(4), F.col("mapq") + 4)).alias("left"))
    return r.groupBy("rname", "left").agg(F.count(F.lit(1)).alias("n"))


def padded_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Qualities laid onto padded reads, with A as the pad."""
    r = reads(spark, sf).select("read_id", scales.padded_qualities(F.translate("seq", "A", "*"), F.col("qual"), ops.has(ops.REVERSE)).alias("q"))
    return r.select("read_id", F.size("q").alias("n"), F.size(F.filter("q", lambda x: x == -1)).alias("pads"))


def made_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A reference of N with one base, for harnesses."""
    one = spark.range(1).select(F.lit("chrT").alias("name"), F.concat(F.repeat(F.lit("N"), 99), F.lit("A"), F.repeat(F.lit("N"), 50)).alias("bases"))
    from ..sources.text import chunked

    return chunked(one, 64).select("chrom", "chunk_start", "bases")


QUERIES = {
    "f08_quality_runs": quality_runs, "f14_clipped_mismatches": clipped_mismatches, "a03_broad_indels": broad_indels, "a06_broad_coverage": broad_coverage, "a10_loh_calls": loh, "h03_h06_h07_h10_site_filters": site_filters,
    "h08_mismap_ratio": mismap_ratio, "h14_minor_allele_mode": minor_allele_mode, "j01_reference_join": reference_join, "o07_first_reads": first_reads, "m07_extracted_with_mates": extracted, "x08_phred": phred, "x12_flanks": flanks,
    "x13_x18_z13_z14_scales": scale_functions, "x17_intensities": intensities, "k06_binary_coverage": binary_coverage, "z05_masked_ranges": masked_ranges, "z07_padded_qualities": padded_reads, "s13_made_reference": made_reference,
}

_MM = f"(SELECT * FROM bases WHERE aligned AND {_USABLE} AND base <> ref)"
ORACLE = {
    "f08_quality_runs": f"{_W}, l AS (SELECT read_id, rname, qual < 20 AND lead(qual) OVER (PARTITION BY read_id ORDER BY i) < 20 AS r FROM bases), g AS (SELECT read_id, rname, bool_or(coalesce(r, false)) AS r FROM l GROUP BY ALL) SELECT rname, count(*) FILTER (r) AS n FROM g GROUP BY rname",
    "f14_clipped_mismatches": f"{_W} SELECT rname, CASE WHEN (kind = 3) = (flag & 16 = 0) THEN 'start' ELSE 'end' END AS \"end\", count(*) AS n FROM bases WHERE {_USABLE} AND NOT aligned AND kind IN (3, 6) AND base <> ref AND qual >= 15 GROUP BY ALL",
    "a03_broad_indels": f"{_W}, g AS (SELECT read_id, rname, kind, tn, flag, min(qual) AS m FROM bases WHERE {_USABLE} AND ((kind = 2 AND i IN (9, 10)) OR (kind = 4 AND i BETWEEN 12 AND 14)) GROUP BY ALL) SELECT rname, CASE WHEN kind = 2 THEN 'deletion' ELSE 'insertion' END AS kind, CAST(CASE WHEN kind = 2 THEN 2 ELSE 3 END AS INT) AS len, tn, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM g WHERE m >= 10 GROUP BY ALL",
    "h08_mismap_ratio": f"{_W}, v AS (SELECT read_id, count(*) FILTER (qual >= 3) <= 6 AND count(*) FILTER (qual >= 15) <= 1 AS passed FROM {_MM} GROUP BY read_id), n AS (SELECT rname, q, base, count(*) FILTER (NOT passed) AS s, count(*) FILTER (passed) AS a FROM {_MM} JOIN v USING (read_id) WHERE qual >= 15 GROUP BY ALL) SELECT rname, count(*) AS rejected FROM n WHERE a > 0 AND s / a >= 0.5 GROUP BY rname",
    "h14_minor_allele_mode": f"WITH {OBS_SQL}, c AS (SELECT pos, base, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base) AS r FROM obs WHERE qual >= 10 GROUP BY pos, base) SELECT pos, max(base) FILTER (r = 1) AS ref, CAST(sum(n) AS BIGINT) AS coverage, max(base) FILTER (r = 2) AS alt FROM c GROUP BY pos HAVING count(*) >= 2 AND sum(n) >= 4",
    "j01_reference_join": f"{_W} SELECT ref, base, count(*) AS n FROM bases WHERE aligned AND {_USABLE} GROUP BY ALL",
    "o07_first_reads": f"WITH {READS_SQL}, f AS (SELECT * FROM reads ORDER BY read_id LIMIT 1000) SELECT count(*) AS n, count(*) FILTER (flag & 4 = 0) AS mapped FROM f",
    "m07_extracted_with_mates": f"WITH {READS_SQL} SELECT rname, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM reads WHERE qname IN (SELECT qname FROM reads WHERE flag & 12 > 0) GROUP BY ALL",
    "x08_phred": "SELECT DISTINCT CAST(l_quantity AS INT) AS q, round(pow(10.0, -(CAST(l_quantity AS INT) // 10)), 9) AS p FROM lineitem",
    "x12_flanks": f"SELECT CAST(s_suppkey * 11 + 1 AS INT) AS pos, CAST(least(20, (s_suppkey * 11) % {CHUNK}) AS INT) AS before, CAST(least(20, {CHUNK} - 1 - (s_suppkey * 11) % {CHUNK}) AS INT) AS after FROM supplier",
    "x13_x18_z13_z14_scales": "WITH n AS (SELECT n_nationkey AS k, n_name, CASE WHEN abs(n_nationkey - 12) >= 9 THEN 3 WHEN abs(n_nationkey - 12) >= 5 THEN 2 WHEN abs(n_nationkey - 12) >= 2 THEN 1 ELSE 0 END AS b FROM nation) SELECT k, CAST(b AS INT) AS bucket, CAST(CASE WHEN b = 0 THEN 0 ELSE 40 + (b - 1) * 30 END AS DOUBLE) AS intensity, round(0.5 + 0.5 * least(k / 20, 1.0), 9) AS shade, CAST(CASE WHEN contains(upper(n_name), 'A') THEN 1 ELSE 0 END + CASE WHEN contains(upper(n_name), 'C') THEN 2 ELSE 0 END + CASE WHEN contains(upper(n_name), 'G') THEN 4 ELSE 0 END + CASE WHEN contains(upper(n_name), 'T') THEN 8 ELSE 0 END AS INT) AS mask, 'key' || k AS key, (k + 4) / 2 AS neutral, CASE WHEN k % 2 = 0 THEN 'T/C' ELSE 'A/G' END AS alleles FROM n",
    "x17_intensities": "WITH l AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k, count(*) OVER () AS m FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, round(CASE WHEN m > 1 THEN k / (m - 1) ELSE 1.0 END, 9) AS intensity, n FROM l",
    "z05_masked_ranges": f"WITH {READS_SQL} SELECT rname, CAST(32 - (mapq + 1) AS INT) AS \"left\", count(*) AS n FROM reads GROUP BY ALL",
    "z07_padded_qualities": f"{_W} SELECT read_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (base = 'A') AS INT) AS pads FROM bases GROUP BY read_id",
    "s13_made_reference": "WITH s AS (SELECT repeat('N', 99) || 'A' || repeat('N', 50) AS b) SELECT 'chrT' AS chrom, CAST(k * 64 + 1 AS INT) AS chunk_start, substr(b, k * 64 + 1, 64) AS bases FROM s, (SELECT CAST(unnest(range(3)) AS INT) AS k)",
}
_BROAD = f"WITH {OBS_SQL}, b AS (SELECT pos, " + ", ".join(f"count(*) FILTER ({c} AND tn = '{t.upper()}') AS {k}_{t}" for k, c in (("ref", "base = ref"), ("alt", "base <> ref")) for t in "nt") + ", count(*) AS coverage FROM obs WHERE qual >= 15 GROUP BY pos)"
ORACLE["a06_broad_coverage"] = f"{_BROAD} SELECT * FROM b"
ORACLE["a10_loh_calls"] = f"""{_BROAD}, f AS (SELECT *, CASE WHEN ref_n + alt_n = 0 THEN 0 ELSE alt_n / (ref_n + alt_n) END AS fn, CASE WHEN ref_t + alt_t = 0 THEN 0 ELSE alt_t / (ref_t + alt_t) END AS ft, CASE WHEN ref_n + alt_n = 0 THEN 0 ELSE ref_n / (ref_n + alt_n) END AS gn, CASE WHEN ref_t + alt_t = 0 THEN 0 ELSE ref_t / (ref_t + alt_t) END AS gt, (ref_n >= 4 AND alt_t >= 4) OR (ref_n + alt_n > 4 AND ref_t + alt_t > 4) AS ok FROM b)
 SELECT pos, CASE WHEN NOT ok THEN '0' WHEN fn <= 0.01 AND ((ft - fn >= 0.5 AND ref_n >= 4 AND alt_t >= 5) OR (ft - fn >= 0.2 AND ft - fn < 0.5 AND ref_n >= 20 AND alt_t >= 4) OR (ft - fn >= 0.1 AND ft - fn < 0.2 AND ref_n >= 30 AND alt_t >= 4)) THEN 'S' WHEN fn >= 0.15 THEN 'G' ELSE '' END AS call,
 CASE WHEN NOT ok THEN '0' WHEN gn >= 0.15 AND fn >= 0.15 AND ft >= 0.15 AND gt <= 0.05 THEN 'LOH_reference' WHEN gn >= 0.15 AND fn >= 0.15 AND gt >= 0.15 AND ft <= 0.05 THEN 'LOH_variant' ELSE '' END AS loh, round(ft - fn, 9) AS diff FROM f"""
ORACLE["h03_h06_h07_h10_site_filters"] = f"WITH {OBS_SQL}, s AS (SELECT pos, count(*) FILTER (base <> ref) AS alt, count(*) AS n, count(*) FILTER (base <> ref AND flank >= 10) AS f, count(DISTINCT unclipped_start) FILTER (base <> ref) AS u, count(DISTINCT qname) FILTER (base <> ref) AS names FROM obs WHERE qual >= 10 GROUP BY pos) SELECT pos, alt >= 3 AND alt / n >= 0.05 AS frequent, alt < 6 OR f >= 1 AS supported, alt < 6 OR u >= 2 AS independent, names FROM s WHERE alt > 0"
ORACLE["k06_binary_coverage"] = "WITH p AS (SELECT l_partkey, least(count(*) * 900, 65535) AS n FROM lineitem GROUP BY 1), h AS (SELECT *, row_number() OVER (PARTITION BY l_partkey // 500 ORDER BY l_partkey) AS r FROM p) SELECT l_partkey // 500 AS block, CAST(count(*) * 2 AS INT) AS bytes, string_agg(printf('%02x%02x', n % 256, n // 256), '' ORDER BY r) FILTER (r <= 4) AS head FROM h GROUP BY 1"
