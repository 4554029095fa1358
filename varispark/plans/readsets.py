"""Queries on reads: filters, bases, mismatches, indels, clips, coverage, reports, mates, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VariantConfig
from ..functions import cigar, dealing, names, seq, tags
from ..operators import coverage, indels, padded, reads as ops
from ..operators.matrix import numbered as numbered_rows
from ..schema import FIRST
from ..sinks.text import sam_lines
from ..sources.paths import scratch
from ..sources.text import sam_header, sam_reads
from .fixtures import BASES_SQL, CHUNK, READS_SQL, SEQUENCES_SQL, reads, reference, sequences

CFG = VariantConfig()
_USABLE = "flag & 1024 = 0 AND flag & 4 = 0 AND flag & 256 = 0 AND mapq >= 1"
_W = f"WITH {BASES_SQL}"


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    return ops.usable_reads(reads(spark, sf))


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    return ops.bases(ops.aligned_pieces(_usable(spark, sf), reference(spark, sf), CHUNK))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return ops.read_mismatches(_usable(spark, sf), reference(spark, sf), CHUNK)


def _mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return ops.mismatch_rows(_judged(spark, sf))


def _count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return _count(reads(spark, sf).withColumn("reason", F.coalesce(ops.skip_reason(), F.lit("used"))), "reason")


def exploded(spark: SparkSession, sf: str) -> DataFrame:
    b = ops.aligned_bases(reads(spark, sf))
    return b.groupBy("rname", "read_i", "base").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos_at").cast("long")).alias("places"), F.sum(F.col("q").cast("long")).alias("quality"))


def indel_list(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).select("read_id", "rname", F.explode(cigar.indels(F.col("cigar"), F.col("pos"))).alias("x"))
    return r.select("read_id", "rname", "x.kind", "x.site", "x.len", "x.read_i")


def indel_quality(spark: SparkSession, sf: str) -> DataFrame:
    return indels.observed(_usable(spark, sf)).select("read_id", "kind", "quality", "flank")


def end_distance(spark: SparkSession, sf: str) -> DataFrame:
    b = ops.aligned_bases(reads(spark, sf))
    return _count(b.withColumn("distance", F.least("read_i", F.length("seq") - F.col("read_i") - 1)), "rname", "distance")


def tag_filtered(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    need = F.col("tags")
    hard = tags.tag_filter(need, "XQ>=20,RG=A/N,NM!=3", required=True)
    soft = tags.tag_filter(need, "XQ<40,ZZ=1", required=False)
    return _count(r.withColumn("required", hard).withColumn("optional", soft), "rname", "required", "optional")


def comparators(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    x = F.col("tags")["XQ"]
    return r.agg(
        *[F.count_if(tags.compare_number(x, op, 25)).alias(f"n{k}") for k, op in enumerate(["=", "!=", ">", ">=", "<", "<="])],
        F.count_if(tags.compare_text(F.col("tags")["RG"], "=", ["A", "R"])).alias("in_set"),
        F.count_if(tags.compare_text(F.col("tags")["RG"], "!=", ["A"])).alias("not_in_set"),
        F.count_if(tags.combine("and", tags.compare_number(x, ">", 10), tags.compare_number(F.col("tags")["RG"], ">", 0))).alias("both"),
        F.count_if(tags.combine("or", tags.compare_number(x, ">", 45), F.col("rname") == "chr1")).alias("either"),
    )


def quality_flanks(spark: SparkSession, sf: str) -> DataFrame:
    return ops.flanked_bases(_usable(spark, sf), CFG.min_quality, 2, 8)


def mismatch_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _count(ops.mismatch_counts(_mismatches(spark, sf)), "lq", "hq", "passed")


def forgiven(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("chr1").alias("chrom"), (F.col("p_partkey") + 100).cast("int").alias("pos"), F.lit(15).cast("tinyint").alias("mask")).where("pos % 2 = 0")
    return _count(ops.mismatch_counts(_mismatches(spark, sf), known=known), "lq", "hq")


def masked(spark: SparkSession, sf: str) -> DataFrame:
    m = sequences(spark, sf).withColumn("m", seq.poly_x_mask(F.col("seq")))
    return m.select("doc_id", F.length("m").alias("len"), F.length(F.regexp_replace("m", "[^!]", "")).alias("masked"))


def suspicious(spark: SparkSession, sf: str) -> DataFrame:
    failed = _judged(spark, sf).where(~ops.passes(VariantConfig(mismatch_max_hq=1)))
    return _count(ops.mismatch_rows(failed).where(F.col("q") >= 15), "rname", "pos_at", "base")


def dense_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return _count(ops.densest_window(_mismatches(spark, sf), 10, 15), "best")


def ends(spark: SparkSession, sf: str) -> DataFrame:
    cfg = VariantConfig(end_mismatch_windows=((10, 2), (6, 1)))
    return _count(ops.near_bad_ends(_judged(spark, sf), cfg), "rname", "read_i")


def end_bases(spark: SparkSession, sf: str) -> DataFrame:
    first, last = ops.end_base_mismatch()
    return _bases(spark, sf).groupBy("rname").agg(F.count_if(first).alias("first_base"), F.count_if(last).alias("last_base"))


def accepted_indels(spark: SparkSession, sf: str) -> DataFrame:
    i = indels.observed(_usable(spark, sf), CFG)
    return _count(i, "rname", "site", "kind", "len", "narrow_ok", "broad_ok")


def indel_calls(spark: SparkSession, sf: str) -> DataFrame:
    r = _usable(spark, sf)
    depth = coverage.depth(r, 10).withColumnRenamed("coverage", "base_count")
    cfg = VariantConfig(min_flanking_quality=2, min_alt_allele_count=2, min_minor_allele_frequency=0.001)
    return indels.call_indels(indels.observed(r, cfg), depth, cfg)


def deletions_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Observations left where alleles near the end of a read inside a deletion are dropped."""
    from ..operators import calls

    r = _usable(spark, sf)
    d = indels.observed(r).where("kind = 'deletion'").groupBy(F.col("rname").alias("chrom"), F.col("site").alias("start"), "len").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    b = ops.aligned_bases(r).where("q >= 15").select(F.col("rname").alias("chrom"), F.col("pos_at").alias("pos"), "base", F.lit("A").alias("alt"), F.least("read_i", F.length("seq") - F.col("read_i") - 1).alias("flank"))
    # Only alleles near an end can be dropped: they are counted by place, all others without one, in the tasks that make them.
    exposed = (F.col("base") == F.col("alt")) & (F.col("flank") < 10)
    b = b.groupBy("chrom", F.when(exposed, F.col("pos")).alias("pos"), "base", "alt", F.when(exposed, 0).otherwise(10).alias("flank")).agg(F.count(F.lit(1)).alias("n"))
    return calls.inside_deletions(b, d.select("chrom", "start", "len"), 10).groupBy("chrom", "base").agg(F.sum("n").alias("n"))


def restricted(spark: SparkSession, sf: str) -> DataFrame:
    r = ops.overlapping(reads(spark, sf), "chr2", 300, 600).where(F.col("qname").contains("7") & ~F.col("qname").contains("99") & ~ops.has(ops.DUPLICATE))
    return _count(r, "rname", "pos")


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).withColumn("rname", F.when(F.col("mapq") > 7, F.concat("rname", F.lit("_random"))).otherwise(F.col("rname")))
    return _count(r.where(~F.col("rname").endswith("_random") & names.is_canonical(F.col("rname"))), "rname")


def soft_clips(spark: SparkSession, sf: str) -> DataFrame:
    r = _usable(spark, sf).withColumn("c", F.explode(ops.soft_clips(4, 15.0)))
    return r.groupBy("rname", "c.side", "c.len").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c.mean_quality"), 6).alias("quality"))


def clip_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    r = _usable(spark, sf).withColumn("c", F.explode(ops.soft_clips(4, 0.0)))
    at = F.when(F.col("c.side") == "start", F.col("pos")).otherwise(cigar.end_position(F.col("cigar"), F.col("pos")) + 1)
    return _count(r.withColumn("breakpoint", at), "rname", "breakpoint")


def interesting(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).where(~ops.has(ops.DUPLICATE))
    judged = ops.read_mismatches(r, reference(spark, sf), CHUNK).withColumn("best", ops.densest(10, 15))
    flags = ops.interesting_bits(F.col("best"), F.lit(0), F.col("cigar").rlike("[ID]"), 2)
    return _count(judged.withColumn("bits", flags), "bits")


def minimum_aligned(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).where(cigar.aligned_length(F.col("cigar")) >= 29)
    wrong = ops.bases(ops.aligned_pieces(r, reference(spark, sf), CHUNK)).groupBy("read_id", "rname").agg(F.count_if(F.col("base") != F.col("ref")).alias("mismatches"))
    return _count(wrong.where("mismatches <= 1"), "rname", "mismatches")


def small_or_secondary(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    kind = F.when(ops.has(ops.SECONDARY), "non_primary").when(cigar.aligned_length(F.col("cigar")) <= 28, "small")
    return _count(r.withColumn("kind", kind).where("kind is not null"), "kind", "rname")


def trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return _count(ops.trim_adapter(_usable(spark, sf), "GACTA", 3), "trimmed")


def coverage_query(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).where(~ops.has(ops.DUPLICATE) & ~ops.has(ops.UNMAPPED))
    return coverage.region(r, "chr1", 90, 700, 15)


def target_coverage(spark: SparkSession, sf: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"), F.lit("chr1").alias("chrom"), (F.col("s_suppkey") * 17 + 90).cast("int").alias("start"), (F.col("s_suppkey") * 17 + 130).cast("int").alias("end"))
    return coverage.targets(reads(spark, sf).where(~ops.has(ops.DUPLICATE) & ~ops.has(ops.UNMAPPED)), targets, 15)


def mismatch_rate(spark: SparkSession, sf: str) -> DataFrame:
    b = _bases(spark, sf).where((F.col("q") >= 15) & F.col("ref").isin(*"ACGT"))
    inserted = _usable(spark, sf).where(F.col("cigar").rlike("[ID]")).agg(F.sum(F.aggregate(cigar.operations(F.col("cigar")), F.lit(0), lambda n, x: n + F.when(x["op"].isin("I", "D"), x["len"]).otherwise(0))).alias("indel_bases"))
    t = b.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("base") != F.col("ref")).alias("mismatches"))
    return t.withColumn("k", F.lit(0)).join(inserted.withColumn("k", F.lit(0)), "k").select("compared", "mismatches", "indel_bases", F.round((F.col("mismatches") + F.col("indel_bases")) / F.col("compared"), 9).alias("rate"))


def hq_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = _bases(spark, sf).where((F.col("base") != F.col("ref")) & (F.col("q") >= 15)).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(*[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (3, 4, 5)])


def read_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(~ops.has(ops.UNMAPPED)).alias("mapped"), F.count_if(ops.has(ops.DUPLICATE)).alias("duplicate"), F.count_if(ops.has(ops.UNMAPPED)).alias("unmapped"))


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned lengths with how many reads have each and the first ten places."""
    from pyspark.sql.window import Window

    r = reads(spark, sf).select(cigar.aligned_length(F.col("cigar")).alias("len"), "rname", "pos", "read_id")
    # Only ten rows a length can matter, so each task drops the others before the shuffle.
    w = Window.partitionBy("len").orderBy("rname", "pos", "read_id")
    first = r.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("len").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "rname", F.col("pos").cast("string")).alias("p")))), lambda x: x["p"]), ",").alias("examples"))
    return _count(r, "len").join(first, "len")


def mapq_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = _count(reads(spark, sf), "mapq")
    every = spark.range(256).select(F.col("id").cast("int").alias("mapq"))
    return every.join(n, "mapq", "left").select("mapq", F.coalesce("n", F.lit(0)).alias("n"))


def mapq_median(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).agg(F.expr("percentile_disc(0.5) within group (order by mapq)").cast("int").alias("median"), F.expr("percentile_disc(0.9) within group (order by mapq)").cast("int").alias("p90"), F.round(F.avg("mapq"), 9).alias("mean"))


def skipping_reads(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return r.agg(F.count_if(F.col("cigar").contains("N")).alias("with_n"), F.bool_or(F.col("cigar").contains("N")).alias("rna"))


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = reads(spark, sf).select(F.explode("tags").alias("tag", "value"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"))


def tag_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Of whole-number tags at each place: least, middle, mean (whole) and greatest value."""
    t = _usable(spark, sf).select("rname", "pos", F.col("tags")["XQ"].cast("int").alias("x"))
    s = t.groupBy("rname", "pos").agg(F.min("x").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").cast("int").alias("middle"), F.avg("x").cast("int").alias("mean"), F.max("x").alias("most"))
    return s.select("rname", "pos", F.concat(F.lit("XQ:i:"), F.concat_ws(",", *[x.cast("string") for x in (F.col("least"), F.col("middle"), F.col("mean"), F.col("most"))])).alias("text"))


def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    n = lambda p: F.sum(F.length(F.regexp_replace("seq", p, "")).cast("long"))
    return s.agg(n("").alias("total"), n("[^N]").alias("n_bases"), n("[ACGTN]").alias("other"), F.count_if(F.col("seq").contains("N")).alias("reads_with_n"))


def duplicate_mappings(spark: SparkSession, sf: str) -> DataFrame:
    r = _usable(spark, sf).where(F.col("cigar").contains("N"))
    n = r.groupBy("qname", "rname", "pos", ops.strand().alias("strand"), "cigar").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("places"), F.max(F.struct("n", "qname"))["qname"].alias("name"))


def counts_at_positions(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"), F.lit("chr2").alias("rname"), (F.col("s_suppkey") * 19 + 100).cast("int").alias("pos_at"))
    b = ops.aligned_bases(_usable(spark, sf)).where("q >= 10").groupBy("rname", "pos_at").agg(*[F.count_if(F.col("base") == x).alias(x) for x in "ACGT"])
    return wanted.join(b, ["rname", "pos_at"], "left").fillna(0, list("ACGT"))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return ops.numbered_names(_usable(spark, sf)).select("read_id", "unique_name")


def mate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).withColumn("pnext", F.col("pos") + 1 - 2 * (F.col("pos") % 2))
    r = r.withColumn("qname", F.concat_ws(":", "rname", F.floor(F.col("pos") / 2).cast("string")))
    return ops.mates(r).groupBy("read_id").agg(F.count(F.lit(1)).alias("mates"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a first and a second read, and what is left over."""
    r = reads(spark, sf)
    p = r.groupBy("qname").agg(F.count_if(ops.has(FIRST)).alias("first"), F.count_if(~ops.has(FIRST)).alias("second"))
    return _count(p.withColumn("kind", F.when((F.col("first") > 0) & (F.col("second") > 0), "pair").when(F.col("first") > 0, "only_first").otherwise("only_second")), "kind")


def wanted_names(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'").select(names.strip_read_suffix(F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit(".F1"))).alias("qname"))
    return _count(reads(spark, sf).join(wanted, "qname", "left_semi"), "rname")


def unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return _count(reads(spark, sf).where(ops.has(ops.UNMAPPED)), "rname")


def starts_at(spark: SparkSession, sf: str) -> DataFrame:
    at = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") + 150).cast("int").alias("pos"))
    return _count(reads(spark, sf).join(at, "pos"), "pos")


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Reads by place, forward before reverse."""
    return reads(spark, sf).select("rname", "pos", ops.strand().alias("strand"), "read_id").orderBy("rname", "pos", "strand", "read_id")


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources pooled with their index, as a merge of sorted files would order them."""
    r = reads(spark, sf)
    both = r.where("tn = 'T'").unionByName(r.where("tn = 'N'"))
    return both.groupBy("rname", "sample_idx").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _gap_plan(spark: SparkSession, r: DataFrame) -> DataFrame:
    """The gaps of all reads, found once: the steps that need them read them from the shared folder."""
    path = scratch(spark, "gaps")
    padded.insertion_gaps(r).write.parquet(path)
    return spark.read.parquet(path)


def padded_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """What all reads have at each place of the consensus that their insertions widen."""
    r = reads(spark, sf)
    return padded.consensus(r, _gap_plan(spark, r))


def mapped_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus places of reference positions, and the positions of places, null on pads."""
    plan = _gap_plan(spark, reads(spark, sf))
    places = reads(spark, sf).select(F.col("rname").alias("chrom"), "pos").distinct()
    there = padded.to_padded(places, plan)
    near = there.select("chrom", "pos", F.explode(F.sequence(F.col("padded") - 3, F.col("padded"))).alias("padded")).withColumnRenamed("pos", "from")
    return padded.to_reference(near, plan).select("chrom", "from", "padded", "pos")


def base_at_place(spark: SparkSession, sf: str) -> DataFrame:
    """Base and quality of each read three consensus places behind its start."""
    r = reads(spark, sf)
    c = padded.cells_behind_start(r, _gap_plan(spark, r), 13)
    return c.groupBy("base", "q").agg(F.count(F.lit(1)).alias("n"))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Two SAM files, sorted and with headers, checked and merged: every read's place in the common order."""
    r = reads(spark, sf)
    paths, names = [], ["chr3", "chr1", "chr2"]
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("rname"))
    header = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{n}\tLN:{1 << 28}" for n in names]]
    for tn in "TN":
        top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header)], "k long, i int, value string")
        own = r.where(F.col("tn") == tn).withColumn("qname", F.concat_ws(":", "qname", "read_id"))
        k = rank * (1 << 32) + F.col("pos")
        lines = own.select(k.alias("k"), F.lit(0).alias("i"), F.struct(*own.columns).alias("r"))
        body = sam_lines(lines.select("k", "i", "r.*"), keep=["k", "i"])
        path = scratch(spark, "sorted-sam")
        dealing.by_ranges(top.unionByName(body), F.col("k"), dealing.bounds(own, k)).sortWithinPartitions("k", "i").select("value").write.text(path)
        paths.append(path)
    sources, dictionaries, orders = [], [], []
    for path in paths:
        head = sam_header(spark, path)
        orders.append((head.where("kind = 'HD'").select(F.col("fields")["SO"].alias("o")).first() or ["unknown"])[0])
        found = spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", "SN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", "LN:([0-9]+)", 1).cast("long").alias("length"))
        dictionaries.append(found.withColumn("rank", F.array_position(F.array(*map(F.lit, names)), F.col("name"))))
        back = sam_reads(spark, path)
        sources.append(back.select("rname", "pos", "flag", F.element_at(F.split("qname", ":"), -1).cast("long").alias("read_id")))
    order = ops.check_poolable(dictionaries, orders)
    both = ops.pooled(sources, order).select("rname", "pos", "source_idx", "read_id").withColumn("k", rank)
    return numbered_rows(both, [F.asc(c) for c in ("k", "pos", "source_idx", "read_id")], "place").drop("k")


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    once = r.unionByName(r.where("mapq > 5")).withColumn("strand", ops.strand()).dropDuplicates(["read_id", "rname", "pos", "strand"])
    return _count(once, "rname")


def unclipped(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return r.groupBy("cigar").agg(F.min(cigar.unclipped_start(F.col("cigar"), F.col("pos")) - F.col("pos")).alias("start"), F.max(cigar.unclipped_end(F.col("cigar"), F.col("pos")) - F.col("pos")).alias("end"), F.min(cigar.compact(F.col("cigar"))).alias("compact"), F.min(cigar.reference_span(F.col("cigar"))).alias("span"))


def genome_coverage(spark: SparkSession, sf: str) -> DataFrame:
    b = ops.aligned_bases(reads(spark, sf).where(~ops.has(ops.DUPLICATE) & ~ops.has(ops.UNMAPPED)))
    return coverage.by_base(b)


def saturated(spark: SparkSession, sf: str) -> DataFrame:
    return genome_coverage(spark, sf).select("rname", "pos_at", F.least("coverage", F.lit(65535)).cast("int").alias("value"))


def introns(spark: SparkSession, sf: str) -> DataFrame:
    r = _usable(spark, sf)
    skips = coverage.junctions(r)
    known = spark.read.parquet(f"{sf}/part.parquet").where("p_size > 25").select(F.concat_ws("-", (F.col("p_partkey") + 120).cast("string"), (F.col("p_partkey") + 219).cast("string")).alias("span"))
    return _count(skips.withColumn("span", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).join(known, "span"), "rname", "span")


QUERIES = {
    "f01_read_filter_audit": audit,
    "p01_exploded_bases": exploded,
    "p02_indel_list": indel_list,
    "p04_indel_quality": indel_quality,
    "p05_end_distance": end_distance,
    "f02_tag_filter": tag_filtered,
    "f03_f04_f05_comparators": comparators,
    "f06_f07_flanking_quality": quality_flanks,
    "f09_mismatch_filter": mismatch_filter,
    "f10_dbsnp_forgiven": forgiven,
    "f11_w03_poly_x_mask": masked,
    "f12_suspicious_mismatches": suspicious,
    "f13_w02_dense_mismatches": dense_mismatches,
    "f16_end_blacklist": ends,
    "f17_end_base_mismatches": end_bases,
    "f15_a04_indel_acceptance": accepted_indels,
    "h13_indel_calls": indel_calls,
    "h05_j03_deletion_filter": deletions_filter,
    "f20_s02_region_reads": restricted,
    "f18_f19_canonical_reads": canonical,
    "f24_soft_clips": soft_clips,
    "a22_clip_breakpoints": clip_breakpoints,
    "f21_interesting_reads": interesting,
    "f22_minimum_aligned": minimum_aligned,
    "f23_small_or_secondary": small_or_secondary,
    "f25_adapter_trim": trimmed,
    "a12_region_coverage": coverage_query,
    "a12_genome_coverage": genome_coverage,
    "j26_target_coverage": target_coverage,
    "k06_saturated_coverage": saturated,
    "a13_mismatch_rate": mismatch_rate,
    "a14_hq_mismatch_histogram": hq_histogram,
    "a15_read_totals": read_totals,
    "a16_length_histogram": length_histogram,
    "a17_mapq_histogram": mapq_histogram,
    "a17_mapq_percentiles": mapq_median,
    "a18_skipping_reads": skipping_reads,
    "a19_tag_counts": tag_counts,
    "a09_tag_statistics": tag_statistics,
    "a20_ambiguity": ambiguity,
    "a21_duplicate_mappings": duplicate_mappings,
    "a28_j21_counts_at_positions": counts_at_positions,
    "w01_numbered_names": numbered,
    "j06_s05_mates": mate_pairs,
    "j08_pairs": pairs,
    "j09_wanted_names": wanted_names,
    "j24_known_introns": introns,
    "s03_unmapped": unmapped,
    "s04_start_lookup": starts_at,
    "o10_read_order": ordered,
    "s06_u01_pooled_sources": pooled,
    "s06_ordered_merge": merged,
    "m03_padded_consensus": padded_consensus,
    "m03_coordinate_map": mapped_both_ways,
    "z06_cell_at_place": base_at_place,
    "u02_deduplicated_reads": deduplicated,
    "x07_cigar_ends": unclipped,
}

_OKB = f"(SELECT * FROM bases WHERE aligned AND {_USABLE})"
_MM = f"(SELECT * FROM bases WHERE aligned AND {_USABLE} AND base <> ref)"
_ALIGNED_LEN = "CASE kind WHEN 3 THEN 27 WHEN 4 THEN 29 WHEN 6 THEN 28 ELSE 32 END"
_RC = f"WITH {READS_SQL}"

ORACLE = {
    "f01_read_filter_audit": f"{_RC} SELECT CASE WHEN flag & 1024 > 0 THEN 'duplicate' WHEN flag & 4 > 0 THEN 'unmapped' WHEN flag & 256 > 0 THEN 'non_primary' WHEN mapq < 1 THEN 'low_mapq' ELSE 'used' END AS reason, count(*) AS n FROM reads GROUP BY 1",
    "p01_exploded_bases": f"{_W} SELECT rname, i AS read_i, base, count(*) AS n, CAST(sum(q) AS BIGINT) AS places, CAST(sum(qual) AS BIGINT) AS quality FROM bases WHERE aligned GROUP BY ALL",
    "p02_indel_list": f"{_RC} SELECT read_id, rname, CASE WHEN kind = 2 THEN 'deletion' ELSE 'insertion' END AS kind, CAST(pos + CASE WHEN kind = 2 THEN 10 ELSE 12 END AS INT) AS site, CAST(CASE WHEN kind = 2 THEN 2 ELSE 3 END AS INT) AS len, CAST(CASE WHEN kind = 2 THEN 10 ELSE 12 END AS INT) AS read_i FROM reads WHERE kind IN (2, 4)",
    "p04_indel_quality": f"{_W} SELECT read_id, CASE WHEN kind = 2 THEN 'deletion' ELSE 'insertion' END AS kind, CAST(sum(qual) // count(*) AS INT) AS quality, CAST(CASE WHEN kind = 2 THEN 10 ELSE 12 END AS INT) AS flank FROM bases WHERE {_USABLE} AND ((kind = 2 AND i IN (9, 10)) OR (kind = 4 AND i BETWEEN 12 AND 14)) GROUP BY read_id, kind",
    "p05_end_distance": f"{_W} SELECT rname, CAST(least(i, 31 - i) AS INT) AS distance, count(*) AS n FROM bases WHERE aligned GROUP BY ALL",
    "f02_tag_filter": f"{_RC} SELECT rname, CAST(l_quantity AS INT) >= 20 AND l_returnflag IN ('A', 'N') AND l_linenumber <> 3 AS required, CAST(l_quantity AS INT) < 40 AS optional, count(*) AS n FROM reads GROUP BY ALL",
    "f03_f04_f05_comparators": f"{_RC}, q AS (SELECT CAST(l_quantity AS INT) AS x, l_returnflag AS g, rname FROM reads) SELECT count(*) FILTER (x = 25) AS n0, count(*) FILTER (x <> 25) AS n1, count(*) FILTER (x > 25) AS n2, count(*) FILTER (x >= 25) AS n3, count(*) FILTER (x < 25) AS n4, count(*) FILTER (x <= 25) AS n5, count(*) FILTER (g IN ('A', 'R')) AS in_set, count(*) FILTER (g <> 'A') AS not_in_set, CAST(0 AS BIGINT) AS both, count(*) FILTER (x > 45 OR rname = 'chr1') AS either FROM q",
    "f06_f07_flanking_quality": f"{_W}, w AS (SELECT *, min(qual) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, min(qual) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f FROM bases) SELECT rname, base, count(*) AS n FROM w WHERE aligned AND {_USABLE} AND qual >= 10 AND coalesce(b, 99) >= 8 AND coalesce(f, 99) >= 8 GROUP BY ALL",
    "f09_mismatch_filter": f"{_W}, m AS (SELECT read_id, count(*) FILTER (qual >= 3) AS lq, count(*) FILTER (qual >= 15) AS hq FROM {_MM} GROUP BY read_id) SELECT lq, hq, lq <= 6 AND hq <= 3 AS passed, count(*) AS n FROM m GROUP BY ALL",
    "f10_dbsnp_forgiven": f"{_W}, m AS (SELECT read_id, count(*) FILTER (qual >= 3) AS lq, count(*) FILTER (qual >= 15) AS hq FROM {_MM} b WHERE NOT (rname = 'chr1' AND q % 2 = 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey + 100 = b.q)) GROUP BY read_id) SELECT lq, hq, count(*) AS n FROM m GROUP BY ALL",
    "f11_w03_poly_x_mask": f"WITH {SEQUENCES_SQL} SELECT doc_id, CAST(length(seq) AS INT) AS len, CAST(coalesce(list_sum(list_transform(regexp_extract_all(seq, 'A{{9,}}|C{{9,}}|G{{9,}}|T{{9,}}|N{{9,}}'), lambda x: length(x))), 0) AS INT) AS masked FROM sequences",
    "f12_suspicious_mismatches": f"{_W}, m AS (SELECT read_id FROM {_MM} GROUP BY read_id HAVING count(*) FILTER (qual >= 3) > 6 OR count(*) FILTER (qual >= 15) > 1) SELECT rname, q AS pos_at, base, count(*) AS n FROM {_MM} WHERE qual >= 15 AND read_id IN (SELECT read_id FROM m) GROUP BY ALL",
    "f13_w02_dense_mismatches": f"{_W}, w AS (SELECT read_id, count(*) OVER (PARTITION BY read_id ORDER BY q RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS k FROM {_MM} WHERE qual >= 15), b AS (SELECT read_id, max(k) AS best FROM w GROUP BY read_id) SELECT best, count(*) AS n FROM b GROUP BY best",
    "f16_end_blacklist": f"{_W}, m AS (SELECT * FROM {_MM} WHERE qual >= 10), e AS (SELECT *, count(*) FILTER (i < 10) OVER r AS a, count(*) FILTER (i >= 22) OVER r AS b, count(*) FILTER (i < 6) OVER r AS c6, count(*) FILTER (i >= 26) OVER r AS d FROM m WINDOW r AS (PARTITION BY read_id)) SELECT rname, i AS read_i, count(*) AS n FROM e WHERE (i < 10 AND a >= 2) OR (i >= 22 AND b >= 2) OR (i < 6 AND c6 >= 1) OR (i >= 26 AND d >= 1) GROUP BY ALL",
    "f17_end_base_mismatches": f"{_W} SELECT rname, count(*) FILTER (base <> ref AND i = CASE WHEN flag & 16 > 0 THEN 31 ELSE 0 END) AS first_base, count(*) FILTER (base <> ref AND i = CASE WHEN flag & 16 > 0 THEN 0 ELSE 31 END) AS last_base FROM {_OKB} GROUP BY rname",
    "f20_s02_region_reads": f"{_RC} SELECT rname, pos, count(*) AS n FROM reads WHERE rname = 'chr2' AND pos <= 600 AND pos + CASE kind WHEN 2 THEN 34 WHEN 3 THEN 27 WHEN 4 THEN 29 WHEN 5 THEN 132 WHEN 6 THEN 28 ELSE 32 END - 1 >= 300 AND contains(qname, '7') AND NOT contains(qname, '99') AND flag & 1024 = 0 GROUP BY ALL",
    "f18_f19_canonical_reads": f"{_RC} SELECT rname, count(*) AS n FROM reads WHERE mapq <= 7 GROUP BY rname",
    "f24_soft_clips": f"{_W}, c AS (SELECT read_id, rname, CASE WHEN kind = 3 THEN 'start' ELSE 'end' END AS side, CAST(count(*) AS INT) AS len, avg(qual) AS quality FROM bases WHERE {_USABLE} AND ((kind = 3 AND i < 5) OR (kind = 6 AND i >= 28)) GROUP BY ALL HAVING avg(qual) >= 15) SELECT rname, side, len, count(*) AS n, round(avg(quality), 6) AS quality FROM c GROUP BY ALL",
    "a22_clip_breakpoints": f"{_RC} SELECT rname, CAST(CASE WHEN kind = 3 THEN pos ELSE pos + 28 END AS INT) AS breakpoint, count(*) AS n FROM reads WHERE kind IN (3, 6) AND {_USABLE} GROUP BY ALL",
    "f21_interesting_reads": f"{_W}, r AS (SELECT DISTINCT read_id, flag, kind FROM bases WHERE flag & 1024 = 0), w AS (SELECT read_id, count(*) OVER (PARTITION BY read_id ORDER BY q RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS k FROM bases WHERE aligned AND flag & 1024 = 0 AND base <> ref AND qual >= 15), b AS (SELECT read_id, max(k) AS best FROM w GROUP BY read_id) SELECT CAST(CASE WHEN flag & 4 > 0 THEN 1 ELSE 0 END + CASE WHEN flag & 8 > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(best, 0) >= 2 THEN 4 ELSE 0 END + CASE WHEN kind IN (2, 4) THEN 16 ELSE 0 END AS INT) AS bits, count(*) AS n FROM r LEFT JOIN b USING (read_id) GROUP BY ALL",
    "f22_minimum_aligned": f"{_W}, m AS (SELECT read_id, rname, count(*) FILTER (base <> ref) AS mismatches FROM bases WHERE aligned AND kind NOT IN (3, 6) GROUP BY ALL) SELECT rname, mismatches, count(*) AS n FROM m WHERE mismatches <= 1 GROUP BY ALL",
    "f23_small_or_secondary": f"{_RC} SELECT CASE WHEN flag & 256 > 0 THEN 'non_primary' ELSE 'small' END AS kind, rname, count(*) AS n FROM reads WHERE flag & 256 > 0 OR {_ALIGNED_LEN} <= 28 GROUP BY ALL",
    "a12_region_coverage": f"{_W}, c AS (SELECT q, base, count(*) AS k FROM bases WHERE aligned AND flag & 1028 = 0 AND qual >= 15 AND rname = 'chr1' GROUP BY ALL) SELECT CAST(p AS INT) AS pos, CAST(coalesce(sum(k), 0) AS BIGINT) AS coverage FROM (SELECT unnest(range(90, 701)) AS p) LEFT JOIN c ON q = p GROUP BY p",
    "a12_genome_coverage": f"{_W} SELECT rname, q AS pos_at, count(*) AS coverage, {', '.join(f'count(*) FILTER (base = {chr(39)}{b}{chr(39)}) AS {b}' for b in 'ACGT')} FROM bases WHERE aligned AND flag & 1028 = 0 GROUP BY ALL",
    "j26_target_coverage": f"{_W}, t AS (SELECT s_name AS name, s_suppkey * 17 + 90 AS s, s_suppkey * 17 + 130 AS e FROM supplier), c AS (SELECT q, count(*) AS k FROM bases WHERE aligned AND flag & 1028 = 0 AND qual >= 15 AND rname = 'chr1' GROUP BY q) SELECT name, CAST(coalesce(sum(k), 0) AS BIGINT) AS bases, count(k) AS covered, CAST(max(e - s + 1) AS INT) AS size FROM t LEFT JOIN c ON q BETWEEN s AND e GROUP BY name",
    "k06_saturated_coverage": f"{_W} SELECT rname, q AS pos_at, CAST(least(count(*), 65535) AS INT) AS value FROM bases WHERE aligned AND flag & 1028 = 0 GROUP BY ALL",
    "a13_mismatch_rate": f"{_W}, t AS (SELECT count(*) AS compared, count(*) FILTER (base <> ref) AS mismatches FROM {_OKB} WHERE qual >= 15), d AS (SELECT CAST(sum(CASE kind WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 0 END) AS BIGINT) AS indel_bases FROM reads WHERE {_USABLE}) SELECT *, round((mismatches + indel_bases) / compared, 9) AS rate FROM t, d",
    "a14_hq_mismatch_histogram": f"{_W}, m AS (SELECT count(*) AS k FROM {_MM} WHERE qual >= 15 GROUP BY read_id) SELECT count(*) FILTER (k >= 3) AS at_least_3, count(*) FILTER (k >= 4) AS at_least_4, count(*) FILTER (k >= 5) AS at_least_5 FROM m",
    "a15_read_totals": f"{_RC} SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1024 > 0) AS duplicate, count(*) FILTER (flag & 4 > 0) AS unmapped FROM reads",
    "a16_length_histogram": f"{_RC}, l AS (SELECT CAST({_ALIGNED_LEN} AS INT) AS len, rname, pos, row_number() OVER (PARTITION BY {_ALIGNED_LEN} ORDER BY rname, pos, read_id) AS r FROM reads) SELECT len, count(*) AS n, string_agg(rname || ':' || pos, ',' ORDER BY r) FILTER (r <= 10) AS examples FROM l GROUP BY len",
    "a17_mapq_histogram": f"{_RC} SELECT CAST(m AS INT) AS mapq, count(read_id) AS n FROM (SELECT unnest(range(256)) AS m) LEFT JOIN reads ON mapq = m GROUP BY m",
    "a17_mapq_percentiles": f"{_RC} SELECT CAST(quantile_disc(mapq, 0.5) AS INT) AS median, CAST(quantile_disc(mapq, 0.9) AS INT) AS p90, round(avg(mapq), 9) AS mean FROM reads",
    "a18_skipping_reads": f"{_RC} SELECT count(*) FILTER (kind = 5) AS with_n, bool_or(kind = 5) AS rna FROM reads",
    "a19_tag_counts": f"{_RC} SELECT 'NM' AS tag, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_values FROM reads UNION ALL SELECT 'RG', count(*), count(DISTINCT l_returnflag) FROM reads UNION ALL SELECT 'XQ', count(*), count(DISTINCT CAST(l_quantity AS INT)) FROM reads",
    "a09_tag_statistics": f"{_RC}, x AS (SELECT rname, pos, CAST(l_quantity AS INT) AS x FROM reads WHERE {_USABLE}) SELECT rname, pos, 'XQ:i:' || min(x) || ',' || list_sort(list(x))[(count(*) - 1) // 2 + 1] || ',' || CAST(floor(avg(x)) AS INT) || ',' || max(x) AS text FROM x GROUP BY rname, pos",
    "a20_ambiguity": f"WITH {SEQUENCES_SQL} SELECT CAST(sum(length(seq)) AS BIGINT) AS total, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS n_bases, CAST(0 AS BIGINT) AS other, count(*) FILTER (contains(seq, 'N')) AS reads_with_n FROM sequences",
    "a21_duplicate_mappings": f"{_RC}, g AS (SELECT qname, count(*) AS n FROM reads WHERE kind = 5 AND {_USABLE} GROUP BY qname, rname, pos, flag & 16, cigar) SELECT max(n) AS most, count(*) AS places, arg_max(qname, (n, qname)) AS name FROM g",
    "a28_j21_counts_at_positions": f"{_W} SELECT s_name AS name, 'chr2' AS rname, CAST(s_suppkey * 19 + 100 AS INT) AS pos_at, {', '.join(f'count(*) FILTER (base = {chr(39)}{b}{chr(39)}) AS {b}' for b in 'ACGT')} FROM supplier LEFT JOIN (SELECT * FROM {_OKB} WHERE qual >= 10 AND rname = 'chr2') o ON o.q = s_suppkey * 19 + 100 GROUP BY s_name, s_suppkey",
    "w01_numbered_names": f"{_RC} SELECT read_id, qname || '.' || CASE WHEN flag & 16 > 0 THEN 'R' ELSE 'F' END || row_number() OVER (PARTITION BY qname, flag & 16 ORDER BY rname, pos, read_id) AS unique_name FROM reads WHERE {_USABLE}",
    "j06_s05_mates": f"{_RC}, m AS (SELECT read_id, rname || ':' || (pos // 2) AS name, pos, pos + 2 * (1 - pos % 2) - 1 AS pnext, flag & 16 > 0 AS rev, flag & 32 > 0 AS mrev FROM reads) SELECT a.read_id, count(*) AS mates FROM m a JOIN m b ON a.name = b.name AND a.pnext = b.pos AND a.mrev = b.rev AND a.read_id <> b.read_id GROUP BY a.read_id",
    "j08_pairs": f"{_RC}, p AS (SELECT qname, count(*) FILTER (flag & 64 > 0) AS f, count(*) FILTER (flag & 64 = 0) AS s FROM reads GROUP BY qname) SELECT CASE WHEN f > 0 AND s > 0 THEN 'pair' WHEN f > 0 THEN 'only_first' ELSE 'only_second' END AS kind, count(*) AS n FROM p GROUP BY 1",
    "j09_wanted_names": f"{_RC} SELECT rname, count(*) AS n FROM reads WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY rname",
    "j24_known_introns": f"{_RC} SELECT rname, (pos + 20) || '-' || (pos + 119) AS span, count(*) AS n FROM reads JOIN part ON p_partkey + 120 = pos + 20 WHERE kind = 5 AND {_USABLE} AND p_size > 25 GROUP BY ALL",
    "s03_unmapped": f"{_RC} SELECT rname, count(*) AS n FROM reads WHERE flag & 4 > 0 GROUP BY rname",
    "s04_start_lookup": f"{_RC} SELECT pos, count(*) AS n FROM reads JOIN supplier ON s_suppkey + 150 = pos GROUP BY pos",
    "o10_read_order": f"{_RC} SELECT rname, pos, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, read_id FROM reads ORDER BY rname, pos, strand, read_id",
    "s06_u01_pooled_sources": f"{_RC} SELECT rname, sample_idx, count(*) AS n, min(pos) AS first, max(pos) AS last FROM reads GROUP BY ALL",
    "u02_deduplicated_reads": f"{_RC} SELECT rname, count(DISTINCT read_id) AS n FROM reads GROUP BY rname",
    "x07_cigar_ends": f"{_RC} SELECT cigar, CAST(min(CASE kind WHEN 3 THEN -5 WHEN 0 THEN -4 ELSE 0 END) AS INT) AS start, CAST(max(CASE kind WHEN 2 THEN 33 WHEN 3 THEN 26 WHEN 4 THEN 28 WHEN 5 THEN 131 ELSE 31 END) AS INT) AS \"end\", min(CASE kind WHEN 1 THEN 'M32' WHEN 2 THEN 'M10D2M22' WHEN 3 THEN 'S5M27' WHEN 4 THEN 'M12I3M17' WHEN 5 THEN 'M20N100M12' WHEN 6 THEN 'M28S4' ELSE 'H4M32' END) AS compact, CAST(min(CASE kind WHEN 2 THEN 34 WHEN 3 THEN 27 WHEN 4 THEN 29 WHEN 5 THEN 132 WHEN 6 THEN 28 ELSE 32 END) AS INT) AS span FROM reads GROUP BY cigar",
}

_IND = f"""{_W}, g AS (SELECT read_id, rname, kind, pos, tn, flag, max(CASE WHEN (kind = 2 AND i IN (9, 10)) OR (kind = 4 AND i BETWEEN 12 AND 14) THEN CASE WHEN qual < 10 THEN 1 ELSE 0 END END) = 0 AS q_ok,
  min(CASE WHEN (kind = 2 AND i BETWEEN 5 AND 14) OR (kind = 4 AND (i BETWEEN 7 AND 11 OR i BETWEEN 15 AND 19)) THEN qual END) AS flankq,
  sum(qual) FILTER ((kind = 2 AND i IN (9, 10)) OR (kind = 4 AND i BETWEEN 12 AND 14)) // CASE WHEN kind = 2 THEN 2 ELSE 3 END AS quality,
  string_agg(base, '' ORDER BY i) FILTER (kind = 4 AND i BETWEEN 12 AND 14) AS inserted, CAST(pos + CASE WHEN kind = 2 THEN 10 ELSE 12 END AS INT) AS site FROM bases WHERE kind IN (2, 4) AND {_USABLE} GROUP BY read_id, rname, kind, pos, tn, flag)"""
ORACLE["f15_a04_indel_acceptance"] = f"{_IND} SELECT rname, site, CASE WHEN kind = 2 THEN 'deletion' ELSE 'insertion' END AS kind, CAST(CASE WHEN kind = 2 THEN 2 ELSE 3 END AS INT) AS len, q_ok AND flankq >= 15 AS narrow_ok, q_ok AS broad_ok, count(*) AS n FROM g GROUP BY ALL"
ORACLE["f25_adapter_trim"] = f"""{_W}, s AS (SELECT read_id, CASE WHEN flag & 16 > 0 THEN translate(reverse(string_agg(base, '' ORDER BY i)), 'ACGT', 'TGCA') ELSE string_agg(base, '' ORDER BY i) END AS s FROM bases WHERE {_USABLE} GROUP BY read_id, flag),
 k AS (SELECT list_filter(range(0, 30), lambda k: substr(s, k + 1, 5) = substr('GACTA', 1, least(5, 32 - k)))[1] AS k FROM s) SELECT CAST(32 - coalesce(k, 32) AS INT) AS trimmed, count(*) AS n FROM k GROUP BY 1"""
ORACLE["h13_indel_calls"] = f"""{_IND}, depth AS (SELECT rname, q AS pos, count(*) AS base_count FROM {_OKB} WHERE qual >= 10 GROUP BY ALL),
 s AS (SELECT rname, site, kind, count(*) AS indel_count, count(*) FILTER (tn = 'T') AS tumor, count(*) FILTER (tn = 'N') AS normal, mode(inserted ORDER BY inserted) AS m FROM g WHERE q_ok AND flankq >= 2 GROUP BY ALL),
 c AS (SELECT s.*, greatest(0, base_count - CASE WHEN kind = 4 THEN indel_count ELSE 0 END) + indel_count AS coverage FROM s JOIN depth d ON d.rname = s.rname AND d.pos = s.site)
 SELECT rname AS chrom, site AS pos, CASE WHEN kind = 2 THEN 'deletion' ELSE 'insertion' END AS kind, CAST(CASE WHEN kind = 2 THEN 2 ELSE 3 END AS INT) AS len, indel_count, tumor, normal, coverage, round(indel_count / coverage, 9) AS freq FROM c WHERE coverage >= 4 AND indel_count >= 2 AND indel_count / coverage >= 0.001"""
ORACLE["h05_j03_deletion_filter"] = f"""{_W}, d AS (SELECT rname, pos + 10 AS s, count(*) AS k FROM reads WHERE kind = 2 AND {_USABLE} GROUP BY ALL HAVING count(*) >= 3), gone AS (SELECT DISTINCT rname, s + o AS p FROM d, (VALUES (0), (1)) t(o))
 SELECT b.rname AS chrom, base, count(*) AS n FROM {_OKB} b LEFT JOIN gone ON gone.rname = b.rname AND gone.p = b.q WHERE qual >= 15 AND NOT (gone.p IS NOT NULL AND base = 'A' AND least(i, 31 - i) < 10) GROUP BY ALL"""

_SPAN = "CASE kind WHEN 2 THEN 34 WHEN 3 THEN 27 WHEN 4 THEN 29 WHEN 5 THEN 132 WHEN 6 THEN 28 ELSE 32 END"
_PADDED = f"""{_W}, p AS (SELECT DISTINCT rname, pos + 12 AS p FROM reads WHERE kind = 4), x AS (SELECT rname, unnest(range(1, (SELECT max(pos) + 200 FROM reads))) AS x FROM (SELECT DISTINCT rname FROM reads)),
 gp AS (SELECT x.rname, x, 3 * count(p) OVER (PARTITION BY x.rname ORDER BY x) AS k, p IS NOT NULL AS gap FROM x LEFT JOIN p ON p.rname = x.rname AND p.p = x),
 cells AS (SELECT read_id, b.rname, q + k AS place, base, qual FROM bases b JOIN gp ON gp.rname = b.rname AND x = q WHERE aligned
  UNION ALL SELECT read_id, b.rname, pos + 12 + k - 3 + i - 12, base, qual FROM bases b JOIN gp ON gp.rname = b.rname AND x = pos + 12 WHERE kind = 4 AND i BETWEEN 12 AND 14
  UNION ALL SELECT read_id, r.rname, x + k, CASE kind WHEN 2 THEN '*' ELSE '>' END, NULL FROM reads r JOIN gp ON gp.rname = r.rname AND ((kind = 2 AND x BETWEEN pos + 10 AND pos + 11) OR (kind = 5 AND x BETWEEN pos + 20 AND pos + 119))
  UNION ALL SELECT read_id, r.rname, x + k - j, CASE WHEN kind = 5 AND x BETWEEN pos + 20 AND pos + 119 THEN '>' ELSE '*' END, NULL FROM reads r JOIN gp ON gp.rname = r.rname AND gap AND x > pos AND x < pos + {_SPAN} AND NOT (kind = 4 AND x = pos + 12), (VALUES (1), (2), (3)) t(j))"""
ORACLE["m03_padded_consensus"] = f"{_PADDED} SELECT rname AS chrom, place, base, count(*) AS n, CAST(sum(qual) AS BIGINT) AS qualities FROM cells GROUP BY ALL"
ORACLE["z06_cell_at_place"] = f"{_PADDED} SELECT base, qual AS q, count(*) AS n FROM cells c JOIN reads r ON r.read_id = c.read_id JOIN gp ON gp.rname = r.rname AND gp.x = r.pos WHERE place = r.pos + k + 13 GROUP BY ALL"
ORACLE["m03_coordinate_map"] = f"{_PADDED}, n AS (SELECT DISTINCT r.rname, pos, pos + k AS padded FROM reads r JOIN gp ON gp.rname = r.rname AND x = pos), f AS (SELECT rname, pos, unnest(range(padded - 3, padded + 1)) AS padded FROM n) SELECT f.rname AS chrom, f.pos AS \"from\", f.padded, CAST(g.x AS INT) AS pos FROM f LEFT JOIN gp g ON g.rname = f.rname AND g.x + g.k = f.padded"
ORACLE["s06_ordered_merge"] = f"{_RC}, s AS (SELECT rname, pos, CASE tn WHEN 'T' THEN 0 ELSE 1 END AS source_idx, read_id FROM reads) SELECT *, row_number() OVER (ORDER BY list_position(['chr3', 'chr1', 'chr2'], rname), pos, source_idx, read_id) AS place FROM s"
