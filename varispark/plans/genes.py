"""Queries on genes, intervals, names, identifiers, sequences and coordinate maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, seq
from ..operators import annotate as ops
from .fixtures import INTERVALS_SQL, SEQUENCES_SQL, intervals, ref_index, sequences


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    i = intervals(spark, sf)
    return ops.interval_overlaps(i.where("id % 2 = 0"), i.where("id % 2 = 1"), 64)


def point_index(spark: SparkSession, sf: str) -> DataFrame:
    """Points in intervals by way of bins: candidates share a bin, the residual test decides."""
    i = intervals(spark, sf)
    p = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).cast("int").alias("chrom"), (F.col("c_custkey") * 3).alias("s"), (F.col("c_custkey") * 3).alias("e"))
    return ops.interval_overlaps(p, i, 64).groupBy("id_a").agg(F.count(F.lit(1)).alias("n"))


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "supplier")
    k = F.col("s_suppkey") * 40
    starts = F.array(*[(k + x).cast("int") for x in (1, 15, 30)])
    stops = F.array(*[(k + x).cast("int") for x in (10, 22, 38)])
    strand = F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-")
    return s.select(F.col("s_name").alias("name"), F.lit("chr1").alias("chrom"), strand.alias("strand"), (k + 3).cast("int").alias("cds_start"), (k + 36).cast("int").alias("cds_end"), starts.alias("exon_starts"), stops.alias("exon_ends"))


def codon_table(spark: SparkSession, sf: str) -> DataFrame:
    c = ops.codons(_transcripts(spark, sf))
    return c.select("name", "strand", "codon_no", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    c = ops.codons(_transcripts(spark, sf))
    base = lambda shift: F.expr(f"substr('ACGT', cast(({ref_index('cast(pos as bigint)', '1', True)} + {shift}) % 4 + 1 as int), 1)")
    at = c.select("chrom", F.explode("places").alias("pos")).distinct()
    return ops.coding_changes(at.where("pos % 2 = 0").withColumn("alt", base(1)), c, at.withColumn("ref", base(0)))


_TX = "cds AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(s_suppkey * 40 + o AS INT) AS pos FROM supplier, (SELECT unnest(range(3, 11) || range(15, 23) || range(30, 37)) AS o)), numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) - 1 AS i FROM cds), full_codons AS (SELECT *, CAST(i // 3 AS INT) AS codon_no, i % 3 AS k FROM numbered QUALIFY count(*) OVER (PARTITION BY name, i // 3) = 3)"
_COMP = "translate({x}, 'ACGT', 'TGCA')"
_BASE = "substr('ACGT', CAST(({r} + {s}) % 4 + 1 AS INT), 1)"
_R = ref_index("pos", "1", False)
_AA = "substr('FFLLSSSSYY!!CC!WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (instr('TCAG', substr({c}, 1, 1)) - 1) * 16 + (instr('TCAG', substr({c}, 2, 1)) - 1) * 4 + instr('TCAG', substr({c}, 3, 1)), 1)"


def chromosome_names(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ["chr", "Chr", "CHR", "", "x"])), (F.col("p_partkey") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ["X", "y", "MT", "m"])), (F.col("p_size") % 4 + 1).cast("int"))).alias("raw"))
    n = n.withColumn("raw", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("chr"), (F.col("p_partkey") % 30).cast("string"))).otherwise(F.col("raw")))
    return n.select("p_partkey", names.chromosome(F.col("raw")).alias("name"), names.chromosome_number(F.col("raw")).alias("number"), names.bucket_chromosome(F.col("raw")).alias("bucket"))


def fuzzy_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Barcodes of two tables that match once the vial letter is trimmed."""
    c = _table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("TCGA-"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 300).cast("string"), 4, "0"), F.lit("-01A-11D")).alias("id"))
    s = _table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("TCGA-"), F.lpad((F.col("s_suppkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("s_suppkey") % 300).cast("string"), 4, "0"), F.lit("-01B")).alias("id"))
    return c.withColumn("k", names.fuzzy_id(F.col("id"))).join(s.withColumn("k", names.fuzzy_id(F.col("id"))), "k").select("c_custkey", "s_suppkey", "k")


def barcode_parts(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "supplier").withColumn("id", F.concat(F.lit("TCGA.02."), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit(".01A.01D.00193.01")))
    kind = ops.sample_type(F.replace("id", F.lit("."), F.lit("-")), [ops.TCGA])
    return s.select("s_suppkey", *[names.id_level(F.col("id"), n).alias(f"level_{n}") for n in (3, 4, 5, 7)], kind["tn"].alias("tn"), kind["description"].alias("description"))


def naming_conventions(spark: SparkSession, sf: str) -> DataFrame:
    own = ops.parse_convention("order,^O-([A-Z])-,F,T,filled,O,N,open")
    o = _table(spark, sf, "orders").select(F.concat(F.lit("O-"), "o_orderstatus", F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("id"))
    return o.withColumn("t", ops.sample_type(F.col("id"), [ops.TCGA, own])).groupBy("id", "t.convention", "t.code", "t.tn", "t.description").agg(F.count(F.lit(1)).alias("n"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("length"))
    b = n.where("n_nationkey > 4").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10 + F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(0)).alias("length"))
    return ops.dictionary_check(a, b)


def build(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation")
    own = n.where("n_regionkey = 1").select(F.col("n_name").alias("chrom"), (F.col("n_nationkey") * 100).alias("length"))
    builds = n.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return ops.identify_build(own, builds.select(F.concat(F.lit("b"), F.col("b").cast("string")).alias("build"), F.col("n_name").alias("chrom"), (F.col("n_nationkey") * F.when(F.col("b") == 2, 100).otherwise(100 + F.col("b"))).alias("length")))


def intron_islands(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part").where("p_size > 6").select((F.col("p_partkey") % 4).alias("grp"), F.floor(F.col("p_partkey") / 4).alias("pos"))
    return ops.islands(p, 10, 2)


def shifted_places(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("grp"), F.floor(F.col("p_partkey") / 4).alias("pos"))
    return ops.shifted(p, intron_islands(spark, sf))


_ISL = "pts AS (SELECT DISTINCT p_partkey % 4 AS grp, p_partkey // 4 AS pos FROM part WHERE p_size > 6), isl AS (SELECT grp, min(pos) + 2 AS \"start\", max(pos) - 2 AS \"end\" FROM (SELECT *, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS k FROM pts) GROUP BY grp, k HAVING max(pos) - min(pos) + 1 >= 10)"


def layout(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").select(F.col("n_name").alias("chrom"), (1000 + F.col("n_nationkey") * 37).alias("size"), F.col("n_nationkey").alias("k"))
    return ops.genome_layout(n, 500)


def gistic_infill(spark: SparkSession, sf: str) -> DataFrame:
    bins = _table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("bin"), F.col("p_brand").alias("chrom"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("marker"))
    peaks = _table(spark, sf, "supplier").select(F.col("s_nationkey").alias("peak"), F.concat(F.lit("m"), (F.col("s_suppkey") * 3).cast("string")).alias("marker"))
    return ops.infill(peaks, bins.withColumn("chrom", F.lit("c")), 40)


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    loc = names.location(F.concat(F.lit("chr"), F.col("k").cast("string"), F.lit(":"), (F.col("k") * 10).cast("string"), F.lit("-"), (F.col("k") * 10 + 5).cast("string")))
    return n.select(
        "k", loc["chrom"].alias("chrom"), loc["start"].alias("start"), loc["end"].alias("end"),
        names.basename(F.concat(F.lit("/data/x/"), F.col("n_name"))).alias("base"), names.strict_int(F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("1x")).alias("whole"),
        names.is_accession(F.when(F.col("k") % 2 == 0, "NM_123456").otherwise(F.col("n_name"))).alias("accession"), names.usable(F.when(F.col("k") % 3 == 0, "unknown").otherwise(F.col("n_name"))).alias("usable"),
        names.log_q(F.pow(F.lit(10.0), -(F.col("k") * 2).cast("double") - 0.5)).alias("log_q"), seq.is_nucleotide_search(F.when(F.col("k") % 2 == 0, "acgtAC").otherwise(F.col("n_name"))).alias("nucleotides"),
        names.strip_subset(F.concat(F.lit("A-cnv-"), F.col("k").cast("string")), ["cnv"]).alias("stripped"), F.array_join(names.alternates(F.lit("MT")), ",").alias("alternates"),
    )


def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("doc_id", seq.reverse_complement(F.col("seq")).alias("rc"))


def translated(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("seq", F.lit("(.{3})"), F.lit(1))).alias("codon"))
    return s.groupBy("codon").agg(F.count(F.lit(1)).alias("n")).select("codon", "n", seq.amino_acid(F.col("codon")).alias("aa"))


def padded(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf).withColumn("p", F.replace("seq", F.lit("N"), F.lit("*")))
    return s.select("doc_id", F.size(ops.pad_map(F.col("p"))).alias("unpadded"), F.coalesce(F.get(ops.pad_map(F.col("p")), F.lit(9)), F.lit(-1)).alias("tenth"), F.length(seq.unpadded(F.col("p"))).alias("again"))


def flipped_contigs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("doc_id", ops.orientation(F.col("seq")).alias("flip"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("chrom"), (F.col("o_orderkey") % 300).alias("pos"), (F.floor("o_totalprice").cast("long") % 9 + 1).cast("int").alias("len"))
    return ops.gap_plan(o)


def gene_pathways(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each pathway with what is known of them, UNKNOWN where nothing is."""
    g = _table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("gene"), F.col("c_mktsegment").alias("about"))
    p = _table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pathway"), F.col("o_custkey").alias("gene")).distinct()
    return p.join(g, "gene", "left").groupBy("pathway", F.coalesce("about", F.lit("UNKNOWN")).alias("about")).agg(F.count(F.lit(1)).alias("n"))


def annotation_order(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by an annotation, usable values first and by number where all of them are whole."""
    c = _table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise((F.col("c_custkey") % 50).cast("string")).alias("v"))
    good = names.usable(F.col("v"))
    whole = c.agg(F.bool_and(names.strict_int(F.col("v")).isNotNull() | ~good).alias("whole"))
    j = c.join(whole, F.lit(True))
    return j.orderBy(~good, F.when(F.col("whole") & good, F.col("v").try_cast("int")), "v", "c_custkey").select("c_custkey", "v")


def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation columns with the number of usable and of distinct values; those with one value say nothing."""
    c = _table(spark, sf, "customer")
    cols = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("v")) for x in ("c_name", "c_nationkey", "c_mktsegment")], F.struct(F.lit("empty").alias("field"), F.lit("-").alias("v")))).alias("x")
    return c.select(cols).groupBy("x.field").agg(F.count_if(names.usable(F.col("x.v"))).alias("usable"), F.count_distinct("x.v").alias("values"))


def key_column(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each annotation column are known patients: the first with any is the key."""
    known = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("v"))
    c = _table(spark, sf, "supplier").select(F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("v")) for x in ("s_name", "s_nationkey")])).alias("x")).select("x.field", "x.v")
    hit = c.join(known, "v", "left_semi").groupBy("field").agg(F.count(F.lit(1)).alias("hits"))
    return c.select("field").distinct().join(hit, "field", "left").fillna(0, ["hits"])


def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select("c_custkey").join(_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


def equal_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the set of states of their orders."""
    s = _table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("states"))
    return s.groupBy("states").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "j10_interval_overlaps": overlaps, "j12_bucketed_points": point_index, "m05_codon_table": codon_table, "j11_a27_coding_changes": changes, "x05_chromosome_names": chromosome_names, "j15_fuzzy_ids": fuzzy_ids,
    "x10_barcode_levels": barcode_parts, "j25_naming_conventions": naming_conventions, "j22_dictionary_check": dictionary, "j23_identify_build": build, "w04_intron_islands": intron_islands, "w05_m04_shifted_places": shifted_places,
    "w09_genome_layout": layout, "j19_gistic_infill": gistic_infill, "x09_x16_scalar_functions": scalar_functions, "x01_x02_reverse_complement": reverse_complements, "x04_translated": translated, "w06_x03_pad_map": padded,
    "m06_contig_orientation": flipped_contigs, "w07_gap_plan": gaps, "j20_s28_gene_pathways": gene_pathways, "o05_annotation_order": annotation_order, "s27_annotation_columns": constant_columns, "j14_key_column": key_column,
    "u03_missing_ids": missing_ids, "u04_shared_ids": shared_ids, "u06_equal_sets": equal_sets,
}

ORACLE = {
    "j10_interval_overlaps": f"WITH {INTERVALS_SQL} SELECT a.id AS id_a, b.id AS id_b, a.chrom FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e WHERE a.id % 2 = 0 AND b.id % 2 = 1",
    "j12_bucketed_points": f"WITH {INTERVALS_SQL} SELECT c_custkey AS id_a, count(*) AS n FROM customer JOIN intervals ON chrom = c_custkey % 25 AND c_custkey * 3 BETWEEN s AND e GROUP BY c_custkey",
    "m05_codon_table": f"WITH {_TX} SELECT name, strand, codon_no, string_agg(pos, ',' ORDER BY i) AS places FROM full_codons GROUP BY ALL",
    "j11_a27_coding_changes": f"WITH {_TX}, b AS (SELECT *, CASE WHEN strand = '-' THEN {_COMP.format(x=_BASE.format(r=_R, s=0))} ELSE {_BASE.format(r=_R, s=0)} END AS b, CASE WHEN strand = '-' THEN {_COMP.format(x=_BASE.format(r=_R, s=1))} ELSE {_BASE.format(r=_R, s=1)} END AS a FROM full_codons), c AS (SELECT *, string_agg(b, '') OVER w AS codon FROM b WINDOW w AS (PARTITION BY name, codon_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), d AS (SELECT *, substr(codon, 1, k) || a || substr(codon, k + 2, 3) AS new_codon FROM c WHERE pos % 2 = 0), e AS (SELECT *, {_AA.format(c='codon')} AS old_aa, {_AA.format(c='new_codon')} AS new_aa FROM d) SELECT name, 'chr1' AS chrom, pos, codon_no, codon, new_codon, old_aa, new_aa, CAST(CASE WHEN old_aa = new_aa THEN 0 WHEN '!' IN (old_aa, new_aa) THEN 2 ELSE 1 END AS INT) AS change FROM e",
    "x05_chromosome_names": "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'chr' || (p_partkey % 30) ELSE ['chr', 'Chr', 'CHR', '', 'x'][p_partkey % 5 + 1] || ['X', 'y', 'MT', 'm'][p_size % 4 + 1] END AS raw FROM part), c AS (SELECT *, CASE WHEN upper(regexp_replace(raw, '^(?i)chr', '')) = 'MT' THEN 'M' ELSE upper(regexp_replace(raw, '^(?i)chr', '')) END AS core FROM r), d AS (SELECT *, core IN ('X', 'Y', 'M') OR core IN (SELECT CAST(unnest(range(1, 23)) AS VARCHAR)) AS ok FROM c) SELECT p_partkey, CASE WHEN ok THEN 'chr' || core ELSE raw END AS name, CASE WHEN ok THEN CAST(CASE core WHEN 'X' THEN '23' WHEN 'Y' THEN '24' WHEN 'M' THEN '25' ELSE core END AS INT) WHEN regexp_full_match(raw, 'chr[0-9]+') THEN CAST(substr(raw, 4) AS INT) END AS number, CASE WHEN ok OR regexp_full_match(raw, 'chr[0-9]+') THEN CASE WHEN ok THEN 'chr' || core ELSE raw END ELSE 'other' END AS bucket FROM d",
    "j15_fuzzy_ids": "SELECT c_custkey, s_suppkey, 'TCGA-' || (c_custkey % 90 + 10) || '-' || lpad(CAST(c_custkey % 300 AS VARCHAR), 4, '0') || '-01' AS k FROM customer JOIN supplier ON c_custkey % 90 = s_suppkey % 90 AND c_custkey % 300 = s_suppkey % 300",
    "x10_barcode_levels": "SELECT s_suppkey, 'TCGA-02-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS level_3, 'TCGA-02-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '-01A' AS level_4, 'TCGA-02-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '-01A-01D' AS level_5, 'TCGA-02-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '-01A-01D-00193-01' AS level_7, 'T' AS tn, 'primary solid tumor' AS description FROM supplier",
    "j25_naming_conventions": "SELECT 'O-' || o_orderstatus || '-' || substr(o_orderpriority, 1, 1) AS id, 'order' AS convention, o_orderstatus AS code, CASE o_orderstatus WHEN 'F' THEN 'T' WHEN 'O' THEN 'N' ELSE '?' END AS tn, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS description, count(*) AS n FROM orders GROUP BY ALL",
    "j22_dictionary_check": "SELECT n_name AS name, CASE WHEN n_nationkey <= 4 THEN 'not_in_reference' WHEN n_nationkey >= 20 THEN 'not_in_reads' WHEN n_nationkey % 7 = 0 THEN 'length_differs' ELSE 'same' END AS status FROM nation",
    "j23_identify_build": "SELECT 'b2' AS build",
    "w04_intron_islands": f"WITH {_ISL} SELECT grp, \"start\", \"end\" FROM isl",
    "w05_m04_shifted_places": f"WITH {_ISL} SELECT p_partkey % 4 AS grp, p_partkey // 4 AS pos, CASE WHEN NOT EXISTS (SELECT 1 FROM isl WHERE grp = p_partkey % 4 AND p_partkey // 4 BETWEEN \"start\" AND \"end\") THEN CAST(p_partkey // 4 - coalesce((SELECT sum(\"end\" - \"start\" + 1) FROM isl WHERE grp = p_partkey % 4 AND \"end\" < p_partkey // 4), 0) AS BIGINT) END AS new_pos FROM part",
    "w09_genome_layout": "WITH n AS (SELECT n_name AS chrom, 1000 + n_nationkey * 37 AS size, sum(1000 + n_nationkey * 37) OVER (ORDER BY n_nationkey) AS upto, sum(1000 + n_nationkey * 37) OVER () AS total FROM nation) SELECT chrom, CAST(floor((upto - size) * 500 / total) + 1 AS BIGINT) AS first, CAST(floor(upto * 500 / total) AS BIGINT) AS last FROM n",
    "j19_gistic_infill": "WITH h AS (SELECT DISTINCT s_nationkey AS peak, CAST(p_partkey AS INT) AS bin FROM supplier JOIN part ON p_partkey = s_suppkey * 3), g AS (SELECT *, lead(bin) OVER (PARTITION BY peak ORDER BY bin) AS nxt FROM h) SELECT peak, 'c' AS chrom, CAST(unnest(range(bin, CASE WHEN nxt - bin - 1 <= 40 THEN nxt ELSE bin + 1 END)) AS INT) AS bin FROM g",
    "x09_x16_scalar_functions": "SELECT n_nationkey AS k, 'chr' || n_nationkey AS chrom, CAST(n_nationkey * 10 AS BIGINT) AS start, CAST(n_nationkey * 10 + 5 AS BIGINT) AS \"end\", n_name AS base, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS INT) AS whole, n_nationkey % 2 = 0 AS accession, n_nationkey % 3 <> 0 AS usable, CAST(least(n_nationkey * 2 + 1, 37) AS DOUBLE) AS log_q, n_nationkey % 2 = 0 AS nucleotides, 'A-' || n_nationkey AS stripped, 'MT,chrMT,M,chrM' AS alternates FROM nation",
    "x01_x02_reverse_complement": f"WITH {SEQUENCES_SQL} SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM sequences",
    "x04_translated": f"WITH {SEQUENCES_SQL}, c AS (SELECT unnest(regexp_extract_all(seq, '.{{3}}')) AS codon FROM sequences) SELECT codon, count(*) AS n, CASE WHEN contains(codon, 'N') THEN '?' ELSE {_AA.format(c='codon')} END AS aa FROM c GROUP BY codon",
    "w06_x03_pad_map": f"WITH {SEQUENCES_SQL}, p AS (SELECT doc_id, list_filter(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) <> 'N' THEN i END), lambda i: i IS NOT NULL) AS m FROM sequences) SELECT doc_id, CAST(len(m) AS INT) AS unpadded, CAST(coalesce(m[10], -1) AS INT) AS tenth, CAST(len(m) AS INT) AS again FROM p",
    "m06_contig_orientation": f"WITH {SEQUENCES_SQL} SELECT doc_id, regexp_matches(seq, '[TNX]{{13}}.{{9,35}}TTTATT') AS flip FROM sequences",
    "w07_gap_plan": "SELECT o_custkey % 5 AS chrom, o_orderkey % 300 AS pos, repeat('*', max(CAST(floor(o_totalprice) AS BIGINT) % 9 + 1)) AS pads FROM orders GROUP BY ALL",
    "j20_s28_gene_pathways": "WITH p AS (SELECT DISTINCT o_orderpriority AS pathway, o_custkey AS gene FROM orders) SELECT pathway, coalesce(c_mktsegment, 'UNKNOWN') AS about, count(*) AS n FROM p LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON c_custkey = gene GROUP BY ALL",
    "o05_annotation_order": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE CAST(c_custkey % 50 AS VARCHAR) END AS v FROM customer ORDER BY c_custkey % 4 = 0, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 50 END, c_custkey",
    "s27_annotation_columns": "SELECT 'c_name' AS field, count(*) AS usable, count(DISTINCT c_name) AS values FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'empty', 0, 1",
    "j14_key_column": "SELECT 's_name' AS field, CAST(0 AS BIGINT) AS hits UNION ALL SELECT 's_nationkey', count(*) FROM supplier",
    "u03_missing_ids": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "u04_shared_ids": "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "u06_equal_sets": "WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey) SELECT states, count(*) AS n FROM s GROUP BY states",
}
