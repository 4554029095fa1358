"""Queries on variant evidence, over observations made from lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import calls, reads
from .fixtures import OBS_SQL, observations


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("chrom", F.lit("chr1"))


def snp_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calls.call_snps(_obs(spark, sf_dir))
    rounded = ["alt_freq", "score", "strand_skew", "ratio_normal", "ratio_tumor", "ratio_diff"]
    return out.drop("chrom").withColumns({c: F.round(c, 9) for c in rounded})


_SITES = f"""WITH {OBS_SQL}, good AS (SELECT * FROM obs WHERE qual >= 10),
 cnt AS (SELECT pos, ref, base, count(*) AS n FROM good GROUP BY ALL),
 seeded AS (SELECT * FROM cnt UNION ALL SELECT DISTINCT pos, ref, ref, 0 FROM cnt c WHERE NOT EXISTS (SELECT 1 FROM cnt d WHERE d.pos = c.pos AND d.base = c.ref)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS r FROM seeded),
 site AS (SELECT pos, ref, max(base) FILTER (r = 1) AS top, max(base) FILTER (r = 2) AS second, CAST(sum(n) AS BIGINT) AS coverage FROM ranked GROUP BY pos, ref HAVING count(*) >= 2 AND sum(n) >= 4),
 chosen AS (SELECT *, CASE WHEN top <> ref THEN top ELSE second END AS alt, CASE WHEN top <> ref THEN second ELSE top END AS other FROM site)"""

_CALLS = f"""{_SITES},
 two AS (SELECT g.*, c.alt, c.other, c.top, c.coverage, g.base IN (c.top, c.second) AS best FROM good g JOIN chosen c USING (pos) WHERE g.base IN (c.top, c.second, c.ref)),
 bad AS (SELECT pos, qname FROM two WHERE best GROUP BY pos, qname HAVING count(DISTINCT base) = 2),
 much AS (SELECT pos FROM bad GROUP BY pos HAVING count(*) > 1),
 kept AS (SELECT * FROM two t WHERE NOT EXISTS (SELECT 1 FROM bad b JOIN much m ON m.pos = b.pos WHERE b.pos = t.pos AND b.qname = t.qname)),
 a AS (SELECT pos, ref, alt, top, coverage, count(*) FILTER (base = alt) AS alt_count, count(*) FILTER (base = other) AS other_count, sum(qual // 10) FILTER (base = alt) AS ad, sum(qual // 10) FILTER (base = other) AS od,
  count(*) FILTER (base = alt AND flank >= 10) AS flanked, sum(mapq) FILTER (base = alt) AS mq, count(DISTINCT unclipped_start) FILTER (base = alt) AS unique_starts, count(DISTINCT qname) FILTER (base = alt) AS unique_names,
  {", ".join(f"count(*) FILTER (base = alt AND tn = '{t}' AND strand = '{s}') AS alt_{t}_{k}" for t in "NT" for s, k in (("+", "fwd"), ("-", "rev")))} FROM kept GROUP BY ALL HAVING alt_count > 0),
 r AS (SELECT pos, {", ".join(f"count(*) FILTER (tn = '{t}' AND strand = '{s}') AS ref_{t}_{k}" for t in "NT" for s, k in (("+", "fwd"), ("-", "rev")))}
  FROM kept k WHERE base = ref AND NOT EXISTS (SELECT 1 FROM kept v WHERE v.pos = k.pos AND v.base = v.alt AND v.qname = k.qname AND v.strand = k.strand) GROUP BY pos),
 j AS (SELECT a.*, {", ".join(f"coalesce(ref_{t}_{k}, 0) AS ref_{t}_{k}" for t in "NT" for k in ("fwd", "rev"))}, alt_count / (alt_count + other_count) AS alt_freq,
  pow(10.0, -CAST(CASE WHEN top = ref AND other_count > 0 THEN od ELSE 5 END AS DOUBLE)) AS pr, pow(10.0, -CAST(ad AS DOUBLE)) AS pv FROM a LEFT JOIN r ON r.pos = a.pos),
 k AS (SELECT *, 0.001 * (1 - pr) * (1 - pv) / (0.001 * (1 - pr) * (1 - pv) + 0.999 * ((1 - pr) * pv + pr * (1 - pv))) AS score,
  alt_N_fwd + alt_T_fwd AS vp, alt_N_rev + alt_T_rev AS vm, alt_N_fwd + alt_T_fwd + ref_N_fwd + ref_T_fwd AS cp, alt_N_rev + alt_T_rev + ref_N_rev + ref_T_rev AS cm,
  ref_N_fwd + ref_N_rev AS rn, ref_T_fwd + ref_T_rev AS rt, alt_N_fwd + alt_N_rev AS an, alt_T_fwd + alt_T_rev AS att
  FROM j WHERE alt_count >= 3 AND alt_freq >= 0.05 AND (alt_count < 6 OR (flanked >= 1 AND unique_starts >= 2))),
 l AS (SELECT *, CASE WHEN vp + vm >= 3 AND cp >= 10 AND cm >= 10 THEN CASE WHEN cp > cm THEN vp / (vp + vm * (cp / cm)) ELSE vp * (cm / cp) / (vp * (cm / cp) + vm) END END AS skew,
  CASE WHEN rn + an = 0 THEN 0 ELSE an / (rn + an) END AS fn, CASE WHEN rt + att = 0 THEN 0 ELSE att / (rt + att) END AS ft,
  CASE WHEN rn + an = 0 THEN 0 ELSE rn / (rn + an) END AS gn, CASE WHEN rt + att = 0 THEN 0 ELSE rt / (rt + att) END AS gt,
  (rn >= 4 AND att >= 4) OR (rn + an > 4 AND rt + att > 4) AS ok FROM k)"""

_CALL_COLUMNS = f"""pos, ref, alt, coverage, alt_count, other_count, round(alt_freq, 9) AS alt_freq, round(score, 9) AS score, unique_names, unique_starts,
 {", ".join(f"{a}_{t}_{k}" for a in ("alt", "ref") for t in "NT" for k in ("fwd", "rev"))}, CAST(mq // alt_count AS BIGINT) AS avg_mapq, CAST(vp > 0 AND vm > 0 AS INT) AS both_strands, round(skew, 9) AS strand_skew,
 CASE WHEN NOT ok THEN '0' WHEN fn <= 0.01 AND ((ft - fn >= 0.5 AND rn >= 4 AND att >= 5) OR (ft - fn >= 0.2 AND ft - fn < 0.5 AND rn >= 20 AND att >= 4) OR (ft - fn >= 0.1 AND ft - fn < 0.2 AND rn >= 30 AND att >= 4)) THEN 'S' WHEN fn >= 0.15 THEN 'G' ELSE '' END AS call,
 CASE WHEN NOT ok THEN '0' WHEN gn >= 0.15 AND fn >= 0.15 AND ft >= 0.15 AND gt <= 0.05 THEN 'LOH_reference' WHEN gn >= 0.15 AND fn >= 0.15 AND gt >= 0.15 AND ft <= 0.05 THEN 'LOH_variant' ELSE '' END AS loh,
 round(fn, 9) AS ratio_normal, round(ft, 9) AS ratio_tumor, round(ft - fn, 9) AS ratio_diff"""

_SNP_SQL = f"{_CALLS} SELECT {_CALL_COLUMNS} FROM l WHERE NOT coalesce(vp + vm >= 6 AND cp >= 20 AND cm >= 20 AND (skew >= 0.95 OR skew <= 1 - 0.95), false)"


def narrow_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.pileup(_obs(spark, sf_dir).where("qual >= 10")).drop("chrom")


def broad_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.pileup(_obs(spark, sf_dir).where("qual >= 15"), ["strand", "tn"]).drop("chrom")


def allele_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.candidate_sites(_obs(spark, sf_dir).where("qual >= 10")).drop("chrom")


def evidence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    what = F.when(F.col("base") == F.col("ref"), "R").otherwise("V")
    cells = [F.count_if((what == v) & (F.col("tn") == t) & (F.col("strand") == s)).alias(f"{v}_{t}_{k}".lower()) for v in "RV" for t in "NT" for s, k in (("+", "fwd"), ("-", "rev"))]
    return o.groupBy("pos").agg(*cells)


_CUBE_SQL = f"WITH {OBS_SQL} SELECT pos, " + ", ".join(f"count(*) FILTER ({c} AND tn = '{t}' AND strand = '{s}') AS {v}_{t.lower()}_{k}" for v, c in (("r", "base = ref"), ("v", "base <> ref")) for t in "NT" for s, k in (("+", "fwd"), ("-", "rev"))) + " FROM obs GROUP BY pos"


def joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    d = F.floor(F.col("qual") / 10)
    s = o.groupBy("pos").agg(F.sum(F.when(F.col("base") == F.col("ref"), d)).alias("r"), F.sum(F.when(F.col("base") != F.col("ref"), d)).alias("v"))
    return s.where("v is not null").select("pos", F.round(calls.joint_score(F.coalesce("r", F.lit(5)), F.col("v")), 9).alias("score"))


_SCORE_SQL = f"""WITH {OBS_SQL}, s AS (SELECT pos, pow(10.0, -CAST(coalesce(sum(qual // 10) FILTER (base = ref), 5) AS DOUBLE)) AS r, pow(10.0, -CAST(sum(qual // 10) FILTER (base <> ref) AS DOUBLE)) AS v FROM obs GROUP BY pos)
 SELECT pos, round(0.001 * (1 - r) * (1 - v) / (0.001 * (1 - r) * (1 - v) + 0.999 * ((1 - r) * v + r * (1 - v))), 9) AS score FROM s WHERE v IS NOT NULL"""


def average_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).where("base <> ref").groupBy("pos").agg(F.floor(F.sum("mapq") / F.count(F.lit(1))).alias("avg_mapq"))


def skews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    n = lambda c: F.count_if(c)
    plus, alt = F.col("strand") == "+", F.col("base") != F.col("ref")
    s = o.groupBy("pos").agg(n(plus).alias("cp"), n(~plus).alias("cm"), n(plus & alt).alias("vp"), n(~plus & alt).alias("vm"))
    skew, fails = calls.strand_skew(F.col("cp"), F.col("cm"), F.col("vp"), F.col("vm"))
    return s.select("pos", F.round(skew, 9).alias("skew"), fails.alias("fails"))


_SKEW_SQL = f"""WITH {OBS_SQL}, s AS (SELECT pos, count(*) FILTER (strand = '+') AS cp, count(*) FILTER (strand = '-') AS cm, count(*) FILTER (strand = '+' AND base <> ref) AS vp, count(*) FILTER (strand = '-' AND base <> ref) AS vm FROM obs GROUP BY pos),
 k AS (SELECT *, CASE WHEN vp + vm >= 3 AND cp >= 10 AND cm >= 10 THEN CASE WHEN cp > cm THEN vp / (vp + vm * (cp / cm)) ELSE vp * (cm / cp) / (vp * (cm / cp) + vm) END END AS x FROM s)
 SELECT pos, round(x, 9) AS skew, coalesce(vp + vm >= 6 AND cp >= 20 AND cm >= 20 AND (x >= 0.95 OR x <= 1 - 0.95), false) AS fails FROM k"""


def mate_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir).withColumn("qname", F.col("qname") % 200)
    return calls.disagreeing_mates(o.where("base in ('A', 'C')"), 1).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def reference_without_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir).withColumn("qname", F.col("qname") % 50).withColumn("alt", F.when(F.col("ref") == "A", "C").otherwise("A"))
    return calls.without_variant_reads(o).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def dbsnp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir).where("base <> ref").select("chrom", "pos", "ref", F.col("base").alias("alt")).distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = part.select(F.lit("chr1").alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), (F.col("p_partkey") * 7).alias("rs"), (F.col("p_size") % 16).cast("tinyint").alias("mask"))
    return calls.with_dbsnp(o, known).drop("chrom")


def site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snp_calls(spark, sf_dir).select("pos", "ref", "alt").orderBy("pos")


def by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that a reviewer steps through: best score first, then by place."""
    return joint_scores(spark, sf_dir).orderBy(F.desc("score"), "pos").limit(100)


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.thin_deep_sites(_obs(spark, sf_dir), 20, 2).groupBy("pos", "tn", "strand").agg(F.count(F.lit(1)).alias("n"))


_THIN_SQL = f"""WITH {OBS_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY pos) AS depth, count(*) OVER s AS size,
  row_number() OVER (PARTITION BY pos, tn, strand, unclipped_start % 5 ORDER BY qual * CASE WHEN flank >= 10 THEN 100 ELSE 1 END DESC, qname) AS r FROM obs WINDOW s AS (PARTITION BY pos, tn, strand, unclipped_start % 5))
 SELECT pos, tn, strand, count(*) AS n FROM w WHERE depth <= 20 OR size <= 2 OR r <= greatest(floor(size * 20 / depth), 1) GROUP BY ALL"""


def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose variant lies on one strand only, with the exact two-tailed probability of that."""
    c = evidence_cube(spark, sf_dir)
    t = c.select("pos", *[(F.col(f"{v}_n_{k}") + F.col(f"{v}_t_{k}")).alias(f"{v}{k}") for v in "rv" for k in ("fwd", "rev")])
    t = t.where((F.least("vfwd", "vrev") == 0) & (F.col("vfwd") + F.col("vrev") > 0) & (F.col("vfwd") + F.col("rfwd") > 0) & (F.col("vrev") + F.col("rrev") > 0))
    return t.withColumn("p", F.round(calls.fisher_two_tailed("rfwd", "rrev", "vfwd", "vrev"), 9))


_FISHER_SQL = f"""WITH {OBS_SQL}, t AS (SELECT pos, count(*) FILTER (base = ref AND strand = '+') AS rfwd, count(*) FILTER (base = ref AND strand = '-') AS rrev, count(*) FILTER (base <> ref AND strand = '+') AS vfwd, count(*) FILTER (base <> ref AND strand = '-') AS vrev FROM obs GROUP BY pos),
 u AS (SELECT * FROM t WHERE least(vfwd, vrev) = 0 AND vfwd + vrev > 0 AND vfwd + rfwd > 0 AND vrev + rrev > 0),
 e AS (SELECT *, unnest(range(greatest(0, rfwd + rrev + rfwd + vfwd - (rfwd + rrev + vfwd + vrev)), least(rfwd + rrev, rfwd + vfwd) + 1)) AS k FROM u),
 p AS (SELECT *, lgamma(rfwd + rrev + 1) + lgamma(vfwd + vrev + 1) + lgamma(rfwd + vfwd + 1) + lgamma(rrev + vrev + 1) - lgamma(rfwd + rrev + vfwd + vrev + 1) AS fixed FROM e),
 q AS (SELECT *, exp(fixed - lgamma(k + 1) - lgamma(rfwd + rrev - k + 1) - lgamma(rfwd + vfwd - k + 1) - lgamma(vrev + rrev - (rfwd + rrev - k) + 1)) AS w,
  exp(fixed - lgamma(rfwd + 1) - lgamma(rrev + 1) - lgamma(vfwd + 1) - lgamma(vrev + 1)) AS own FROM p)
 SELECT pos, rfwd, rrev, vfwd, vrev, round(least(1.0, sum(w) FILTER (w <= own * (1 + 1e-7))), 9) AS p FROM q GROUP BY ALL"""


def allele_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose sets of alleles differ between T and N: 1, equal 0, -1 where one has no reads.

    At 95 % for one base a set is that base alone.
    """
    n = _obs(spark, sf_dir).groupBy("pos", "tn", "base").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("pos", "tn").agg(F.max_by("base", F.struct("n", F.col("base"))).alias("best"), (F.max("n") / F.sum("n")).alias("top"), F.array_sort(F.collect_set("base")).alias("all"))
    s = s.withColumn("alleles", F.when(F.col("top") >= 0.95, F.col("best")).otherwise(F.array_join("all", "")))
    t = s.groupBy("pos").agg(F.max(F.when(F.col("tn") == "T", F.col("alleles"))).alias("t"), F.max(F.when(F.col("tn") == "N", F.col("alleles"))).alias("n"))
    return t.withColumn("code", F.when(F.col("t").isNull() | F.col("n").isNull(), -1).when(F.col("t") != F.col("n"), 1).otherwise(0))


_ALLELE_SKEW_SQL = f"""WITH {OBS_SQL}, c AS (SELECT pos, tn, base, count(*) AS n FROM obs GROUP BY ALL),
 s AS (SELECT pos, tn, CASE WHEN max(n) / sum(n) >= 0.95 THEN arg_max(base, n) ELSE string_agg(base, '' ORDER BY base) END AS alleles FROM c GROUP BY pos, tn),
 t AS (SELECT pos, max(alleles) FILTER (tn = 'T') AS t, max(alleles) FILTER (tn = 'N') AS n FROM s GROUP BY pos)
 SELECT *, CASE WHEN t IS NULL OR n IS NULL THEN -1 WHEN t <> n THEN 1 ELSE 0 END AS code FROM t"""


def heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-reference percentage, whole numbers, over all, normal and tumor reads that reach the least coverage."""
    o = _obs(spark, sf_dir)
    own = {"all": F.lit(True), "normal": F.col("tn") == "N", "tumor": F.col("tn") == "T"}
    alt = F.col("base") != F.col("ref")
    s = o.groupBy("pos").agg(*[f for k, c in own.items() for f in (F.count_if(c).alias(f"cov_{k}"), F.count_if(c & alt).alias(f"alt_{k}"))])
    return s.select("pos", *[F.when(F.col(f"cov_{k}") >= 4, F.floor(F.col(f"alt_{k}") * 100 / F.col(f"cov_{k}"))).otherwise(0).alias(f"pct_{k}") for k in own], F.col("cov_all").alias("coverage"))


_HET_SQL = f"WITH {OBS_SQL} SELECT pos, " + ", ".join(f"CAST(CASE WHEN count(*) FILTER ({c}) >= 4 THEN count(*) FILTER ({c} AND base <> ref) * 100 // count(*) FILTER ({c}) ELSE 0 END AS BIGINT) AS pct_{k}" for k, c in (("all", "true"), ("normal", "tn = 'N'"), ("tumor", "tn = 'T'"))) + ", count(*) AS coverage FROM obs GROUP BY pos"


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent base of a site in lower case; of equal counts the first of A, C, G, T."""
    n = _obs(spark, sf_dir).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("pos").agg(F.lower(F.min_by("base", F.struct(-F.col("n"), F.col("base")))).alias("consensus"))


def genotype_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each sample as 'sample,base,n,...', samples set apart by a space."""
    n = _obs(spark, sf_dir).groupBy("pos", "tn", "base").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("pos", "tn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "n"))), lambda x: F.concat_ws(",", x["base"], x["n"].cast("string"))), ",").alias("x"))
    return s.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "tn", "x"))), " ").alias("genotypes"))


def named_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a site's call: place, bases, and key of an indel of the part's size."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.when(F.col("p_partkey") % 2 == 0, "deletion").otherwise("insertion")
    return part.select("p_partkey", names.indel_key(kind, F.col("p_size") % 5 + 1).alias("indel"), names.printable_read(F.col("p_brand"), (F.col("p_size") % 32).cast("int")).alias("read_name"))


QUERIES = {
    "call_variants_snp": snp_calls,
    "a01_narrow_pileup": narrow_pileup,
    "a02_broad_pileup": broad_pileup,
    "h01_h02_allele_choice": allele_choice,
    "h04_j04_mate_disagreement": mate_disagreement,
    "h11_a11_strand_skew": skews,
    "h12_fisher_strand_bias": fisher,
    "a05_evidence_cube": evidence_cube,
    "a07_joint_score": joint_scores,
    "a08_average_mapq": average_mapq,
    "a23_heterozygosity": heterozygosity,
    "a24_consensus": consensus,
    "a25_genotype_text": genotype_text,
    "a26_allele_skew": allele_skew,
    "j02_dbsnp_join": dbsnp_join,
    "j05_reference_without_variant_reads": reference_without_variant,
    "o01_site_order": site_order,
    "o06_best_scores": by_score,
    "o08_thin_deep_sites": thinned,
    "x06_p03_names_and_keys": named_calls,
}

ORACLE = {
    "call_variants_snp": _SNP_SQL,
    "a01_narrow_pileup": f"WITH {OBS_SQL} SELECT pos, ref, base, count(*) AS n FROM obs WHERE qual >= 10 GROUP BY ALL",
    "a02_broad_pileup": f"WITH {OBS_SQL} SELECT pos, ref, base, strand, tn, count(*) AS n FROM obs WHERE qual >= 15 GROUP BY ALL",
    "h01_h02_allele_choice": f"{_SITES} SELECT pos, ref, coverage, top, second, alt, other FROM chosen",
    "h04_j04_mate_disagreement": f"WITH {OBS_SQL}, b AS (SELECT pos, qname % 200 AS q FROM obs WHERE base IN ('A', 'C') GROUP BY pos, q HAVING count(DISTINCT base) = 2) SELECT pos, count(*) AS n FROM b GROUP BY pos HAVING count(*) > 1",
    "h11_a11_strand_skew": _SKEW_SQL,
    "h12_fisher_strand_bias": _FISHER_SQL,
    "a05_evidence_cube": _CUBE_SQL,
    "a07_joint_score": _SCORE_SQL,
    "a08_average_mapq": f"WITH {OBS_SQL} SELECT pos, CAST(sum(mapq) // count(*) AS BIGINT) AS avg_mapq FROM obs WHERE base <> ref GROUP BY pos",
    "a23_heterozygosity": _HET_SQL,
    "a24_consensus": f"WITH {OBS_SQL}, c AS (SELECT pos, base, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base) AS r FROM obs GROUP BY pos, base) SELECT pos, lower(base) AS consensus FROM c WHERE r = 1",
    "a25_genotype_text": f"WITH {OBS_SQL}, c AS (SELECT pos, tn, base, count(*) AS n FROM obs GROUP BY ALL), s AS (SELECT pos, tn, string_agg(base || ',' || n, ',' ORDER BY base) AS x FROM c GROUP BY pos, tn) SELECT pos, string_agg(tn || ',' || x, ' ' ORDER BY tn) AS genotypes FROM s GROUP BY pos",
    "a26_allele_skew": _ALLELE_SKEW_SQL,
    "j02_dbsnp_join": f"WITH {OBS_SQL}, o AS (SELECT DISTINCT pos, ref, base AS alt FROM obs WHERE base <> ref), bit AS (SELECT * FROM (VALUES ('A', 1), ('C', 2), ('G', 4), ('T', 8)) t(b, m)) SELECT pos, ref, alt, CASE WHEN ((p_size % 16) & x.m) <> 0 AND ((p_size % 16) & y.m) <> 0 THEN 'rs' || (p_partkey * 7) END AS dbsnp FROM o JOIN bit x ON x.b = ref JOIN bit y ON y.b = alt LEFT JOIN part ON p_partkey = pos",
    "j05_reference_without_variant_reads": f"WITH {OBS_SQL}, o AS (SELECT *, qname % 50 AS q, CASE WHEN ref = 'A' THEN 'C' ELSE 'A' END AS alt FROM obs) SELECT pos, count(*) AS n FROM o WHERE base = ref AND NOT EXISTS (SELECT 1 FROM o v WHERE v.pos = o.pos AND v.base = v.alt AND v.q = o.q AND v.strand = o.strand) GROUP BY pos",
    "o01_site_order": f"{_SNP_SQL.replace(_CALL_COLUMNS, 'pos, ref, alt')} ORDER BY pos",
    "o06_best_scores": f"{_SCORE_SQL} ORDER BY score DESC, pos LIMIT 100",
    "o08_thin_deep_sites": _THIN_SQL,
    "x06_p03_names_and_keys": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'deletion' ELSE 'insertion' END || (p_size % 5 + 1) AS indel, p_brand || CASE WHEN (p_size % 32) & 16 <> 0 THEN '.R' ELSE '.F' END AS read_name FROM part",
}
