"""Queries on chromatograms made from embeddings, genotypes from line items, headers from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as ops


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    """Four channels of 64 levels each from four neighbouring vectors."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int")).alias("y"))
    name = F.concat(F.lit("t"), F.floor(F.col("vec_id") / 4).cast("string"))
    cols = [F.max(F.when(F.col("vec_id") % 4 == k, F.col("y"))).alias(c) for k, c in enumerate("acgt")]
    return v.groupBy(name.alias("name")).agg(*cols).withColumn("bases", F.lit("ACGTA")).withColumn("places", F.array(*map(F.lit, (5, 15, 25, 40, 60))))


_POINTS = "pts AS (SELECT 't' || (vec_id // 4) AS name, ['a', 'c', 'g', 't'][vec_id % 4 + 1] AS channel, CAST(unnest(range(64)) AS INT) AS p, CAST(floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 40) AS INT) AS v FROM embeddings)"
_PEAKS = f"{_POINTS}, s AS (SELECT *, CASE WHEN lag(v) OVER w <> v OR lag(v) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM pts WINDOW w AS (PARTITION BY name, channel ORDER BY p)), r AS (SELECT *, sum(new) OVER (PARTITION BY name, channel ORDER BY p) AS run FROM s), f AS (SELECT name, channel, run, v, min(p) AS a, max(p) AS b FROM r GROUP BY ALL), n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS h, max(v) OVER (PARTITION BY name) AS most FROM f WINDOW w AS (PARTITION BY name, channel ORDER BY run)), peaks AS (SELECT name, channel, CAST((a + b) // 2 AS INT) AS p, v AS height FROM n WHERE v > l AND v > h AND v >= 0.05 * most)"


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    t = _traces(spark, sf)
    return t.select("name", F.posexplode("places").alias("i", "place"), "bases").select("name", "i", F.substring("bases", 1, 1).alias("x"), "place", F.col("bases").substr(F.col("i") + 1, F.lit(1)).alias("base")).drop("x")


def found(spark: SparkSession, sf: str) -> DataFrame:
    return ops.peaks(ops.samples(_traces(spark, sf)))


def alternates(spark: SparkSession, sf: str) -> DataFrame:
    return ops.alternates(_calls(spark, sf), found(spark, sf))


def recalled(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recall(found(spark, sf))


def normal(spark: SparkSession, sf: str) -> DataFrame:
    p = ops.samples(_traces(spark, sf))
    return ops.normalised(p, ops.peaks(p)).groupBy("name", "channel").agg(F.round(F.sum("v"), 6).alias("total"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and ratios packed as text, as tags of a read have them."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.translate("p_brand", "#", "!").alias("packed"))
    return p.select("p_partkey", F.array_join(F.transform(ops.unpacked_positions(F.col("packed"), F.lit(100), F.col("p_partkey") % 2 == 0), lambda x: x.cast("string")), ",").alias("places"), F.round(F.aggregate(ops.amplitude_ratios(F.col("packed")), F.lit(0.0), lambda s, x: s + x), 6).alias("ratios"))


def turned(spark: SparkSession, sf: str) -> DataFrame:
    t = ops.turned(_traces(spark, sf))
    return t.select("name", "bases", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"), F.get("a", F.lit(0)).alias("first_a"), F.get("c", F.lit(0)).alias("first_c"))


def amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    c = alternates(spark, sf).withColumn("height", F.lit(50.0))
    return ops.amplitude_report(c, F.lit("A"), F.lit("C")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("var_amplitude").alias("var_amplitude"), F.sum("ref_amplitude").alias("ref_amplitude"))


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") % 500).alias("snp"), F.translate("l_returnflag", "ANR", "ACG").alias("allele1"), F.translate("l_linestatus", "FO", "AC").alias("allele2"))
    return ops.genotype_alleles(g)


def visible_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """SNPs that a view of heterozygous ones, or of those with a given allele, shows."""
    return genotypes(spark, sf).agg(F.count_if("any_heterozygous").alias("heterozygous"), F.count_if(F.col("alleles").contains("G")).alias("with_g"))


def header_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Latest run date, and how many samples and builds, of headers."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"), F.count_distinct("o_custkey").alias("samples"), F.count_distinct("o_orderpriority").alias("builds"))


def expression_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Log-10 ratios of markers that all samples share, as whole log-2 values."""
    e = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("marker"), (F.col("p_size") % 3).alias("sample"), (F.col("p_retailprice") / 1000 - 1).alias("log10"))
    m = e.groupBy("marker", "sample").agg(F.avg("log10").alias("v"))
    full = m.groupBy("marker").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("marker")
    return m.join(full, "marker", "left_semi").select("marker", "sample", F.round(F.log2(F.pow(F.lit(10.0), F.col("v")))).cast("int").alias("log2"))


QUERIES = {
    "w11_peaks": found,
    "w12_alternate_calls": alternates,
    "w13_base_recalling": recalled,
    "w14_s35_packed_positions": positions,
    "z15_normalised_traces": normal,
    "x19_turned_traces": turned,
    "x20_amplitude_report": amplitudes,
    "a40_genotype_alleles": genotypes,
    "z17_visible_genotypes": visible_genotypes,
    "a38_header_facts": header_facts,
    "a41_s29_expression_merge": expression_merge,
}

_ALT = f"{_PEAKS}, calls AS (SELECT DISTINCT name, unnest([0, 1, 2, 3, 4]) AS i, unnest([5, 15, 25, 40, 60]) AS place, unnest(['A', 'C', 'G', 'T', 'A']) AS base FROM pts), b AS (SELECT *, coalesce((lag(place) OVER w + place) / 2, -1) AS lo, coalesce((place + lead(place) OVER w) / 2, 1e9) AS hi FROM calls WINDOW w AS (PARTITION BY name ORDER BY place)), best AS (SELECT b.name, i, max(struct_pack(height := CAST(height AS DOUBLE), channel := channel)) AS x FROM b JOIN peaks q ON q.name = b.name AND q.p >= lo AND q.p < hi AND channel <> lower(base) GROUP BY ALL), alts AS (SELECT b.name, CAST(b.i AS INT) AS i, base, upper(x.channel) AS alt, x.height AS alt_height FROM b LEFT JOIN best ON best.name = b.name AND best.i = b.i)"
ORACLE = {
    "w11_peaks": f"WITH {_PEAKS} SELECT name, channel, p AS \"at\", height FROM peaks",
    "w12_alternate_calls": f"WITH {_ALT} SELECT * FROM alts",
    "x20_amplitude_report": f"WITH {_ALT} SELECT CASE WHEN base = 'C' THEN 'called' WHEN alt = 'C' THEN 'alternate' ELSE 'not called' END AS kind, count(*) AS n, sum(CASE WHEN base = 'C' THEN 50.0 WHEN alt = 'C' THEN alt_height ELSE 0.0 END) AS var_amplitude, sum(CASE WHEN base = 'A' THEN 50.0 WHEN alt = 'A' THEN alt_height ELSE 0.0 END) AS ref_amplitude FROM alts GROUP BY 1",
    "z15_normalised_traces": f"WITH {_PEAKS}, t AS (SELECT name, channel, max(height) AS top, max(max(height)) OVER (PARTITION BY name) AS most FROM peaks GROUP BY name, channel) SELECT pts.name, pts.channel, round(sum(coalesce(v * most / top, CAST(v AS DOUBLE))), 6) AS total FROM pts LEFT JOIN t ON t.name = pts.name AND t.channel = pts.channel GROUP BY ALL",
    "w14_s35_packed_positions": "WITH c AS (SELECT p_partkey, unnest(range(1, length(p_brand) + 1)) AS i, translate(p_brand, '#', '!') AS s FROM part), d AS (SELECT p_partkey, i, ascii(substr(s, i, 1)) - 33 AS v FROM c), e AS (SELECT *, 100 + sum(v) OVER (PARTITION BY p_partkey ORDER BY i) AS place FROM d) SELECT p_partkey, string_agg(CAST(place AS INT), ',' ORDER BY CASE WHEN p_partkey % 2 = 0 THEN -i ELSE i END) AS places, round(sum(v * 100.0 / 92), 6) AS ratios FROM e GROUP BY p_partkey",
    "x19_turned_traces": "SELECT 't' || (vec_id // 4) AS name, 'TACGT' AS bases, '3,23,38,48,58' AS places, CAST(floor(abs(CAST(max(embedding[64]) FILTER (vec_id % 4 = 3) AS DOUBLE)) * 40) AS INT) AS first_a, CAST(floor(abs(CAST(max(embedding[64]) FILTER (vec_id % 4 = 2) AS DOUBLE)) * 40) AS INT) AS first_c FROM embeddings GROUP BY 1",
    "a40_genotype_alleles": "WITH g AS (SELECT l_partkey % 500 AS snp, translate(l_returnflag, 'ANR', 'ACG') AS a, translate(l_linestatus, 'FO', 'AC') AS b FROM lineitem), u AS (SELECT snp, a AS x FROM g UNION SELECT snp, b FROM g) SELECT g.snp, (SELECT string_agg(x, '' ORDER BY x) FROM u WHERE u.snp = g.snp) AS alleles, bool_or(a <> b) AS any_heterozygous FROM g GROUP BY g.snp",
    "z17_visible_genotypes": "WITH g AS (SELECT l_partkey % 500 AS snp, translate(l_returnflag, 'ANR', 'ACG') AS a, translate(l_linestatus, 'FO', 'AC') AS b FROM lineitem), s AS (SELECT snp, bool_or(a <> b) AS h, bool_or(a = 'G' OR b = 'G') AS g FROM g GROUP BY snp) SELECT count(*) FILTER (h) AS heterozygous, count(*) FILTER (g) AS with_g FROM s",
    "a38_header_facts": "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(DISTINCT o_custkey) AS samples, count(DISTINCT o_orderpriority) AS builds FROM orders",
    "a41_s29_expression_merge": "WITH m AS (SELECT p_brand AS marker, p_size % 3 AS sample, avg(p_retailprice / 1000 - 1) AS v FROM part GROUP BY ALL) SELECT marker, sample, CAST(round(log2(pow(10.0, v))) AS INT) AS log2 FROM m WHERE marker IN (SELECT marker FROM m GROUP BY marker HAVING count(*) = 3)",
}
