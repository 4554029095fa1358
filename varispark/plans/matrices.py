"""Queries on sample-by-marker matrices made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as ops
from .fixtures import MATRIX_SQL, matrix


def _m(spark: SparkSession, sf: str) -> DataFrame:
    m = matrix(spark, sf).withColumnRenamed("vec_id", "sample")
    return m.withColumn("patient", F.floor(F.col("sample") / 3)).withColumn("subset", (F.col("sample") % 3).cast("int"))


def _sql() -> str:
    return f"WITH {MATRIX_SQL}, m AS (SELECT vec_id AS sample, vec_id // 3 AS patient, CAST(vec_id % 3 AS INT) AS subset, col, value FROM matrix)"


def gradients(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gradients(_m(spark, sf))


def change_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the largest rung, at least 1."""
    return gradients(spark, sf).agg(F.greatest(F.lit(1), F.floor(F.max("value") * 0.5)).alias("threshold"))


def distances(spark: SparkSession, sf: str) -> DataFrame:
    return ops.pair_distances(_m(spark, sf), "euclidean", 2).withColumn("d", F.round("d", 6))


def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return ops.pair_distances(_m(spark, sf), "pearson").withColumn("d", F.round("d", 6) + 0.0)


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that lack cells altogether, each sample others."""
    return _m(spark, sf).where((F.col("sample") * 7 + F.col("col") * 3) % 5 != 0)


def holed_distances(spark: SparkSession, sf: str) -> DataFrame:
    return ops.pair_distances(_holed(spark, sf), "euclidean", 2).withColumn("d", F.round("d", 6))


def holed_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return ops.pair_distances(_holed(spark, sf), "pearson").withColumn("d", F.round("d", 6) + 0.0)


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cluster(_m(spark, sf), "pearson", 0.5)


def euclidean_clusters(spark: SparkSession, sf: str) -> DataFrame:
    m = _m(spark, sf).withColumn("value", F.greatest(F.lit(-2), F.least(F.lit(2), F.col("value"))))
    return ops.cluster(m, "euclidean", 9.0, "mean")


def patient_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters that begin with patients, all of whose samples stay together."""
    m = _m(spark, sf)
    return ops.cluster(m, "pearson", 0.2, "minimum", m.select("sample", F.col("patient").alias("label")).distinct())


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by nearest members, joined in rounds on Spark down to a few."""
    return ops.cluster(_m(spark, sf), "pearson", 0.6, "minimum", driver_clusters=8)


def linked_report(spark: SparkSession, sf: str) -> DataFrame:
    return linked(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("samples"))


def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("samples"))


def marker_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Markers to columns whose headers name several, exact first and then without regard to case."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    headers = part.select((F.col("p_partkey") - 1).cast("int").alias("col"), F.split("p_name", " ").alias("names")).select("col", F.explode("names").alias("marker"))
    exact = headers.groupBy("marker").agg(F.max("col").alias("col"))
    lower = headers.groupBy(F.lower("marker").alias("lower")).agg(F.max("col").alias("low_col"))
    wanted = part.where("p_size < 10").select(F.upper(F.substring_index("p_name", " ", 1)).alias("wanted")).union(part.where("p_size = 11").select(F.substring_index("p_name", " ", -1))).distinct()
    j = wanted.join(exact, F.col("wanted") == F.col("marker"), "left").join(lower, F.lower("wanted") == F.col("lower"), "left")
    return j.select("wanted", F.coalesce("col", "low_col").alias("col"))


QUERIES = {
    "a29_change_percent": lambda s, d: ops.change_percent(_m(s, d), 3),
    "a30_value_histogram": lambda s, d: ops.histogram(_m(s, d)),
    "a31_gradients": gradients,
    "a32_change_threshold": change_threshold,
    "a33_frequency_report": lambda s, d: ops.frequency(_m(s, d)).withColumn("percent", F.round("percent", 9)),
    "a34_representative_average": lambda s, d: ops.representative(_m(s, d)).withColumn("value", F.round("value", 9)),
    "a34_representative_highest": lambda s, d: ops.representative(_m(s, d), "highest", 1),
    "a35_euclidean_distance": distances,
    "a36_pearson": correlations,
    "a35_absent_cells": holed_distances,
    "a36_absent_cells": holed_correlations,
    "a37_statistics": lambda s, d: ops.statistics(_m(s, d), "col").withColumns({c: F.round(c, 8) for c in ("mean", "variance", "deviation", "bound")}),
    "m01_pearson_clusters": clusters,
    "m01_euclidean_clusters": euclidean_clusters,
    "m01_single_linkage": linked,
    "k11_linkage_report": linked_report,
    "k11_cluster_report": cluster_report,
    "m01_patient_clusters": patient_clusters,
    "m02_greedy_columns": lambda s, d: ops.greedy_columns(_m(s, d), 9).withColumn("value", F.round("value", 9)),
    "j13_marker_lookup": marker_lookup,
    "j16_combine_rows": lambda s, d: ops.combine_rows(_m(s, d).where("subset = 0").withColumn("sample", F.col("sample").cast("string")), _m(s, d).where("subset = 1 and col < 50").withColumn("sample", F.col("sample").cast("string")), "x"),
    "j17_combine_columns": lambda s, d: ops.combine_columns(_m(s, d).where("subset = 0 and col < 40"), _m(s, d).where("subset = 1 and col >= 30"), ("cn", "expr")),
    "j18_combine_subsets": lambda s, d: ops.combine_subsets(_m(s, d), 0, lambda v: v >= 2, 1, lambda v: v <= -2, "or"),
    "o02_sort_by_column": lambda s, d: ops.sort_by_column(_m(s, d), 5).withColumns({"value": F.round("value", 9), "place": F.col("place").cast("int")}),
    "o03_o04_order_by_list": lambda s, d: ops.order_by_list(_m(s, d), s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("name"), (100 - F.col("n_nationkey")).cast("int").alias("rank"))).withColumn("place", F.col("place").cast("int")),
    "w08_dividers": lambda s, d: ops.dividers(_m(s, d).where("col = 0").select(F.col("sample").alias("place"), "patient")),
    "w10_display_bins": lambda s, d: ops.display_bins(_m(s, d), 7),
    "u07_subset_columns": lambda s, d: ops.subset_columns(_m(s, d), _m(s, d).where("col % 5 = 2").select("col")),
    "f26_visible_samples": lambda s, d: _m(s, d).groupBy("sample").agg(F.bool_and(F.col("value").isNull()).alias("all_null"), F.bool_and(F.coalesce(F.col("value"), F.lit(0)) == 0).alias("all_empty")),
    "u05_distinct_patients": lambda s, d: _m(s, d).select("patient", "subset").distinct(),
}

_PAIRS = "p AS (SELECT a.sample AS a, b.sample AS b, CAST(a.value AS DOUBLE) AS x, CAST(b.value AS DOUBLE) AS y FROM m a JOIN m b ON a.col = b.col AND a.sample < b.sample)"
_LINKED = f"""{_PAIRS}, d AS (SELECT a, b FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY a, b HAVING corr(x, y) >= 0.6), e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
 reach(s, t) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.s, e.b FROM reach JOIN e ON e.a = reach.t), roots AS (SELECT s AS sample, min(t) AS root FROM reach GROUP BY s),
 numbered AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS cluster FROM roots GROUP BY root)"""
_HOLED = _PAIRS.replace("FROM m a JOIN m b", "FROM (SELECT * FROM m WHERE (sample * 7 + col * 3) % 5 <> 0) a JOIN (SELECT * FROM m WHERE (sample * 7 + col * 3) % 5 <> 0) b")
ORACLE = {
    "a29_change_percent": f"{_sql()} SELECT col, " + ", ".join(f"CAST(count(*) FILTER ({c}) * 100 // count(*) AS BIGINT) AS {k}" for k, c in (("gain", "value >= 3"), ("loss", "value <= -3"), ("either", "abs(value) >= 3"))) + " FROM m GROUP BY col",
    "a30_value_histogram": f"{_sql()}, v AS (SELECT sample, subset, abs(value) AS value FROM m WHERE value IS NOT NULL) SELECT sample, subset, value, count(*) AS n FROM v GROUP BY GROUPING SETS ((sample, value), (subset, value), (value))",
    "a31_gradients": f"{_sql()}, n AS (SELECT abs(value) AS value, count(*) AS n FROM m WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT value, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM n), r AS (SELECT s, min(value) AS value FROM c, (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.97, 0.99]) AS s) WHERE upto >= floor(total * s) GROUP BY s) SELECT DISTINCT value FROM r WHERE value NOT IN (0, 99) ORDER BY value DESC LIMIT 5",
    "a33_frequency_report": f"{_sql()} SELECT col, round(count(*) FILTER (value > 0) * 100.0 / count(*), 9) AS percent FROM m GROUP BY col HAVING count(*) FILTER (value > 0) > 0",
    "a34_representative_average": f"{_sql()} SELECT patient, col, round(avg(value), 9) AS value FROM m WHERE value IS NOT NULL GROUP BY ALL",
    "a34_representative_highest": f"{_sql()} SELECT patient, col, CAST(max(value) AS DOUBLE) AS value FROM m WHERE value > 0 GROUP BY ALL",
    "m01_single_linkage": f"{_sql().replace('WITH ', 'WITH RECURSIVE ', 1)}, {_LINKED} SELECT r.sample, CAST(c.cluster AS INT) AS cluster FROM roots r JOIN numbered c ON c.root = r.root",
    "k11_linkage_report": f"{_sql().replace('WITH ', 'WITH RECURSIVE ', 1)}, {_LINKED} SELECT CAST(c.cluster AS INT) AS cluster, max(c.n) AS n, string_agg(r.sample, ',' ORDER BY r.sample) AS samples FROM roots r JOIN numbered c ON c.root = r.root GROUP BY c.cluster",
    "a35_absent_cells": f"{_sql()}, {_HOLED} SELECT a, b, round(sqrt(sum(pow(greatest(-2, least(2, x)) - greatest(-2, least(2, y)), 2))), 6) AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY a, b",
    "a36_absent_cells": f"{_sql()}, {_HOLED} SELECT a, b, round(corr(x, y), 6) + 0.0 AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY a, b",
    "a35_euclidean_distance": f"{_sql()}, {_PAIRS} SELECT a, b, round(sqrt(sum(pow(greatest(-2, least(2, x)) - greatest(-2, least(2, y)), 2))), 6) AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY a, b",
    "a36_pearson": f"{_sql()}, {_PAIRS} SELECT a, b, round(corr(x, y), 6) + 0.0 AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY a, b",
    "a37_statistics": f"{_sql()} SELECT col, round(avg(value), 8) AS mean, list_sort(list(value))[count(*) // 2 + 1] AS median, round(var_pop(value), 8) AS variance, round(stddev_pop(value), 8) AS deviation, round(1.96 * stddev_pop(value) / sqrt(count(*)), 8) AS bound FROM m WHERE value IS NOT NULL GROUP BY col",
    "j13_marker_lookup": "WITH h AS (SELECT CAST(p_partkey - 1 AS INT) AS col, unnest(string_split(p_name, ' ')) AS marker FROM part), e AS (SELECT marker, max(col) AS col FROM h GROUP BY marker), l AS (SELECT lower(marker) AS lower, max(col) AS low_col FROM h GROUP BY 1), w AS (SELECT upper(string_split(p_name, ' ')[1]) AS wanted FROM part WHERE p_size < 10 UNION SELECT string_split(p_name, ' ')[-1] FROM part WHERE p_size = 11) SELECT wanted, coalesce(col, low_col) AS col FROM w LEFT JOIN e ON wanted = marker LEFT JOIN l ON lower(wanted) = l.lower",
    "j16_combine_rows": f"{_sql()}, p AS (SELECT * FROM m WHERE subset = 0), o AS (SELECT * FROM m WHERE subset = 1 AND col < 50) SELECT patient, CAST(sample AS VARCHAR) AS sample, col, value, CAST(0 AS INT) AS source, CAST(0 AS INT) AS block FROM p UNION ALL SELECT patient, sample || '-x', col, value, CAST(1 AS INT), CAST(CASE WHEN patient IN (SELECT patient FROM p) THEN 0 ELSE 1 END AS INT) FROM o WHERE col IN (SELECT col FROM p)",
    "j17_combine_columns": f"{_sql()}, b AS (SELECT coalesce(x.patient, y.patient) AS patient, coalesce(x.col, y.col) AS col, x.value AS a, y.value AS b FROM (SELECT * FROM m WHERE subset = 0 AND col < 40) x FULL JOIN (SELECT * FROM m WHERE subset = 1 AND col >= 30) y ON x.patient = y.patient AND x.col = y.col) SELECT patient, col, 'cn' AS kind, a AS value FROM b UNION ALL SELECT patient, col, 'expr', b FROM b",
    "j18_combine_subsets": f"{_sql()} SELECT patient, col, CAST(coalesce(max(value) FILTER (subset = 0) >= 2, false) OR coalesce(max(value) FILTER (subset = 1) <= -2, false) AS INT) AS value FROM m GROUP BY patient, col",
    "o02_sort_by_column": f"{_sql()}, r AS (SELECT patient, avg(value) AS value FROM m WHERE col = 5 GROUP BY patient) SELECT patient, round(value, 9) AS value, CAST(row_number() OVER (ORDER BY value ASC NULLS FIRST, patient) AS INT) AS place FROM r",
    "o03_o04_order_by_list": f"{_sql()}, p AS (SELECT patient, count(value) > 0 AS h FROM m GROUP BY patient), j AS (SELECT patient, h, CAST(100 - n_nationkey AS INT) AS rank FROM p LEFT JOIN nation ON n_nationkey = patient) SELECT patient, rank, CAST(row_number() OVER (ORDER BY CASE WHEN rank IS NOT NULL THEN 0 WHEN h THEN 1 ELSE 2 END, rank NULLS LAST, patient) AS INT) AS place FROM j",
    "w08_dividers": f"{_sql()}, o AS (SELECT sample AS place, patient FROM m WHERE col = 0) SELECT place, patient, coalesce(lag(patient) OVER (ORDER BY place) <> patient, false) AND (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM o GROUP BY patient)) AS divider FROM o",
    "w10_display_bins": f"{_sql()}, b AS (SELECT CAST(col // 7 AS INT) AS bin, max(value) AS most FROM m GROUP BY 1) SELECT bin, most, CAST(floor(most * 100 / max(most) OVER ()) AS INT) AS scaled FROM b",
    "u07_subset_columns": f"{_sql()} SELECT sample, CAST((col - 2) // 5 AS INT) AS col, value FROM m WHERE col % 5 = 2",
    "f26_visible_samples": f"{_sql()} SELECT sample, bool_and(value IS NULL) AS all_null, bool_and(coalesce(value, 0) = 0) AS all_empty FROM m GROUP BY sample",
    "u05_distinct_patients": f"{_sql()} SELECT DISTINCT patient, subset FROM m",
}
ORACLE["m02_greedy_columns"] = (
    f"{_sql().replace('WITH ', 'WITH RECURSIVE ', 1)}, c AS (SELECT patient, col, avg(value) AS value FROM m GROUP BY ALL HAVING max(value) >= 9), "
    "r AS (SELECT patient, list(DISTINCT col) AS cols FROM c GROUP BY patient), "
    "t AS (SELECT CAST(-1 AS INT) AS place, CAST(NULL AS INT) AS col, CAST([] AS INT[]) AS taken UNION ALL "
    "(SELECT place + 1, k, list_append(taken, k) FROM (SELECT place, taken, unnest(cols) AS k FROM t, r WHERE NOT list_has_any(cols, taken)) GROUP BY place, taken, k ORDER BY count(*) DESC, k LIMIT 1)), "
    "f AS (SELECT patient, min(place) AS place FROM c JOIN t USING (col) GROUP BY patient) "
    "SELECT t.place, CAST(t.col AS INT) AS col, patient, round(c.value, 9) AS value FROM f JOIN t USING (place) JOIN c USING (patient) WHERE c.col = t.col"
)
ORACLE["a32_change_threshold"] = f"SELECT CAST(greatest(1, floor(max(value) * 0.5)) AS BIGINT) AS threshold FROM ({ORACLE['a31_gradients']})"
