"""Queries that run the streaming operators over files to their end and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as ops
from ..sources.paths import scratch, written
from ..streaming import frontier, held
from .fixtures import BASES_SQL, READS_SQL, reads


def _run(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    path, schema = scratch(spark, name), df.schema
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", scratch(spark, f"{name}-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def piled(spark: SparkSession, sf: str) -> DataFrame:
    """Sites that are final when the stream ends: all but those that the last reads begin at."""
    s = _stream(spark, sf, "lineitem").select((F.col("l_partkey") + 1).alias("pos"), F.translate("l_returnflag", "ANR", "ACG").alias("base"))
    out = _run(frontier.pileup(s, 0), spark, "pileup")
    return out


def flushed(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of three chromosomes that are final when the stream ends: all but the last one of the last chromosome."""
    name = F.concat(F.lit("chr"), F.col("l_linenumber") % 3 + 1)
    s = _stream(spark, sf, "lineitem").select(name.alias("chrom"), (F.col("l_partkey") + 1).alias("pos"), F.translate("l_returnflag", "ANR", "ACG").alias("base"))
    longest = spark.read.parquet(f"{sf}/part.parquet").agg(F.max("p_partkey")).first()[0] + 1
    return _run(frontier.pileup(s, 0, {f"chr{c}": longest for c in (1, 2, 3)}), spark, "flushed")


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), F.lit("chr1").alias("rname"), (F.col("l_partkey") + 1).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"))
    return _run(frontier.distinct_reads(s, 1_000_000), spark, "distinct").groupBy("strand").agg(F.count(F.lit(1)).alias("n"))


def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that each micro-batch writes under its own number, so that a batch that runs again replaces itself."""
    path = scratch(spark, "batches")

    def work(batch: DataFrame, number: int) -> None:
        batch.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    frontier.in_batches(_stream(spark, sf, "lineitem"), work, scratch(spark, "batches-log")).awaitTermination()
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.sum("n").alias("n"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda odd: _stream(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == odd).select(F.col("l_orderkey").alias("qname"), (F.col("l_partkey") + 1).alias("pos"))
    return _run(frontier.pairs(s(1), s(0), 50), spark, "pairs").agg(F.count(F.lit(1)).alias("pairs"), F.sum("pos_a").alias("a"), F.sum("pos_b").alias("b"))


def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return frontier.bucketed(e, "1 hour").withColumn("total", F.round("total", 6)).withColumn("start", F.unix_timestamp("start"))


def sliding(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return frontier.bucketed(e, "1 hour", "30 minutes").groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return frontier.sessions(e, "10 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def _batches(df: DataFrame, spark: SparkSession, name: str, n: int = 4) -> DataFrame:
    """A stream of rows (chrom, start, ...) in n micro-batches by place, with a last one that makes all before it final."""
    path = scratch(spark, name)
    timed = written(df.withColumn("_at", F.substring("chrom", 4, 2).cast("double") * 1e9 + F.col("start")), f"{name}-all")  # read again for each batch
    cuts = [float("-inf"), *timed.approxQuantile("_at", [k / n for k in range(1, n)], 0.01), float("inf")]
    for a, b in zip(cuts, cuts[1:], strict=False):
        timed.where((F.col("_at") > a) & (F.col("_at") <= b)).drop("_at").coalesce(1).write.mode("append").parquet(path)
    held.frontier_rows(df, "chr3", 1 << 30).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Longer than the reads' chromosomes, so that places stay apart.
LENGTHS = {f"chr{c}": 1 << 31 for c in (1, 2, 3)}


def _held(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    before = spark.conf.get(held.STORE[0])
    spark.conf.set(*held.STORE)
    try:
        return _run(df, spark, name)
    finally:
        spark.conf.set(held.STORE[0], before)


def held_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Sites held for deletions of up to 100 bases, in a stream of several batches without any lateness."""
    r = reads(spark, sf)
    long = r.where("cigar in ('20M100N12M', '10M2D22M')").select(F.col("rname").alias("chrom"), F.col("pos").alias("start"), "cigar")
    at, size = F.when(F.col("cigar") == "20M100N12M", 20).otherwise(10), F.when(F.col("cigar") == "20M100N12M", 100).otherwise(2)
    none = F.lit(None)
    gone = long.select("chrom", "start", (F.col("start") + at).alias("pos"), none.cast("string").alias("base"), (F.col("start") + at + size - 1).alias("last"))
    seen = ops.aligned_bases(r).where("q >= 30").select(F.col("rname").alias("chrom"), F.col("pos").alias("start"), F.col("pos_at").cast("int").alias("pos"), "base", none.cast("int").alias("last"))
    return _held(held.pileup_behind_deletions(_batches(seen.union(gone), spark, "held-rows"), LENGTHS, 5), spark, "held")


def clip_queue(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).where("cigar in ('5S27M', '28M4S')")
    site = F.when(F.col("cigar") == "5S27M", F.col("pos")).otherwise(F.col("pos") + 28)
    clips = r.select(F.col("rname").alias("chrom"), F.col("pos").alias("start"), site.alias("site"), "qname")
    return _held(held.clips_behind_frontier(_batches(clips, spark, "clip-rows"), LENGTHS), spark, "clips")


def duplicate_map(spark: SparkSession, sf: str) -> DataFrame:
    """Spliced reads that begin at one place on one strand, in groups that are flushed as the stream passes."""
    r = reads(spark, sf).where("cigar = '20M100N12M'")
    rows = r.select(F.col("rname").alias("chrom"), F.col("pos").alias("start"), "pos", ops.strand().alias("strand"))
    return _held(held.duplicate_groups(_batches(rows, spark, "duplicate-rows"), LENGTHS, F.col("strand")), spark, "duplicates")


QUERIES = {
    "r01_frontier_pileup": piled,
    "r04_chromosome_flush": flushed,
    "r06_streaming_duplicates": deduplicated,
    "r08_micro_batches": micro_batches,
    "r10_streaming_pairs": paired,
    "r02_r03_held_flush": held_flush,
    "r07_clip_queue": clip_queue,
    "r09_duplicate_map": duplicate_map,
    "r_tumbling_windows": tumbling,
    "r_sliding_windows": sliding,
    "r_session_windows": user_sessions,
}

_SPANS = "SELECT rname, pos + 20 AS a, pos + 119 AS b FROM reads WHERE kind = 5 UNION ALL SELECT rname, pos + 10, pos + 11 FROM reads WHERE kind = 2"
ORACLE = {
    "r02_r03_held_flush": f"WITH {BASES_SQL}, d AS (SELECT rname, a, b, count(*) AS k FROM ({_SPANS}) GROUP BY ALL), s AS (SELECT rname, q, base, count(*) AS n FROM bases WHERE aligned AND qual >= 30 GROUP BY ALL), t AS (SELECT rname, q, sum(n) AS depth FROM s GROUP BY ALL), o AS (SELECT t.rname, t.q, sum(k) AS k FROM t JOIN d ON d.rname = t.rname AND t.q BETWEEN a - 5 AND b + 5 GROUP BY ALL) SELECT s.rname AS chrom, CAST(s.q AS BIGINT) AS pos, base, n, CAST(depth AS BIGINT) AS depth, CAST(coalesce(k, 0) AS BIGINT) AS deletions FROM s JOIN t ON s.rname = t.rname AND s.q = t.q LEFT JOIN o ON o.rname = s.rname AND o.q = s.q",
    "r07_clip_queue": f"WITH {READS_SQL}, c AS (SELECT rname, CASE WHEN kind = 3 THEN pos ELSE pos + 28 END AS site, qname FROM reads WHERE kind IN (3, 6)), n AS (SELECT rname, site, count(*) AS k FROM c GROUP BY ALL) SELECT c.rname AS chrom, CAST(c.site AS BIGINT) AS site, qname, count(*) AS n, max(k) AS clips FROM c JOIN n ON n.rname = c.rname AND n.site = c.site GROUP BY ALL",
    "r09_duplicate_map": f"WITH {READS_SQL} SELECT rname AS chrom, CAST(pos AS BIGINT) AS pos, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS key, count(*) AS n FROM reads WHERE kind = 5 GROUP BY ALL",
    "r01_frontier_pileup": "SELECT l_partkey + 1 AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'G' END AS base, count(*) AS n FROM lineitem WHERE l_partkey < (SELECT max(l_partkey) FROM lineitem) GROUP BY ALL",
    "r04_chromosome_flush": "WITH l AS (SELECT 'chr' || (l_linenumber % 3 + 1) AS chrom, l_partkey + 1 AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'G' END AS base FROM lineitem) SELECT chrom, pos, base, count(*) AS n FROM l WHERE (chrom, pos) <> (SELECT (chrom, pos) FROM l ORDER BY chrom DESC, pos DESC LIMIT 1) GROUP BY ALL",
    "r06_streaming_duplicates": "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber % 2 AS s FROM lineitem) SELECT CASE WHEN s = 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM d GROUP BY s",
    "r08_micro_batches": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "r10_streaming_pairs": "SELECT count(*) AS pairs, CAST(sum(a.l_partkey + 1) AS BIGINT) AS a, CAST(sum(b.l_partkey + 1) AS BIGINT) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_partkey - b.l_partkey) <= 50 WHERE a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0",
    "r_tumbling_windows": "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "r_session_windows": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '10 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "r_sliding_windows": "WITH w AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * o AS s FROM events, (VALUES (0), (1)) t(o)), g AS (SELECT event_type, s, count(*) AS n FROM w GROUP BY ALL) SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY event_type",
}

