"""Adapters that read the star-schema tables as reads, observations, matrices, intervals and sequences.

Each exists twice: as a DataFrame, and as SQL that DuckDB runs on the same tables, written without the operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_LENGTH = 32
#: Base of a made-up reference at a position q of chromosome number c, from 0 to 3 for ACGT; some runs of A.
_REF = "(CASE WHEN (({q}) {div} 12) % 9 = 0 THEN 0 ELSE (({q}) * 7 + (({q}) {div} 3) * 5 + {c} * 3 + ({q}) * ({q})) % 4 END)"


def ref_index(q: str, c: str, spark: bool) -> str:
    return _REF.format(q=q, c=c, div="div" if spark else "//")


_CIGAR = "CASE l_linenumber % 7 WHEN 1 THEN '32M' WHEN 2 THEN '10M2D22M' WHEN 3 THEN '5S27M' WHEN 4 THEN '12M3I17M' WHEN 5 THEN '20M100N12M' WHEN 6 THEN '28M4S' ELSE '4H32M' END"
_PLACE = "(pos + CASE kind WHEN 2 THEN CASE WHEN i < 10 THEN i ELSE i + 2 END WHEN 3 THEN i - 5 WHEN 4 THEN CASE WHEN i < 15 THEN i ELSE i - 3 END WHEN 5 THEN CASE WHEN i < 20 THEN i ELSE i + 100 END ELSE i END)"
_SHIFT = "(CASE WHEN {p} % 40 = 0 AND l_orderkey % 3 = 0 AND (tn = 'T' OR {p} % 80 <> 0) THEN 2 WHEN (l_orderkey * 31 + i * 17 + l_linenumber * 7) % 29 = 0 THEN 1 ELSE 0 END)"
_QUAL = "CAST(2 + (l_orderkey * 13 + i * 11 + l_linenumber * 5) % 39 AS INT)"
_FLAG = "CAST(1 + CASE WHEN l_orderkey % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 23 = 0 THEN 8 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 32 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN 256 ELSE 0 END + CASE WHEN l_orderkey % 13 = 0 THEN 1024 ELSE 0 END AS INT)"
_FIELDS = f"""(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS INT) AS read_id, concat('r', CAST(l_orderkey AS VARCHAR(20))) AS qname, {_FLAG} AS flag,
 CAST(l_suppkey % 3 + 1 AS INT) AS c, concat('chr', CAST(l_suppkey % 3 + 1 AS VARCHAR(20))) AS rname, CAST(l_partkey + 100 AS INT) AS pos,
 CAST(round(l_discount * 100) AS INT) AS mapq, {_CIGAR} AS cigar, CASE WHEN l_linestatus = 'F' THEN 'T' ELSE 'N' END AS tn,
 CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS INT) AS sample_idx, CAST(l_linenumber % 7 AS INT) AS kind, l_orderkey, l_linenumber, l_quantity, l_returnflag"""

#: read_id outgrows 64 bits from orderkeys of some 18 million on, where `*` is an error: from there on a shift drops the topmost bits.
#: Two reads get one id by that only if all five columns differ by just the right amounts.
_READ_ID = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS INT)"
_WRAPPED_ID = "shiftleft(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey, 6) + CAST(l_quantity AS INT)"

#: DuckDB: reads as rows, and every base of them with its place, whether it is aligned, base and quality.
READS_SQL = f"reads AS (SELECT {_FIELDS} FROM lineitem)"
BASES_SQL = f"""{READS_SQL}, placed AS (SELECT *, {_PLACE} AS q FROM reads, (SELECT CAST(range AS INT) AS i FROM range({READ_LENGTH}))),
 bases AS (SELECT read_id, qname, flag, rname, c, pos, mapq, cigar, tn, kind, i, CAST(q AS INT) AS q,
  substr('ACGT', CAST(({ref_index("q", "c", False)} + {_SHIFT.format(p="q")}) % 4 + 1 AS INT), 1) AS base,
  substr('ACGT', CAST({ref_index("q", "c", False)} + 1 AS INT), 1) AS ref, {_QUAL} AS qual,
  NOT ((kind = 3 AND i < 5) OR (kind = 4 AND i BETWEEN 12 AND 14) OR (kind = 6 AND i >= 28)) AS aligned FROM placed)"""


def _ref_codes(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """ref_index() of places."""
    return np.where(q // 12 % 9 == 0, 0, (q * 7 + q // 3 * 5 + c * 3 + q * q) % 4)


def _made_bases(pos: pa.Array, kind: pa.Array, c: pa.Array, order: pa.Array, line: pa.Array, tn: pa.Array) -> pa.Array:
    """Sequences and qualities by the rules of BASES_SQL, for a batch of rows at once."""
    pos, kind, c, order, line = (np.asarray(x, np.int64)[:, None] for x in (pos, kind, c, order, line))
    tumor, i = np.asarray(pc.equal(tn, "T"))[:, None], np.arange(READ_LENGTH)[None, :]
    q = pos + i + (kind == 2) * np.where(i < 10, 0, 2) - (kind == 3) * 5 - (kind == 4) * np.where(i < 15, 0, 3) + (kind == 5) * np.where(i < 20, 0, 100)
    ref = _ref_codes(q, c)
    shift = np.where((q % 40 == 0) & (order % 3 == 0) & (tumor | (q % 80 != 0)), 2, (order * 31 + i * 17 + line * 7) % 29 == 0)
    letters = np.frombuffer(b"ACGT", np.uint8)[(ref + shift) % 4]
    n, offsets = len(pos), np.arange(len(pos) + 1, dtype=np.int32) * READ_LENGTH
    seq = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    qual = pa.ListArray.from_arrays(pa.array(offsets), pa.array((2 + (order * 13 + i * 11 + line * 5) % 39).astype(np.int32).reshape(-1)))
    return pa.StructArray.from_arrays([seq, qual], ["seq", "qual"])


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 32 bases with every kind of CIGAR operation; lineitem rows give names, places and qualities."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[x.strip() for x in _split(_FIELDS.replace(_READ_ID, _WRAPPED_ID))])
    made = F.arrow_udf(_made_bases, "seq string, qual array<int>")("pos", "kind", "c", "l_orderkey", "l_linenumber", "tn")
    rows = rows.withColumn("made", made).withColumn("seq", F.col("made.seq")).withColumn("qual", F.col("made.qual"))
    tags = F.create_map(F.lit("NM"), F.col("l_linenumber").cast("string"), F.lit("RG"), F.col("l_returnflag"), F.lit("XQ"), F.col("l_quantity").cast("int").cast("string"))
    mate = (F.col("pos") + 50).cast("int")
    return rows.select("read_id", "sample_idx", "tn", "qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("=").alias("rnext"), mate.alias("pnext"), "seq", "qual", tags.alias("tags"))


def _split(fields: str) -> list[str]:
    """Top-level comma-separated parts of a select list."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(fields):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(fields[start:k])
            start = k + 1
    return [*out, fields[start:]]


CHUNK = 256


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (chrom, chunk_start, bases) that cover the positions of reads(): as many as the parts need."""
    top = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey").alias("top"))
    chunks = top.select(F.explode(F.sequence(F.lit(0), ((F.col("top") + 400) / CHUNK).cast("int"))).alias("k"))
    chunks = chunks.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("c"), "k")
    start = F.col("k") * CHUNK + 1
    return chunks.select(F.concat(F.lit("chr"), F.col("c").cast("string")).alias("chrom"), start.alias("chunk_start"), F.arrow_udf(_made_chunks, "string")(start, "c").alias("bases"))


def _made_chunks(start: pa.Array, c: pa.Array) -> pa.Array:
    """CHUNK bases of the reference from each start on, for a batch of chunks at once."""
    q = np.asarray(start, np.int64)[:, None] + np.arange(CHUNK)[None, :]
    letters = np.frombuffer(b"ACGT", np.uint8)[_ref_codes(q, np.asarray(c, np.int64)[:, None])]
    offsets = np.arange(len(q) + 1, dtype=np.int32) * CHUNK
    return pa.StringArray.from_buffers(len(q), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


#: Observations: lineitem with part, rows dropped so that every branch of the somatic and LOH rules is met.
OBS_SQL = """obs_all AS (SELECT CAST(l_partkey AS INT) AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'G' END AS base,
  substr('ACG', CAST(p_size % 3 + 1 AS INT), 1) AS ref, CASE WHEN l_linestatus = 'F' THEN 'T' ELSE 'N' END AS tn,
  CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS INT) AS qual, l_orderkey AS qname,
  CAST(l_orderkey % 97 AS INT) AS unclipped_start, CAST(round(l_discount * 100) AS INT) AS mapq, CAST(l_suppkey % 25 AS INT) AS flank
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 obs AS (SELECT * FROM obs_all WHERE NOT ((pos % 7 = 0 AND tn = 'N' AND base <> ref) OR (pos % 11 = 0 AND tn = 'T' AND base = ref)
  OR (pos % 13 = 0 AND tn = 'T' AND base <> ref) OR (pos % 5 = 0 AND base <> ref AND strand = '-')))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, base, ref, tn, strand, qual, qname, unclipped_start, mapq, flank): one base of one read at a site each."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("pos"), "p_size")
    o = line.select(
        F.col("l_partkey").cast("int").alias("pos"),
        F.translate("l_returnflag", "ANR", "ACG").alias("base"),
        F.when(F.col("l_linestatus") == "F", "T").otherwise("N").alias("tn"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("l_quantity").cast("int").alias("qual"),
        F.col("l_orderkey").alias("qname"),
        (F.col("l_orderkey") % 97).cast("int").alias("unclipped_start"),
        F.round(F.col("l_discount") * 100).cast("int").alias("mapq"),
        (F.col("l_suppkey") % 25).cast("int").alias("flank"),
    ).join(part, "pos")
    o = o.select("pos", "base", F.lit("ACG").substr((F.col("p_size") % 3 + 1).cast("int"), F.lit(1)).alias("ref"), "tn", "strand", "qual", "qname", "unclipped_start", "mapq", "flank")
    alt, plus = F.col("base") != F.col("ref"), F.col("tn") == "T"
    drop = ((F.col("pos") % 7 == 0) & ~plus & alt) | ((F.col("pos") % 11 == 0) & plus & ~alt) | ((F.col("pos") % 13 == 0) & plus & alt) | ((F.col("pos") % 5 == 0) & alt & (F.col("strand") == "-"))
    return o.where(~drop)


#: Matrix with a sample a vector: cells of groups of five related vectors, some null.
MATRIX_SQL = """vectors AS (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS col FROM embeddings),
 matrix AS (SELECT a.vec_id, a.col, CASE WHEN (a.vec_id + a.col) % 17 = 0 THEN NULL ELSE CAST(greatest(-98, least(98, CASE WHEN a.vec_id % 3 <> 0
  THEN floor(30 * CAST(b.x AS DOUBLE) + 10 * CAST(a.x AS DOUBLE) + 0.5) ELSE floor(30 * CAST(a.x AS DOUBLE) + 0.5) END)) AS INT) END AS value
  FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id - a.vec_id % 5 AND a.col = b.col)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, col, value): a sample-by-marker matrix in long form; null cells are missing measurements."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("col", "x"))
    v = v.withColumn("x", F.col("x").cast("double"))
    head = v.where(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("g"), "col", F.col("x").alias("y"))
    both = v.withColumn("g", F.col("vec_id") - F.col("vec_id") % 5).join(head, ["g", "col"])
    cell = F.when(F.col("vec_id") % 3 != 0, F.floor(30 * F.col("y") + 10 * F.col("x") + 0.5)).otherwise(F.floor(30 * F.col("x") + 0.5))
    cell = F.when((F.col("vec_id") + F.col("col")) % 17 != 0, F.greatest(F.lit(-98), F.least(F.lit(98), cell)).cast("int"))
    return both.select("vec_id", "col", cell.alias("value"))


INTERVALS_SQL = "intervals AS (SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS chrom, o_orderkey AS s, o_orderkey + 1 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS e FROM orders)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("chrom"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 1 + F.floor("o_totalprice") % 50).alias("e"))


SEQUENCES_SQL = "sequences AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("seq"))
