"""Round trips of sources that read files of their own kind: tasks write the files, the sources read them back."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archives, binary, other, ranges, text
from ..sources.bam import located
from ..sources.paths import scratch
from .fixtures import CHUNK, MATRIX_SQL, matrix, ref_index, reference


def _files(rows: DataFrame, spark: SparkSession, name: str, encode: Callable[[pd.DataFrame], bytes]) -> str:
    """A folder with a file for each value of rows.file, encoded from its rows."""
    path = scratch(spark, name)

    def write(f: pd.DataFrame) -> pd.DataFrame:
        where, folder = located(path)
        where.create_dir(folder, recursive=True)
        target = f"{folder}/{f['file'].iloc[0]}"
        with where.open_output_stream(f"{folder}/_{f['file'].iloc[0]}", compression=None) as out:
            out.write(encode(f))
        where.move(f"{folder}/_{f['file'].iloc[0]}", target)
        return f[["file"]].head(1)

    rows.groupBy("file").applyInPandas(write, "file string").count()
    return path


#: Chunks in one file: what a task writes at once.
FILE_CHUNKS = 64


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(chrom, chunk_start, bases): the reference cut into sequences of FILE_CHUNKS chunks, with N and lower case in some."""
    r = reference(spark, sf).withColumn("k", F.floor(F.col("chunk_start") / CHUNK).cast("int"))
    bases = F.when(F.col("k") % 3 == 1, F.lower("bases")).otherwise(F.concat(F.lit("N"), F.expr("substring(bases, 2)")))
    own = F.concat_ws("_", "chrom", F.floor(F.col("k") / FILE_CHUNKS).cast("string"))
    return r.select(own.alias("chrom"), (F.col("k") % FILE_CHUNKS * CHUNK + 1).alias("chunk_start"), bases.alias("bases"))


def _paths(folder: str, ending: str) -> list[str]:
    where, name = located(folder)
    lead = folder[: len(folder) - len(name)]
    return sorted(lead + x.path for x in where.get_file_info(fs.FileSelector(name)) if x.path.endswith(ending))


def _digest(chunks: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.length("bases") - F.length(F.replace("bases", F.lit(c), F.lit("")))).alias({"a": "low_a", "A": "a", "N": "n"}[c])
    return chunks.groupBy("chrom").agg(F.sum(F.length("bases")).alias("bases"), count("A"), count("a"), count("N"), F.sum(F.col("chunk_start") * F.ascii("bases")).cast("long").alias("places"))


def _joined(f: pd.DataFrame) -> str:
    return "".join(f.sort_values("chunk_start")["bases"])


def ranged_fasta(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of indexed FASTA files by ranges of bytes."""
    lines = lambda s: "\n".join(s[i : i + 60] for i in range(0, len(s), 60))
    rows = _sequences(spark, sf).withColumn("file", F.concat("chrom", F.lit(".fa")))
    path = _files(rows, spark, "fasta", lambda f: f">{f['chrom'].iloc[0]} made\n{lines(_joined(f))}\n".encode())
    found = _paths(path, ".fa")
    ranges.build_fai(spark, found)
    return _digest(ranges.fasta_ranges(spark, found, CHUNK, run=4))


def ranged_two_bit(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 2-bit files by ranges of bytes."""
    return _digest(ranges.two_bit_ranges(spark, _paths(_two_bits(spark, sf), ".2bit"), CHUNK, run=4))


def _two_bits(spark: SparkSession, sf: str) -> str:
    rows = _sequences(spark, sf).withColumn("file", F.concat("chrom", F.lit(".2bit")))
    return _files(rows, spark, "two-bit", lambda f: binary.encode_2bit({f["chrom"].iloc[0]: _joined(f)}))


def two_bit(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(_rechunked(binary.genome_2bit(spark, _two_bits(spark, sf))))


def _rechunked(found: DataFrame) -> DataFrame:
    """Chunks of CHUNK from those of 4,096."""
    k = found.select("chrom", "chunk_start", "bases", F.explode(F.sequence(F.lit(0), F.ceil(F.length("bases") / CHUNK).cast("int") - 1)).alias("k"))
    return k.select("chrom", (F.col("chunk_start") + F.col("k") * CHUNK).alias("chunk_start"), F.col("bases").substr(F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("bases"))


def _nib(text: str) -> bytes:
    code = {c: i for i, c in enumerate("TCAGN")}
    half = [code[c.upper()] | (8 if c.islower() else 0) for c in text] + [0] * (len(text) % 2)
    return struct.pack("<II", 0x6BE93D3A, len(text)) + bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))


def nib(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sequences(spark, sf).withColumn("file", F.concat("chrom", F.lit(".nib")))
    return _digest(_rechunked(binary.genome_nib(spark, _files(rows, spark, "nib", lambda f: _nib(_joined(f))))))


def dbsnp(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    rows = p.select(F.concat(F.lit("snp"), F.col("p_partkey") % 32, F.lit(".blob")).alias("file"), F.concat(F.lit("chr"), F.col("p_size") % 3 + 1).alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), (F.col("p_partkey") * 7).cast("int").alias("rs"), (F.col("p_size") % 15 + 1).cast("int").alias("mask"))

    def encode(f: pd.DataFrame) -> bytes:
        out = b"CdDF" + struct.pack(">i", 2)
        for chrom, g in f.groupby("chrom"):
            out += bytes([len(chrom)]) + chrom.encode() + struct.pack(">i", len(g))
            out += b"".join(struct.pack(">iib", r, p - 1, m) for r, p, m in zip(g["rs"], g["pos"], g["mask"], strict=True))
        return out

    back = binary.dbsnp_blob(spark, _files(rows, spark, "dbsnp", encode))
    return back.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.sum("rs").alias("names"), F.sum("mask").cast("long").alias("masks"))


def matrix_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Binary blocks, a file for every eighth of the samples: plain bytes for even samples, runs for the others."""
    m = matrix(spark, sf).select(F.concat(F.lit("m"), F.col("vec_id") % 8, F.lit(".bin")).alias("file"), "vec_id", "col", F.coalesce("value", F.lit(-99)).alias("value"))

    def encode(f: pd.DataFrame) -> bytes:
        out = b""
        for sample, g in f.groupby("vec_id"):
            v = g.sort_values("col")["value"].to_numpy(np.int8)
            kind, body = (4, v.tobytes()) if sample % 2 == 0 else (5, np.stack([v, np.ones(len(v), np.int8)], 1).tobytes())
            name = str(sample).encode()
            out += struct.pack(">ii", 3, len(name)) + name + struct.pack(">ii", kind, len(body)) + body
        return out

    back = binary.matrix_binary(spark, _files(m, spark, "matrix-blocks", encode))
    return back.groupBy("col").agg(F.count("value").alias("n"), F.sum(F.col("value").cast("long")).alias("total"), F.sum(F.col("sample").cast("long")).alias("samples"))


def _traces(spark: SparkSession, sf: str, ending: str, encode: Callable, read: Callable) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 5 = 0")
    level = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int"))
    rows = e.select(F.concat(F.col("vec_id").cast("string"), F.lit(ending)).alias("file"), "vec_id", level.alias("v"))

    def one(f: pd.DataFrame) -> bytes:
        v, i = f["v"].iloc[0].tolist(), int(f["vec_id"].iloc[0])
        return encode([v[k * 16 : k * 16 + 16] for k in range(4)], "ACGTN"[: i // 5 % 5 + 1], [3 * k + i % 3 for k in range(i // 5 % 5 + 1)])

    back = read(spark, _files(rows, spark, "traces", one))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return back.select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("vec_id"), *[total(c).alias(c) for c in "acgt"], "bases", total("places").alias("places"))


def zipped(spark: SparkSession, sf: str) -> DataFrame:
    """A gene list kept as members of several zip archives."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    line = F.concat_ws("\t", F.concat(F.lit("gene"), "p_partkey"), F.col("p_size") % 22 + 1, "p_partkey", F.col("p_partkey") + F.col("p_size"))
    path = scratch(spark, "zips")
    archives.write_zips(p.select((F.col("p_partkey") % 3).alias("archive"), F.concat(F.lit("lists/"), F.col("p_size") % 4, F.lit(".txt")).alias("member"), F.col("p_partkey").alias("i"), line.alias("value")), path)
    back = other.gene_list(spark, archives.unpacked(spark, path, "*.txt"))
    return back.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def fasta_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A FASTA folder of one-record files."""
    rows = _sequences(spark, sf).withColumn("file", F.concat("chrom", F.lit(".fasta")))
    path = _files(rows, spark, "fasta-folder", lambda f: f">{f['chrom'].iloc[0]}\n{_joined(f)}\n".encode())
    return _digest(text.chunked(text.fasta(spark, path), CHUNK))


QUERIES = {
    "s11_ranged_fasta": ranged_fasta,
    "s09_ranged_two_bit": ranged_two_bit,
    "s09_two_bit": two_bit,
    "s10_nib": nib,
    "s12_fasta_folder": fasta_folder,
    "s17_dbsnp_blob": dbsnp,
    "s23_matrix_blocks": matrix_blocks,
    "s30_abi_traces": lambda s, d: _traces(s, d, ".ab1", binary.encode_abi, binary.abi),
    "s30_scf_traces": lambda s, d: _traces(s, d, ".scf", binary.encode_scf, binary.scf),
    "s34_zip_members": zipped,
}

_SEQ = f"""WITH c AS (SELECT unnest(range(1, 4)) AS c), k AS (SELECT unnest(range(CAST((SELECT max(p_partkey) + 400 FROM part) // {CHUNK} + 1 AS BIGINT))) AS k),
 b AS (SELECT c, k, i, substr('ACGT', CAST({ref_index(f"(k * {CHUNK} + 1 + i)", "c", False)} + 1 AS INT), 1) AS x FROM c, k, (SELECT unnest(range({CHUNK})) AS i)),
 s AS (SELECT c, k, i, CASE WHEN k % 3 = 1 THEN lower(x) WHEN i = 0 THEN 'N' ELSE x END AS x FROM b)
 SELECT 'chr' || c || '_' || (k // {FILE_CHUNKS}) AS chrom, count(*) AS bases, count(*) FILTER (x = 'A') AS a, count(*) FILTER (x = 'a') AS low_a, count(*) FILTER (x = 'N') AS n, CAST(sum(CASE WHEN i = 0 THEN (k % {FILE_CHUNKS} * {CHUNK} + 1) * ascii(x) ELSE 0 END) AS BIGINT) AS places FROM s GROUP BY 1"""
_TRACES = """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE vec_id % 5 = 0), q AS (SELECT vec_id, k // 16 AS q, CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS INT) AS y FROM v)
 SELECT vec_id, CAST(sum(y) FILTER (q = 0) AS INT) AS a, CAST(sum(y) FILTER (q = 1) AS INT) AS c, CAST(sum(y) FILTER (q = 2) AS INT) AS g, CAST(sum(y) FILTER (q = 3) AS INT) AS t, substr('ACGTN', 1, CAST(vec_id // 5 % 5 + 1 AS INT)) AS bases,
 CAST(list_sum([3 * k + vec_id % 3 FOR k IN range(vec_id // 5 % 5 + 1)]) AS INT) AS places FROM q GROUP BY vec_id"""
ORACLE = {
    **dict.fromkeys(("s11_ranged_fasta", "s09_ranged_two_bit", "s09_two_bit", "s10_nib", "s12_fasta_folder"), _SEQ),
    "s17_dbsnp_blob": "SELECT 'chr' || (p_size % 3 + 1) AS chrom, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS places, CAST(sum(p_partkey * 7) AS BIGINT) AS names, CAST(sum(p_size % 15 + 1) AS BIGINT) AS masks FROM part GROUP BY 1",
    "s23_matrix_blocks": f"WITH {MATRIX_SQL} SELECT col, count(value) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(vec_id) AS BIGINT) AS samples FROM matrix GROUP BY col",
    "s30_abi_traces": _TRACES,
    "s30_scf_traces": _TRACES,
    "s34_zip_members": "SELECT 'chr' || (p_size % 22 + 1) AS chrom, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS starts, CAST(sum(p_partkey + p_size) AS BIGINT) AS ends FROM part GROUP BY 1",
}
