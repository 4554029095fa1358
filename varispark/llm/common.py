"""Helpers that the operators of this subpackage share: the shared folder, written tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session names none (tests), a temporary folder is made and set; on a cluster executors would write
    to disks of their own there, so that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = held.get() if held.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="varispark-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: For columns of packed bytes: no dictionary pays off, and the fastest level of zstd is nearly as small.
PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return the table: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(options or {"compression": "zstd"})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._varispark_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    path = getattr(df, "_varispark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def _round(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v), both long: (node, component), component the least node.

    Nodes without edges are absent. Alternates large stars and small stars until the edges stand still, which takes
    rounds in the order of the logarithm of the longest path. Each round is two group-and-join steps whose join
    sides Spark may split where a node has very many edges; nothing is collected.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, state = _round(e, "edges")
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, _ = _round(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        small, new = _round(small.where("u <> v").distinct(), "edges")
        drop_table(e)
        drop_table(large)
        e = small
        if new == state:
            break
        state = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Words of a map of hashes: 2 MB, whatever the input; when it fills, it only lets more through.
MAP_WORDS = 1 << 18


def hash_map(hashes: DataFrame) -> np.ndarray:
    """A map of the first column's hashes, one bit for each low hash: MAP_WORDS words at most come to the driver."""
    h = F.col(hashes.columns[0])
    word = F.pmod(h, F.lit(MAP_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({hashes.columns[0]}, {MAP_WORDS.bit_length() - 1}), 64) as int))")
    out = np.zeros(MAP_WORDS, np.int64)
    for r in hashes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def in_hash_map(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the map lets hashes (signed or unsigned 64 bits) through."""
    h = h.view(np.uint64)
    return (words[h % np.uint64(MAP_WORDS)] >> ((h >> np.uint64(MAP_WORDS.bit_length() - 1)) % np.uint64(64)) & np.uint64(1)).astype(bool)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
