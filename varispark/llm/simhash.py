"""SimHash near-duplicates found with covering locality-sensitive hashing.

A covering family for radius r assigns each of the 64 bits a nonzero vector of r + 1 bits and makes one mask for each
nonzero v: the bits whose vector has an odd inner product with v. The vectors of any r differing bits span less than
the whole space, so some v is orthogonal to all of them and its mask leaves every differing bit out: each pair
within the radius agrees under at least one of the 2^(r+1) - 1 masks, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hash_map, in_hash_map, read, written

RADIUS = 2
#: Fingerprints under one mask value up to which pairs are compared; larger buckets go through midpoints instead.
PAIR_LIMIT = 48


def simhash(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over the shingles of the words of a text given as UTF-8; 0 for a text without words."""
    words = data.lower().split()  # bytes: A-Z alone are lower-cased, and exactly the six ASCII spaces split
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([h(flat[a:b], seed) for a, b in pairs], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, fp, key): the fingerprint of every document as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in b.column(1)], np.uint64)
            yield pa.record_batch({"doc_id": b.column(0), "fp": pa.array(fp.view(np.int64)), "key": b.column(2)})

    key = F.lit(None).cast("long") if key is None else key
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), key.alias("key")).mapInArrow(run, "doc_id long, fp long, key long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks as signed longs."""
    span = (1 << (radius + 1)) - 1
    vector = [i % span + 1 for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, span + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) whose closure links all within the radius.

    Every pair within the radius meets under a mask. Where few fingerprints share a mask value, they are compared in
    pairs. Where many do, pairs would grow with the square: there each fingerprint (radius 2) is put under itself and
    its one-bit neighbours outside the mask, and equal ones are joined to the least fingerprint. Two fingerprints
    share such a midpoint only within two bits, and any two within two bits that agree under the mask share one.
    """
    if radius != 2:
        raise ValueError("midpoints are written for a radius of 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(rows.join(sizes, ["t", "key"]), "buckets")
    few = rows.where(F.col("n") <= pair_limit).select("t", "key", F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = few.join(few.withColumnRenamed("u", "v"), ["t", "key"]).where((F.col("v") < F.col("u")) & near).select("u", "v")
    flips = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 0), i -> fp ^ shiftleft(1L, i))")
    mid = rows.where(F.col("n") > pair_limit).select("t", F.col("fp").alias("u"), F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
    least = mid.groupBy("t", "mid").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return pairs.union(mid.join(least, ["t", "mid"]).where("u <> v").select("u", "v"))


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id reachable through links, itself included).

    Fingerprints link at `radius` or fewer differing bits; equal ones are folded into one before any search, so a
    large group of copies is one row there. Null, empty and blank texts have fingerprint 0 and link like any other.
    Repeated doc_ids give repeated rows, null ones count in no minimum; an empty table gives no row; other columns
    are ignored.
    """
    return grouped(written(fingerprints(docs), "fingerprints"), radius).select("doc_id", "fp", "component_id")


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (doc_id, fp, …) with root, the fingerprint that stands for the row's group, and component_id."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(fingerprint_links(distinct.select("fp"), radius))
    root = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    label = root.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return fps.join(label, "fp", "left")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that stay, columns as given: of each group the one with the least doc_id.

    Where texts of a group share that doc_id, one text stays; documents without a doc_id come after all others. Rows
    are told by doc_id and a hash of the text, so texts under one doc_id are judged apart; rows equal in both stay or
    go together. Most rows stay and don't travel: a row meets the list of those that go only if a fixed-size map of
    that list, which every task has, lets it through.
    """
    key = F.xxhash64("doc_id", "text")
    found = fingerprints(docs.select("doc_id", "text"), key)
    groups = written(grouped(written(found, "fingerprints"), radius).select("doc_id", "key", "root"), "simhash-groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    keeper = groups.groupBy("root").agg(F.min(place).alias("keeper"))
    gone = groups.join(keeper, "root").where(~place.eqNullSafe(F.col("keeper"))).select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__key")).distinct()
    gone = written(gone, "simhash-gone")
    marks = docs.sparkSession.sparkContext.broadcast(hash_map(gone.select("__key")))

    @F.pandas_udf("boolean")
    def listed(keys: pd.Series) -> pd.Series:
        return pd.Series(in_hash_map(marks.value, keys.to_numpy()))

    rows = docs.withColumn("__key", key).withColumn("__listed", listed("__key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__key") == F.col("__gone"))
    kept = rows.where("__listed").join(gone.withColumnRenamed("__key", "__gone"), same, "left_anti")
    return rows.where("not __listed").union(kept).select(*docs.columns)


def op1_query(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
