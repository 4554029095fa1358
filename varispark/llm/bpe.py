"""Byte-level BPE over whole texts in chunks, as the tiktoken library would encode them, and decoding.

Texts over the chunk size are cut into overlapping chunks that are pre-tokenised apart. A chunk's first matches may
be wrong, as it can begin inside a pre-token; from the first place where its matches and those of the chunk before
begin alike, both go on alike. There the chunks are stitched; pieces between stitches are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, written
from .tokens import vocabulary

CHUNK, OVERLAP = 1 << 16, 1 << 10


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a rank file, and the bytes of each id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        table[i] = word
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def pretoken_starts(text: str, pattern: regex.Pattern) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def stitch(mine: list[int], following: list[int], chunk: int, overlap: int, size: int) -> int | None:
    """Where a chunk hands over to the next, from the next one's start; None if they nowhere meet in the overlap.

    mine, following: starts of matches in the two, each from its own chunk's start; size: characters in the first.
    Starts in a chunk's last few characters don't count: a cut contraction there may have been parted.
    """
    met = {x - chunk for x in mine if chunk <= x < size - 8} & {x for x in following if x < overlap - 8}
    return min(met, default=None)


def long_pieces(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, k, part) of docs (row, doc_id, text): parts in order of k that begin and end between pre-tokens.

    Where two chunks of a text don't meet (a pre-token longer than the overlap), the rest of that text is one part.
    """
    last = (F.ceil(F.length("text") / F.lit(chunk)) - 1).cast("int")
    cut = docs.select("row", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("k"), "text")
    cut = cut.select("row", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part")).repartition("row", "k")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        for b in batches:
            texts = b.column(2).to_pylist()
            starts = [[m.start() for m in find.finditer(x)] for x in texts]
            head, tail = [[y for y in x if y < overlap] for x in starts], [[y for y in x if y >= chunk] for x in starts]
            kind = pa.list_(pa.int32())
            yield pa.record_batch({"row": b.column(0), "k": b.column(1), "size": pa.array([len(x) for x in texts], pa.int32()), "head": pa.array(head, kind), "tail": pa.array(tail, kind)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tail, size, following = (b.column(i).to_pylist() for i in (2, 3, 4))
            at = [None if f is None else stitch(t, f, chunk, overlap, s) for t, f, s in zip(tail, following, size, strict=True)]
            yield pa.record_batch({"row": b.column(0), "k": b.column(1), "met": pa.array(at, pa.int32()), "last": pa.array([f is None for f in following], pa.bool_())})

    w = Window.partitionBy("row").orderBy("k")
    marks = cut.mapInArrow(scan, "row long, k int, size int, head array<int>, tail array<int>")
    marks = marks.select("row", "k", "tail", "size", F.lead("head").over(w).alias("following")).mapInArrow(meet, "row long, k int, met int, last boolean")
    start = F.coalesce(F.col("k") * chunk + F.lag("met").over(w), F.lit(0))
    stop = F.when(F.col("met").isNotNull(), (F.col("k") + 1) * chunk + F.col("met"))  # null: to the end of the text
    broken = F.sum((F.col("met").isNull() & ~F.col("last")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = marks.select("row", "k", start.alias("start"), stop.alias("stop"), F.coalesce(broken, F.lit(0)).alias("broken")).where("broken = 0")
    part = F.expr("substring(text, cast(start + 1 as int), cast(coalesce(stop, length(text)) - start as int))")
    return docs.join(spans, "row").select("row", "doc_id", "k", part.alias("part"))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers and the bytes that they decode to.

    Whole texts are encoded, each match of the pattern apart, without special tokens; null and empty texts have no
    ids. Every row gives one row, repeated doc_ids too; an empty table gives none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        enc = coder(path, pattern)[0]
        return [np.array(enc.encode_ordinary(x or ""), "<u4") for x in texts]

    def decode(ids: np.ndarray) -> bytes:
        table = coder(path, pattern)[1]
        return b"".join([table[i] for i in ids.tolist()])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = ids_of(part.column(1).to_pylist())
                yield pa.record_batch({"doc_id": part.column(0), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "decoded": pa.array(map(decode, ids), pa.binary())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ids_of(b.column(3).to_pylist())
            yield pa.record_batch({"row": b.column(0), "doc_id": b.column(1), "k": b.column(2), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b"".join(p["ids"] for p in sorted(ps, key=lambda p: p["k"])) for ps in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary())})

    fields = "doc_id long, ids binary, decoded binary"
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(direct, fields)
    longs = written(docs.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = long_pieces(longs.select("row", "doc_id", "text"), pattern, chunk, overlap)
    own = parts.mapInArrow(pieces, "row long, doc_id long, k int, ids binary").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "ids")).alias("parts"))
    return short.union(own.select("doc_id", "parts").mapInArrow(joined, fields))


def op8_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
