"""Texts of an Arrow batch as flat numpy arrays: bytes, words and lines with their places and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a sample of labelled rows, at most.
SAMPLE_BYTES = 64 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


@dataclass
class Texts:
    """size[i] bytes of text i from start[i] in data; word and line arrays in order of place."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    word_start: np.ndarray
    word_size: np.ndarray
    word_hash: np.ndarray
    word_text: np.ndarray


#: Bytes that are hashed at a time: some forty times as much memory.
HASHED = 1 << 20


def segment_hash(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given byte ranges, which must not overlap and stand in order."""
    out = np.zeros(len(starts), np.uint64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, HASHED):  # bytes at..stop of the ranges laid end to end
        stop = min(at + HASHED, total)
        i, j = np.searchsorted(ends, at, "right"), np.searchsorted(begins, stop, "left")
        begin, end = np.maximum(begins[i:j], at), np.minimum(ends[i:j], stop)
        n = end - begin
        some = np.flatnonzero(n > 0)
        own = np.repeat(np.arange(len(n)), n)
        place = np.arange(at, stop) - begins[i:j][own]
        value = _BYTE[data[starts[i:j][own] + place]] * _POWER[place % len(_POWER)]
        value += (place // len(_POWER)).astype(np.uint64) * value
        out[i + some] += np.add.reduceat(value, begin[some] - at)
    return mix(out + sizes.astype(np.uint64))


def of_texts(texts: list[bytes]) -> Texts:
    size = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)  # a space between texts parts their words
    start = np.cumsum(size + 1) - size - 1
    gap = _SPACE[data]
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    return Texts(data, start, size, first, end - first, segment_hash(data, first, end - first), np.searchsorted(start, first, "right") - 1)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, texts of the second) of runs of rows of about `most` bytes; null texts are empty."""
    for b in batches:
        names, texts = b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and n < most:
                n += len(texts[stop])
                stop += 1
            yield names[at:stop], texts[at:stop]
            at = stop


def judged(column: pd.Series, judge: Callable[[list[bytes]], np.ndarray], most: int = 1 << 20) -> pd.Series:
    """judge's verdicts on runs of texts of about `most` characters; a run's bytes are made when its turn comes."""
    texts, out, at = column.tolist(), [], 0
    while at < len(texts):
        part: list[bytes] = []
        n = 0
        while at < len(texts) and n < most:
            part.append(texts[at].encode() if isinstance(texts[at], str) else b"")
            n += len(part[-1])
            at += 1
        out.append(judge(part))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most: int = SAMPLE_BYTES) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, quality) of at most `rows` labelled documents for training, of `most` bytes at most, on the driver.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out. The sample is the rows with the least hashes, so it is
    the same for the same tables, and no larger whatever their size; texts that would pass the bound on bytes are
    passed over. Ids and sizes are drawn before any text comes to the driver.
    """
    train = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    drawn = train.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sizes = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("size")).join(drawn, "doc_id")
    sizes = sizes.groupBy("doc_id", "quality").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    wanted, held = {}, 0
    for r in sizes:
        if held + r["size"] <= most:
            wanted[r["doc_id"]], held = r["quality"], held + r["size"]
    if not wanted:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most `rows` ids
    once = found.groupBy("doc_id").agg(F.max("text").cast("binary").alias("text")).collect()
    return sorted((r["doc_id"], bytes(r["text"]), wanted[r["doc_id"]]) for r in once)
