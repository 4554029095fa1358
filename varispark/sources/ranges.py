"""Reference sequences by ranges of bytes: indexed FASTA and 2-bit files, of which a task reads its own stretch alone.

An index says where a sequence's bases lie, so the bytes of any stretch are computed and fetched without reading what is
before it. A chromosome becomes as many tasks as it has runs of chunks, and a region costs the bytes of its chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..schema import REFERENCE
from .bam import Ranged, located

CHUNK = 4096
#: Chunks that a row of work covers: its bytes are fetched at once.
RUN = 256


def build_fai(spark: SparkSession, paths: list[str]) -> None:
    """Writes path.fai beside each FASTA file: name, length, offset, bases and bytes of a line. One pass, a file a task.

    Lines of a record but the last must have one width, as the format asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = located(f"{path}.fai")
                text = "".join(f"{n}\t{k}\t{at}\t{bases}\t{width}\n" for n, k, at, bases, width in _records(path))
                with where.open_output_stream(name) as out:
                    out.write(text.encode())
            yield b

    spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "path string").count()


def _records(path: str) -> Iterator[tuple[str, int, int, int, int]]:
    where, name = located(path)
    record: list | None = None
    short = at = 0
    rest = b""
    with where.open_input_stream(name) as s:
        while True:
            block = s.read(1 << 20)
            *lines, rest = (rest + block).split(b"\n") if block else ([rest] if rest else []) + [b""]
            for line in lines:
                size = len(line) + 1
                text = line.rstrip(b"\r")
                if text.startswith(b">"):
                    if record:
                        yield tuple(record)
                    record, short = [text[1:].split()[0].decode() if text[1:].split() else "", 0, at + size, 0, 0], 0
                elif record is not None and text:
                    record[3], record[4] = record[3] or len(text), record[4] or size
                    if short or len(text) > record[3]:
                        raise ValueError(f"{path}: lines of {record[0]} differ in length")
                    short = len(text) < record[3]
                    record[1] += len(text)
                elif record is not None:
                    short = 1
                at += size
            if not block:
                break
    if record:
        yield tuple(record)


def fai(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, length, offset, line_bases, line_width) of FASTA files' indexes."""
    table = spark.read.option("sep", "\t").schema("name string, length long, offset long, line_bases int, line_width int").csv([f"{p}.fai" for p in paths])
    return table.withColumn("path", F.regexp_replace("_metadata.file_path", r"\.fai$", ""))


def _work(index: DataFrame, chunk: int, run: int, region: tuple[str, int, int] | None) -> DataFrame:
    """index with rows (first, count): runs of chunks, from 0, cut at the sequence's end; a region's chunks alone."""
    if region:
        chrom, start, end = region
        same = names.chromosome(F.col("name")) == names.chromosome(F.lit(chrom))
        low, high = max(start - 1, 0) // chunk, max(end - 1, 0) // chunk
        index = index.where(same & (F.col("length") > low * chunk))
        lowest, last = F.lit(low), F.least(F.lit(high), F.floor((F.col("length") - 1) / chunk))
    else:
        index = index.where("length > 0")
        lowest, last = F.lit(0), F.floor((F.col("length") - 1) / chunk)
    rows = index.withColumn("first", F.explode(F.sequence(lowest.cast("long"), last.cast("long"), F.lit(run).cast("long")))).withColumn("count", F.least(F.lit(run), last - F.col("first") + 1).cast("int"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "path", "name", "first")


def _chunks(name: str, first: int, bases: bytes, chunk: int) -> pa.RecordBatch:
    cut = [bases[i : i + chunk].decode() for i in range(0, len(bases), chunk)]
    starts = [(first + i) * chunk + 1 for i in range(len(cut))]
    return pa.record_batch({"chrom": pa.array([name] * len(cut)), "chunk_start": pa.array(starts, pa.int32()), "bases": pa.array(cut)})


def fasta_ranges(spark: SparkSession, paths: list[str], chunk: int = CHUNK, region: tuple[str, int, int] | None = None, run: int = RUN) -> DataFrame:
    """REFERENCE chunks of FASTA files with indexes, or those that a region (chrom, start, end) touches.

    The region's chromosome may go by another of its names; what lies beyond a sequence's end isn't there.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files: dict[str, Ranged] = {}
            for r in b.to_pylist():
                file = files.setdefault(r["path"], Ranged(r["path"], ahead=0)) if r["path"] not in files else files[r["path"]]
                place = lambda i, r=r: r["offset"] + i // r["line_bases"] * r["line_width"] + i % r["line_bases"]
                a, z = r["first"] * chunk, min((r["first"] + r["count"]) * chunk, r["length"])
                raw = file.get(place(a), place(z - 1) + 1 - place(a))
                bases = raw.replace(b"\n", b"").replace(b"\r", b"")
                if len(bases) != z - a:
                    raise ValueError(f"{r['path']} doesn't fit its index at {r['name']}")
                yield _chunks(r["name"], r["first"], bases, chunk)

    return _work(fai(spark, paths), chunk, run, region).mapInArrow(read, REFERENCE)


@lru_cache(maxsize=4)
def _two_bit(path: str) -> tuple[str, dict[str, int]]:
    """(byte order, sequence -> offset) of a 2-bit file's index."""
    f = Ranged(path, ahead=1 << 16)
    end = next((e for e in "<>" if struct.unpack(e + "I", f.get(0, 4))[0] == 0x1A412743), None)
    if end is None:
        raise ValueError(f"{path} is no 2-bit file")
    at, out = 16, {}
    for _ in range(struct.unpack(end + "I", f.get(8, 4))[0]):
        n = f.get(at, 1)[0]
        out[f.get(at + 1, n).decode()] = struct.unpack(end + "I", f.get(at + 1 + n, 4))[0]
        at += 5 + n
    return end, out


def _two_bit_head(f: Ranged, end: str, at: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], int]:
    """(bases, (starts, sizes) of N and of mask blocks, offset of the packed bases) of a sequence."""
    u32 = lambda p, n: np.frombuffer(f.get(p, 4 * n), end + "u4").astype(np.int64)
    size, at, blocks = int(u32(at, 1)[0]), at + 4, []
    for _ in range(2):
        k = int(u32(at, 1)[0])
        blocks.append((u32(at + 4, k), u32(at + 4 + 4 * k, k)))
        at += 4 + 8 * k
    return size, blocks, at + 4


def two_bit_ranges(spark: SparkSession, paths: list[str], chunk: int = CHUNK, region: tuple[str, int, int] | None = None, run: int = RUN) -> DataFrame:
    """REFERENCE chunks of 2-bit files, whose own indexes say where sequences are; as fasta_ranges(). chunk: a multiple of 4."""
    if chunk % 4:
        raise ValueError("chunks of 2-bit files begin at whole bytes: a multiple of 4")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                end, found = _two_bit(path)
                f = Ranged(path, ahead=1 << 12)
                sizes = [struct.unpack(end + "I", f.get(at, 4))[0] for at in found.values()]
                yield pa.record_batch({"path": pa.array([path] * len(found), pa.string()), "name": pa.array(list(found), pa.string()), "length": pa.array(sizes, pa.int64()), "offset": pa.array(list(found.values()), pa.int64())})

    table = spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(heads, "path string, name string, length long, offset long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            for r in b.to_pylist():
                if last is None or last[0] != (r["path"], r["name"]):
                    f = Ranged(r["path"], ahead=0)
                    last = ((r["path"], r["name"]), *_two_bit_head(f, _two_bit(r["path"])[0], r["offset"]))
                _, size, (unknown, lower), packed = last
                a, z = r["first"] * chunk, min((r["first"] + r["count"]) * chunk, size)
                codes = (np.frombuffer(f.get(packed + a // 4, -(-z // 4) - a // 4), np.uint8)[:, None] >> np.array([6, 4, 2, 0])) & 3
                bases = np.frombuffer(b"TCAG", np.uint8)[codes.reshape(-1)[: z - a]].copy()
                for (starts, sizes), change in ((unknown, lambda x: ord("N")), (lower, lambda x: x | 0x20)):
                    i, j = np.searchsorted(starts + sizes, a, "right"), np.searchsorted(starts, z, "left")
                    for s, k in zip(starts[i:j].tolist(), sizes[i:j].tolist(), strict=True):
                        cut = slice(max(s - a, 0), min(s + k, z) - a)
                        bases[cut] = change(bases[cut])
                yield _chunks(r["name"], r["first"], bases.tobytes(), chunk)

    return _work(table, chunk, run, region).mapInArrow(read, REFERENCE)
