"""Members of zip archives in front of any source: unpacked by tasks into the shared folder, read from there as files.

The lists of members are read from the archives' ends alone. Members are dealt to tasks one by one, so a large archive is
unpacked by many tasks, each of which copies its members in pieces.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import located
from .paths import scratch

PIECE = 1 << 20


def members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, member, size) of the files in a zip archive, or in the archives of a folder, whose names fit a pattern."""
    where, name = located(path)
    info = where.get_file_info(name)
    lead = path[: len(path) - len(name)] if path.endswith(name) else path.split(":")[0] + "://"
    found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(name))
    archives = [(lead + x.path,) for x in found if x.type == pafs.FileType.File and (x is info or x.path.lower().endswith(".zip"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                own, local = located(archive)
                with own.open_input_file(local) as f, zipfile.ZipFile(f) as z:
                    rows = [(x.filename, x.file_size) for x in z.infolist() if not x.is_dir() and fnmatch.fnmatch(x.filename, pattern)]
                yield pa.record_batch({"archive": pa.array([archive] * len(rows), pa.string()), "member": pa.array([n for n, _ in rows], pa.string()), "size": pa.array([k for _, k in rows], pa.int64())})

    return spark.createDataFrame(archives, "archive string").repartition(max(1, len(archives))).mapInArrow(run, "archive string, member string, size long")


def unpacked(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """A folder with the members of the archives as files, for a source to read; names that would leave it are an error.

    Files are named by archive and member; a member appears under its name once it is whole, so a task that runs again
    replaces it. Members that are compressed themselves (.gz, .bz2) keep their ending, by which Spark decompresses.
    """
    target = scratch(spark, "unpacked")
    every = members(spark, path, pattern)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                clean = posixpath.normpath(r["member"])
                if clean.startswith(("/", "..")):
                    raise ValueError(f"{r['archive']} holds a path outside of itself: {r['member']}")
                where, folder = located(target)
                name = f"{posixpath.basename(r['archive'])}-{clean.replace('/', '-')}"
                where.create_dir(folder, recursive=True)
                own, local = located(r["archive"])
                held = f"{folder}/_{name}-{id(b)}"
                with own.open_input_file(local) as f, zipfile.ZipFile(f) as z, z.open(r["member"]) as source, where.open_output_stream(held, compression=None) as out:
                    while piece := source.read(PIECE):
                        out.write(piece)
                where.move(held, f"{folder}/{name}")
            yield b.select(["member"])

    every.repartition(n, "archive", "member").mapInArrow(run, "member string").count()
    where, folder = located(target)
    where.create_dir(folder, recursive=True)
    return target


def write_zips(lines: DataFrame, path: str) -> None:
    """Archives path/<archive>.zip of lines (archive, member, i, value): each member's lines in order of i.

    An archive is one task's, which streams its members; it appears under its name when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = located(path)
        where.create_dir(folder, recursive=True)
        name, z, member, out, stream = None, None, None, None, None

        def close() -> None:
            if z is not None:
                if member is not None:
                    out.close()
                z.close()
                stream.close()
                where.move(f"{folder}/_{name}.zip", f"{folder}/{name}.zip")

        for b in batches:
            for archive, m, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if archive != name:
                    close()
                    name, member, stream = archive, None, where.open_output_stream(f"{folder}/_{archive}.zip", compression=None)
                    z = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                if m != member:
                    if member is not None:
                        out.close()
                    member, out = m, z.open(m, "w")
                out.write(value.encode() + b"\n")
        close()
        yield pa.record_batch({"member": pa.array([], pa.string())})

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = lines.select(F.col("archive").cast("string").alias("archive"), F.col("member").cast("string").alias("member"), "value", "i")
    dealt = text.repartition(n, "archive").sortWithinPartitions("archive", "member", "i").select("archive", "member", "value")
    dealt.mapInArrow(run, "member string").count()
