"""BAM as a data source of Spark: files split into ranges of BGZF blocks, with columns and filters pushed to the reader.

A BAM file is a chain of small compressed blocks and its records don't begin where blocks do, so a file can be entered
only where an index tells a record's virtual offset: the file offset of a block, and the place in what it holds. An
index here has one such checkpoint for about every `step` bytes, with the place of its first record and how far its records
reach; written files have it beside them, others get it from build_index(), a pass over each file in a task of its own.
Tasks read runs of segments between checkpoints. Of a query for a region, or of filters on rname and pos, only the segments
that can hold such records are opened. Ranges are read through pyarrow's file systems, so not only from local disks.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dealing
from ..functions.batches import Texts

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, seq string, qual array<int>, tags map<string,string>"
INDEX = ".vsi"
#: Compressed bytes between checkpoints, and in the segments that one task reads.
STEP = 1 << 20
SPLIT = 64 << 20
BATCH = 4096
#: Tasks of a scan at most: beyond that, a task reads segments of more bytes than asked for.
TASKS = 1024
# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
BLOCK = 0xFF00
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_SEGMENT = np.dtype([("at", "<u8"), ("ref", "<i4"), ("pos", "<i4"), ("last_ref", "<i4"), ("reach", "<i4"), ("n", "<i8")])
_NUMBER = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or uri, and the path there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class Ranged:
    """Bytes of a file by place, fetched `ahead` at a time but not beyond `stop`; fetched counts them."""

    def __init__(self, path: str, stop: int | None = None, ahead: int = 1 << 18):
        where, name = located(path)
        self.file = where.open_input_file(name)
        self.size, self.ahead, self.fetched = self.file.size(), ahead, 0
        self.stop = self.size if stop is None else min(stop, self.size)
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(self.ahead, self.stop - at)))
            self.fetched += len(self.held)
        return self.held[at - self.at : at - self.at + n]

    def block(self, at: int) -> tuple[bytes, int] | None:
        """(content, next block's place) of the block at a place; None at the end."""
        head = self.get(at, 12)
        if len(head) < 12:
            return None
        if head[:4] != HEAD[:4]:
            raise ValueError("this is no BGZF block")
        extra = self.get(at + 12, struct.unpack("<H", head[10:12])[0])
        size, p = None, 0
        while p + 4 <= len(extra):
            kind, n = extra[p : p + 2], struct.unpack("<H", extra[p + 2 : p + 4])[0]
            size = struct.unpack("<H", extra[p + 4 : p + 6])[0] + 1 if kind == b"BC" else size
            p += 4 + n
        if size is None:
            raise ValueError("this is no BGZF block")
        body = self.get(at, size)
        return zlib.decompress(body[12 + len(extra) : -8], -15), at + size


def dictionary(path: str) -> tuple[list[tuple[str, int]], int]:
    """(sequences with lengths, virtual offset of the first record) of a file's header."""
    f, raw, at, starts = Ranged(path), b"", 0, []

    def need(n: int) -> None:
        nonlocal raw, at
        while len(raw) < n:
            block = f.block(at)
            if block is None:
                raise ValueError(f"{path} ends within its header")
            starts.append((len(raw), at))
            raw, at = raw + block[0], block[1]

    need(8)
    if raw[:4] != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    p = 8 + struct.unpack("<i", raw[4:8])[0]
    need(p + 4)
    refs, (n,) = [], struct.unpack("<i", raw[p : p + 4])
    p += 4
    for _ in range(n):
        need(p + 4)
        (k,) = struct.unpack("<i", raw[p : p + 4])
        need(p + 8 + k)
        refs.append((raw[p + 4 : p + 3 + k].decode(), struct.unpack("<i", raw[p + 4 + k : p + 8 + k])[0]))
        p += 8 + k
    if p == len(raw):
        return refs, at << 16
    begin, block = max(s for s in starts if s[0] <= p)
    return refs, block << 16 | p - begin


def records(f: Ranged, first: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) of the records that begin at virtual offsets first..stop."""
    at, skip, tail, began = first >> 16, first & 0xFFFF, b"", first
    while block := f.block(at):
        data, after = block
        known = len(tail)
        buf, p = tail + data[skip:], 0
        while True:
            if p >= known:
                began = at << 16 | skip + p - known
                if stop is not None and began >= stop:
                    return
            if p + 4 > len(buf):
                break
            size = struct.unpack_from("<i", buf, p)[0]
            if p + 4 + size > len(buf):
                break
            yield began, buf[p + 4 : p + 4 + size]
            p += 4 + size
        tail, skip, at = buf[p:], 0, after
    if tail:
        raise ValueError("the file ends within a record")


def _reach(rec: bytes) -> int:
    """The last place that a record's alignment covers, from 1; its own place without one."""
    pos, k, ops = struct.unpack_from("<i", rec, 4)[0], rec[8], struct.unpack_from("<H", rec, 12)[0]
    return pos + max(1, sum(x >> 4 for x in struct.unpack_from(f"<{ops}I", rec, 32 + k) if OPS[x & 15] in "MDN=X"))


def _tags(raw: bytes) -> list[tuple[str, str]]:
    out, p = [], 0
    while p + 3 <= len(raw):
        name, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind in "ZH":
            end = raw.index(0, p)
            value, p = raw[p:end].decode(), end + 1
        elif kind == "A":
            value, p = chr(raw[p]), p + 1
        elif kind == "B":
            form, n = _NUMBER[chr(raw[p])], struct.unpack_from("<i", raw, p + 1)[0]
            width = struct.calcsize(form)
            items = struct.unpack_from(f"<{n}{form[1]}", raw, p + 5)
            value, p = ",".join([chr(raw[p]), *map(str, items)]), p + 5 + n * width
        else:
            form = _NUMBER[kind]
            value, p = str(struct.unpack_from(form, raw, p)[0]), p + struct.calcsize(form)
        out.append((name, value))
    return out


_known_tags = lru_cache(1 << 16)(_tags)


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places at..at+n of each row, one after the other."""
    n = n.astype(np.int64)
    return np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)


def _offsets(n: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate(([0], np.cumsum(n))).astype(np.int32))


_LETTERS = np.frombuffer(BASES.encode(), np.uint8)


class Records:
    """Columns of some records at once."""

    def __init__(self, recs: list[bytes], refs: list[str]):
        self.recs, self.names = recs, pa.array([*refs, "*"], pa.string())
        size = np.array([len(r) for r in recs], np.int64)
        self.raw, self.at, self.n = np.frombuffer(b"".join(recs), np.uint8), np.cumsum(size) - size, len(recs)
        head = self.raw[self.at[:, None] + np.arange(32)].copy().view(np.dtype("<i4,<i4,u1,u1,<u2,<u2,<u2,<i4,<i4,<i4,<i4"))[:, 0]
        self.ref, self.pos, self.name, self.mapq, self.ops, self.flag, self.bases, self.next_ref, self.next_pos = (head[f"f{i}"].astype(np.int64) for i in (0, 1, 2, 3, 5, 6, 7, 8, 9))
        self.cigar = 32 + self.name
        self.seq = self.cigar + 4 * self.ops
        self.qual = self.seq + (self.bases + 1) // 2
        self.tags = self.qual + self.bases

    def _text(self, at: np.ndarray, n: np.ndarray, data: np.ndarray | None = None, null: np.ndarray | None = None) -> pa.Array:
        data = self.raw[ragged(at, n)] if data is None else data
        valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.StringArray.from_buffers(self.n, _offsets(n), pa.py_buffer(np.ascontiguousarray(data)), valid)

    def column(self, name: str, kind: pa.DataType) -> pa.Array:
        if name == "qname":
            return self._text(self.at + 32, self.name - 1)
        if name in ("flag", "mapq"):
            return pa.array(getattr(self, name)).cast(kind)
        if name in ("pos", "pnext"):
            return pa.array((self.pos if name == "pos" else self.next_pos) + 1).cast(kind)
        if name in ("rname", "rnext"):
            own = self.ref if name == "rname" else self.next_ref
            text = self.names.take(pa.array(np.where(own < 0, len(self.names) - 1, own)))
            return text if name == "rname" else pc.if_else(pa.array((own == self.ref) & (own >= 0)), "=", text)
        if name == "cigar":
            known: dict[bytes, str | None] = {}
            raw = [r[a : a + 4 * n] for r, a, n in zip(self.recs, self.cigar.tolist(), self.ops.tolist(), strict=True)]
            for x in set(raw):
                known[x] = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{len(x) // 4}I", x)) or None
            return pa.array([known[x] for x in raw], kind)
        if name == "seq":
            half = (self.bases + 1) // 2
            pairs = self.raw[ragged(self.at + self.seq, half)]
            data = _LETTERS[np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)]
            return self._text(self.at, self.bases, data[ragged(2 * (np.cumsum(half) - half), self.bases)], self.bases == 0)
        if name == "qual":
            none = self.bases == 0
            none[~none] = self.raw[(self.at + self.qual)[~none]] == 0xFF
            n = np.where(none, 0, self.bases)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32), mask=np.append(none, False))
            return pa.ListArray.from_arrays(offsets, pa.array(self.raw[ragged(self.at + self.qual, n)].astype(np.int32))).cast(kind)
        return pa.array([_known_tags(r[a:]) for r, a in zip(self.recs, self.tags.tolist(), strict=True)], kind)


def segments(path: str) -> np.ndarray | None:
    """The checkpoints of a file's index, None without one."""
    where, name = located(path + INDEX)
    if where.get_file_info(name).type != pafs.FileType.File:
        return None
    with where.open_input_stream(name) as s:
        raw = s.read()
    if raw[:4] != b"VSI\1":
        raise ValueError(f"{path + INDEX} is no index")
    return np.frombuffer(raw, _SEGMENT, offset=4)


class Checkpoints:
    """Collects an index as records pass in file order; whether they are sorted by place shows in `ordered`."""

    def __init__(self, step: int):
        self.step, self.rows, self.ordered, self.last, self.last_key = step, [], True, (0, 0), 0

    def add(self, at: int, rec: bytes) -> None:
        ref, pos = struct.unpack_from("<ii", rec, 0)
        key = (ref & 0xFFFFFFFF, pos)  # records without a place come last
        self.ordered &= key >= self.last
        self.last = key
        if not self.rows or (at >> 16) - (self.rows[-1][0] >> 16) >= self.step:
            self.rows.append([at, ref, pos + 1, ref, 0, 0])
        row = self.rows[-1]
        if ref != row[3]:
            row[3], row[4] = ref, 0
        row[4], row[5] = max(row[4], _reach(rec)), row[5] + 1

    def add_run(self, at: int, ref: np.ndarray, pos: np.ndarray, reach: np.ndarray) -> None:
        """Records that begin in one block, the first at virtual offset `at`."""
        key = np.where(ref < 0, (1 << 31) - 1, ref) << 32 | (pos + (1 << 31))
        self.ordered &= int(key[0]) >= self.last_key and bool((key[1:] >= key[:-1]).all())
        self.last_key = int(key[-1])
        if not self.rows or (at >> 16) - (self.rows[-1][0] >> 16) >= self.step:
            self.rows.append([at, int(ref[0]), int(pos[0]) + 1, int(ref[0]), 0, 0])
        row, own = self.rows[-1], int(ref[-1])
        row[4] = max(row[4] if own == row[3] else 0, int(reach[ref == own].max()))
        row[3], row[5] = own, row[5] + len(ref)

    def save(self, path: str) -> None:
        where, name = located(path + INDEX)
        with where.open_output_stream(name) as s:
            s.write(b"VSI\1" + (np.array([tuple(r) for r in self.rows], _SEGMENT).tobytes() if self.ordered else b""))


def build_index(spark: SparkSession, paths: list[str], step: int = STEP) -> None:
    """Indexes of BAM files beside them: one pass over each file, a file a task, a block in memory at a time.

    A file that isn't sorted by place gets an empty index, and is read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                made, f = Checkpoints(step), Ranged(path)
                for at, rec in records(f, dictionary(path)[1], None):
                    made.add(at, rec)
                made.save(path)
            yield b

    spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "path string").count()


@dataclass
class Range(InputPartition):
    path: str
    refs: list[str]
    first: int
    stop: int | None


@dataclass
class Wanted:
    """Bounds of the records that a query can use; the ends are those of places where a read begins."""

    refs: set[str] | None = None
    low: int = 0
    high: int = 1 << 31
    start: int = 0

    def names(self, given: set[str]) -> None:
        self.refs = given if self.refs is None else self.refs & given


def other_name(chrom: str) -> str:
    return chrom[3:] if chrom.startswith("chr") else f"chr{chrom}"


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.split = int(options.get("split", SPLIT))
        self.region, self.wanted = options.get("region"), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters narrow what is opened; Spark tests all of them again."""
        for x in filters:
            name = x.attribute[0] if hasattr(x, "attribute") else ""
            if name == "rname" and isinstance(x, (EqualTo, In)):
                self.wanted.names({x.value} if isinstance(x, EqualTo) else set(x.value))
            elif name == "pos" and isinstance(x, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.wanted.low = max(self.wanted.low, x.value + isinstance(x, GreaterThan))
            if name == "pos" and isinstance(x, (LessThan, LessThanOrEqual, EqualTo)):
                self.wanted.high = min(self.wanted.high, x.value - isinstance(x, LessThan))
            yield x

    def _files(self) -> list[str]:
        where, name = located(self.path)
        info = where.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(name))
        lead = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else self.path.split(":")[0] + "://"
        return sorted(lead + x.path for x in found if x.path.endswith(".bam") or x is info)

    def partitions(self) -> list[Range]:
        out, found = [], []
        for path in self._files():
            sequences, first = dictionary(path)
            names = [n for n, _ in sequences]
            want = self.bounds(set(names))
            index = segments(path)
            if index is None or not len(index):
                out.append(Range(path, names, first, None))
                continue
            found.append((path, names, index["at"], self.needed(index, names, want)))
        total = sum(int((np.diff(at >> np.uint64(16)).astype(np.int64) * need[:-1]).sum()) for _, _, at, need in found)
        split = max(self.split, -(-total // TASKS))
        for path, names, begin, wanted in found:
            stop = np.append(begin[1:], np.uint64(0)).tolist()
            at, held = begin.tolist(), None
            for i, need in enumerate(wanted.tolist()):
                if need and held and held.stop == at[i] and (at[i] >> 16) - (held.first >> 16) < split:
                    held.stop = stop[i] or None
                elif need:
                    held = Range(path, names, at[i], stop[i] or None)
                    out.append(held)
        return out or [Range("", [], 0, None)]

    def bounds(self, names: set[str]) -> Wanted:
        """The filters with the region chrom, chrom:start or chrom:start-end, under the chromosome's name in the file."""
        want = Wanted(self.wanted.refs, self.wanted.low, self.wanted.high, self.wanted.low)
        if self.region:
            chrom, _, span = self.region.partition(":")
            chrom = chrom if chrom in names else other_name(chrom)
            a, _, b = span.replace(",", "").partition("-")
            want.names({chrom})
            want.start = max(want.start, int(a or 0))
            want.high = min(want.high, int(b or (1 << 31)))
        return want

    def needed(self, index: np.ndarray, names: list[str], want: Wanted) -> np.ndarray:
        n = len(names)
        if want.refs is None and want.start <= 0 and want.high >= 1 << 31:
            return np.ones(len(index), bool)
        rank = lambda x: np.where(x < 0, n, x)
        first, last = rank(index["ref"]), rank(index["last_ref"])
        out = np.zeros(len(index), bool)
        for r in [*range(n), n] if want.refs is None else [n if x == "*" else names.index(x) for x in want.refs if x == "*" or x in names]:
            out |= (first <= r) & (r <= last) & ((first < r) | (index["pos"] <= want.high)) & ((last > r) | (index["reach"] >= want.start))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        if not part.path:
            return
        want = self.bounds(set(part.refs))
        refs = None if want.refs is None else {part.refs.index(x) if x != "*" else -1 for x in want.refs if x == "*" or x in part.refs}
        span = int((self.region or "").partition(":")[2].replace(",", "").partition("-")[0] or 0)
        file = Ranged(part.path, None if part.stop is None else (part.stop >> 16) + 0x10000)
        rows: list[bytes] = []
        for _, rec in records(file, part.first, part.stop):
            ref, pos = struct.unpack_from("<ii", rec, 0)
            if (refs is not None and ref not in refs) or not want.low <= pos + 1 <= want.high or (span and _reach(rec) < span):
                continue
            rows.append(rec)
            if len(rows) == BATCH:
                yield self._batch(rows, part.refs, arrow)
                rows = []
        yield self._batch(rows, part.refs, arrow)

    @staticmethod
    def _batch(rows: list[bytes], refs: list[str], arrow: pa.Schema) -> pa.RecordBatch:
        if not rows:
            return pa.record_batch([pa.array([], f.type) for f in arrow], schema=arrow)
        made = Records(rows, refs)
        return pa.record_batch([made.column(f.name, f.type) for f in arrow] if len(arrow) else [], schema=arrow)


class Output:
    """A BGZF file: blocks of at most `most` bytes, and virtual offsets as bytes come."""

    def __init__(self, stream: pa.NativeFile, most: int = BLOCK):
        self.stream, self.most, self.at, self.held = stream, min(most, BLOCK), 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, raw: bytes) -> None:
        self.held += raw
        while len(self.held) >= self.most:
            self.flush(self.most)

    def flush(self, n: int) -> None:
        raw = bytes(self.held[:n])
        del self.held[:n]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush()
        block = HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
        self.stream.write(block)
        self.at += len(block)

    def close(self) -> None:
        if self.held:
            self.flush(len(self.held))
        self.stream.write(LAST)
        self.stream.close()


_CODES = np.full(256, 15, np.uint8)
_CODES[_LETTERS] = np.arange(16)


class Encoded:
    """Records of a batch of rows, each with its size before it: raw, where each begins and ends, ref, pos and reach. Columns that the rows lack
    have the format's neutral values."""

    def __init__(self, b: pa.RecordBatch, ranks: dict[str, int]):
        n = b.num_rows
        column = lambda k, kind, d: (b.column(k).cast(kind).fill_null(d) if k in b.schema.names else pa.array([d] * n, kind))
        number = lambda k: np.asarray(column(k, pa.int64(), 0))

        def rank(k: str, same: np.ndarray | None = None) -> np.ndarray:
            coded = column(k, pa.string(), "*").dictionary_encode()
            own = np.array([-2 if x == "=" and same is not None else ranks[x] for x in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
            return own if same is None else np.where(own == -2, same, own)

        ref = rank("rname")
        after, pos = rank("rnext", ref), number("pos") - 1
        coded = column("cigar", pa.string(), "").dictionary_encode()
        ops = [[(int(k), OPS.index(o)) for k, o in re.findall(r"(\d+)([MIDNSHP=X])", x)] for x in coded.dictionary.to_pylist()]
        which, packed = np.asarray(coded.indices, np.int64), [b"".join(struct.pack("<I", k << 4 | o) for k, o in x) for x in ops]
        n_ops = np.array([len(x) for x in ops], np.int64)
        span = np.array([max(1, sum(k for k, o in x if OPS[o] in "MDN=X")) for x in ops], np.int64)
        name, seq = Texts(column("qname", pa.string(), "*"), False), Texts(column("seq", pa.string(), ""))
        lists = column("qual", pa.list_(pa.int64()), []) if "qual" in b.schema.names else pa.array([[]] * n, pa.list_(pa.int64()))
        n_qual = np.asarray(lists.value_lengths(), np.int64)
        if (bad := np.flatnonzero((n_qual > 0) & (n_qual != seq.size))).size:
            raise ValueError(f"bad sequence or quality of {b.column('qname')[int(bad[0])] if 'qname' in b.schema.names else '*'}")
        row, keys, values = self._tags(b, n)
        tag_at = np.cumsum(keys.size + values.size + 2) - (keys.size + values.size + 2)
        n_tags = np.bincount(row, keys.size + values.size + 2, n).astype(np.int64)
        half = (seq.size + 1) // 2
        size = 36 + name.size + 1 + 4 * n_ops[which] + half + seq.size + n_tags
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        head = np.zeros(n, np.dtype("<i4,<i4,<i4,u1,u1,<u2,<u2,<u2,<i4,<i4,<i4,<i4"))
        for k, x in enumerate((size - 4, ref, pos, name.size + 1, number("mapq"), 4680, n_ops[which], number("flag"), seq.size, after, number("pnext") - 1, 0)):
            limit = np.iinfo(head.dtype[k])
            if np.any((np.asarray(x) < limit.min) | (np.asarray(x) > limit.max)):
                raise ValueError("a field is beyond what the format holds")
            head[f"f{k}"] = x
        out[at[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
        p = at + 36
        out[ragged(p, name.size)] = name.data[ragged(name.at, name.size)]
        p = p + name.size + 1
        every, first = np.frombuffer(b"".join(packed), np.uint8), np.cumsum(4 * n_ops) - 4 * n_ops
        out[ragged(p, 4 * n_ops[which])] = every[ragged(first[which], 4 * n_ops[which])]
        p = p + 4 * n_ops[which]
        codes = np.zeros(int(2 * half.sum()), np.uint8)
        codes[ragged(2 * (np.cumsum(half) - half), seq.size)] = _CODES[seq.data[ragged(seq.at, seq.size)]]
        out[ragged(p, half)] = codes[::2] << 4 | codes[1::2]
        p = p + half
        some = n_qual > 0
        quality = np.asarray(lists.flatten(), np.int64)
        if len(quality) and not 0 <= quality.min() <= quality.max() <= 255:
            raise ValueError("a quality is beyond what the format holds")
        out[ragged(p[some], n_qual[some])] = quality
        out[ragged(p[~some], seq.size[~some])] = 0xFF
        tag = tag_at + (p + seq.size - (np.cumsum(n_tags) - n_tags))[row]
        out[ragged(tag, keys.size)] = keys.data[ragged(keys.at, keys.size)]
        out[tag + keys.size] = ord("Z")
        out[ragged(tag + keys.size + 1, values.size)] = values.data[ragged(values.at, values.size)]
        self.raw, self.at, self.end, self.ref, self.pos, self.reach = out, at, at + size, ref, pos, pos + span[which]

    @staticmethod
    def _tags(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, Texts, Texts]:
        """Rows, keys and values of all tags, by row and key."""
        none = pa.array([], pa.string())
        if "tags" not in b.schema.names:
            return np.zeros(0, np.int64), Texts(none), Texts(none)
        maps = pa.ListArray.from_arrays(b.column("tags").offsets, pa.StructArray.from_arrays([b.column("tags").keys, b.column("tags").items], ["k", "v"]))
        lengths = np.where(np.asarray(b.column("tags").is_valid()), np.diff(np.asarray(maps.offsets)), 0)
        first = np.asarray(maps.offsets, np.int64)[:-1]
        cells = maps.values.take(pa.array(ragged(first, lengths)))
        row, coded = np.repeat(np.arange(n), lengths), cells.field("k").dictionary_encode()
        rank = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), object))) if len(coded.dictionary) else np.zeros(0, np.int64)
        order = pa.array(np.lexsort((rank[np.asarray(coded.indices)], row)) if len(row) else np.zeros(0, np.int64))
        values = cells.field("v").take(order)
        if values.null_count:
            raise ValueError("a tag has no value")
        return row, Texts(cells.field("k").take(order), False), Texts(values, False)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class BamWriter(DataSourceArrowWriter):
    """A file a task, with its index, moved into place when all tasks are done."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.names = options["path"].rstrip("/"), schema.names
        self.step, self.block = int(options.get("step", STEP)), int(options.get("block", BLOCK))
        self.refs = [(n, int(k)) for n, _, k in (x.rpartition(":") for x in options["refs"].split(","))]
        self.held = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        where, name = located(self.path)
        if where.get_file_info(name).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bam"
        path, ranks = f"{self.held}/{name}", {n: i for i, (n, _) in enumerate(self.refs)} | {"*": -1}
        where, local = located(self.held)
        where.create_dir(local, recursive=True)
        where, local = located(path)
        out, made, some = Output(where.open_output_stream(local, compression=None), self.block), Checkpoints(self.step), False
        text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.refs)
        out.write(b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.refs)))
        for n, k in self.refs:
            out.write(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k))
        for batch in iterator:
            if not batch.num_rows:
                continue
            some, e, i = True, Encoded(batch, ranks), 0
            while i < batch.num_rows:
                # Records that the block has room for; one begins in a block of its own rather than across two.
                until = max(int(np.searchsorted(e.end, e.at[i] + self.block - len(out.held), "right")), i)
                if until == i and out.held:
                    out.flush(len(out.held))
                    continue
                until = max(until, i + 1)
                made.add_run(out.tell(), e.ref[i:until], e.pos[i:until], e.reach[i:until])
                out.write(e.raw[e.at[i] : e.end[until - 1]].tobytes())
                i = until
        out.close()
        made.save(path)
        return Written([name] if some else [])

    def commit(self, messages: list) -> None:
        where, base = located(self.path)
        held = located(self.held)[1]
        where.create_dir(base, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                for end in (INDEX, ""):
                    where.move(f"{held}/{name}{end}", f"{base}/{name}{end}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, held = located(self.held)
        if where.get_file_info(held).type != pafs.FileType.NotFound:
            where.delete_dir(held)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, schema, overwrite)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def bam(spark: SparkSession, path: str, columns: list[str] | None = None, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Records of a BAM file, or of the files of a folder, in SCHEMA; `columns` are all that is taken from a record.

    region: chrom, chrom:start or chrom:start-end, reads that touch it, under either name of the chromosome. Filters on
    rname and pos narrow what is opened. Files without an index, or not sorted, are read by one task each.
    """
    _register(spark)
    fields = {x.split()[0]: x for x in SCHEMA.split(", ")}
    reader = spark.read.format("bam").schema(", ".join(fields[c] for c in columns or fields)).option("split", split)
    return (reader.option("region", region) if region else reader).load(path)


def write_bam(reads: DataFrame, path: str, refs: list[tuple[str, int]], step: int = STEP, block: int = BLOCK) -> None:
    """reads as BAM files with indexes, sorted by the dictionary `refs` and place; they appear together or not at all."""
    from pyspark.sql import functions as F

    _register(reads.sparkSession)
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, (n, _) in enumerate(refs) for x in (n, i)])[F.col("rname")], F.lit(len(refs)))
    kept = [x.split()[0] for x in SCHEMA.split(", ") if x.split()[0] in reads.columns]
    # Ranges are found from places alone, so nothing else of a read is made twice.
    place = rank.cast("long") * (1 << 32) + F.coalesce(F.col("pos"), F.lit(0))
    spread = dealing.by_ranges(reads.withColumn("__place", place), F.col("__place"), dealing.bounds(reads, place))
    dealt = spread.sortWithinPartitions("__place").select(kept)
    dealt.write.format("bam").option("refs", ",".join(f"{n}:{k}" for n, k in refs)).option("step", step).option("block", block).mode("append").save(path)
