"""Binary sources: 2-bit and nib genomes, dbSNP blobs, binary matrices, BAM, SCF traces.

Files come through Spark's binaryFile reader, one row a file (2 GB at most: larger ones are kept split, as by
chromosome), and small decoders turn each into rows inside its task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def decoded(spark: SparkSession, path: str, decode: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    fields = [x.strip().split()[0] for x in _split(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows: list[tuple] = []
                for r in decode(name, bytes(content)):
                    rows.append(r)
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=fields)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=fields)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def _unpack_2bit(raw: bytes, n: int) -> np.ndarray:
    codes = (np.frombuffer(raw, np.uint8)[:, None] >> np.array([6, 4, 2, 0])) & 3
    return np.frombuffer(b"TCAG", np.uint8)[codes.reshape(-1)[:n]].copy()


def decode_2bit(name: str, data: bytes, chunk: int = 4096) -> Iterator[tuple]:
    """(chrom, chunk_start, bases): N blocks and lower-case mask blocks applied."""
    end = next((e for e in "<>" if struct.unpack(e + "I", data[:4])[0] == 0x1A412743), None)
    if end is None:
        raise ValueError(f"{name} is no 2-bit file")
    u32 = lambda at, n=1: struct.unpack(f"{end}{n}I", data[at : at + 4 * n])
    at = 16
    for _ in range(u32(8)[0]):
        size = data[at]
        chrom, (off,) = data[at + 1 : at + 1 + size].decode(), u32(at + 1 + size)
        at += 5 + size
        (n,) = u32(off)
        off += 4
        blocks = []
        for _kind in "nm":
            (k,) = u32(off)
            blocks.append(list(zip(u32(off + 4, k), u32(off + 4 + 4 * k, k), strict=True)))
            off += 4 + 8 * k
        bases = _unpack_2bit(data[off + 4 : off + 4 + -(-n // 4)], n)
        for s, k in blocks[0]:
            bases[s : s + k] = ord("N")
        for s, k in blocks[1]:
            bases[s : s + k] |= 0x20
        for s in range(0, n, chunk):
            yield chrom, s + 1, bases[s : s + chunk].tobytes().decode()


def encode_2bit(sequences: dict[str, str]) -> bytes:
    """A little-endian 2-bit file: what decode_2bit() reads."""
    index, body, at = b"", b"", 16 + sum(5 + len(n) for n in sequences)
    for name, s in sequences.items():
        index += bytes([len(name)]) + name.encode() + struct.pack("<I", at + len(body))
        arr = np.frombuffer(s.encode(), np.uint8)
        runs = []
        for hit in (np.char.upper(arr.view("S1")) == b"N", arr >= 97):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            runs.append((edge[::2], edge[1::2] - edge[::2]))
        body += struct.pack("<I", len(s))
        for starts, sizes in runs:
            body += struct.pack("<I", len(starts)) + starts.astype("<u4").tobytes() + sizes.astype("<u4").tobytes()
        code = np.zeros(256, np.uint8)
        for k, c in enumerate("TCAG"):
            code[[ord(c), ord(c.lower())]] = k
        four = np.zeros(-(-len(s) // 4) * 4, np.uint8)
        four[: len(s)] = code[arr]
        body += struct.pack("<I", 0) + (four.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    return struct.pack("<IIII", 0x1A412743, 0, len(sequences), 0) + index + body


def decode_nib(name: str, data: bytes, chunk: int = 4096) -> Iterator[tuple]:
    """(chrom, chunk_start, bases) of a .nib file: two bases a byte, high half first, bit 8 for lower case."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != 0x6BE93D3A:
        raise ValueError(f"{name} is no nib file")
    n = max(n, 2 * (len(data) - 8)) if n < 2 * (len(data) - 8) - 1 else n
    half = np.stack([np.frombuffer(data[8:], np.uint8) >> 4, np.frombuffer(data[8:], np.uint8) & 15], 1).reshape(-1)[:n]
    bases = np.frombuffer(b"TCAGNNNN", np.uint8)[half & 7] | np.where(half & 8, 0x20, 0).astype(np.uint8)
    chrom = name.rpartition("/")[2].removesuffix(".nib")
    for s in range(0, n, chunk):
        yield chrom, s + 1, bases[s : s + chunk].tobytes().decode()


def decode_matrix(name: str, data: bytes) -> Iterator[tuple]:
    """(sample, col, value) of binary blocks (type, length, payload): 3 a sample's name, 4 its bytes, 5 its runs."""
    at, sample = 0, ""
    while at < len(data):
        kind, n = struct.unpack(">ii", data[at : at + 8])
        body, at = data[at + 8 : at + 8 + n], at + 8 + n
        if kind == 3:
            sample = body.decode()
        elif kind in (4, 5):
            v = np.frombuffer(body, np.int8)
            if kind == 5:
                v = np.repeat(v[::2], v[1::2].view(np.uint8))
            for i, x in enumerate(v.tolist()):
                yield sample, i, None if x == -99 else x


def decode_dbsnp(name: str, data: bytes) -> Iterator[tuple]:
    """(chrom, pos, rs, mask) of a blob: magic, then for each chromosome its name, count and records, places from 0."""
    if data[:4] != b"CdDF":
        raise ValueError(f"{name} is no dbSNP blob")
    at = 8
    while at < len(data):
        size = data[at]
        chrom, (n,) = data[at + 1 : at + 1 + size].decode(), struct.unpack(">i", data[at + 1 + size : at + 5 + size])
        at += 5 + size
        for rs, start, mask in struct.iter_unpack(">iib", data[at : at + 9 * n]):
            yield chrom, start + 1, rs, mask
        at += 9 * n


def bgzf(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        yield d.decompress(data[at:])
        at = len(data) - len(d.unused_data)


def decode_bam(name: str, data: bytes) -> Iterator[tuple]:
    """(qname, flag, rname, pos, mapq, cigar, pnext, seq, qual) of a BAM file's records; pos from 1."""
    raw = b"".join(bgzf(data))
    if raw[:4] != b"BAM\1":
        raise ValueError(f"{name} is no BAM file")
    i32 = lambda at: struct.unpack("<i", raw[at : at + 4])[0]
    at = 8 + i32(4)
    refs, n, at = [], i32(at), at + 4
    for _ in range(n):
        k = i32(at)
        refs.append(raw[at + 4 : at + 3 + k].decode())
        at += 8 + k
    while at < len(raw):
        size = i32(at)
        ref, pos, k, mapq, _, ops, flag, n, _, pnext, _ = struct.unpack("<iiBBHHHiiii", raw[at + 4 : at + 36])
        p = at + 36
        qname = raw[p : p + k - 1].decode()
        p += k
        cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack(f"<{ops}I", raw[p : p + 4 * ops]))
        p += 4 * ops
        half = np.frombuffer(raw[p : p + (n + 1) // 2], np.uint8)
        seq = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)[np.stack([half >> 4, half & 15], 1).reshape(-1)[:n]].tobytes().decode()
        p += (n + 1) // 2
        yield qname, flag, refs[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or None, pnext + 1, seq, list(raw[p : p + n])
        at += 4 + size


BAM_SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, pnext int, seq string, qual array<int>"


def encode_bam(refs: list[tuple[str, int]], rows: list[tuple]) -> bytes:
    """One BGZF block of records (qname, flag, ref index, pos, mapq, [(n, op)], seq, qual): what decode_bam() reads."""
    out = b"BAM\1" + struct.pack("<ii", 0, len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
    for qname, flag, ref, pos, mapq, ops, seq, qual in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual)
        out += struct.pack("<i", len(body)) + body
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(out) + z.flush()


def decode_scf(name: str, data: bytes) -> Iterator[tuple]:
    """(name, a, c, g, t, bases, places) of an SCF 3 trace with 16-bit samples stored as second differences."""
    if data[:4] != b".scf":
        raise ValueError(f"{name} is no SCF file")
    n, off, k, _, _, boff = struct.unpack(">IIIIII", data[4:28])
    channels = []
    for c in range(4):
        d = np.frombuffer(data[off + 2 * n * c : off + 2 * n * (c + 1)], ">u2").astype(np.uint16)
        channels.append(np.cumsum(np.cumsum(d, dtype=np.uint16), dtype=np.uint16).astype(int).tolist())
    places = np.frombuffer(data[boff : boff + 4 * k], ">u4").astype(int).tolist()
    yield name.rpartition("/")[2], *channels, data[boff + 8 * k : boff + 9 * k].decode(), places


SCF_SCHEMA = "name string, a array<int>, c array<int>, g array<int>, t array<int>, bases string, places array<int>"


def encode_scf(channels: list[list[int]], bases: str, places: list[int]) -> bytes:
    """An SCF 3 file: what decode_scf() reads."""
    n, k = len(channels[0]), len(bases)
    body = b"".join(np.diff(np.diff(np.array(c, np.uint16), prepend=np.uint16(0)), prepend=np.uint16(0)).astype(">u2").tobytes() for c in channels)
    calls = np.array(places, ">u4").tobytes() + bytes(4 * k) + bases.encode() + bytes(3 * k)
    head = b".scf" + struct.pack(">IIIIII", n, 128, k, 0, 0, 128 + len(body)) + struct.pack(">II", 0, 0) + b"3.00" + struct.pack(">I", 2)
    return head.ljust(128, b"\0") + body + calls


#: Types of directory entries that are read here, by their number in the format: bytes and characters, 16 and 32 bits.
_ABI_FORMS = {1: "B", 2: "B", 4: ">h", 5: ">i"}


def decode_abi(name: str, data: bytes) -> Iterator[tuple]:
    """(name, a, c, g, t, bases, places) of an ABI trace: a directory of tagged records, small ones within their entry.

    Channels are the processed traces DATA 9 to 12 in the order that FWO_ tells; calls and places are the edited ones
    (PBAS and PLOC 1) where the file has them, else those of the base caller (2). The directory may lie behind 128
    bytes of a foreign header.
    """
    lead = 0 if data[:4] == b"ABIF" else 128 if data[128:132] == b"ABIF" else None
    if lead is None:
        raise ValueError(f"{name} is no ABI file")
    body = data[lead:]
    _, _, _, _, n, _, at, _ = struct.unpack(">4siHHiiii", body[6:34])
    held = {}
    for k in range(n):
        entry = body[at + 28 * k : at + 28 * k + 28]
        tag, number, kind, _, count, size, place, _ = struct.unpack(">4siHHiiii", entry)
        held[tag.decode("latin-1"), number] = (kind, count, entry[20 : 20 + size] if size <= 4 else body[place : place + size])

    def numbers(tag: str, number: int) -> list[int]:
        kind, count, raw = held[tag, number]
        form = _ABI_FORMS[kind]
        return np.frombuffer(raw, form, count).astype(int).tolist()

    order = held["FWO_", 1][2].decode("latin-1")
    channels = {letter: numbers("DATA", 9 + k) for k, letter in enumerate(order)}
    edition = 1 if ("PBAS", 1) in held and ("PLOC", 1) in held else 2
    bases = held["PBAS", edition][2].decode("latin-1").rstrip("\0")
    yield name.rpartition("/")[2], *(channels[x] for x in "ACGT"), bases, numbers("PLOC", edition)


def encode_abi(channels: list[list[int]], bases: str, places: list[int], order: str = "GATC") -> bytes:
    """An ABI file with channels in A, C, G, T order: what decode_abi() reads."""
    entries, body, begin = [], b"", 128
    own = [(b"DATA", 9 + k, 4, 2, np.array(channels["ACGT".index(x)], ">i2").tobytes()) for k, x in enumerate(order)]
    own += [(b"FWO_", 1, 2, 1, order.encode()), (b"PBAS", 1, 2, 1, bases.encode()), (b"PLOC", 1, 4, 2, np.array(places, ">i2").tobytes())]
    for tag, number, kind, width, raw in own:
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">i", begin + len(body))
        entries.append(struct.pack(">4siHHii", tag, number, kind, width, len(raw) // width, len(raw)) + place + bytes(4))
        body += raw if len(raw) > 4 else b""
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4siHHiiii", b"tdir", 1, 1023, 28, len(entries), 28 * len(entries), begin + len(body), 0)
    return head.ljust(begin, b"\0") + body + b"".join(entries)


def abi(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_abi, SCF_SCHEMA)


def genome_2bit(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_2bit, "chrom string, chunk_start int, bases string")


def genome_nib(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_nib, "chrom string, chunk_start int, bases string")


def dbsnp_blob(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_dbsnp, "chrom string, pos int, rs int, mask tinyint")


def matrix_binary(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_matrix, "sample string, col int, value tinyint")


def bam(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_bam, BAM_SCHEMA)


def scf(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, decode_scf, SCF_SCHEMA)
