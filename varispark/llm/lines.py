"""Line dedup over a corpus by a segment-partition edit join.

Two lines are near copies at edit distance (in code points) MAX_DISTANCE or less. Every line of n code points is
split into MAX_DISTANCE + 1 even segments. If a longer or equally long line is within the distance, it holds one of
the segments unchanged, near the same place; which places need a look follows from the difference in length and from
the edits that the other segments leave over. So each line is indexed under (length, segment number, segment) and
probes, for each length up to MAX_DISTANCE below its own, the substrings at those places. Lines that meet are verified
with a banded bit-parallel edit distance. Equal lines are one line throughout; what tells lines apart where
lines are removed is 128 bits of hash, and links are verified on the lines themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hash_map, in_hash_map, read, written
from .textarrays import mix

MAX_DISTANCE = 2
#: Shorter lines are compared for equality only: two edits there make other words.
MIN_CHARS = 20
#: Lines under one key up to which each pair is a candidate; more are compared in blocks of BLOCK lines.
PAIR_LIMIT = 16
BLOCK = 512
#: Entries of segment keys that a task holds before it passes them on.
HELD = 1_500_000
#: Bytes of entries that meet in a task, about, whatever the session's number of shuffle partitions.
MEETING = 16 << 20
#: Occurrences of lines that a task hands on at a time.
OCCURRENCES = 1 << 16
_ENTRY = np.dtype([("low", "<u4"), ("top", "u1"), ("line", "<i8")])  # 38 bits of key, 2 of role; line hash


def edit_within(a: str, b: str, k: int) -> bool:
    """Whether a and b are within k insertions, deletions and substitutions.

    Bit-parallel over a band of 2k + 1 diagonals: the vectors hold vertical differences of one column, in rows from
    k above the diagonal to k below it.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    if a == b:
        return True
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    m, n = len(a), len(b)
    if m <= k:
        return True
    if not n:
        return False
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * k + 1)) - 1
    plus, minus, dist = full >> k << k, 0, k
    for j in range(1, n + 1):
        at = places.get(b[j - 1], 0)
        x = (at >> (j - k - 1) if j > k else at << (k + 1 - j)) & full
        diag = ((((x & plus) + plus) ^ plus) | x | minus) & full
        up, down = (minus | ~(diag | plus)) & full, diag & plus
        if j <= m - k:
            dist += not diag >> 2 * k & 1
        else:
            t = m - j + k
            dist += (up >> t & 1) - (down >> t & 1)
        plus, minus = (down | ~(diag >> 1 | up)) & full, diag >> 1 & up
    return dist <= k


def segments(n: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of segment i, from 0, of lines of n characters split into k + 1; longer ones come last."""
    short, extra = n // (k + 1), n % (k + 1)
    longer = np.maximum(0, i - (k + 1 - extra))
    return i * short + longer, short + (i >= k + 1 - extra)


def probes(k: int) -> list[tuple[int, int, int, int]]:
    """(difference in length, segment, shift, role) of what a line looks up; role 1 is its own index entry, 2 a probe.

    A match at segment i leaves i edits to its left and k - i to its right at most, if it is to be the first or the
    last of the unchanged ones; the shifts allowed from either end are cut with each other.
    """
    out = []
    for d in range(k + 1):
        for i in range(k + 1):
            for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                out.append((d, i, shift, 3 if d == 0 and shift == 0 else 2))
    return out


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        return cls.up, cls.down


def segment_entries(lines: list[str], k: int, least: int) -> np.ndarray:
    """Index and probe entries (key of 64 bits, role, line hash) of distinct lines of `least` characters or more."""
    lines = [x for x in lines if len(x) >= least]
    if not lines:
        return np.zeros(0, [("key", "u8"), ("role", "u1"), ("line", "i8")])
    n = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(n) - n
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = Powers.of(len(codes) + 1)
    value = mix(codes + np.uint64(1)) * up[: len(codes)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    names = line_hashes(lines)[:, 0]
    out = []
    for d, i, shift, role in probes(k):
        length = n - d
        at, size = segments(length, i, k)
        at = at + shift
        fine = (length >= least) & (at >= 0) & (at + size <= n) & (size > 0)
        a = (start + at)[fine]
        h = (total[a + size[fine]] - total[a]) * down[a]
        part = np.zeros(len(a), [("key", "u8"), ("role", "u1"), ("line", "i8")])
        part["key"] = mix(h + mix(length[fine].astype(np.uint64) * np.uint64(16) + np.uint64(i)))
        part["role"], part["line"] = role, names[fine]
        out.append(part)
    return np.concatenate(out)


def line_hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each line as two columns of signed longs: the name that joins use, and what tells lines that share it."""
    raw = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
    return np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)


def text_lines(text: bytes) -> list[str]:
    return text.decode("utf-8", "surrogatepass").split("\n")


def distinct_lines(texts: pa.Array, most: int) -> Iterator[set[str]]:
    """The different lines of runs of texts of about `most` bytes; a text's lines are made when its turn comes."""
    lines: set[str] = set()
    size = 0
    for x in texts:
        text = x.as_py() or b""
        lines.update(text_lines(text))
        size += len(text)
        if size > most:
            yield lines
            lines, size = set(), 0
    yield lines


def has_word(line: str) -> bool:
    return bool(line) and bool(line.strip(" \t\n\r\x0b\x0c"))


def meetings(session: int, n_lines: int, k: int) -> int:
    """Tasks that entries of so many lines are dealt to: as many as the session has, or more where they would hold more than MEETING bytes."""
    return max(session, -(-n_lines * len(probes(k)) * _ENTRY.itemsize // MEETING))


def candidates(docs: DataFrame, k: int = MAX_DISTANCE, least: int = MIN_CHARS, n_lines: int = 0) -> DataFrame:
    """(g, u, v): hashes of lines that share a segment where the join looks for it; `least` is k + 1 or more, so that
    no segment is empty. n_lines: how many lines docs have at most, if that is known; tasks are made small by it.

    Where g is null, u > v are two different lines to be verified. Where many lines share a key, their pairs would
    grow with the square: there g is the key, and u is one of its lines.

    Entries travel packed in rows of one bucket each, so the shuffle moves few large rows; a bucket has the entries
    of many keys, and equal entries of one task travel once.
    """
    if least <= k:
        raise ValueError(f"lines of {least} characters can't be split into {k + 1} segments")
    n = meetings(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_lines, k)
    buckets = 16 * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            e = np.unique(np.concatenate(held))
            place = ((e["key"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            packed = np.zeros(len(e), _ENTRY)
            packed["low"], packed["line"] = e["key"] & np.uint64(0xFFFFFFFF), e["line"]
            packed["top"] = (e["key"] >> np.uint64(32)).astype(np.uint8) & 0xFC | e["role"]
            order = np.argsort(place, kind="stable")
            place, packed = place[order], packed[order]
            cuts = np.flatnonzero(np.diff(place)) + 1
            held.clear()
            return pa.record_batch({"bucket": pa.array(place[np.concatenate(([0], cuts))]), "entries": pa.array([x.tobytes() for x in np.split(packed, cuts)], pa.binary())})

        for b in batches:
            for lines in distinct_lines(b.column(0), 1 << 20):
                held.append(segment_entries(list(lines), k, least))
                size += len(held[-1])
                if size > HELD:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, places = [], []
        for b in batches:
            for place, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.append(np.frombuffer(x, _ENTRY))
                places.append(place)
        if not parts:
            return
        e = np.concatenate(parts)
        place = np.repeat(np.array(places, np.uint64), [len(x) for x in parts])
        key = e["low"].astype(np.uint64) | (e["top"] & 0xFC).astype(np.uint64) << np.uint64(32)
        key |= (place & np.uint64(0xFFFFFF)) << np.uint64(40)
        order = np.lexsort((e["line"], key))
        key, line, role = key[order], e["line"][order], (e["top"] & 3)[order]
        del e, place, order, parts
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        several = np.concatenate(([False], (key[1:] == key[:-1]) & (line[1:] != line[:-1])))
        some = np.maximum.reduceat(several, first)
        rows: list[np.ndarray] = []
        held = 0
        for a, n_rows in zip(first[some].tolist(), size[some].tolist(), strict=True):
            own, r = line[a : a + n_rows], role[a : a + n_rows]
            every = np.unique(own)
            if len(every) > PAIR_LIMIT:
                if (r & 1).any() and (r & 2).any():
                    rows.append(np.stack((np.full(len(every), key[a].astype(np.int64)), every, every), 1))
            else:
                x, y = np.meshgrid(np.unique(own[r & 1 > 0]), np.unique(own[r & 2 > 0]))
                pair = np.stack((np.zeros(x.size, np.int64), np.maximum(x, y).ravel(), np.minimum(x, y).ravel()), 1)
                rows.append(pair[pair[:, 1] != pair[:, 2]])
            held += len(rows[-1]) if rows else 0
            if held > 1 << 17:
                yield found(rows)
                rows, held = [], 0
        if rows:
            yield found(rows)

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        p = np.unique(np.concatenate(rows), axis=0)
        alone = p[:, 1] != p[:, 2]
        return pa.record_batch({"g": pa.array(p[:, 0], pa.int64(), mask=alone), "u": pa.array(p[:, 1]), "v": pa.array(p[:, 2])})

    entries = docs.select(F.col("text").cast("binary")).mapInArrow(run, "bucket int, entries binary")
    return entries.repartition(n, "bucket").mapInArrow(meet, "g long, u long, v long").distinct()


def sketch(lines: list[str]) -> np.ndarray:
    """How often each code point, mod 32, occurs in each line: an edit changes two counts by one at most."""
    n = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) % 32
    return np.bincount(np.repeat(np.arange(len(lines)), n) * 32 + codes, minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def block_links(members: DataFrame, k: int) -> DataFrame:
    """(u, v) within k edits among the members (g, h, line) of each key g.

    Lines are dealt into blocks; a task compares two blocks, first by character counts, then by distance. What it
    writes is links alone, and what travels is each line once for each block of its key.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nb"))
    rows = members.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "h", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)

        for (_, x, y), group in groupby(every(), key=lambda r: r[:3]):
            block, names, lines = zip(*[r[3:] for r in group], strict=True)
            counts, size = sketch(list(lines)), np.array([len(t) for t in lines])
            apart, u, v = np.array(block), [], []
            for i in range(len(lines) - 1):
                near = np.abs(size[i + 1 :] - size[i]) <= k
                if x != y:
                    near &= apart[i + 1 :] != apart[i]
                at = np.flatnonzero(near) + i + 1
                at = at[np.abs(counts[at] - counts[i]).sum(1) <= 2 * k]
                for j in at.tolist():
                    if names[i] != names[j] and edit_within(lines[i], lines[j], k):
                        u.append(max(names[i], names[j]))
                        v.append(min(names[i], names[j]))
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.repartition(n, "g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(run, "u long, v long")


def line_links(docs: DataFrame, k: int = MAX_DISTANCE, least: int = MIN_CHARS) -> DataFrame:
    """(u, v): hashes, u > v, of all pairs of different lines of `least` characters or more within k edits."""
    return verified(docs, k, least)[0]


def verified(docs: DataFrame, k: int, least: int, n_lines: int = 0) -> tuple[DataFrame, DataFrame]:
    """line_links, and (h, other, line) of the lines that they were verified with."""
    spark = docs.sparkSession
    found = written(candidates(docs, k, least, n_lines), "line-pairs")
    marks = spark.sparkContext.broadcast(hash_map(found.select(F.explode(F.array("u", "v")).alias("h"))))
    pairs = found.where("g is null").select("u", "v")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for every in distinct_lines(b.column(0), 4 << 20):
                lines = [y for y in every if len(y) >= least]
                h = line_hashes(lines)
                at = np.flatnonzero(in_hash_map(marks.value, h[:, 0].copy()))
                yield pa.record_batch({"h": pa.array(h[at, 0]), "other": pa.array(h[at, 1]), "line": pa.array([lines[i] for i in at.tolist()], pa.string())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [edit_within(x, y, k) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch({"u": b.column(0), "v": b.column(1)}).filter(pa.array(near, pa.bool_()))

    texts = written(docs.select(F.col("text").cast("binary")).mapInArrow(pick, "h long, other long, line string").groupBy("h").agg(F.min("other").alias("other"), F.min_by("line", "other").alias("line")), "lines")
    one = pairs.join(texts.select(F.col("h").alias("u"), F.col("line").alias("a")), "u")
    both = one.join(texts.select(F.col("h").alias("v"), F.col("line").alias("b")), "v").select("u", "v", "a", "b")
    crowds = found.where("g is not null").select("g", F.col("u").alias("h")).join(texts.select("h", "line"), "h")
    return both.mapInArrow(verify, "u long, v long").union(block_links(crowds, k)).distinct(), texts


def line_classes(docs: DataFrame, k: int = MAX_DISTANCE, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, line_no, first_doc, first_key, first_line, n_links, removed) of lines that occur or nearly occur again.

    row_key hashes doc_id and text. The first occurrence of a class, in order of (doc_id, row_key, line_no), stays.
    n_links counts the different lines within the distance of this one. Lines are equal if 128 bits of hash are: of
    lines that share the 64 bits by which links are named, one has them, and the others are classes of their own.
    """

    def occurrences(rows: list[tuple[int | None, int, int, str]]) -> pa.RecordBatch:
        doc, key, no, own = zip(*rows, strict=True) if rows else ((), (), (), ())
        h = line_hashes(list(own))
        return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "row_key": pa.array(key, pa.int64()), "line_no": pa.array(no, pa.int32()), "h": pa.array(h[:, 0]), "other": pa.array(h[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int | None, int, int, str]] = []
            for name, key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [(name, key, i, y) for i, y in enumerate(text_lines(x.as_py() or b"")) if has_word(y)]
                if len(rows) > OCCURRENCES:
                    yield occurrences(rows)
                    rows = []
            yield occurrences(rows)

    rows = docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("binary"))
    occ = written(rows.mapInArrow(run, "doc_id long, row_key long, line_no int, h long, other long"), "occurrences")
    links, texts = verified(docs, k, least, occ.count())
    links = written(links, "line-links")
    place = F.struct("doc_id", "row_key", "line_no")
    lines = occ.groupBy("h", "other").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    degree = links.select(F.explode(F.array("u", "v")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    named = components(links).withColumnRenamed("node", "h").join(degree, "h", "left").join(texts.select("h", "other"), "h")
    lines = lines.join(named, ["h", "other"], "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    label = F.when(F.col("component").isNull(), F.struct(F.col("h").alias("a"), F.col("other").alias("b"))).otherwise(F.struct(F.col("component").alias("a"), F.lit(None).cast("long").alias("b")))
    lines = written(lines.select("h", "other", "first", label.alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "line-classes")
    firsts = lines.groupBy("class").agg(F.min("first").alias("keeper"))
    known = lines.join(firsts, lines["class"].eqNullSafe(firsts["class"])).select("h", "other", "keeper", "n_links")
    found = occ.join(known, ["h", "other"])
    gone = ~place.eqNullSafe(F.col("keeper"))
    return found.select("doc_id", "row_key", "line_no", F.col("keeper.doc_id").alias("first_doc"), F.col("keeper.row_key").alias("first_key"), F.col("keeper.line_no").alias("first_line"), "n_links", gone.alias("removed")).distinct()


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key")


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers: one pass over each, however many lines it has."""
    out = []
    for x, numbers in zip(text, gone, strict=True):
        if x is not None and numbers is not None and len(numbers):
            drop = set(np.asarray(numbers).tolist())
            x = "\n".join([y for i, y in enumerate(x.split("\n")) if i not in drop])
        out.append(x)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, k: int = MAX_DISTANCE, least: int = MIN_CHARS) -> DataFrame:
    """docs with lines left out that equal or nearly equal an earlier line of the corpus; columns as given.

    Added (or replaced): `line_dups`, an array of (line_no, first_doc, first_line, n_links, removed) for the lines of
    classes with several occurrences, or null. Links are k edits or less, and links close into classes. Blank lines
    stay; null and empty texts stay as they are; rows equal in doc_id and text get the same result; a text all of
    whose lines are copies becomes empty or blank and its row stays. An empty table gives no row. Rows meet their
    marks by doc_id and a hash of the text, so only texts under one doc_id could be taken for each other. Time and
    memory grow in proportion to a text's lines: a text with n copied lines has n marks of some 50 bytes in its row.
    """
    own = F.struct("line_no", "first_doc", "first_line", "n_links", "removed")
    marks = line_classes(docs, k, least).groupBy(F.col("row_key").alias("__row_key"), F.col("doc_id").alias("__doc_id")).agg(F.array_sort(F.collect_list(own)).alias("__dups"))
    same = (F.col("__key") == F.col("__row_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    out = docs.withColumn("__key", row_key()).join(marks, same, "left")
    gone = F.transform(F.filter("__dups", lambda x: x["removed"]), lambda x: x["line_no"])
    some = F.coalesce(F.exists("__dups", lambda x: x["removed"]), F.lit(False))
    text = F.when(some, F.pandas_udf(_without, "string")(F.when(some, F.col("text")), F.when(some, gone))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("line_dups", F.col("__dups")).drop("__row_key", "__key", "__doc_id", "__dups")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text", F.col("text").alias("whole")))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.size(F.filter(F.split(F.coalesce("whole", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n_removed = F.size(F.filter(F.coalesce("line_dups", F.array()), lambda x: x["removed"]))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.crc32(text.cast("binary")).alias("text_crc32"), "line_dups")
