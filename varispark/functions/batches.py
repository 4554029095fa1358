"""Reads in Arrow batches: CIGAR strings, sequences and qualities of many reads laid out at once with numpy.

A batch of reads becomes flat arrays with a cell for each base, beside the row that it belongs to; nothing here is done row by
row, and a CIGAR string that many reads of a batch share is parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ON_READ, _ON_REFERENCE, _ALIGNED = (np.frombuffer(x, np.uint8) for x in (b"M=XIS", b"M=XDN", b"M=X"))


class Operations:
    """Operations of all CIGAR strings of a batch: row, op (its letter's byte), size, and where each begins in read and reference.

    Reads without a place have none.
    """

    def __init__(self, cigars: pa.Array, pos: pa.Array):
        coded = cigars.dictionary_encode()
        parts = [re.findall(r"(\d+)([MIDNSHP=X])", x) for x in coded.dictionary.to_pylist()] + [[]]
        n = np.array([len(p) for p in parts])
        code = np.asarray(coded.indices.fill_null(len(parts) - 1), np.int64)
        code = np.where(np.asarray(pc.is_null(pos)), len(parts) - 1, code)
        begin, own = np.cumsum(n) - n, n[code]
        self.row = np.repeat(np.arange(len(code)), own)
        at = np.arange(len(self.row)) + np.repeat(begin[code] - (np.cumsum(own) - own), own)
        self.op = np.array([ord(o) for p in parts for _, o in p], np.uint8)[at]
        self.size = np.array([int(k) for p in parts for k, _ in p], np.int64)[at]
        place = np.asarray(pos.fill_null(0), np.int64)
        self.on_ref = np.isin(self.op, _ON_REFERENCE)
        self.aligned = np.isin(self.op, _ALIGNED)
        self.read = self._before(np.isin(self.op, _ON_READ))
        self.ref = self._before(self.on_ref) + place[self.row]
        self.rows = len(code)

    def _before(self, counted: np.ndarray) -> np.ndarray:
        """Sizes of the row's earlier operations that count."""
        own = np.where(counted, self.size, 0)
        before = np.cumsum(own) - own
        return before - before[np.searchsorted(self.row, self.row)] if len(own) else before

    def units(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(operation, i from 0) for each place of the chosen operations."""
        k = np.flatnonzero(chosen)
        n = self.size[k]
        return np.repeat(k, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Texts:
    """Bytes of a column of texts, in upper case by default, by row and place; 0 beyond a text's end."""

    def __init__(self, texts: pa.Array, upper: bool = True):
        t = (pc.ascii_upper(texts) if upper else texts).fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        at = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8)
        self.data = np.frombuffer(t.buffers()[2] or b"", np.uint8)
        self.at, self.size = at[:-1], np.diff(at)

    def get(self, row: np.ndarray, i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < self.size[row])
        return np.where(inside, self.data[np.where(inside, self.at[row] + i, 0)], 0).astype(np.uint8) if len(self.data) else np.zeros(len(row), np.uint8)


class Numbers:
    """Whole numbers of a column of lists by row and place; -1 beyond a list's end and for nulls."""

    def __init__(self, lists: pa.Array):
        self.size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.asarray(lists.flatten().fill_null(-1))

    def get(self, row: np.ndarray, i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < self.size[row])
        return np.where(inside, self.data[np.where(inside, self.at[row] + i, 0)], -1).astype(np.int32) if len(self.data) else np.full(len(row), -1, np.int32)


def letters(codes: np.ndarray) -> pa.Array:
    """Texts of one letter each, null for 0."""
    n = len(codes)
    valid = None if codes.all() else pa.py_buffer(np.packbits(codes != 0, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes)), valid)


def numbers(x: np.ndarray) -> pa.Array:
    """int32, null below 0."""
    return pa.array(x.astype(np.int32), mask=x < 0)


def listed(row: np.ndarray, rows: int, **fields: pa.Array) -> pa.Array:
    """A list of structs for each row, from cells in order of their rows."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def aligned_cells(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
    """pos_at, read_i, base and q of each aligned base of each read."""
    o = Operations(cigars, pos)
    k, i = o.units(o.aligned)
    row, read_i = o.row[k], o.read[k] + i
    return listed(row, o.rows, pos_at=pa.array((o.ref[k] + i).astype(np.int32)), read_i=pa.array(read_i.astype(np.int32)), base=letters(Texts(seq).get(row, read_i)), q=numbers(Numbers(qual).get(row, read_i)))


def differing_cells(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array, start: pa.Array, window: pa.Array) -> pa.Array:
    """pos_at, read_i, base, q and ref where an aligned base differs from a known one of the window that begins at start."""
    o = Operations(cigars, pos)
    k, i = o.units(o.aligned)
    row, read_i, at = o.row[k], o.read[k] + i, o.ref[k] + i
    x, y = Texts(seq).get(row, read_i), Texts(window).get(row, at - np.asarray(start.fill_null(0), np.int64)[row])
    hit = np.flatnonzero((x != y) & (x != 0) & (y != 0) & (y != ord("N")))
    row, read_i = row[hit], read_i[hit]
    return listed(row, o.rows, pos_at=pa.array(at[hit].astype(np.int32)), read_i=pa.array(read_i.astype(np.int32)), base=letters(x[hit]), q=numbers(Numbers(qual).get(row, read_i)), ref=letters(y[hit]))


def _in_gaps(o: Operations) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each operation, whether the read has begun on the reference before it and how many inserted bases stand between the last such
    operation and this one; for each row, the inserted bases before its first position."""
    n = len(o.row)
    first = np.searchsorted(o.row, o.row)
    here = (o.on_ref & (o.size > 0)).astype(np.int64)
    took = np.cumsum(here) - here
    begun = took > took[first] if n else took.astype(bool)
    inserted = o.op == ord("I")
    own = np.where(inserted, o.size, 0)
    total = np.cumsum(own) - own
    opens = np.arange(n) == first
    mark = np.maximum.accumulate(np.where(o.on_ref | opens, total, 0)) if n else total
    before = np.where(opens, 0, total - np.concatenate(([0], mark[:-1]))) if n else total
    lead = np.zeros(o.rows, np.int64)
    np.add.at(lead, o.row[inserted & ~begun], o.size[inserted & ~begun])
    return begun, before, lead


def _placed(o: Operations) -> np.ndarray:
    """Operations on the reference and insertions of rows that have an aligned one."""
    some = np.zeros(o.rows, bool)
    some[o.row[o.aligned]] = True
    return (o.on_ref | (o.op == ord("I"))) & some[o.row]


def _own(o: Operations, k: np.ndarray, i: np.ndarray, seq: pa.Array, qual: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base and quality of places of operations; '*' where deleted, '>' where skipped."""
    row, read_i, gone, skipped = o.row[k], o.read[k] + i, o.op[k] == ord("D"), o.op[k] == ord("N")
    base = np.where(gone, ord("*"), np.where(skipped, ord(">"), Texts(seq, False).get(row, read_i))).astype(np.uint8)
    return base, np.where(gone | skipped, -1, Numbers(qual).get(row, read_i))


def evidence_cells(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
    """What a read has at each reference position of its span: pos, base ('*' deleted, '>' skipped), q, ready and shift.

    ready: inserted bases that stand in front of it in the gap before the position, -1 for a read's first position, before which
    it has nothing. shift: null; for inserted bases, which are rows of the position after them, their place in the gap
    from its start, or below 0 from its end where they stand before the first aligned base.
    """
    o = Operations(cigars, pos)
    begun, before, lead = _in_gaps(o)
    k, i = o.units(_placed(o))
    row, ins = o.row[k], o.op[k] == ord("I")
    base, q = _own(o, k, i, seq, qual)
    ready = np.where(ins | (i > 0), 0, np.where(begun[k], before[k], -1))
    shift = before[k] + i - np.where(begun[k], 0, lead[row])
    at = np.where(ins, o.ref[k], o.ref[k] + i)
    return listed(row, o.rows, pos=pa.array(at.astype(np.int32)), base=letters(base), q=numbers(q), ready=pa.array(ready.astype(np.int32)), shift=pa.array(shift.astype(np.int32), mask=~ins))


def counted_evidence(reads: pa.RecordBatch) -> pa.RecordBatch:
    """evidence_cells() of reads (chrom, pos, cigar, seq, qual) summed: a row for each of its kinds at each place, n cells and their qualities."""
    found = evidence_cells(*[reads.column(c) for c in ("cigar", "pos", "seq", "qual")])
    row, cells = found.value_parent_indices(), found.flatten()
    base = cells.field("base")
    base = pc.if_else(reads.column("seq").is_valid().take(row), pc.fill_null(base, ""), base)
    t = pa.table({"chrom": reads.column("chrom").take(row), "base": base, "q": cells.field("q").cast(pa.int64())} | {c: cells.field(c) for c in ("pos", "ready", "shift")})
    keys = ["chrom", "pos", "base", "ready", "shift"]
    g = t.group_by(keys).aggregate([("q", "count", pc.CountOptions(mode="all")), ("q", "sum")])
    g = g.select([*keys, "q_count", "q_sum"]).rename_columns([*keys, "n", "qualities"])
    return pa.RecordBatch.from_arrays([_whole(c) for c in g.columns], schema=g.schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def padded_cells(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array, gap_pos: pa.Array, gap_len: pa.Array) -> pa.Array:
    """out, the cells (base, q) of each read on the consensus with these gaps, and lead, how many inserted ones stand before the
    first position."""
    o = Operations(cigars, pos)
    n = np.asarray(gap_pos.value_lengths().fill_null(0), np.int64)
    held = np.repeat(np.arange(o.rows), n) << 32 | np.asarray(gap_pos.flatten(), np.int64)
    order = np.argsort(held, kind="stable")
    return _padded(o, seq, qual, held[order], np.asarray(gap_len.flatten(), np.int64)[order], lambda row, at: row << 32 | at)


def padded_cells_among(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array, gap_pos: np.ndarray, gap_len: np.ndarray) -> pa.Array:
    """padded_cells() of reads of one neighbourhood, whose gaps stand in order of place and are the same for all of them."""
    return _padded(Operations(cigars, pos), seq, qual, gap_pos, gap_len, lambda row, at: at)


def _padded(o: Operations, seq: pa.Array, qual: pa.Array, held: np.ndarray, width: np.ndarray, name: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """held: in order, what name(row, place) says of places with a gap in front; width: how wide these are."""
    begun, before, lead = _in_gaps(o)
    k, i = o.units(_placed(o))
    row, ins = o.row[k], o.op[k] == ord("I")
    base, q = _own(o, k, i, seq, qual)
    want = name(row, o.ref[k] + i)
    at = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
    pads = np.where(held[at] == want, width[at], 0) if len(held) else np.zeros(len(k), np.int64)
    pads = np.where(ins | ((i == 0) & ~begun[k]), 0, np.maximum(pads - np.where(i == 0, before[k], 0), 0))
    unit = np.repeat(np.arange(len(k)), pads + 1)
    last = np.zeros(len(unit), bool)
    last[np.cumsum(pads + 1) - 1] = True
    filler = np.where(o.op[k] == ord("N"), ord(">"), ord("*")).astype(np.uint8)
    cells = listed(row[unit], o.rows, base=letters(np.where(last, base[unit], filler[unit])), q=numbers(np.where(last, q[unit], -1)))
    return pa.StructArray.from_arrays([cells, pa.array(lead.astype(np.int32))], ["out", "lead"])


def spread_qualities(bases: pa.Array, qual: pa.Array) -> pa.Array:
    """For each letter of each text the next of the row's qualities, -1 at pads ('*') and null beyond the last; null for null texts."""
    texts, values = [None if x is None else np.array(list(x)) for x in bases.to_pylist()] if not _one_byte(bases) else None, Numbers(qual)
    size = np.asarray(pc.utf8_length(bases).fill_null(0), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    pad = Texts(bases, False).get(row, i) == ord("*") if texts is None else np.concatenate([x == "*" for x in texts if x is not None] or [np.zeros(0, bool)])
    own = np.cumsum(~pad) - ~pad
    first = np.repeat((np.cumsum(size) - size), size)
    at = own - own[np.minimum(first, max(len(own) - 1, 0))] if len(own) else own
    q = values.get(row, at)
    cells = pa.array(np.where(pad, -1, q).astype(np.int32), mask=~pad & (q < 0))
    offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32), mask=np.append(np.asarray(pc.is_null(bases)), False))
    return pa.ListArray.from_arrays(offsets, cells)


def _one_byte(texts: pa.Array) -> bool:
    return pc.all(pc.equal(pc.utf8_length(texts), pc.binary_length(texts)), min_count=0).as_py() is not False


#: What site_groups() makes.
GROUPS = "chrom string, pos int, base string, ref string, tn string, strand string, near boolean, unclipped_start int, alone boolean, named boolean, qname string, n long, decades long, flanked long, mapq_sum long, suspicious long"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


class Sums:
    """Sums by two whole keys over batches, held sorted; given out when there are more than `most` of them."""

    def __init__(self, most: int):
        self.most, self.held, self.waiting = most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, *sums: np.ndarray) -> list[np.ndarray] | None:
        self.held.append([a, b, *sums])
        self.waiting += len(a)
        if self.waiting <= self.most:
            return None
        out = self.take()
        if len(out[0]) * 2 > self.most:
            return out
        self.held, self.waiting = [out], len(out[0])
        return None

    def take(self) -> list[np.ndarray]:
        """Keys and sums, of which none stay."""
        if not self.held:
            return []
        a, b, *sums = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.waiting = [], 0
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        return [a[first], b[first], *[np.add.reduceat(x[order], first) if len(a) else x for x in sums]]


class Codes:
    """Small whole numbers for texts and null, as they come."""

    def __init__(self):
        self.known: dict = {}

    def of(self, texts: pa.Array) -> np.ndarray:
        coded = texts.dictionary_encode()
        own = [self.known.setdefault(x, len(self.known)) for x in [*coded.dictionary.to_pylist(), None]]
        return np.array(own, np.int64)[np.asarray(coded.indices.fill_null(len(own) - 1), np.int64)]

    def texts(self, codes: np.ndarray) -> pa.Array:
        return pa.array(list(self.known), pa.string()).take(pa.array(codes))


def judged_cells(cigars: pa.Array, pos: pa.Array, seq: pa.Array, qual: pa.Array, start: pa.Array, window: pa.Array, cfg) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """(row, read_i, pos, base, ref, q, used, suspicious) of each base over a reference chunk: used, if the read has few mismatches, the base a
    good quality, good company, and isn't a mismatch near a bad end; suspicious, if it is a good mismatch of a read that fails.

    The window has '.' where there is no chunk and N where its bases are unknown.
    """
    o = Operations(cigars, pos)
    k, i = o.units(o.aligned)
    row, read_i, at = o.row[k], o.read[k] + i, o.ref[k] + i
    text = Texts(seq)
    y = Texts(window).get(row, at - np.asarray(start.fill_null(0), np.int64)[row])
    there = np.flatnonzero((y != 0) & (y != ord(".")))
    row, read_i, at, y = row[there], read_i[there], at[there], y[there]
    x, values = text.get(row, read_i), Numbers(qual)
    q = values.get(row, read_i)
    wrong = (x != y) & (y != ord("N")) & (x != 0)
    count = lambda chosen: np.bincount(row[chosen], minlength=o.rows)
    passed = (count(wrong & (q >= cfg.mismatch_lq_quality)) <= cfg.mismatch_max_lq) & (count(wrong & (q >= cfg.mismatch_hq_quality)) <= cfg.mismatch_max_hq)
    good, n = wrong & (q >= cfg.min_quality), text.size[row]
    bad = np.zeros(len(row), bool)
    for size, most in cfg.end_mismatch_windows:
        for own in (good & (read_i < size), good & (read_i >= n - size) & (read_i < n)):
            bad |= own & (count(own) >= most)[row]
    used = passed[row] & (q >= cfg.min_quality) & ~bad & in_good_company(values, row, read_i, cfg.flanking_window, cfg.min_flanking_quality)
    return row, read_i, at, x, y, q, used, wrong & ~passed[row] & (q >= cfg.mismatch_hq_quality)


def in_good_company(values: Numbers, row: np.ndarray, i: np.ndarray, window: int, least: int) -> np.ndarray:
    """Whether all qualities within `window` of a base, itself left out, reach `least`; there are none beyond the ends."""
    low = np.concatenate(([0], np.cumsum(values.data < least)))
    at, n = values.at[row], values.size[row]
    below = lambda a, b: low[at + np.clip(b, 0, n)] - low[at + np.clip(a, 0, n)]
    return below(i - window, i) + below(i + 1, i + 1 + window) == 0


def site_groups(batches: Iterator[pa.RecordBatch], cfg, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows of GROUPS from reads with chunk_start, window, clipped start, strand and alone: observations of reads that are alone summed by site, base,
    sample, strand, closeness to an end and, off the reference, start; others one by one with their name."""
    chroms, samples, sums = Codes(), Codes(), Sums(most)
    schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in GROUPS.split(", "))])
    boolean = lambda x: pa.array(x.astype(bool))

    def made(a: np.ndarray, b: np.ndarray, sample: np.ndarray, start: pa.Array, alone: bool, qname: pa.Array, own: list[pa.Array]) -> pa.RecordBatch:
        flags = b & 0xFF
        columns = [chroms.texts(a >> 32), pa.array((a & 0xFFFFFFFF).astype(np.int32)), letters((b >> 16 & 0xFF).astype(np.uint8)), letters((b >> 8 & 0xFF).astype(np.uint8)), samples.texts(sample), pa.array(np.where(flags & 1, "-", "+")), boolean(flags & 2), start, boolean(np.full(len(a), alone)), boolean(flags & 4), qname, *own]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def grouped(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if out and len(out[0]):
            a, b, *own = out
            low, code = b & 0xFFFFFF, (b >> 24 & 0xFFFFFFFF).astype(np.int64)
            start = (code - (1 << 31)).astype(np.int32)
            part = 1 << 16
            for k in range(0, len(a), part):
                s = slice(k, k + part)
                yield made(a[s], low[s], b[s] >> 56, pa.array(start[s], mask=code[s] == 0), True, pa.nulls(len(a[s]), pa.string()), [pa.array(x[s]) for x in own])

    for r in batches:
        c = {n: r.column(n) for n in r.schema.names}
        row, read_i, at, x, y, q, used, suspicious = judged_cells(c["cigar"], c["pos"], c["seq"], c["qual"], c["chunk_start"], c["window"], cfg)
        keep = np.flatnonzero(used | suspicious)
        row, read_i, at, x, y, q, used, suspicious = (v[keep] for v in (row, read_i, at, x, y, q, used, suspicious))
        n = np.asarray(pc.utf8_length(c["seq"]).fill_null(0), np.int64)[row]
        flank, back, named = np.minimum(read_i, n - read_i - 1), np.asarray(c["back"].fill_null(False)), np.asarray(pc.is_valid(c["qname"]))
        mapq, known = np.asarray(c["mapq"].fill_null(0), np.int64), np.asarray(pc.is_valid(c["mapq"]))
        sample = samples.of(c["tn"])
        alone = (np.asarray(c["alone"].fill_null(False)) & known & (sample < 128))[row] | suspicious
        start = np.asarray(c["unclipped_start"].fill_null(0), np.int64)[row]
        a = chroms.of(c["rname"])[row] << 32 | at
        b = x.astype(np.int64) << 16 | y.astype(np.int64) << 8 | back[row] | (flank < cfg.mismapped_deletion_distance).astype(np.int64) << 1 | named[row].astype(np.int64) << 2
        own = [used.astype(np.int64), np.where(used, q // 10, 0).astype(np.int64), (used & (flank >= cfg.alt_flank_window)).astype(np.int64), np.where(used, mapq[row], 0), suspicious.astype(np.int64)]
        code = np.where((x == y) | suspicious, 0, start + (1 << 31)) << 24
        e = np.flatnonzero(alone)
        yield from grouped(sums.add(a[e], (b | code | sample[row] << 56)[e], *[v[e] for v in own]) or [])
        e = np.flatnonzero(~alone)
        if len(e):
            columns = [pa.array(v[e]) for v in own]
            columns[3] = pa.array(mapq[row][e], mask=~known[row][e])
            yield made(a[e], b[e], sample[row][e], pa.array(start[e].astype(np.int32)), False, c["qname"].cast(pa.string()).take(pa.array(row[e])), columns)
    yield from grouped(sums.take())


def depth_counts(batches: Iterator[pa.RecordBatch], least: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(chrom, pos, n): aligned bases of quality `least` or more of reads (rname, cigar, pos, qual), summed over batches as far as they fit."""
    chroms, sums = Codes(), Places(most)

    def out(a: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.record_batch([chroms.texts(a[s] >> 32).cast(pa.string()), pa.array((a[s] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(n[s].astype(np.int64))], ["chrom", "pos", "n"])

    for r in batches:
        o, values = Operations(r.column("cigar"), r.column("pos")), Numbers(r.column("qual"))
        k, i = o.units(o.aligned)
        row = o.row[k]
        good = np.flatnonzero(values.get(row, o.read[k] + i) >= least)
        at = (o.ref[k] + i)[good] & 0xFFFFFFFF
        yield from out(*sums.add(chroms.of(r.column("rname"))[row[good]] << 32 | at))
    yield from out(*sums.take())


class Places:
    """How often keys come over batches; given out when there are more than `most` different ones."""

    def __init__(self, most: int):
        self.most, self.keys, self.n, self.held, self.waiting = most, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.held.append(keys)
        self.waiting += len(keys)
        if self.waiting > self.most:
            self._merge()
        return self.take() if len(self.keys) > self.most // 2 else (self.keys[:0], self.n[:0])

    def _merge(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        self.held, self.waiting = [], 0
        self.keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.keys)).astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        keys, n = self.keys, self.n
        self.keys, self.n = keys[:0], n[:0]
        return keys, n


def flanked_counts(batches: Iterator[pa.RecordBatch], quality: int, window: int, least: int) -> Iterator[pa.RecordBatch]:
    """(rname, base, n): aligned bases of reads (rname, cigar, pos, seq, qual) of `quality` or more, all qualities within `window` of which reach `least`."""
    chroms, total = Codes(), np.zeros(0, np.int64)
    for r in batches:
        o, values = Operations(r.column("cigar"), r.column("pos")), Numbers(r.column("qual"))
        k, i = o.units(o.aligned)
        row, read_i = o.row[k], o.read[k] + i
        good = (values.get(row, read_i) >= quality) & in_good_company(values, row, read_i, window, least)
        row, read_i = row[good], read_i[good]
        n = np.bincount(chroms.of(r.column("rname"))[row] << 8 | Texts(r.column("seq")).get(row, read_i))
        total = np.pad(total, (0, max(len(n) - len(total), 0)))
        total[: len(n)] += n
    key = np.flatnonzero(total)
    if len(key):
        yield pa.record_batch([chroms.texts(key >> 8).cast(pa.string()), letters((key & 0xFF).astype(np.uint8)), pa.array(total[key])], ["rname", "base", "n"])
