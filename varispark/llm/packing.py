"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens hold at once.

The open bin takes the example with the largest dot product of its needs and the bin's remaining room, both as shares
of the limits, among those that fit; when none fits, the best one is cut so that its head fills the room. Bins are
filled from a window of examples that each task reads from its stream, so packing needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .tokens import ended, text_runs, vocabulary, word_encoder


@dataclass(frozen=True)
class Limits:
    """Of one packed sequence. window: examples and tokens that a task looks at together (memory bound)."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096
    window: int = 4096
    window_tokens: int = 8_000_000


def pack_window(n: np.ndarray, loss: np.ndarray, limits: Limits, bears: list[np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (example, start, length) for examples of n tokens, `loss` of which bear loss.

    bears[i][k]: loss-bearing tokens among the first k of example i; without it they are spread evenly. Every token is
    in one piece. A sequence that the limits on segments or loss close early, or that a window's end leaves short, is
    parted into lengths of powers of two, which need no padding.
    """
    top = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    if top.min() < 1:
        raise ValueError("limits must be positive")
    share = np.divide(loss, n, out=np.zeros(len(n)), where=n > 0)

    def borne(i: int, a: int, b: int) -> float:
        return share[i] * (b - a) if bears is None else float(bears[i][b] - bears[i][a])

    def most(i: int, tokens: int, loss_room: float) -> int:
        """Tokens of example i from at[i] that fit both rooms."""
        if bears is None:
            return min(tokens, int(left[i]), int((loss_room + 1e-6) / share[i]) if share[i] > 0 else tokens)
        a = int(at[i])
        return min(tokens, int(left[i]), int(np.searchsorted(bears[i], bears[i][a] + loss_room, "right")) - 1 - a)

    at, left = np.zeros(len(n), np.int64), n.astype(np.int64)
    out: list[list[tuple[int, int, int]]] = []
    for i in np.flatnonzero(left >= limits.tokens).tolist():  # full sequences of one example
        while left[i] >= limits.tokens and most(i, limits.tokens, limits.loss_tokens) == limits.tokens:
            out.append([(i, int(at[i]), limits.tokens)])
            at[i] += limits.tokens
            left[i] -= limits.tokens
    # Needs left of each example; those of one that is used up are infinite, so it never fits.
    tokens = np.where(left > 0, left, np.inf)
    lossy = np.array([borne(i, int(at[i]), int(n[i])) for i in range(len(n))], float)
    todo = int((left > 0).sum())
    while todo:
        room, pieces = top.copy(), []
        while todo and room[0] >= 1 and room[1] >= 1:
            # Products with the room, both as shares of the limits; the need of one segment is the same for all.
            value = tokens * (room[0] / top[0] ** 2) + lossy * (room[2] / top[2] ** 2)
            fits = (tokens <= room[0]) & (lossy <= room[2] + 1e-6)
            i = int(np.argmax(np.where(fits, value, -1)))
            if fits[i]:
                take = int(left[i])
            else:  # cut the best one that has a token which fits
                value[tokens == np.inf] = -1
                i = int(np.argmax(value))
                take = most(i, int(room[0]), room[2])
                if take < 1:
                    order = (int(j) for j in np.argsort(-value, kind="stable") if value[j] >= 0)
                    i, take = next(((j, k) for j in order if (k := most(j, int(room[0]), room[2])) > 0), (i, 0))
                if take < 1:
                    break
            pieces.append((i, int(at[i]), take))
            room -= [take, 1, borne(i, int(at[i]), int(at[i]) + take)]
            at[i] += take
            left[i] -= take
            tokens[i], lossy[i] = left[i] or np.inf, borne(i, int(at[i]), int(n[i]))
            todo -= not left[i]
        out.append(pieces)
    return [x for pieces in out for x in ([pieces] if sum(k for *_, k in pieces) == limits.tokens else powers(pieces))]


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One short sequence as several whose lengths are powers of two, longest first."""
    total, out, todo = sum(k for _, _, k in pieces), [], list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        own: list[tuple[int, int, int]] = []
        while size:
            i, s, k = todo.pop(0)
            take = min(k, size)
            own.append((i, s, take))
            size -= take
            if take < k:
                todo.insert(0, (i, s + take, k - take))
        out.append(own)
    return out


Example = tuple[int | None, np.ndarray, np.ndarray | None]
FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def sequences(examples: Iterator[Example], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS of one task's examples (name, ids, which of them bear loss: None for all), window by window."""
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 36, 0
    window: list[Example] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal count
        n = np.array([len(x) for _, x, _ in window], np.int64)
        bears = None if all(b is None for *_, b in window) else [np.arange(len(x) + 1) if b is None else np.concatenate(([0], np.cumsum(b))) for _, x, b in window]
        loss = n if bears is None else np.array([b[-1] for b in bears], np.int64)
        rows: list[tuple] = []
        for pieces in pack_window(n, loss, limits, bears):
            offset = 0
            for i, start, size in pieces:
                name, ids, _ = window[i]
                rows.append((name, start, size, ids[start : start + size].astype("<u4").tobytes(), int(n[i]), base + count, offset))
                offset += size
            count += 1
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    for example in examples:
        window.append(example)
        held += len(example[1])
        if len(window) >= limits.window or held >= limits.window_tokens:
            yield flush()
            window, held = [], 0
    if window:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents, ids little-endian u32.

    All tokens of a document bear loss. Null and empty texts have end_id alone. sequence_id is the task's number in
    the high bits and a count in the low 36; tasks read fixed splits, so a task that runs again gives the same rows.
    Equal doc_ids are packed as separate examples; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)

        def examples() -> Iterator[Example]:
            for b in batches:
                for part in text_runs(b):
                    ids, ends = ended(*encoder.encode_column(part.column(1)), end_id)
                    yield from zip(part.column(0).to_pylist(), np.split(ids, ends[:-1]), [None] * len(ends), strict=True)

        yield from sequences(examples(), limits)
        encoder.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FIELDS)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int, limits: Limits, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pieces of conversations (conv_id, turn, role, text), as pack() gives them, with conv_id as doc_id.

    A conversation's turns follow one another in order of (turn, role, text), each with end_id after it. Turns of
    `roles` bear loss, others and those of a null role don't; null texts are empty. Rows without a conv_id are
    conversations of one turn each. A conversation's turns meet in one task, so it must fit there.
    """
    said = F.struct("turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), said.alias("said"))
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("said")).alias("said"))
    parts = whole.select("conv_id", F.col("said.text").alias("texts"), F.transform("said", lambda s: F.coalesce(s["role"].isin(*roles), F.lit(False))).alias("bears"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)

        def examples() -> Iterator[Example]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    texts, bears = part.column(1), part.column(2).flatten().to_numpy(zero_copy_only=False)
                    ids, ends = ended(*encoder.encode_column(texts.flatten()), end_id)
                    marks = np.repeat(bears.astype(bool), np.diff(ends, prepend=0))
                    stop = np.concatenate(([0], ends))[np.cumsum(pc.list_value_length(texts).to_numpy())][:-1]
                    yield from zip(part.column(0).to_pylist(), np.split(ids, stop), np.split(marks, stop), strict=True)

        yield from sequences(examples(), limits)
        encoder.rest()

    return parts.mapInArrow(run, FIELDS)


def pack_digest(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, vocabulary("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return pack_digest(read(spark, sf_dir, "documents"))
