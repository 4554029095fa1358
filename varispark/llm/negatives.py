"""Hard negatives by blocked dense products of anchors with all vectors.

Anchors pass in chunks of bounded size, each broadcast once; tasks multiply a block of a chunk with a block of their own
vectors in float64, which is exact for integers as long as every partial sum stays under 2^53 (pairs that might not are
multiplied again as Python integers). The first pass keeps each anchor's best rows of its own label, a short list that
tasks fill as they go and Spark merges by anchor. Their scores set the windows of the second pass, which keeps the best
rows of other labels inside each window in the same way. What a task sends is a few rows an anchor, however many
vectors it has read; a vector is never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, read, written

POSITIVES = 5
NEGATIVES = 5
#: Anchors in a broadcast chunk, and components of all its vectors together (8 bytes each), at most.
CHUNK_ANCHORS = 1 << 14
CHUNK_CELLS = 1 << 22
#: Anchors and vectors in one product: 16 MB of scores.
BLOCK_ANCHORS = 1024
BLOCK_ROWS = 2048
EXACT = 2.0**53
LIMIT = (1 << 63) - 1
_OUT = "anchor long, slot int, score long, vec_id long, same boolean"


@dataclass
class Block:
    """Vectors as rows of integers in float64, zeros behind shorter ones; ids of null are told apart by `known`."""

    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    largest: np.ndarray


def _numbers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, wanted): floor(256 x) with width columns, and which lists hold finite numbers only."""
    size = np.array(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()  # without what null lists hold
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    row = np.repeat(np.arange(len(size)), size)
    wanted = np.asarray(vectors.is_valid()) & (np.bincount(row, ~np.isfinite(x), len(size)) == 0)
    column = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    inside = column < width
    values = np.zeros((len(size), width))
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore", invalid="ignore"):
        values[row[inside], column[inside]] = np.clip(np.floor(256 * x[inside]), -top, top)
    values[~wanted] = 0
    return values, wanted


def _block(batch: pa.RecordBatch, width: int) -> Block:
    values, wanted = _numbers(batch.column(2), width)
    ids, labels = batch.column(0).filter(pa.array(wanted)), np.asarray(batch.column(1))[wanted]
    values = values[wanted]
    known = np.asarray(ids.is_valid())
    ids = np.asarray(ids.fill_null(LIMIT), np.int64)
    order = np.lexsort((ids, ~known))
    values = values[order]
    return Block(ids[order], known[order], labels[order], values, np.abs(values).max(1, initial=0.0))


def scores(a: Block, c: Block) -> np.ndarray:
    """Integer inner products, a row an anchor; beyond 64 bits they are held at the limit, and then as Python integers."""
    width = a.values.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        out = a.values @ c.values.T
        bound = max(width, 1) * a.largest.max(initial=0.0) * c.largest.max(initial=0.0)
        if bound < EXACT:
            return out
        doubt = np.argwhere(~(max(width, 1) * a.largest[:, None] * c.largest[None, :] < EXACT))
    out[tuple(doubt.T)] = 0
    out = out.astype(np.int64).astype(object)
    for i, j in doubt.tolist():
        exact = sum(int(x) * int(y) for x, y in zip(a.values[i].tolist(), c.values[j].tolist(), strict=True))
        out[i, j] = min(LIMIT, max(-LIMIT, exact))
    return out


class Best:
    """The first k of every slot: larger scores first, ties by smaller id, null ids last. offer() takes what a block adds."""

    def __init__(self, k: int):
        self.k = k
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)
        self.same = np.zeros(0, bool)
        self.floor = np.full(0, -LIMIT - 1, np.int64)

    def offer(self, slots: np.ndarray, s: np.ndarray, open_: np.ndarray, c: Block, same: np.ndarray | None = None) -> None:
        """s: scores, a row for each of `slots` (ascending, unique); open_: what may be taken."""
        if len(slots) and slots[-1] >= len(self.floor):
            self.floor = np.concatenate([self.floor, np.full(slots[-1] + 1 - len(self.floor), -LIMIT - 1, np.int64)])
        exact = s.dtype == object
        s = s.astype(np.int64) if exact else s
        open_ = open_ & (s >= self.floor[slots][:, None] if exact else s >= self.floor[slots].astype(np.float64)[:, None])
        if s.shape[1] > self.k:  # what lies under a row's k-th score can't stay
            low = np.iinfo(np.int64).min if exact else -np.inf
            kth = np.partition(np.where(open_, s, low), -self.k, axis=1)[:, -self.k]
            open_ &= s >= kth[:, None]
        i, j = np.nonzero(open_)
        if len(i):
            more = np.zeros(len(i), bool) if same is None else same[i, j]
            self._keep(slots[i], s[i, j].astype(np.int64), c.ids[j], c.known[j], more)

    def _keep(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, same: np.ndarray) -> None:
        touched = np.zeros(len(self.floor), bool)
        touched[slot] = True
        old = touched[self.slot]
        slot, score, ids, known, same = (np.concatenate(x) for x in ((self.slot[old], slot), (self.score[old], score), (self.ids[old], ids), (self.known[old], known), (self.same[old], same)))
        order = np.lexsort((ids, ~known, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        stays = order[place < self.k]
        slot = slot[place < self.k]
        full = place[place < self.k] == self.k - 1
        self.floor[slot[full]] = score[stays][full]
        self.slot, self.score, self.ids, self.known, self.same = (np.concatenate(x) for x in ((self.slot[~old], slot), (self.score[~old], score[stays]), (self.ids[~old], ids[stays]), (self.known[~old], known[stays]), (self.same[~old], same[stays])))

    def batch(self, first: int, slots: int) -> pa.RecordBatch:
        """What is kept, of anchors counted from `first` with so many slots each."""
        return pa.record_batch({"anchor": first + self.slot // slots, "slot": (self.slot % slots).astype(np.int32), "score": self.score, "vec_id": pa.array(self.ids, mask=~self.known), "same": pa.array(self.same)})


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            c = _block(b.slice(i, BLOCK_ROWS), width)
            if len(c.ids):
                yield c


def _parts(a: Block) -> Iterator[tuple[int, Block]]:
    for i in range(0, len(a.ids), BLOCK_ANCHORS):
        s = slice(i, i + BLOCK_ANCHORS)
        yield i, Block(a.ids[s], a.known[s], a.labels[s], a.values[s], a.largest[s])


def _first_pass(held, width: int, k: int) -> Callable:
    """The first k + 1 rows of an anchor's label, `same` for those equal to it in id and vector: it is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = held.value, defaultdict(lambda: Best(k + 1))
        for c in _blocks(batches, width):
            for at, a in _parts(anchors):
                alike = a.labels[:, None] == c.labels[None, :]
                if alike.any():
                    same = (a.ids[:, None] == c.ids[None, :]) & c.known[None, :] & alike
                    for i, j in np.argwhere(same).tolist():
                        same[i, j] = np.array_equal(a.values[i], c.values[j])
                    best[at].offer(np.arange(len(a.ids)), scores(a, c), alike, c, same)
        for at, x in best.items():
            yield x.batch(at, 1)

    return run


def _second_pass(held, width: int, k: int, slots: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (anchors, positive, filled), best = held.value, defaultdict(lambda: Best(k))
        for c in _blocks(batches, width):
            for at, a in _parts(anchors):
                other = a.labels[:, None] != c.labels[None, :]
                s = scores(a, c)
                hundred = 100 * (s if s.dtype == object else s.astype(np.int64))
                for slot in range(slots):
                    rows = np.flatnonzero(filled[at : at + len(a.ids), slot])
                    p = positive[at + rows, slot]
                    p = p.astype(object) if s.dtype == object or np.abs(p).max(initial=0) >= EXACT else p
                    inside = other[rows] & (hundred[rows] >= (low * p)[:, None]).astype(bool) & (hundred[rows] <= (high * p)[:, None]).astype(bool)
                    best[at].offer(rows * slots + slot, s[rows], inside, c)
        for at, x in best.items():
            yield x.batch(at, slots)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot, numbered from 1; groups hold k rows a task at most."""
    w = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _chunks(anchors: DataFrame) -> Iterator[Block]:
    """Anchors by ascending id, a bounded chunk at a time; no more is on the driver at once than Spark fetches at once."""
    held: list[tuple] = []
    width = 0
    for r in anchors.orderBy("vec_id").toLocalIterator():
        wide = max(width, len(r["embedding"]))
        if held and (len(held) >= CHUNK_ANCHORS or wide * (len(held) + 1) > CHUNK_CELLS):
            yield _chunk(held, width)
            held, wide = [], len(r["embedding"])
        width = wide
        held.append((r["vec_id"], r["label"], r["embedding"]))
    if held:
        yield _chunk(held, width)


def _chunk(held: list[tuple], width: int) -> Block:
    ids, labels, vectors = zip(*held, strict=True)
    batch = pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64()))})
    return _block(batch, width)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id,
    embedding, label) that `anchors` marks.

    A component counts as floor(256 x), a row's score is its inner product with the anchor. Positives of an anchor are
    the first `positives` other rows of its label; for each, the first `negatives` rows of other labels with
    low * positive <= 100 * negative <= high * positive are returned, numbered from 1. Higher scores come first, then
    smaller ids, null ids last. Rows with a null label or vector or a component that is null or not finite take no
    part; an empty vector scores 0, of vectors of different lengths the common components count. An anchor is left out
    of its own positives once: a repeated row is a positive of its copy, and repeated anchors are mined apart. Scores
    beyond 64 bits count as the limit. An empty table, or one without anchors, gives no row; other columns are ignored.

    Work is (number of anchors) x (number of rows): the stated queries against all rows. A task holds a chunk of
    anchors, short lists for each and one block of scores.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(anchors, F.lit(False)).alias("__anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    everything = rows.select("vec_id", "label", "embedding")
    parts = []
    for chunk in _chunks(rows.where(F.col("__anchor") & fine).drop("__anchor")):
        width = chunk.values.shape[1]
        held = spark.sparkContext.broadcast(chunk)
        first = written(everything.mapInArrow(_first_pass(held, width, positives), _OUT), "positives")
        top = _merged(first, positives + 1).select("anchor", "rank", "score", "vec_id", "same").collect()  # bounded by the chunk
        score, ids, filled = _positives(top, len(chunk.ids), positives)
        windows = spark.sparkContext.broadcast((chunk, score, filled))
        found = written(everything.mapInArrow(_second_pass(windows, width, negatives, positives, low, high), _OUT), "negatives")
        at = np.argwhere(filled)
        own = [(int(i), int(j), int(chunk.ids[i]) if chunk.known[i] else None, ids[i][j], int(score[i, j])) for i, j in at.tolist()]
        pairs = spark.createDataFrame(own, "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        part = pairs.join(_merged(found, negatives), ["anchor", "slot"])
        parts.append(written(part.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
        for table in (first, found):
            drop_table(table)
        held.destroy()
        windows.destroy()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[p._varispark_path for p in parts])


def _positives(top: list, anchors: int, k: int) -> tuple[np.ndarray, list[list], np.ndarray]:
    """Scores, ids and which exist, k an anchor, from the first k + 1 with the anchor itself taken out once."""
    score, ids, filled = np.zeros((anchors, k), np.int64), [[None] * k for _ in range(anchors)], np.zeros((anchors, k), bool)
    lists: dict[int, list] = {}
    for r in top:
        lists.setdefault(r["anchor"], []).append(r)
    for i, rows in lists.items():
        rows.sort(key=lambda r: r["rank"])
        own = next((j for j, r in enumerate(rows) if r["same"]), None)
        for j, r in enumerate([r for n, r in enumerate(rows) if n != own][:k]):
            score[i, j], ids[i][j], filled[i, j] = r["score"], r["vec_id"], True
    return score, ids, filled


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> p.own AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5
"""
