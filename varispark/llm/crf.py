"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Emissions come from bucketed statistics of the line and of its neighbours, transitions
from the pair of labels. Weights are fitted by gradient ascent on the exact likelihood of a bounded sample of
labelled documents, each line taking its document's label. A document's quality is the average of the
forward-backward marginals of "good" over its lines, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .textarrays import Texts, judged, labelled_sample, mix, of_texts, segment_hash, slices, sums

#: Labelled documents that the field is fitted on, at most.
TRAIN_ROWS = 2500
GOOD = 0.7
BUCKETS = 6
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>@^~_=+{}[]\\"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!?"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def line_table(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text, whether it has a word, hash) of every line."""
    stop = np.sort(np.concatenate((np.flatnonzero(t.data == 10), t.start + t.size)))
    start = np.zeros_like(stop)
    start[1:] = stop[:-1] + 1
    filled = np.zeros(len(stop), bool)
    filled[np.searchsorted(stop, t.word_start)] = True
    return start, stop, np.searchsorted(t.start, stop, "right") - 1, filled, segment_hash(t.data, start, stop - start)


def line_stats(texts: list[bytes], t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, text, weight) of the lines of the texts, blank ones but the first of a text left out.

    A text without words still has one line, so that every text has a score.
    """
    start, stop, owner, keep, lines = line_table(t)
    word_line = np.searchsorted(stop, t.word_start)
    words = np.bincount(word_line, minlength=len(stop))
    keep |= start == t.start[owner] if len(stop) else np.zeros(0, bool)
    new = np.cumsum(keep) - 1
    start, stop, owner, words = start[keep], stop[keep], owner[keep], words[keep]
    word_line, n = new[word_line], len(start)
    size = np.maximum(stop - start, 0)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[t.data])))
        return (total[stop] - total[start]) / np.maximum(size, 1)

    some = np.maximum(words, 1)
    one = np.lexsort((t.word_hash, word_line))
    h, wl = t.word_hash[one], word_line[one]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (wl[1:] != wl[:-1])
    distinct = np.bincount(wl[fresh], minlength=n)
    again = (t.word_hash[1:] == t.word_hash[:-1]) & (word_line[1:] == word_line[:-1])
    runs = np.bincount(word_line[1:][again], minlength=n)
    marked = np.bincount(word_line, (_SYMBOL | _MARK)[t.data[t.word_start + t.word_size - 1]], n)
    caps = np.bincount(word_line, _UPPER[t.data[t.word_start]], n)
    lines = mix(lines[keep] + mix(owner.astype(np.uint64)))
    order = np.argsort(lines, kind="stable")
    same = np.zeros(n, bool)
    same[order[1:]] = lines[order[1:]] == lines[order[:-1]]
    stats = np.stack(
        [np.log1p(size), np.log1p(words), size / some, share(_UPPER), share(_SYMBOL), share(_MARK), share(_STOP), share(_DIGIT), 1 - distinct / some, runs / some, marked / some, caps / some, same.astype(float)],
        axis=1,
    )
    return stats, owner, size + 1.0


def neighbours(stats: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Statistics of each line, of the line before and of the line after; -1 at a text's ends."""
    before, after = np.full_like(stats, -1), np.full_like(stats, -1)
    same = owner[1:] == owner[:-1]
    before[1:][same] = stats[:-1][same]
    after[:-1][same] = stats[1:][same]
    return np.concatenate((stats, before, after), axis=1)


@dataclass(frozen=True)
class Field:
    """cuts[j]: bucket bounds of statistic j; emit[j][b]: weight of "good" for bucket b; trans[a][b], begin[b]."""

    cuts: list[np.ndarray]
    emit: list[np.ndarray]
    trans: np.ndarray
    begin: np.ndarray

    def buckets(self, wide: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, wide[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def emission(self, buckets: np.ndarray) -> np.ndarray:
        return sum(e[buckets[:, j]] for j, e in enumerate(self.emit))


#: Lines of a chain up to which it is worked through place by place; longer chains are cut into about as many pieces
#: as a piece has lines, and the pieces are worked through side by side.
STRAIGHT = 512


def forward(e: np.ndarray, size: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all labellings up to each line that end in each label; e (lines, 2) are emissions.

    A piece's effect on what comes in is a 2 x 2 matrix, which all pieces get at once; what comes in then runs from
    piece to piece, and all pieces fill in their lines at once.
    """
    longest = int(size.max(initial=0))
    most = longest if longest <= STRAIGHT else int(np.ceil(np.sqrt(longest)))
    pieces = np.maximum(-(-size // max(most, 1)), 0)
    chain = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(size) - size)[chain] + number * most
    length = np.minimum(size[chain] - number * most, most)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, most + 1), "right")  # pieces with so many lines or more

    def run(state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """state (pieces, 2): weights of the first line's labels without its emission."""
        for k, n in enumerate(live.tolist()):
            at = order[:n]
            s = state[at]
            s = (np.logaddexp(s[:, :1] + trans[0], s[:, 1:] + trans[1]) if k else s) + e[start[at] + k]
            state[at] = s
            if out is not None:
                out[start[at] + k] = s
        return state

    enter = np.repeat(begin[None, :].astype(float), len(chain), 0)
    if longest > most:
        ends = run(enter.copy())
        effect = np.stack([run(np.repeat(trans[x][None, :], len(chain), 0)) for x in (0, 1)], 1)
        for j in range(1, int(number.max(initial=0)) + 1):
            at = np.flatnonzero(number == j) if len(size) > 1 else np.array([j])
            before = ends[at - 1]
            enter[at] = np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
            ends[at] = np.logaddexp(before[:, :1] + effect[at, 0], before[:, 1:] + effect[at, 1])
    out = np.zeros((len(e), 2))
    run(enter, out)
    return out


def forward_backward(score: np.ndarray, owner: np.ndarray, n: int, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end: P(good) of each line, expected transitions (2, 2) and P(first label) (n, 2).

    Works through all chains at once; emission of "bad" is 0. The backward pass is a forward pass from the ends.
    Memory is some hundred bytes a line.
    """
    size = np.bincount(owner, minlength=n)
    first = np.cumsum(size) - size
    e = np.stack([np.zeros(len(score)), score], 1)
    a = forward(e, size, trans, begin)
    b = forward(e[::-1], size[::-1], trans.T, np.zeros(2))[::-1] - e
    z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    good = np.exp(a[:, 1] + b[:, 1] - z)
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, int)
    for x in (0, 1):
        for y in (0, 1):
            pair[x, y] = np.exp(a[inner, x] + trans[x, y] + e[inner + 1, y] + b[inner + 1, y] - z[inner]).sum()
    head = good[first[size > 0]]
    return good, pair, np.stack([1 - head, head], 1)


def fit(rows: list[tuple[int, bytes, int]], steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """rows: (doc_id, text, label). Adam on the penalised log-likelihood of the label chains."""
    if len({y for *_, y in rows}) < 2:  # nothing to learn from: the only label seen, or even odds
        only = {y for *_, y in rows}
        return Field([], [], np.zeros((2, 2)), np.array([0.0, 3.0 if only == {1} else -3.0 if only == {0} else 0.0]))
    y, n = np.array([q for *_, q in rows]), len(rows)
    parts, owners = [], []
    for at in range(0, n, 200):  # a few texts at a time: their arrays of bytes are large, those of lines small
        texts = [x for _, x, _ in rows[at : at + 200]]
        stats, own, _ = line_stats(texts, of_texts(texts))
        parts.append(neighbours(stats, own))
        owners.append(own + at)
    wide, owner = np.concatenate(parts), np.concatenate(owners)
    cuts = [np.unique(np.quantile(np.unique(wide[:, j]), np.linspace(0, 1, BUCKETS + 1)[1:-1])) for j in range(wide.shape[1])]
    cuts = [np.unique(np.concatenate((c, np.quantile(wide[:, j], np.linspace(0, 1, BUCKETS + 1)[1:-1])))) for j, c in enumerate(cuts)]
    field = Field(cuts, [np.zeros(len(c) + 1) for c in cuts], np.zeros((2, 2)), np.zeros(2))
    where, truth = field.buckets(wide), y[owner].astype(float)
    real = np.zeros((2, 2))
    inner = owner[1:] == owner[:-1]
    np.add.at(real, (y[owner][1:][inner], y[owner][1:][inner]), 1)
    head = np.stack([1 - y, y], 1).astype(float)
    params = [*field.emit, field.trans, field.begin]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        good, pair, first = forward_backward(field.emission(where), owner, n, field.trans, field.begin)
        grads = [np.bincount(where[:, j], truth - good, len(c) + 1) / n for j, c in enumerate(cuts)] + [(real - pair) / n, (head - first).sum(0) / n]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g -= ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return field


#: Lines of texts that are scored together, and bytes of a longer text whose lines get their statistics together.
LINES = 1 << 14
PIECE_BYTES = 1 << 18


def quality(texts: list[bytes], field: Field) -> np.ndarray:
    """Of each text, the average over its lines of P(good), weighted by their lengths.

    Texts are taken together while they have few lines; one with many is worked through in pieces of whole lines.
    """
    out = np.zeros(len(texts))
    lines = [x.count(b"\n") for x in texts]
    at = 0
    while at < len(texts):
        stop, n = at, 0
        while stop < len(texts) and n + lines[stop] <= LINES:
            n += lines[stop]
            stop += 1
        if stop == at:
            out[at] = long_quality(texts[at], field)
            stop += 1
        else:
            part = texts[at:stop]
            stats, owner, weight = line_stats(part, of_texts(part))
            score = field.emission(field.buckets(neighbours(stats, owner))) if field.cuts else np.zeros(len(owner))
            out[at:stop] = weighted(score, owner, weight, len(part), field)
        at = stop
    return out


def weighted(score: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, field: Field) -> np.ndarray:
    good, *_ = forward_backward(score, owner, n, field.trans, field.begin)
    return np.clip(sums(good * weight, owner, n) / sums(weight, owner, n), 0, 1)


def line_pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text's lines in runs of about `most` bytes, without the line feed between two runs."""
    at = 0
    while True:
        stop = text.find(b"\n", at + most)
        yield text[at : stop if stop >= 0 else len(text)]
        if stop < 0:
            return
        at = stop + 1


def long_quality(text: bytes, field: Field) -> float:
    """quality() of one text with any number of lines: a piece's statistics are gone once its lines have their emission,
    of which a line keeps 8 bytes, its weight and its hash as much.

    What crosses pieces is put right: which lines equal an earlier one of the text, and the neighbours at the cuts.
    """
    names, blank = [], []
    for piece in line_pieces(text):  # first the lines that stay and their hashes
        _, _, _, keep, lines = line_table(of_texts([piece]))
        names.append(lines)
        blank.append(~keep)
    name, drop = np.concatenate(names), np.concatenate(blank)
    drop[0] = False  # a text's first line always counts
    held = np.flatnonzero(~drop)
    order = held[np.argsort(name[held], kind="stable")]
    same = np.zeros(len(name), bool)
    same[order[1:]] = name[order[1:]] == name[order[:-1]]
    del names, blank, name, order
    scores, weights, waiting, last, at = [], [], None, None, 0

    def finish(stats: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> None:
        wide = neighbours(stats, np.zeros(len(stats), np.int64))
        k = stats.shape[1]
        if before is not None:
            wide[0, k : 2 * k] = before
        if after is not None:
            wide[-1, 2 * k :] = after
        scores.append(field.emission(field.buckets(wide)) if field.cuts else np.zeros(len(stats)))

    for piece in line_pieces(text):
        stats, _, weight = line_stats([piece], of_texts([piece]))
        n = piece.count(b"\n") + 1
        mine = ~drop[at : at + n]
        if len(stats) > mine.sum():  # line_stats keeps a piece's first line, which counts only if it isn't blank
            stats, weight = stats[1:], weight[1:]
        stats[:, -1] = same[at : at + n][mine]
        at += n
        if not len(stats):
            continue
        weights.append(weight)
        if waiting is not None:
            finish(waiting, last, stats[0])
            last = waiting[-1]
        waiting = stats
    finish(waiting, last, None)
    score, weight = np.concatenate(scores), np.concatenate(weights)
    return float(weighted(score, np.zeros(len(score), np.int64), weight, 1, field)[0])


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of every row; only texts are inputs. Null, empty and blank texts are one line without words.

    Rows with equal doc_ids are scored apart; an empty table gives no row; other columns are ignored. A text takes time
    in proportion to its bytes, and some 120 bytes of memory a line: 10 MB of one-character lines are 600 MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in slices(batches):
            yield pa.record_batch({"doc_id": pa.array(names, pa.int64()), "score": pa.array(quality(texts, shared.value))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def filter_documents(docs: DataFrame, field: Field, good: float = GOOD) -> DataFrame:
    """The documents scored at least `good`, columns as given; judged in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def verdict(text: pd.Series) -> pd.Series:
        return judged(text, lambda texts: quality(texts, shared.value) >= good)

    return docs.where(verdict("text"))


def trained(spark, sf_dir: str, rows: int = TRAIN_ROWS) -> Field:
    return fit(labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), rows))


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = score_documents(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # no id: none
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
