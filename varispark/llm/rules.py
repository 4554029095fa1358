"""Quality rules: counts of a text against fixed limits, and a calibrated logistic regression on hashed n-grams.

Features are the shares of hashed words, word pairs and runs of four characters in a text. The regression is fitted by
adaptive gradient steps on a bounded sample of labelled rows, then calibrated on labelled rows left out of the fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .textarrays import Texts, judged, labelled_sample, mix, of_texts, slices, sums

#: Labelled rows that the regression is fitted on, at most.
TRAIN_ROWS = 3000
BITS = 18
#: A text is kept if its calibrated probability of being good is at least this.
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def repeated_words(t: Texts) -> np.ndarray:
    """Per text: words within five-word windows that occur twice or more in the text, the first included.

    Windows are told apart by 64-bit hashes.
    """
    n = len(t.word_hash) - WINDOW + 1
    out = np.zeros(len(t.size), np.int64)
    if n <= 0:
        return out
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t.word_hash[k : k + n]
    inside = t.word_text[:n] == t.word_text[WINDOW - 1 :]
    h = mix(h + mix(t.word_text[:n].astype(np.uint64) + np.uint64(1)))[inside]
    place = np.flatnonzero(inside)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(t.word_hash), bool)
    for k in range(WINDOW):
        covered[place[order[twice]] + k] = True
    return sums(covered, t.word_text, len(t.size)).astype(np.int64)


def repeated_in(h: np.ndarray) -> int:
    """repeated_words() of one text, from its words' hashes."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return 0
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(w, kind="stable")
    w = w[order]
    same = w[1:] == w[:-1]
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(h), bool)
    for k in range(WINDOW):
        covered[order[twice] + k] = True
    return int(covered.sum())


def base_counts(texts: list[bytes], t: Texts) -> dict[str, np.ndarray]:
    n = len(texts)
    lead = (t.data & 0xC0) != 0x80
    chars = np.add.reduceat(lead.astype(np.int64), t.word_start) if len(t.word_start) else np.zeros(0)
    dup = []
    for x in texts:
        lines = [y for y in x.split(b"\n") if y and not y.isspace()]
        dup.append(len(lines) - len(set(lines)))
    # reduceat runs to the next word: the white space between is taken off again
    between = np.diff(np.append(t.word_start, len(t.data))) - t.word_size
    return {
        "n_words": sums(None, t.word_text, n).astype(np.int64),
        "word_chars": sums(chars - between, t.word_text, n).astype(np.int64),
        "n_symbols": np.array([sum(x.count(bytes([c])) for c in SYMBOLS) for x in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated_words(t),
    }


def failed(c: dict[str, np.ndarray]) -> np.ndarray:
    """Under ten words, or more than a fifth of the words in repeated windows."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Texts of more bytes are measured in pieces of about so many.
PIECE_BYTES = 1 << 20
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of about `most` bytes that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        m = _SPACES.search(text, at + most)
        stop = m.start() if m else len(text)
        yield at, stop
        at = stop


def character_pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Pieces of about `most` bytes with the three characters before each, so that each run of four is in one of them."""
    inner = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    at = 0
    while at < len(text):
        stop = at + most
        while inner(stop):
            stop += 1
        head = at
        for _ in range(3):
            head = max(head - 1, 0)
            while head > 0 and inner(head):
                head -= 1
        yield text[head:stop]
        at = stop


def line_names(text: bytes, most: int) -> Iterator[np.ndarray]:
    """128-bit hashes of the lines that have a word, in pieces of whole lines."""
    at = 0
    while at >= 0:
        stop = text.find(b"\n", at + most)
        lines = [xxhash.xxh3_128_digest(y) for y in text[at : stop if stop >= 0 else len(text)].split(b"\n") if y and not y.isspace()]
        yield np.frombuffer(b"".join(lines), "V16")
        at = stop + 1 if stop >= 0 else -1


def long_text(text: bytes, model: NgramModel) -> tuple[dict[str, int], float]:
    """base_counts() and the model's score of one text of any length.

    Held for the whole text are 8 bytes a word and 16 a line (40 and 24 while windows and lines are sorted); what
    belongs to characters is held for a piece alone. Pairs and runs of characters that cross pieces count as others do.
    """
    c = dict.fromkeys(COUNTS, 0)
    words, total, count = [], np.zeros(3), np.zeros(3, np.int64)
    for a, b in word_pieces(text, PIECE_BYTES):
        piece = text[a:b]
        t = of_texts([piece])
        for k, v in base_counts([piece], t).items():
            if k not in ("n_dup_lines", "n_repeat_words"):
                c[k] += int(v[0])
        words.append(t.word_hash)
    for piece in character_pieces(text, PIECE_BYTES):
        grams = character_grams(piece)
        total[2] += model.weights[2][grams].sum(dtype=float)
        count[2] += len(grams)
    h = np.concatenate(words) if words else np.zeros(0, np.uint64)
    del words
    shift = np.uint64(64 - BITS)
    for at in range(0, len(h), PIECE_BYTES):
        one, two = h[at : at + PIECE_BYTES], h[at : at + PIECE_BYTES + 1]
        total[0] += model.weights[0][one >> shift].sum(dtype=float)
        total[1] += model.weights[1][mix(two[:-1] * np.uint64(3) + two[1:]) >> shift].sum(dtype=float)
    count[0], count[1] = len(h), max(len(h) - 1, 0)
    c["n_repeat_words"] = repeated_in(h)
    names = np.concatenate(list(line_names(text, PIECE_BYTES)))
    c["n_dup_lines"] = len(names) - len(np.unique(names))
    return c, float(model.bias + (total / np.maximum(count, 1)).sum())


_STEP = np.uint64(0x9E3779B97F4A7C15)


def characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(number of each character, text it belongs to): its bytes, first one lowest, whatever their number."""
    d = np.concatenate((t.data, np.zeros(3, np.uint8)))
    at = np.flatnonzero((t.data & 0xC0) != 0x80)
    code, more = d[at].astype(np.uint64), np.ones(len(at), bool)
    for k in (1, 2, 3):
        more &= (d[at + k] & 0xC0) == 0x80
        code |= np.where(more, d[at + k], 0).astype(np.uint64) << np.uint64(8 * k)
    owner = np.searchsorted(t.start, at, "right") - 1
    own = at < (t.start + t.size)[owner]  # not the spaces put between texts
    return code[own], owner[own]


def _fours(code: np.ndarray) -> np.ndarray:
    return mix(((code[:-3] * _STEP + code[1:-2]) * _STEP + code[2:-1]) * _STEP + code[3:])


def character_grams(text: bytes) -> np.ndarray:
    """Hashes below 2^BITS of the runs of four characters of one text."""
    none = np.zeros(0, np.int64)
    t = Texts(np.frombuffer(text + b"\x20", np.uint8), np.zeros(1, np.int64), np.array([len(text)]), none, none, none.astype(np.uint64), none)
    return _fours(characters(t)[0]) >> np.uint64(64 - BITS)


def gram_hashes(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and four-character grams: (hash below 2^BITS, text it belongs to)."""
    shift = np.uint64(64 - BITS)
    word = (t.word_hash, t.word_text)
    both = t.word_text[1:] == t.word_text[:-1]
    pair = (mix(t.word_hash[:-1] * np.uint64(3) + t.word_hash[1:])[both], t.word_text[1:][both])
    code, owner = characters(t)
    same = owner[3:] == owner[:-3]
    return [(h >> shift, o) for h, o in (word, pair, (_fours(code)[same], owner[3:][same]))]


@dataclass(frozen=True)
class NgramModel:
    weights: np.ndarray  # (3, 2^BITS) float32
    bias: float
    slope: float
    offset: float

    def raw(self, t: Texts) -> np.ndarray:
        out = np.full(len(t.size), self.bias)
        for w, (h, owner) in zip(self.weights, gram_hashes(t), strict=True):
            count = np.maximum(sums(None, owner, len(t.size)), 1)
            out += sums(w[h], owner, len(t.size)) / count
        return out

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))

    def probability(self, t: Texts) -> np.ndarray:
        return self.calibrated(self.raw(t))


def fit(rows: list[tuple[int, bytes, int]], epochs: int = 12, rate: float = 4.0, decay: float = 1e-6) -> NgramModel:
    """rows: (doc_id, text, label). A quarter, by crc32 of doc_id, calibrates and isn't fitted."""
    empty = NgramModel(np.zeros((3, 1 << BITS), np.float32), 0.0, 1.0, 0.0)
    if len({y for *_, y in rows}) < 2:  # nothing to learn from: the only label seen, or even odds
        only = {y for *_, y in rows}
        return NgramModel(empty.weights, 0.0, 0.0, 3.0 if only == {1} else -3.0 if only == {0} else 0.0)
    side = [zlib.crc32(b"fit%d" % i) % 4 == 0 for i, *_ in rows]
    train = [r for r, s in zip(rows, side, strict=True) if not s] or rows
    tune = [r for r, s in zip(rows, side, strict=True) if s] or rows
    cases = []
    for _, text, y in train:
        parts = []
        for k, (h, _) in enumerate(gram_hashes(of_texts([text]))):
            ids, n = np.unique(h, return_counts=True)
            parts.append((k, ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
        cases.append((parts, y))
    w = np.zeros((3, 1 << BITS), np.float32)
    g = np.full((3, 1 << BITS), 1e-8, np.float32)
    bias, bias_g, rng = 0.0, 1e-8, np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(cases)):
            parts, y = cases[i]
            z = bias + sum(float(w[k, ids] @ share) for k, ids, share in parts)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            for k, ids, share in parts:
                step = err * share + decay * w[k, ids]
                g[k, ids] += step * step
                w[k, ids] -= rate * step / np.sqrt(g[k, ids])
            bias_g += err * err
            bias -= 0.1 * err / np.sqrt(bias_g)
    model = NgramModel(w, bias, 1.0, 0.0)
    z = np.concatenate([model.raw(of_texts([x])) for _, x, _ in tune])
    slope, offset = calibrate(z, np.array([y for *_, y in tune], float))
    return NgramModel(w, bias, slope, offset)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores z and labels y, by Newton's steps, with soft targets."""
    scale = max(float(np.abs(z).max()), 1e-9)
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([z / scale, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -4, 4)
    return float(theta[0] / scale), float(theta[1])


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def score(docs: DataFrame, model: NgramModel, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id and FIELDS. base_failed: under ten words, or over a fifth of the words repeated.

    Null, empty and blank texts have counts of 0 and fail. Rows with equal doc_ids are judged apart; an empty table
    gives no row; columns besides doc_id and text are ignored. Texts over PIECE_BYTES are measured in pieces, in time
    in proportion to their bytes and some 100 MB with 40 bytes a word of memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 3 tables of 2^BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in slices(batches):
            c, p = measured(texts, shared.value)
            out = failed(c)
            yield pa.record_batch({"doc_id": pa.array(names, pa.int64())} | {k: pa.array(v) for k, v in c.items()} | {"base_failed": pa.array(out), "score": pa.array(p), "kept": pa.array(~out & (p >= keep))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, " + FIELDS)


def measured(texts: list[bytes], model: NgramModel) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and probabilities of texts: together, but for long ones."""
    long = np.array([len(x) > PIECE_BYTES for x in texts], bool)
    short = [x for x, y in zip(texts, long.tolist(), strict=True) if not y]
    z = np.zeros(len(texts))
    c = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    if short:
        t = of_texts(short)
        for k, v in base_counts(short, t).items():
            c[k][~long] = v
        z[~long] = model.raw(t)
    for i in np.flatnonzero(long).tolist():
        own, z[i] = long_text(texts[i], model)
        for k, v in own.items():
            c[k][i] = v
    return c, model.calibrated(z)


def filter_documents(docs: DataFrame, model: NgramModel, keep: float = KEEP) -> DataFrame:
    """The documents that the rules keep, columns as given. Judged in place: nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[bytes]) -> np.ndarray:
        c, p = measured(texts, shared.value)
        return ~failed(c) & (p >= keep)

    @F.pandas_udf("boolean")
    def verdict(text: pd.Series) -> pd.Series:
        return judged(text, judge)

    return docs.where(verdict("text"))


def trained(spark, sf_dir: str, rows: int = TRAIN_ROWS) -> NgramModel:
    return fit(labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), rows))


def op10_query(spark, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
