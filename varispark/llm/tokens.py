"""Token ids as frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Table format: Parquet rows in ascending doc_id order (file by file, row by row), one per document:
`part`, `part_start` (ids before the document in its part), `n_tokens`, `control` and `data`. Ids are replaced with
their rank by corpus frequency; a rank takes one to four little-endian bytes in `data`, and the number of bytes less
one stands in two bits of `control`, four ranks a byte, first rank lowest. `ranks` holds the ids in rank order.
A row is an ordinary Parquet row, so a lost task is simply written again, and one document can be read alone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, new_path, read, written

#: Words whose ids a Python worker remembers, in each of two generations.
CACHE_WORDS = 400_000
#: Bytes of text that are encoded at once.
RUN_BYTES = 16 << 20
#: A Latin word and the marks after it: these two are pre-tokens of their own in the tokenizer's pattern.
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of the runs `which`, laid end to end; run i of `values` stops before ends[i]."""
    size = np.diff(ends, prepend=0)
    n = size[which]
    out = np.cumsum(n)
    place = np.arange(int(out[-1]) if len(out) else 0) + np.repeat((ends - size)[which] - (out - n), n)
    return values[place], out


def text_runs(b: pa.RecordBatch, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (any, text) whose texts have about `most` bytes, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, stop - at)
        at = stop


class WordEncoder(dict):
    """Ids of whole texts by a tokenizer of the tokenizers library that splits at white space and drops it.

    Such a tokenizer encodes a text as the concatenation of what it makes of the parts between ASCII white space, so
    every distinct part of a run of texts is encoded once; the dictionary remembers them from run to run, as
    little-endian bytes. A plain word goes to the tokenizer's model in lower case, apart from the marks after it, as
    the tokenizer would pre-tokenise it; all else goes through the whole tokenizer. The strings of special tokens are
    ordinary text in a document, as the tokenizers' description has it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model, self.older = self.tokenizer.model, {}
        self.raw = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.size)]
        level, letters = ByteLevel(add_prefix_space=False, use_regex=False), [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.spelled = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        # Lower case and no white space are what the shortcut takes for granted; one word with all of it must agree.
        self.short = True
        for probe in ("ThingÀÖØÞß,.", "ÿöNa!!", "Straßen", "a'", "the"):
            m = re.fullmatch(_PLAIN, probe)
            self.short &= self._piece(m["core"].lower()) + self._piece(m["tail"]) == self._whole(probe)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, word: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]) if word else b""

    def _looked_up(self, words: list, make: Callable) -> list[bytes]:
        out = list(map(self.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            out[i] = ids = self.older[word] if word in self.older else make(word)
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return out

    def rest(self) -> None:
        """At a task's end: forget the older words, so that a worker that goes on to other stages holds less."""
        self.older = {}
        pa.default_memory_pool().release_unused()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts of an Arrow string column, end to end; null texts are empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        words, n = coded.dictionary, len(coded.dictionary)
        plain = pc.extract_regex(words, _PLAIN) if self.short else pa.nulls(n, pa.struct([("core", pa.string()), ("tail", pa.string())]))
        core = pc.utf8_lower(pc.struct_field(plain, "core")).dictionary_encode()
        tail = pc.struct_field(plain, "tail").dictionary_encode()
        odd = np.flatnonzero(pc.is_null(plain).to_numpy(zero_copy_only=False))
        # Pieces: the empty one, cores, tails and odd words; every word is two pieces.
        pieces = [b"", *self._looked_up(core.dictionary.to_pylist(), self._piece), *self._looked_up(tail.dictionary.to_pylist(), self._piece)]
        two = np.zeros((n, 2), np.int64)
        two[:, 0] = pc.fill_null(core.indices, -1).to_numpy(zero_copy_only=False) + 1
        two[:, 1] = np.where(two[:, 0], pc.fill_null(tail.indices, -1).to_numpy(zero_copy_only=False) + 1 + len(core.dictionary), 0)
        two[odd, 0] = len(pieces) + np.arange(len(odd))
        pieces += self._looked_up(words.take(pa.array(odd)).to_pylist(), lambda w: self._whole(w) if w else b"")
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) // self.dtype.itemsize
        flat, ends = gathered(np.frombuffer(b"".join(pieces), self.dtype), ends, two.ravel())
        flat, ends = gathered(flat, ends[1::2], coded.indices.to_numpy())
        return flat, np.concatenate(([0], ends))[parts.offsets.to_numpy()[1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text, in UTF-8, its ids as little-endian bytes of self.dtype."""
        ids, ends = self.encode_column(pa.array([x.decode() for x in texts], pa.string()))
        raw, ends = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
        return [raw[i:j] for i, j in pairwise(ends)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) with end_id after each run."""
    out = np.empty(len(ids) + len(ends), ids.dtype)
    stop = ends + np.arange(1, len(ends) + 1)
    own = np.ones(len(out), bool)
    own[stop - 1] = False
    out[own], out[stop - 1] = ids, end_id
    return out, stop


def binary_runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the runs of a numpy array."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * values.dtype.itemsize
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raise ValueError("a run of texts has 2 GB of ids")


def encode_varint(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    return encode_many(ranks, np.array([len(ranks)]))[0]


def encode_many(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) of each of several runs of ranks that lie end to end."""
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    room = -(-counts // 4)
    code = np.zeros(int(room.sum()) * 4, np.uint8)
    code[np.arange(len(ranks)) + np.repeat((np.cumsum(room) - room) * 4 - (np.cumsum(counts) - counts), counts)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = four[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    rooms = np.concatenate(([0], np.cumsum(room))).tolist()
    return [(control[rooms[i] : rooms[i + 1]], data[ends[i] : ends[i + 1]]) for i in range(len(counts))]


#: For each control byte, the sizes of its four ranks.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_varint(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: sizes by table lookup over control bytes, then gathered from data."""
    return decode_many(control, data, np.array([n]))


def decode_many(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks, end to end, of runs whose control bytes and data are put together."""
    room = -(-counts // 4)
    place = np.arange(int(counts.sum())) + np.repeat((np.cumsum(room) - room) * 4 - (np.cumsum(counts) - counts), counts)
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[place]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    flat = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    four = np.ndarray(max(len(flat) - 3, 0), "<u4", flat.tobytes(), strides=(1,))  # the four bytes from each place
    return four[starts] & _KEEP[sizes]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, counts): the ids of each whole text and end_id, two or four little-endian bytes each; a last row
    of every task without ids has the counts of all ids of the task as int64s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        counts = np.zeros(max(encoder.size, end_id + 1), np.int64)
        for b in batches:
            for part in text_runs(b):
                ids, ends = ended(*encoder.encode_column(part.column(1)), end_id)
                counts += np.bincount(ids, minlength=len(counts))
                yield pa.record_batch({"doc_id": part.column(0), "ids": binary_runs(ids, ends), "counts": pa.nulls(len(ends), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})
        encoder.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: the tasks' counts summed by Spark; one row for each id of the vocabulary comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                more = np.frombuffer(x, np.int64)
                total = more + np.pad(total, (0, len(more) - len(total)))
        ids = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(ids.astype(np.int64)), "n": pa.array(total[ids])})

    sums = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    out = np.zeros(max([0, *rows["id"].to_pylist()]) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def rank_order(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, then by id: the id of each rank."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the token table of docs at path/tokens and path/ranks.

    Null and empty texts have end_id alone; equal doc_ids lie side by side in any order; an empty table makes an
    empty one. Columns besides doc_id and text are ignored. Texts are encoded once; the encoded rows are then dealt
    out by ranges of doc_id, so parts hold like numbers of documents whatever the sources are.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer, end_id), "ids", PACKED)
    order = rank_order(id_counts(tokens))
    width = word_encoder(tokenizer).dtype
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            raw = b.column(1).to_pylist()
            n = np.array([len(x) // width.itemsize for x in raw], np.int64)
            coded: list[tuple[bytes, bytes]] = []
            for at in range(0, len(raw), 256):
                coded += encode_many(rank[np.frombuffer(b"".join(raw[at : at + 256]), width)], n[at : at + 256])
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            control, data = (pa.array([x[k] for x in coded], pa.binary()) for k in (0, 1))
            yield pa.record_batch({"part": pa.array(np.full(len(n), part, np.int64)), "doc_id": b.column(0), "part_start": pa.array(starts), "n_tokens": pa.array(n), "control": control, "data": data})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_by = F.col("doc_id").asc_nulls_first()
    ordered = tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange(n, order_by).sortWithinPartitions(order_by)
    ordered.mapInArrow(encode, "part long, doc_id long, part_start long, n_tokens long, control binary, data binary").write.options(**PACKED).parquet(f"{path}/tokens")
    spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, order.tolist()))), ","))).selectExpr("pos as rank", "cast(col as long) as id").write.parquet(f"{path}/ranks")


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): decoded from the table; ids as little-endian unsigned 32-bit integers.

    The sizes of the parts, one row a part, and the ranks, one a vocabulary entry, come to the driver.
    """
    table = spark.read.parquet(f"{path}/tokens")
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    first, total = {}, 0
    for r in sizes:
        first[r["part"]], total = total, total + r["n"]
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, doc, start, n, control, data = (b.column(i) for i in range(6))
            counts, controls, datas = n.to_numpy(), control.to_pylist(), data.to_pylist()
            ids: list[bytes] = []
            for at in range(0, len(counts), 256):
                k = counts[at : at + 256]
                raw = order[decode_many(b"".join(controls[at : at + 256]), b"".join(datas[at : at + 256]), k)].tobytes()
                cuts = [0, *(np.cumsum(k) * 4).tolist()]
                ids += [raw[i:j] for i, j in pairwise(cuts)]
            begin = [first[p] + s for p, s in zip(part.to_pylist(), start.to_pylist(), strict=True)]
            yield pa.record_batch({"doc_id": doc, "start": pa.array(begin, pa.int64()), "n_tokens": n, "ids": pa.array(ids, pa.binary())})

    return table.select("part", "doc_id", "part_start", "n_tokens", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 1)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


