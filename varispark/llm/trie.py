"""The prefix trie of conversations from the longest common prefixes of neighbours in sorted order.

A conversation is the string of its turns' 128-bit names; sorted, neighbours share prefixes of lcp turns. A node of
the trie is a stretch of conversations between the nearest smaller lcp on its left and on its right, and the stretches
form the Cartesian tree of the lcp array; equal lcps under one parent are one node. One stretch may be several nodes,
one below the other: it is kept as a chain (base, depth] and the missing depths are put in at the end.

Nearest smaller values are found in parallel. Every block of neighbours runs a stack over its own lcps; stretches that
end inside are done. What a block can't decide are its prefix minima, under which it continues what came before, and
its suffix minima, under which it stays open. Those few values with what is summed up under them go through the same
stack once more. Counts, least ids, leaves and saved words are summed up in the stack, so nothing is looked up again.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import read, written

#: Bytes of a turn's name.
TURN = 16
#: Ids in one piece of a list of ids that goes on in another block.
PIECE = 4096
BATCH = 2048
NOTHING = hashlib.sha256(b"").hexdigest()
_WORDS = r"[^\x20\x09-\x0D]+"

#: Chains, what blocks left open ("drop": added under a stretch of earlier blocks, "open": goes on in later ones), pieces of ids.
_ROW = (
    "kind string, pid int, at long, node binary, parent binary, base long, depth long, low long, n long, children long, leaves long, saved long, "
    "first_saved long, before array<long>, ends string, more boolean, seq binary, words array<long>, piece string"
)


def conversations(turns: DataFrame, shared: Column | None = None, group: int = 20) -> DataFrame:
    """(conv_id, seq, words): one row a conversation, seq its turns' names one after another, words of each turn.

    Turns stand in order of `turn` (null first), then of their names; null role or text is empty; rows without a
    conv_id are left out. With `shared`, a conversation c is rebuilt: the first `shared` turns of conversation
    c - c % group, then its own turns after as many. A conversation is one row of 20 bytes a turn, which Spark limits to
    2 GB, a hundred million turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turn = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), name.alias("name"), F.regexp_count(text, F.lit(_WORDS)).alias("words"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["name"]), "")).alias("seq"), F.transform("t", lambda x: x["words"]).alias("words"))
    if shared is None:
        return own
    most = TURN * 3
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__first"), F.substring("seq", 1, most).alias("__seq"), F.slice("words", 1, 3).alias("__words"))
    both = own.withColumn("__h", shared.cast("int")).join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("__first"), "left")
    head, tail = F.expr(f"substring(__seq, 1, {TURN} * __h)"), F.expr(f"substring(seq, {TURN} * __h + 1)")
    words = F.concat(F.expr("coalesce(slice(__words, 1, __h), cast(array() as array<int>))"), F.expr("slice(words, __h + 1, size(words))"))
    return both.select("conv_id", F.concat(F.coalesce(head, F.unhex(F.lit(""))), tail).alias("seq"), words.alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // TURN


def _named(seq: bytes, depth: int) -> bytes:
    return hashlib.blake2b(seq[: TURN * depth], digest_size=TURN).digest()


@dataclass
class Open:
    """A stretch that isn't closed: its depth, its first conversation's turns and running words, and sums over it.

    saved adds up words in the prefixes that conversations but the first share with the one before them; first_saved
    is what the first one shares.
    """

    depth: int
    seq: bytes = b""
    words: list[int] = field(default_factory=lambda: [0])
    low: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    first_saved: int = 0
    more: bool = False
    ends: list[int] = field(default_factory=list)

    def add(self, low: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved


class Stack:
    """Open stretches, depths ascending; close() is called with each that ends and its base depth."""

    def __init__(self, bottom: Open, close: Callable[[Open, int], None]):
        self.open, self.close = [bottom], close

    def down_to(self, lcp: int) -> None:
        """End all deeper stretches; one of depth lcp is open afterwards, unless the bottom is deeper itself."""
        while len(self.open) > 1 and self.open[-1].depth > lcp:
            top = self.open.pop()
            top.leaves = top.leaves or 1
            base = max(lcp, self.open[-1].depth)
            self.close(top, base)
            if self.open[-1].depth < lcp:
                self.open.append(Open(lcp, top.seq, top.words, top.low, top.n, 1, top.leaves, top.saved, top.first_saved))
            else:
                self.open[-1].add(top.low, top.n, 1, top.leaves, top.saved + top.first_saved)


def _chain(x: Open, base: int) -> dict:
    """Nodes base + 1 to depth of one stretch; before: the words in front of each one's last turn."""
    ends = None if x.more else hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()
    before = [x.words[max(d - 1, 0)] for d in range(base + 1, x.depth + 1)]
    parent = _named(x.seq, base) if base >= 0 else None
    return {"kind": "chain", "node": _named(x.seq, x.depth), "parent": parent, "base": base, "depth": x.depth, "low": x.low, "n": x.n, "children": x.children, "leaves": x.leaves, "saved": x.saved, "before": before, "ends": ends, "more": x.more}


def _left(pid: int, at: int, kind: str, x: Open) -> Iterator[dict]:
    """What a block leaves of a stretch, with the ids that end there."""
    out = {"kind": kind, "pid": pid, "at": at, "depth": x.depth, "low": x.low, "n": x.n, "children": x.children, "leaves": x.leaves, "saved": x.saved, "first_saved": x.first_saved, "more": x.more or bool(x.ends)}
    if kind == "open":
        out |= {"seq": x.seq[: TURN * x.depth], "words": x.words[: x.depth + 1]}
    yield out
    yield from _pieces(x)


def _pieces(x: Open) -> Iterator[dict]:
    for i in range(0, len(x.ends), PIECE):
        yield {"kind": "ends", "at": x.ends[i], "node": _named(x.seq, x.depth), "piece": ",".join(map(str, x.ends[i : i + PIECE]))}


def _block(pid: int, rows: Iterator[tuple[int, int, bytes, list[int]]]) -> Iterator[dict]:
    """From the rows (lcp, conv_id, seq, words) of one block, in order: chains that end inside, and what stays open."""
    done: list[dict] = []
    stack, at = None, 0
    for lcp, conv, seq, counts in rows:
        if stack is None:
            stack = Stack(Open(lcp), lambda x, base: done.append(_chain(x, base)))
        stack.down_to(lcp)
        bottom = stack.open[0]
        if bottom.depth > lcp:  # a new prefix minimum
            done.extend(_left(pid, at, "drop", bottom))
            bottom = stack.open[0] = Open(lcp)
            at += 1
        words = [0, *np.cumsum(counts).tolist()]
        length, shared = len(seq) // TURN, words[max(lcp, 0)]
        if length > lcp:
            stack.open.append(Open(length, seq, words, conv, 1, first_saved=shared, ends=[conv]))
        else:  # equal to the conversation before
            top = stack.open[-1]
            top.add(conv, 1, 0, 0, shared)
            top.seq = seq
            top.ends.append(conv)
        yield from done
        done.clear()
    for i, x in enumerate(stack.open if stack else ()):
        yield from _left(pid, at + i, "open" if i else "drop", x)


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """What blocks left open, in order, through the stack once more."""
    done: list[dict] = []
    stack = Stack(Open(-1), lambda x, base: done.append(_chain(x, base)))
    for r in rows:
        if r["kind"] == "open":
            stack.open.append(Open(r["depth"], r["seq"], r["words"], r["low"], r["n"], r["children"], r["leaves"], r["saved"], r["first_saved"], r["more"]))
        else:
            stack.down_to(r["depth"])
            top = stack.open[-1]
            top.add(r["low"], r["n"], r["children"], r["leaves"], r["saved"])
            top.more |= r["more"]
        yield from done
        done.clear()
    stack.down_to(-1)
    yield from done


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            yield from b.slice(i, BATCH).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(text))


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in its partition and the turns it shares with the row before; null for the first."""
    last, k = None, 0
    for b in batches:
        lcp = []
        for x in b.column("seq"):
            seq = x.as_py()
            lcp.append(None if last is None else common_turns(last, seq))
            last = seq
        yield pa.record_batch([*b.columns, pa.array(range(k, k + b.num_rows), pa.int64()), pa.array(lcp, pa.int64())], [*b.schema.names, "k", "lcp"])
        k += b.num_rows


def _first_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared = [common_turns(x.as_py(), y.as_py()) if x.is_valid else -1 for x, y in zip(b.column("last"), b.column("first"), strict=True)]
        yield pa.record_batch({"pid": b.column("pid"), "first_lcp": pa.array(shared, pa.int64())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come together and in order; one piece is held at a time."""
    rows = ((x.as_py(), y.as_py()) for b in batches for x, y in zip(b.column(0), b.column(1), strict=True))
    for node, pieces in itertools.groupby(rows, key=lambda r: r[0]):
        told = hashlib.sha256()
        for i, (_, piece) in enumerate(pieces):
            told.update(("," * bool(i) + piece).encode())
        yield pa.record_batch({"ended": pa.array([node], pa.binary()), "sha": pa.array([told.hexdigest()])})


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie over convs (conv_id, seq, words): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns end at the root; an empty table has no node. conv_id must be unique and not null. A
    conversation that a third of all rows repeat is spread over blocks, since equal ones are dealt by conv_id; its ids
    meet in pieces of 4,096 for the one SHA-256 that needs them in order. What all blocks leave open goes through one
    task: in b blocks over t turns at most sqrt(2 b t) values, as a block with v different lcps holds v * v / 2 turns.
    """
    dealt = convs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("pid", F.spark_partition_id())
    ordered = written(dealt.mapInArrow(_with_lcp, "conv_id long, seq binary, words array<int>, pid int, k long, lcp long"), "sorted-conversations")
    ends = ordered.groupBy("pid").agg(F.min_by("seq", "k").alias("first"), F.max_by("seq", "k").alias("own_last"))
    ends = ends.select("pid", "first", F.lag("own_last").over(W.orderBy("pid")).alias("last"))  # a row a block
    known = ordered.join(ends.mapInArrow(_first_lcp, "pid int, first_lcp long"), "pid")
    schema = _schema(_ROW)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["pid"], (r["lcp"], r["conv_id"], r["seq"], r["words"])) for r in _rows(batches))
        made = (x for pid, own in itertools.groupby(rows, key=lambda r: r[0]) for x in _block(pid, (r[1] for r in own)))
        yield from _batches(made, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_joined(_rows(batches)), schema)

    blocks = known.select("pid", "k", F.coalesce("lcp", "first_lcp").alias("lcp"), "conv_id", "seq", "words").repartition("pid").sortWithinPartitions("pid", "k")
    found = written(blocks.mapInArrow(block, _ROW), "trie-blocks")
    rest = found.where(F.col("kind").isin("drop", "open")).repartition(1).sortWithinPartitions("pid", "at").mapInArrow(join, _ROW)
    chains = written(found.where("kind = 'chain'").unionByName(rest), "trie-chains")
    pieces = found.where("kind = 'ends'").select("node", "piece", "at").repartition("node").sortWithinPartitions("node", "at").select("node", "piece")
    sums = pieces.mapInArrow(_digests, "ended binary, sha string")
    above = chains.select(F.col("node").alias("__node"), F.col("low").alias("above"))
    out = chains.join(above, F.col("parent") == F.col("__node"), "left").join(sums, F.col("node") == F.col("ended"), "left")
    out = out.select("*", F.posexplode("before").alias("i", "words_before"))
    d, low = F.col("base") + 1 + F.col("i"), F.col("low")
    last = d == F.col("depth")
    return out.select(
        low.alias("conv_id"),
        d.alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(low).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("words_before")).alias("saved_tokens"),
        F.when(~last, NOTHING).otherwise(F.coalesce("sha", "ends")).alias("ends_sha256"),
    )


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie(written(conversations(read(spark, sf_dir, "conversations"), shared), "rebuilt-conversations"))


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bits AS (
  SELECT conv_id, t, flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]) AS steps FROM own
), hashed AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(list_prepend(4294967295, steps), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 4 AS h FROM bits
), rebuilt AS (
  SELECT a.conv_id, coalesce(b.t[1:a.h], []) || a.t[a.h + 1:] AS t FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(t) AS total, d AS depth, t[1:d] AS p FROM rebuilt, LATERAL (SELECT unnest(range(len(t) + 1)) AS d)
), nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^ 	-]+')) END AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '') AS ended
  FROM prefixes GROUP BY p, depth
), parented AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS n_children FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves,
  CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, sha256(a.ended) AS ends_sha256
FROM parented a JOIN parented b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p
GROUP BY a.p, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ended
"""
