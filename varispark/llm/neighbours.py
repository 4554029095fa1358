"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by joins of neighbours of neighbours.

Lists start from windows in random-hyperplane orders. In a round every vector is a pivot: the vectors that it lists
and that list it meet there, and each pair among them may enter the other's list. Rounds run on vectors of bytes;
edges near the threshold are then computed in double precision and those that reach it stay. Where a list is full of
links it may have missed some: such a vector is compared in blocks with all vectors but those that the triangle
inequality of angles rules out. Before that, its list grows with the component that it belongs to so far, up to K_MOST, and
rounds go on: only vectors of larger components are compared so. An audit of a fixed number of vectors against all rows estimates
recall without bias, and descents go on while it is low; if it stays low, all vectors are compared in blocks.

Equal vectors are one node with a weight, so a vector that a third of all rows share is a single node.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import components, drop_table, read, written

log = logging.getLogger(__name__)

THRESHOLD = 0.9
#: Length of a neighbour list, and that up to which a list full of links grows.
K, K_MOST = 10, 80
#: Random orders for the first lists, neighbours taken to either side in each, and hyperplanes to an order.
ORDERS, SIDE, PLANES = 16, 2, 24
#: Vectors that meet at once at a pivot; the lists of one that more point to are dealt out anew each round.
MEET = 64
ROUNDS = 4
#: Vectors with and without links found that the audit asks, the recall it asks for, and how often further descents follow.
AUDIT, RECALL, RETRIES = (200, 1000), 0.95, 2
BLOCK = 512

LISTS = "h long, c array<long>, s array<float>"


def nodes_of(rows: DataFrame) -> DataFrame:
    """(vec_id, h, other, raw): sound vectors with 128 bits of hash and little-endian doubles; others have nulls.

    A vector is scaled by the power of two that brings its largest component to 0.5 or more, which changes no digit
    and keeps squares within the range of doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[bytes | None] = []
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ok = name is not None and x is not None and len(x) and all(v is not None for v in x)
                v = np.array(x, "<f8") + 0.0 if ok else np.zeros(0)  # no negative zeros
                ok = ok and np.isfinite(v).all() and v.any()
                raw.append(np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes() if ok else None)
            h = [(None, None) if x is None else np.frombuffer(xxhash.xxh3_128_digest(x), ">i8").tolist() for x in raw]
            one, other = (pa.array([x[k] for x in h], pa.int64()) for k in (0, 1))
            yield pa.record_batch({"vec_id": b.column(0), "h": one, "other": other, "raw": pa.array(raw, pa.binary())})

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, h long, other long, raw binary")


def apart(every: DataFrame) -> DataFrame:
    """every (vec_id, h, raw): of vectors that share 64 bits of hash but not the other 64, all but one are named anew."""
    shared = every.groupBy("h").agg(F.min("other").alias("first"), F.max("other").alias("last")).where("first <> last").select("h", "first")
    shared = written(shared, "shared-hashes")  # next to never any: Spark knows its size before it joins
    name = F.when(F.col("other") != F.col("first"), F.xxhash64("h", "other")).otherwise(F.col("h"))
    return every.join(shared, "h", "left").select("vec_id", name.alias("h"), "raw")


def to_bytes(raw: bytes) -> bytes:
    v = np.frombuffer(raw, "<f8")
    return np.rint(v * (127 / np.abs(v).max())).astype(np.int8).tobytes()


def rounding(raw: bytes) -> float:
    """Sine of the angle, at most, between a vector and its vector of bytes."""
    v = np.frombuffer(raw, "<f8") * (127 / np.abs(np.frombuffer(raw, "<f8")).max())
    return float(np.linalg.norm(np.rint(v) - v) / np.linalg.norm(v))


def margin_of(nodes: DataFrame, threshold: float) -> float:
    """By how much the cosine of two byte vectors may fall short of that of the vectors, at the threshold.

    Rounding turns no vector by more than the greatest angle found among these; both ends of a link turn.
    """

    @F.pandas_udf(DoubleType())
    def sine(raw: pd.Series) -> pd.Series:
        return raw.map(rounding).astype("float64")

    worst = nodes.agg(F.max(sine("raw")).alias("r")).first()["r"] or 0.0
    return threshold - float(np.cos(min(np.pi, np.arccos(threshold) + 2 * np.arcsin(min(1.0, worst))))) + 1e-5


def cosines(vectors: list[bytes], kind: str) -> np.ndarray:
    """All cosines among vectors given as bytes of one kind; -2 between vectors of different lengths."""
    size = np.array([len(x) for x in vectors])
    if (size == size[0]).all():
        m = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float32 if kind == "i1" else np.float64)
        m = m / np.sqrt((m * m).sum(1, keepdims=True))
        return m @ m.T
    out = np.full((len(vectors), len(vectors)), -2.0)
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        out[np.ix_(at, at)] = cosines([vectors[i] for i in at], kind)
    return out


def offers(ids: list[int], vectors: list[bytes], worst: np.ndarray, caps: list[int]) -> Iterator[tuple[int, list[int], list[float]]]:
    """For each vector, the others here that are closer than the worst on its list, as many as its list may hold."""
    sims = cosines(vectors, "i1")
    np.fill_diagonal(sims, -3)
    good = sims > np.maximum(worst, -1.5)[:, None]
    names = np.array(ids)
    for i in np.flatnonzero(good.any(1)).tolist():
        at, k = np.flatnonzero(good[i]), caps[i]
        if len(at) > k:
            at = at[np.argpartition(-sims[i, at], k - 1)[:k]]
        yield ids[i], names[at].tolist(), sims[i, at].tolist()


def batch_of(rows: list[tuple[int, list[int], list[float]]]) -> pa.RecordBatch:
    h, c, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.list_(pa.int64())), "s": pa.array(s, pa.list_(pa.float32()))})


def first_lists(nodes: DataFrame, orders: int, seed: int) -> DataFrame:
    """LISTS rows: neighbours of (h, q) in orders by the signs of random projections."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            q = b.column(1).to_pylist()
            for t in range(orders):
                code = np.zeros(len(q), np.int64)
                size = np.array([len(x) for x in q])
                for d in np.unique(size).tolist():
                    if (d, t) not in planes:
                        planes[d, t] = np.random.default_rng([seed, t, d]).normal(size=(d, PLANES))
                    at = np.flatnonzero(size == d)
                    m = np.frombuffer(b"".join([q[i] for i in at]), "i1").reshape(len(at), d).astype(np.float64)
                    code[at] = ((m @ planes[d, t]) > 0) @ (1 << np.arange(PLANES)[::-1])
                yield pa.record_batch({"t": pa.array(np.full(len(q), t, np.int32)), "code": pa.array(code), "h": b.column(0), "q": b.column(1)})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for b in batches:
            rows = last + list(zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
            out: list[tuple] = []
            for t, group in groupby(rows, key=lambda r: r[0]):
                own = list(group)
                for at in range(0, len(own), 256):
                    part = own[at : at + 256 + SIDE]
                    sims = cosines([r[2] for r in part], "i1")
                    for d in range(1, SIDE + 1):
                        for i in range(len(part) - d):
                            out.append((part[i][1], [part[i + d][1]], [float(sims[i, i + d])]))
                            out.append((part[i + d][1], [part[i][1]], [float(sims[i, i + d])]))
            last = rows[-SIDE:]
            yield batch_of([r for r in out if r[2][0] > -1.5])

    spread = nodes.select("h", "q").mapInArrow(place, "t int, code long, h long, q binary")
    ordered = spread.repartitionByRange(n, "t", "code", "h").sortWithinPartitions("t", "code", "h")
    return ordered.mapInArrow(windows, LISTS)


def merged(state: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """state (h, q, cap, c, s) with the best `cap` of its lists and found; how many entries are new."""
    new = found.groupBy("h").agg(F.flatten(F.collect_list("c")).alias("nc"), F.flatten(F.collect_list("s")).alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs, ss, fresh = [], [], []
            for cap, c, s, nc, ns in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
                best = dict(zip(c or (), s or (), strict=True))
                old = set(best)
                best.update(zip(nc or (), ns or (), strict=True))
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:cap]
                cs.append([x for x, _ in top])
                ss.append([x for _, x in top])
                fresh.append(sum(x not in old for x, _ in top))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cs, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.float32())), pa.array(fresh, pa.int64())], names=["h", "q", "cap", "c", "s", "fresh"])

    seen = Observation()
    out = state.join(new, "h", "left").select("h", "q", "cap", "c", "s", "nc", "ns").mapInArrow(run, "h long, q binary, cap int, c array<long>, s array<float>, fresh long")
    out = written(out.observe(seen, F.sum("fresh").alias("n")).drop("fresh"), "neighbours")
    return out, seen.get["n"] or 0


def descend(state: DataFrame, seed: int) -> DataFrame:
    """LISTS rows: what one round of meetings at pivots offers."""
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worst = F.when(F.size("c") >= F.col("cap"), F.array_min("s")).otherwise(F.lit(-1.5)).cast("float")
    own = state.select("h", "q", worst.alias("worst"), "cap", "c")
    edges = own.select(F.col("h").alias("src"), F.explode("c").alias("dst"))
    rooms = edges.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEET)).cast("int").alias("rooms"))
    own = own.join(rooms, own["h"] == rooms["dst"], "left").select("h", "q", "worst", "cap", "c", F.coalesce("rooms", F.lit(1)).alias("rooms"))
    room = lambda pivot, rooms: F.pmod(F.xxhash64(F.col(pivot), F.col("m"), F.lit(seed)), F.col(rooms)).cast("int")
    listed = own.select(F.col("h").alias("m"), "q", "worst", "cap")
    size = own.select(F.col("h").alias("pivot"), "rooms")
    # Those that a pivot lists, and those that list it (with it itself), each sent with its vector.
    forward = edges.select(F.col("src").alias("pivot"), F.col("dst").alias("m")).join(listed, "m").join(size, "pivot")
    reverse = listed.join(edges.select(F.col("src").alias("m"), F.col("dst").alias("pivot")), "m").join(size, "pivot")
    itself = own.select(F.col("h").alias("pivot"), F.col("h").alias("m"), "q", "worst", "cap", "rooms")
    cols = ["pivot", "m", "q", "worst", "cap", "rooms"]
    met = forward.select(*cols).union(reverse.select(*cols)).union(itself.select(*cols))
    met = met.select("pivot", room("pivot", "rooms").alias("room"), "m", "q", "worst", "cap")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)

        held: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            members = {r[2]: r[3:] for r in group}
            if len(members) > 1:
                ids = list(members)
                held += offers(ids, [members[i][0] for i in ids], np.array([members[i][1] for i in ids]), [members[i][2] for i in ids])
            if len(held) > 20_000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    return met.repartition(n, "pivot", "room").sortWithinPartitions("pivot", "room").mapInArrow(join, LISTS)


def exact_links(state: DataFrame, nodes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(u, v, cos), u > v: edges on either's list whose cosine in double precision reaches the threshold."""
    edges = state.select("h", F.explode(F.arrays_zip("c", "s")).alias("e")).where(F.col("e.s") >= threshold - margin)
    edges = edges.select(F.greatest("h", "e.c").alias("u"), F.least("h", "e.c").alias("v")).distinct()
    raw = nodes.select("h", "raw")
    both = edges.join(raw.withColumnsRenamed({"h": "u", "raw": "a"}), "u").join(raw.withColumnsRenamed({"h": "v", "raw": "b"}), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = np.array([cosine(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], float)
            yield pa.record_batch({"u": b.column(0), "v": b.column(1), "cos": pa.array(cos)}).filter(pa.array(cos >= threshold))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, cos double")


def cosine(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<f8"), np.frombuffer(b, "<f8")
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def cross(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cosines of each of a with each of b, given as doubles; -2 between vectors of different lengths."""
    out = np.full((len(a), len(b)), -2.0)
    of_a, of_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for d in np.intersect1d(of_a, of_b):
        i, j = np.flatnonzero(of_a == d), np.flatnonzero(of_b == d)
        out[np.ix_(i, j)] = unit([a[x] for x in i]) @ unit([b[x] for x in j]).T
    return out


@F.pandas_udf(DoubleType())
def cosine_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([cosine(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def placed(full: DataFrame, nodes: DataFrame, comp: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(h, w, raw, comp, ball): nodes with their component so far; ball is null but for the nodes of full (h, c, s).

    A ball is named by a node: the component's, if that is at the threshold or closer, else the least of the node
    and of the close ones on its list. A ball's members are near its node, so few others come near the ball.
    """
    close = F.transform(F.filter(F.arrays_zip("c", "s"), lambda e: e["s"] >= threshold - margin), lambda e: e["c"])
    near = full.select(F.col("h").alias("node"), F.array_min(F.concat(F.array("h"), close)).alias("near"))
    own = nodes.join(comp, F.col("h") == F.col("node"), "left").select("h", "w", "raw", F.coalesce("component", "h").alias("comp"))
    own = own.join(near, F.col("h") == F.col("node"), "left").drop("node")
    roots = nodes.select(F.col("h").alias("comp"), F.col("raw").alias("root"))
    chosen = own.where("near is not null").join(roots, "comp").select("h", "w", "raw", "comp", F.when(cosine_of("raw", "root") >= threshold, F.col("comp")).otherwise(F.col("near")).alias("ball"))
    return written(chosen.union(own.where("near is null").select("h", "w", "raw", "comp", F.col("near").alias("ball"))), "placed")


def candidates(every: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(ball, h, w, raw, comp, own): the nodes that may reach the threshold with a member of the ball.

    By the triangle inequality of angles none is left out: a ball's reach is the greatest angle between its node and
    a member, and the threshold's angle. Balls and nodes are dealt into blocks and compared block by block.
    """
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centers = nodes.select(F.col("h").alias("ball"), F.col("raw").alias("center"))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_of("raw", "center"))))
    balls = every.where("ball is not null").join(centers, "ball").select("ball", "center", reach.alias("r"))
    balls = balls.groupBy("ball").agg(F.first("center").alias("raw"), (F.max("r") + float(np.arccos(threshold)) + 1e-6).alias("reach"))
    balls = written(balls, "balls")
    nb, nn = -(-balls.count() // BLOCK), -(-every.count() // (8 * BLOCK))
    deal = lambda size: F.pmod(F.xxhash64("h"), F.lit(size)).cast("int")
    over = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    none = F.lit(None).cast("long")
    left = balls.select(F.col("ball").alias("h"), none.alias("w"), "raw", none.alias("comp"), none.alias("own"), "reach")
    left = left.withColumn("x", deal(max(nb, 1))).withColumn("y", over(max(nn, 1)))
    right = every.select("h", "w", "raw", "comp", F.col("ball").alias("own"), F.lit(None).cast("double").alias("reach"))
    right = right.withColumn("y", deal(max(nn, 1))).withColumn("x", over(max(nb, 1)))
    cols = ["x", "y", "h", "w", "raw", "comp", "own", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows_of(batches), key=lambda r: r[:2]):
            rows = list(group)
            asked, rest = [r for r in rows if r[7] is not None], [r for r in rows if r[7] is None]
            if not asked or not rest:
                continue
            cos = cross([r[4] for r in asked], [r[4] for r in rest])
            inside = (cos > -1.5) & (np.arccos(np.clip(cos, -1, 1)) <= np.array([r[7] for r in asked])[:, None])
            for i in np.flatnonzero(inside.any(1)).tolist():
                own = [rest[j] for j in np.flatnonzero(inside[i]).tolist()]
                cols = [pa.array([r[k] for r in own], pa.binary() if k == 4 else pa.int64()) for k in (2, 3, 4, 5, 6)]
                yield pa.record_batch([pa.array([asked[i][2]] * len(own), pa.int64()), *cols], names=["ball", "h", "w", "raw", "comp", "own"])

    dealt = left.select(*cols).union(right.select(*cols)).repartition(n, "x", "y").sortWithinPartitions("x", "y")
    return written(dealt.mapInArrow(run, "ball long, h long, w long, raw binary, comp long, own long"), "candidates")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def ball_links(near: DataFrame, threshold: float) -> DataFrame:
    """(h, links, u, v) of candidates: weights of links with a member of a ball, by node, and components that meet.

    Members count all their links, other nodes those with members; several rows of a node add up. Rows (u, v) name
    two components with a link between them. A ball's members and candidates are dealt into blocks of about BLOCK;
    each pair of blocks is one small task's work and no pairs are written.
    """
    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / F.lit(BLOCK))).cast("int")
    sizes = near.groupBy("ball").agg(blocks(F.col("own") == F.col("ball")).alias("nm"), blocks(F.lit(True)).alias("nc"))
    rows = near.join(sizes, "ball")
    deal = lambda size: F.pmod(F.xxhash64("h"), F.col(size)).cast("int")
    over = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    cols = ["ball", "x", "y", "member", "h", "w", "raw", "comp", "own"]
    members = rows.where("own = ball").withColumn("x", deal("nm")).withColumn("y", over("nc")).withColumn("member", F.lit(True))
    others = rows.withColumn("y", deal("nc")).withColumn("x", over("nm")).withColumn("member", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows_of(batches), key=lambda r: r[:3]):
            own = list(group)
            a, b = [r for r in own if r[3]], [r for r in own if not r[3]]
            if not a or not b:
                continue
            ids, names = np.array([r[4] for r in a]), np.array([r[4] for r in b])
            linked = (cross([r[6] for r in a], [r[6] for r in b]) >= threshold) & (ids[:, None] != names[None, :])
            free = np.array([r[8] is None for r in b])
            counts = [*(linked @ np.array([r[5] for r in b], np.int64)).tolist(), *(linked.T @ np.array([r[5] for r in a], np.int64))[free].tolist()]
            ca, cb = np.array([r[7] for r in a]), np.array([r[7] for r in b])
            i, j = np.nonzero(linked & (ca[:, None] != cb[None, :]))
            meet = sorted(set(zip(ca[i].tolist(), cb[j].tolist(), strict=True)))
            pad, gap = [None] * len(counts), [None] * len(meet)
            out = [[*ids.tolist(), *names[free].tolist(), *gap], [*counts, *gap], [*pad, *[u for u, _ in meet]], [*pad, *[v for _, v in meet]]]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["h", "links", "u", "v"])

    dealt = members.select(*cols).union(others.select(*cols)).repartition(n, "ball", "x", "y").sortWithinPartitions("ball", "x", "y")
    return written(dealt.mapInArrow(run, "h long, links long, u long, v long"), "ball-links")


def saturated(threshold: float, margin: float) -> Column:
    """Whether a list is full of links, so that it may lack some."""
    return (F.size("c") >= F.col("cap")) & (F.array_min("s") >= threshold - margin)


def refined(state: DataFrame, seed: int, rounds: int) -> DataFrame:
    """state after rounds of meetings, until nothing new comes."""
    for r in range(rounds):
        old = state
        state, fresh = merged(state, descend(state, seed + r))
        drop_table(old)
        if not fresh:
            break
    return state


def enlarged(state: DataFrame, seed: int, rounds: int, most: int, threshold: float, margin: float) -> DataFrame:
    """state after lists full of links have grown to hold their component so far and K more, with rounds after that,
    until no list is full but those of `most` and those of vectors whose component is larger than any list."""
    while True:
        full = written(state.where(saturated(threshold, margin) & (F.col("cap") < most)).select("h"), "full-lists")
        if full.limit(1).count() == 0:
            return state
        near = F.filter(F.arrays_zip("c", "s"), lambda e: e["s"] >= threshold - margin)
        comp = written(components(state.select(F.col("h").alias("u"), F.explode(F.transform(near, lambda e: e["c"])).alias("v"))), "list-components")
        sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
        grown = full.join(comp, F.col("h") == F.col("node")).join(sizes, "component").select(F.col("h").alias("g"), F.least(F.col("n") + K, F.lit(most)).cast("int").alias("room"))
        grown = written(grown, "grown-lists")
        if grown.limit(1).count() == 0:
            return state
        old = state
        state = written(state.join(grown, F.col("h") == F.col("g"), "left").select("h", "q", F.coalesce("room", "cap").alias("cap"), "c", "s"), "neighbours")
        drop_table(old)
        state = refined(state, seed, rounds)
        seed += rounds


def counted(state: DataFrame, nodes: DataFrame, threshold: float, margin: float, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """((h, w, links) of every node, components (node, component)).

    Nodes whose list is full of links, or all of them if whole, are compared with every node that may link with
    them; links between other nodes are those on their lists.
    """
    links = written(exact_links(state, nodes, threshold, margin), "links")
    comp = written(components(links.select("u", "v")), "node-components")
    full = state if whole else state.where(saturated(threshold, margin))
    every = placed(full.select("h", "c", "s"), nodes, comp, threshold, margin)
    dense = ball_links(candidates(every, nodes, threshold), threshold)
    free = every.where("ball is null").select("h", "w")
    way = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    listed = way.join(free.select(F.col("h").alias("v"), "w"), "v").join(free.select(F.col("h").alias("u")), "u", "left_semi").select(F.col("u").alias("h"), F.col("w").alias("links"))
    total = listed.union(dense.where("links is not null").select("h", "links")).groupBy("h").agg(F.sum("links").alias("links"))
    counts = written(nodes.select("h", "w").join(total, "h", "left").select("h", "w", F.coalesce("links", F.lit(0)).alias("links")), "link-counts")
    met = components(dense.where("u is not null").select("u", "v")).select(F.col("node").alias("comp"), "component")
    label = every.join(met, "comp", "left").select(F.col("h").alias("node"), F.coalesce("component", "comp").alias("component"))
    return counts, written(label, "node-components")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sizes: tuple[int, int] = AUDIT) -> float:
    """Recall: the mean, over all nodes that have links, of the share of a node's links that were found.

    Nodes with links found and nodes without are two strata, of which sizes[0] and sizes[1] are drawn by hash, and each
    counts for as many as its stratum has: of the second, those that do have links count as recall 0. Their vectors,
    a fixed number, go to all tasks and meet every row.
    """
    some, none = (counts.agg(F.count_if(c)).first()[0] for c in (F.col("links") > 0, F.col("links") == 0))
    linked = counts.where("links > 0").orderBy(F.xxhash64("h")).limit(sizes[0]).select("h", "links")
    rest = counts.where("links = 0").orderBy(F.xxhash64("h", F.lit(1))).limit(sizes[1]).select("h", "links")
    asked = linked.union(rest).join(nodes.select("h", "raw"), "h").collect()
    if not asked:
        return 1.0
    queries = nodes.sparkSession.sparkContext.broadcast([(r["h"], bytes(r["raw"])) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries.value), np.int64)
        names = np.array([h for h, _ in queries.value])
        for b in batches:
            h, w, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            size = np.array([len(x) for x in raw])
            for d in np.unique(size).tolist():
                at, ask = np.flatnonzero(size == d), [i for i, (_, x) in enumerate(queries.value) if len(x) == d]
                if ask:
                    m = unit([raw[i] for i in at])
                    near = unit([queries.value[i][1] for i in ask]) @ m.T >= threshold
                    total[ask] += (near & (names[ask][:, None] != h[at][None, :])) @ w[at]
        yield pa.record_batch({"i": pa.array(np.arange(len(total))), "n": pa.array(total)})

    true = {r["i"]: r["n"] for r in nodes.select("h", "w", "raw").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    shares = [min(1.0, r["links"] / true[i]) if true.get(i) else 1.0 for i, r in enumerate(asked) if r["links"]]
    missed = [bool(true.get(i)) for i, r in enumerate(asked) if not r["links"]]
    lost = none * float(np.mean(missed)) if missed else 0.0
    return some * float(np.mean(shares)) / (some + lost) if shares else float(not lost)


def unit(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = K, rounds: int = ROUNDS, most: int = K_MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of (vec_id, embedding).

    n_links counts other rows at the threshold or closer, equal vectors among them. Vectors that are null, empty or
    zero, hold null or non-finite components, or have no vec_id link with nothing; vectors of different lengths don't
    link. Repeated rows each give a row; an empty table gives none; other columns are ignored. recall is what the
    audit last estimated, the same in all rows; if it stays low after RETRIES, all vectors are compared exactly, and it
    is 1.
    """
    every = written(apart(written(nodes_of(rows), "vectors")), "vectors")
    nodes = every.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("raw").alias("raw"))
    nodes = written(nodes, "nodes")

    @F.pandas_udf("binary")
    def quantised(raw):  # noqa: ANN001, ANN202
        return raw.map(to_bytes)

    state = written(nodes.select("h", quantised("raw").alias("q"), F.lit(k).cast("int").alias("cap"), F.array().cast("array<long>").alias("c"), F.array().cast("array<float>").alias("s")), "neighbours")
    margin = margin_of(nodes, threshold)
    for attempt in range(RETRIES + 1):
        state, _ = merged(state, first_lists(state, ORDERS, attempt))
        state = refined(state, 100 * attempt, rounds)
        state = enlarged(state, 100 * attempt + 50, rounds, most, threshold, margin)
        counts, comp = counted(state, nodes, threshold, margin)
        recall = audit(nodes, counts, threshold)
        log.info("recall %.4f after %d descents", recall, attempt + 1)
        if recall >= RECALL:
            break
    else:
        log.warning("recall %.4f stays below %.2f: all vectors are compared", recall, RECALL)
        counts, comp = counted(state, nodes, threshold, margin, whole=True)
        recall = 1.0
    label = nodes.join(comp, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("component", "h").alias("root"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = label.join(least, "root").join(counts.select("h", "w", "links"), "h").select("h", "component_id", (F.col("links") + F.col("w") - 1).alias("n_links"))
    out = every.select("vec_id", "h").join(label, "h", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings")).drop("recall")
