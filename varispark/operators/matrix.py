"""Sample-by-marker matrices in long form (sample, col, value): summaries, order, combination, distance, clusters.

Null values are missing measurements. All but clusters and greedy columns, which take rounds, are one or two grouped passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..config import MatrixConfig
from ..sources.paths import scratch


def change_percent(m: DataFrame, threshold: int) -> DataFrame:
    """(col, gain, loss, either): whole percent of samples at +threshold or more, -threshold or less, and both."""
    v, n = F.col("value"), F.count(F.lit(1))
    pct = lambda c: F.floor(F.count_if(c) * 100 / n)
    return m.groupBy("col").agg(pct(v >= threshold).alias("gain"), pct(v <= -threshold).alias("loss"), pct(F.abs(v) >= threshold).alias("either"))


def histogram(m: DataFrame) -> DataFrame:
    """(sample, subset, value, n): counts of absolute values by sample, by subset and over all, in one pass."""
    v = m.where("value is not null").select("sample", "subset", F.abs("value").alias("value"))
    sets = v.groupingSets([["sample", "value"], ["subset", "value"], ["value"]], "sample", "subset", "value")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def gradients(m: DataFrame, cfg: MatrixConfig = MatrixConfig()) -> DataFrame:
    """(value): rungs of a color scale, the least values with the given shares of cells at or below them.

    The counts of at most 99 absolute values are what the windows run over.
    """
    n = m.where("value is not null").groupBy(F.abs("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("upto", F.sum("n").over(Window.orderBy("value"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    shares = F.explode(F.array(*[F.lit(x) for x in cfg.gradient_shares])).alias("share")
    rungs = n.select("value", "upto", "total", shares).where(F.col("upto") >= F.floor(F.col("total") * F.col("share"))).groupBy("share").agg(F.min("value").alias("value"))
    return rungs.select("value").where("value not in (0, 99)").distinct().orderBy(F.desc("value")).limit(cfg.gradients_kept)


def frequency(m: DataFrame, positive: bool = True) -> DataFrame:
    """(col, percent) of columns with any value above 0, most frequent first."""
    p = m.groupBy("col").agg((F.count_if(F.col("value") > 0) * 100.0 / F.count(F.lit(1))).alias("percent"))
    return p.where("percent > 0").orderBy(F.desc("percent"), "col")


def representative(m: DataFrame, how: str = "average", sign: int = 0) -> DataFrame:
    """(patient, col, value): a patient's value over its samples: their average or the one farthest from 0.

    sign: 1 or -1 for values above or below 0 alone; ties of the farthest go to the greater.
    """
    v = m.where("value is not null")
    v = v.where(F.col("value") * sign > 0) if sign else v
    agg = F.avg("value") if how == "average" else F.max_by("value", F.struct(F.abs("value"), F.col("value"))).cast("double")
    return v.groupBy("patient", "col").agg(agg.alias("value"))


def arrays(m: DataFrame) -> DataFrame:
    """(sample, at, vec): the places and values of each sample's cells that have a value, in order of place.

    The place of a cell is the rank of its column among all columns of the matrix, so samples that lack cells still
    line up. Of several cells of a sample in one column the greatest counts. A sample without values has empty arrays.
    """
    columns = numbered(m.where("col is not null").select("col").distinct(), [F.asc("col")], "at").withColumn("at", F.col("at") - 1)
    cell = F.when(F.col("value").isNotNull() & F.col("at").isNotNull(), F.struct("at", "value"))
    cells = F.array_sort(F.collect_list(cell))
    rows = m.join(columns, "col", "left").groupBy("sample").agg(cells.alias("c"))
    return rows.select("sample", F.transform("c", lambda x: x["at"]).alias("at"), F.transform("c", lambda x: x["value"]).alias("vec"))


def dense(at: pa.ListArray, vec: pa.ListArray) -> np.ndarray:
    """Rows of values by place, nan where there is none; as wide as the places go."""
    size = np.asarray(at.value_lengths().fill_null(0), np.int64)
    place = np.asarray(at.flatten(), np.int64)
    out = np.full((len(at), int(place.max(initial=-1)) + 1), np.nan)
    out[np.repeat(np.arange(len(at)), size), place] = np.asarray(vec.flatten(), float)
    return out


def euclidean(a: Column, b: Column, limit: int | None = None) -> Column:
    """Over places where both have values, with values held within +-limit; null where no place has both."""
    held = (lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))) if limit else (lambda x: x)
    sq = F.filter(F.zip_with(a, b, lambda x, y: F.pow(held(x) - held(y), F.lit(2))), lambda x: x.isNotNull())
    return F.when(F.size(sq) > 0, F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)))


def pearson(a: Column, b: Column) -> Column:
    """Over places where both have values; null if one of them doesn't vary there."""
    names = ("n", "x", "y", "xx", "yy", "xy")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def step(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        new = (s["n"] + 1, s["x"] + x, s["y"] + y, s["xx"] + x * x, s["yy"] + y * y, s["xy"] + x * y)
        return F.when(x.isNull() | y.isNull(), s).otherwise(F.struct(*[v.alias(k) for k, v in zip(names, new, strict=True)]))

    def finish(s: Column) -> Column:
        vx, vy = s["n"] * s["xx"] - s["x"] * s["x"], s["n"] * s["yy"] - s["y"] * s["y"]
        return F.when((vx > 0) & (vy > 0), (s["n"] * s["xy"] - s["x"] * s["y"]) / F.sqrt(vx * vy))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.aggregate(pairs, zero, step, finish)


def _operands(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of a and b with 0 for missing ones, and which there are. Whole numbers whose sums of products stay exact in
    32 bits are multiplied so, in half the time and with the same results."""
    p, q = ~np.isnan(a), ~np.isnan(b)
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    small = most * most * max(a.shape[1], 1) < 1 << 24 and bool((a == np.rint(a)).all() and (b == np.rint(b)).all())
    kind = np.float32 if small else np.float64
    return a.astype(kind), b.astype(kind), p.astype(kind), q.astype(kind)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T).astype(float)


def block_euclidean(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Of each row of a with each of b, over places where both have values; nan where there are none."""
    if limit is not None:
        a, b = np.clip(a, -limit, limit), np.clip(b, -limit, limit)
    a, b, p, q = _operands(a, b)
    square = _product(a * a, q) + _product(p, b * b) - 2 * _product(a, b)
    return np.where(p @ q.T > 0, np.sqrt(np.maximum(square, 0)), np.nan)


def block_pearson(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Of each row of a with each of b, over places where both have values; nan if one of them doesn't vary there."""
    a, b, p, q = _operands(a, b)
    n, x, y = _product(p, q), _product(a, q), _product(p, b)
    vx, vy = n * _product(a * a, q) - x * x, n * _product(p, b * b) - y * y
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((vx > 0) & (vy > 0), (n * _product(a, b) - x * y) / np.sqrt(vx * vy), np.nan)


DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray, int | None], np.ndarray]] = {"euclidean": block_euclidean, "pearson": block_pearson}


#: Cells of a block of samples (32 MB), and pairs that are compared at once (8 MB an array).
BLOCK_CELLS, PAIRS = 1 << 22, 1 << 20
SIGN = {"euclidean": 1.0, "pearson": -1.0}


def pair_distances(m: DataFrame, metric: str, limit: int | None = None, block: int | None = None, within: float | None = None, groups: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """(a, b, d) of pairs of samples, a < b, by `euclidean` (values held within +-limit) or `pearson`.

    All pairs are compared. within: only pairs at most so far apart (pearson: at least so alike) are given out; others
    never leave their task. forest: of these only as many as join what they join, fewer than the samples of two blocks a
    task, so that pairs that all lie near each other aren't written by the square. groups: (sample, group); only pairs within a group are compared. Samples are dealt into
    blocks, each copied once for every block that it meets: by default about 16 blocks, so that what is shuffled grows
    with the input, until a block would hold BLOCK_CELLS cells. A pair of blocks is worked through in strips of matrix
    products in one task. Cells that a sample lacks are missing, as null ones are; a pair without a common cell has a
    null distance.
    """
    n = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = _kept(m.select("sample", "col", F.col("value").cast("double").alias("value")), "cells")
    samples = m.select("sample").distinct().count()
    if block is None:
        width = m.select("col").distinct().count()
        block = max(min(512, BLOCK_CELLS // max(width, 1)), min(samples // 16, BLOCK_CELLS // max(width, 1)), 1)
    blocks = -(-samples // block) if groups is None else 1
    n = max(n, min(blocks * (blocks + 1) // 2, 256))
    own = m.select("sample").distinct().withColumn("g", F.lit(0)) if groups is None else groups.select("sample", F.col("group").alias("g"))
    sizes = own.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumnRenamed("g", "of")
    own = own.join(sizes, own["g"].eqNullSafe(sizes["of"])).select("sample", "g", "blocks")
    v = arrays(m).join(own, "sample").withColumn("k", F.pmod(F.xxhash64("sample"), F.col("blocks")).cast("int"))
    v = v.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = v.select("g", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "sample", "at", "vec").repartition(n, "g", "x", "y").sortWithinPartitions("g", "x", "y")
    sign = SIGN[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["g", "x", "y"]):
            k, x, y = t["k"].to_numpy(), t["x"][0].as_py(), t["y"][0].as_py()
            names, values = t["sample"].combine_chunks(), dense(t["at"].combine_chunks(), t["vec"].combine_chunks())
            left, right = np.flatnonzero(k == x), np.flatnonzero(k == y)
            strip = max(1, PAIRS // max(len(right), 1))
            part = np.arange(len(k))  # of each sample, by the pairs given out so far
            for s in range(0, len(left), strip):
                rows = left[s : s + strip]
                d = DISTANCES[metric](values[rows], values[right], limit)
                keep = np.ones(d.shape, bool) if within is None else sign * d <= sign * within
                keep = keep & np.less.outer(rows, right) if x == y else keep
                i, j = _joining(keep, rows, right, part) if forest else np.nonzero(keep)
                one, two = names.take(pa.array(rows[i])), names.take(pa.array(right[j]))
                first, far = pc.less(one, two), d[i, j]
                yield pa.record_batch([pc.if_else(first, one, two), pc.if_else(first, two, one), pa.array(far, mask=np.isnan(far))], names=["a", "b", "d"])

    kind = m.schema["sample"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, d double")


def _joining(keep: np.ndarray, rows: np.ndarray, right: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows and right that `keep` has those that join two parts; part is brought up to date."""
    i, j = [], []
    for r in np.flatnonzero(keep.any(1)).tolist():
        near = np.flatnonzero(keep[r])
        own, (others, first) = part[rows[r]], np.unique(part[right[near]], return_index=True)
        new = others != own
        if new.any():
            i += [r] * int(new.sum())
            j += near[first[new]].tolist()
            part[np.isin(part, others)] = own
    return np.array(i, np.int64), np.array(j, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that follow each other with equal keys, which aren't null."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in keys:
            col = b.column(c)
            new[1:] |= np.asarray(pc.not_equal(col[1:], col[:-1]))
            new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != col[0].as_py()
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start in cuts[1:-1] and held:
                yield pa.Table.from_batches(held)
                held = []
            if end > start:
                held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def cluster(
    m: DataFrame, metric: str = "pearson", threshold: float | None = None, linkage: str = "complete", initial: DataFrame | None = None, driver_clusters: int = 1000
) -> DataFrame:
    """(sample, cluster) of clusters of two initial clusters or more, largest first; agglomerative, to a threshold.

    initial: (sample, label) of clusters to begin with, such as patients or all-zero rows; without it, and for samples
    that it lacks, each sample is its own. Pairs of samples within the threshold are a table, or for other than complete linkage as
    many of them as join the same samples; others play no part: minimum linkage gives the components of the graph that they make, and a mean within the threshold needs a pair
    within it, so mean linkage takes the other pairs of a component alone. For complete and mean linkage a round joins
    all pairs whose clusters are each other's nearest, by distance and then by least samples; that joins what joining
    the closest pair again and again joins. Once at most `driver_clusters` clusters have a pair within the threshold
    left, the driver joins them by the same rule over their distances, at most the square of that number.
    """
    cfg = MatrixConfig()
    limit = threshold if threshold is not None else (cfg.pearson_threshold if metric == "pearson" else cfg.euclidean_threshold)
    sign = SIGN[metric]
    label = m.select("sample").distinct()
    if initial is None:
        label = label.withColumn("label", F.col("sample"))
    else:
        own = label.join(initial.select("sample", F.col("label").alias("given")).dropDuplicates(["sample"]), "sample", "left")
        least = own.where("given is not null").groupBy("given").agg(F.min("sample").alias("least"))
        label = own.join(least, "given", "left").select("sample", F.coalesce("least", "sample").alias("label"))
    label = _kept(label, "labels")
    d = _kept(pair_distances(m, metric, within=limit, forest=linkage != "complete").withColumn("d", F.lit(sign) * F.col("d")), "near")
    if linkage == "complete":
        label = _by_rounds(_joined(d.withColumn("w", F.lit(1)), _moves(label), label, linkage), label, sign * limit, linkage, driver_clusters)
    else:
        one, two = label.select(F.col("sample").alias("a"), F.col("label").alias("u")), label.select(F.col("sample").alias("b"), F.col("label").alias("v"))
        top = components(d.join(one, "a").join(two, "b").select("u", "v"))
        if linkage == "minimum":
            label = label.join(top, label["label"] == top["node"], "left").select("sample", F.coalesce("component", "label").alias("label"))
        else:
            held = label.join(top, label["label"] == top["node"]).select("sample", F.col("component").alias("group"))
            d = pair_distances(m, metric, groups=_kept(held, "groups")).where("d is not null").withColumn("d", F.lit(sign) * F.col("d"))
            label = _by_rounds(_joined(d.withColumn("w", F.lit(1)), _moves(label), label, linkage), label, sign * limit, linkage, driver_clusters)
    first = label if initial is None else label.join(initial.select("sample", F.col("label").alias("given")).dropDuplicates(["sample"]), "sample", "left")
    parts = F.count(F.lit(1)) if initial is None else F.count_distinct(F.struct("given", F.when(F.col("given").isNull(), F.col("sample"))))
    big = first.groupBy("label").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).where("parts > 1")
    ranked = numbered(big, [F.desc("n"), F.asc("label")], "cluster").select("label", (F.col("cluster") - 1).cast("int").alias("cluster"))
    return label.join(ranked, "label").select("sample", "cluster")


def _moves(label: DataFrame) -> DataFrame:
    return label.select(F.col("sample").alias("old"), F.col("label").alias("new"))


def _by_rounds(pairs: DataFrame, label: DataFrame, limit: float, linkage: str, driver_clusters: int) -> DataFrame:
    """label (sample, label) after clusters of `pairs` were joined in rounds and then by the driver."""
    while True:
        pairs = _kept(pairs, "pairs")
        near = pairs.where(F.col("d") <= limit)
        live = near.select("a").union(near.select("b")).distinct()
        n = live.count()
        if n <= driver_clusters:
            break
        key = F.struct("d", "a", "b")
        ends = near.select(F.explode(F.array("a", "b")).alias("c"), "d", "a", "b").groupBy("c").agg(F.min(key).alias("best"))
        step = ends.groupBy("best.a", "best.b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("b").alias("old"), F.col("a").alias("new"))
        step = _kept(step, "step")
        label = _kept(label.join(step, label["label"] == step["old"], "left").select("sample", F.coalesce("new", "label").alias("label")), "labels")
        pairs = _joined(pairs, step, label, linkage)
    own = label.join(live.select(F.col("a").alias("label")), "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["label"]: r["n"] for r in sorted(own, key=lambda r: r["label"])}
    names, at = list(sizes), {c: i for i, c in enumerate(sizes)}
    held = live.select(F.col("a").alias("c"))
    left = pairs.join(held.withColumnRenamed("c", "a"), "a", "left_semi").join(held.withColumnRenamed("c", "b"), "b", "left_semi").select("a", "b", "d").toArrow()
    grid = np.full((len(names), len(names)), np.inf)
    for a, b, x in zip(*(left.column(c).to_pylist() for c in ("a", "b", "d")), strict=True):
        grid[at[a], at[b]] = grid[at[b], at[a]] = x
    groups = merge(grid, limit, linkage, np.array(list(sizes.values()), float))
    kind = label.schema["sample"].dataType.simpleString()
    last = label.sparkSession.createDataFrame([(names[i], names[g[0]]) for g in groups for i in g[1:]], f"old {kind}, new {kind}")
    return label.join(last, label["label"] == last["old"], "left").select("sample", F.coalesce("new", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), component the least node that is reachable.

    Large and small stars in turn until the edges stand still: rounds grow with the logarithm of the longest path.
    """
    e, state = _star(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large, _ = _star(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e, new = _star(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low))
        if new == state:
            break
        state = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(edges: DataFrame) -> tuple[DataFrame, Row]:
    """Distinct edges, written, with their number and a sum that tells when they stand still."""
    out = _kept(edges.where("u <> v").distinct(), "edges")
    return out, out.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def _joined(pairs: DataFrame, moves: DataFrame, label: DataFrame, linkage: str) -> DataFrame:
    """(a, b, d, w) of pairs after clusters moved (old, new): distance d over w pairs of samples, those of `label`.

    Complete and mean linkage need the distance of every pair of samples: a pair of clusters that lacks one goes.
    """
    one, two = moves.select(F.col("old").alias("a"), F.col("new").alias("to_a")), moves.select(F.col("old").alias("b"), F.col("new").alias("to_b"))
    p = pairs.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "d", "w")
    p = p.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d", "w")
    how = {"complete": F.max("d"), "minimum": F.min("d")}.get(linkage, F.sum(F.col("d") * F.col("w")) / F.sum("w"))
    g = p.groupBy("a", "b").agg(how.alias("d"), F.sum("w").alias("w"))
    if linkage != "minimum":
        sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        g = g.join(sizes.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
        g = g.where(F.col("w") == F.col("na") * F.col("nb"))
    return g.select("a", "b", "d", "w")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a cut in the plan that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places from 1 by `order`, which must leave no ties.

    Rows are sorted in ranges, one a task; a row's place is its place in its range behind the counts of the ranges
    before, so no task holds more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", row)
    ranged = _kept(ranged.withColumn("_range", F.shiftright("_id", 33)), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(before, "_range").withColumn(name, place).drop("_id", "_range", "_before")


def merge(d: np.ndarray, limit: float, linkage: str, sizes: np.ndarray | None = None) -> list[list[int]]:
    """Groups of indices after joining the closest two, again and again, while they are within the limit.

    sizes: how many samples each index stands for, one without it; mean linkage weighs by them.
    """
    join = {"complete": np.maximum, "minimum": np.minimum}.get(linkage)
    d, groups = d.copy(), [[i] for i in range(len(d))]
    live, size = np.ones(len(d), bool), np.ones(len(d)) if sizes is None else sizes.copy()
    while live.sum() > 1:
        i, j = divmod(int(np.argmin(np.where(live[:, None] & live[None, :], d, np.inf))), len(d))
        if not d[i, j] <= limit:
            break
        i, j = min(i, j), max(i, j)
        row = join(d[i], d[j]) if join else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        live[j], size[i] = False, size[i] + size[j]
        groups[i] = sorted(groups[i] + groups[j])
        groups[j] = []
    return [g for g in groups if g]


def greedy_columns(m: DataFrame, threshold: int, up: bool = True) -> DataFrame:
    """(place, col, patient, value): columns by the share of patients left that reach the threshold, and those patients.

    Each step takes the column that most of the patients left reach, by greatest count then least column, and its
    patients, whose place within the step is by value (their average in that column), then by patient. Patients are
    reduced to the columns that they reach, a written table; a step counts the columns of those that none of the
    columns taken so far holds, so the driver keeps the columns taken alone, and there are no more steps than columns.
    """
    hit = F.max("value") >= threshold if up else F.min("value") <= -threshold
    cells = m.where("value is not null").groupBy("patient", "col").agg(hit.alias("hit"), F.avg("value").alias("value")).where("hit")
    reach = _kept(cells.groupBy("patient").agg(F.collect_set("col").alias("cols")), "reach")
    taken: list = []
    kind = m.schema["col"].dataType
    while True:
        held = F.array(*map(F.lit, taken)).cast(ArrayType(kind))
        left = reach.where(~F.arrays_overlap("cols", held)) if taken else reach
        best = left.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "col").first()
        if best is None:
            break
        taken.append(best["col"])
    places = m.sparkSession.createDataFrame(list(enumerate(taken)), StructType([StructField("place", IntegerType()), StructField("col", kind)]))
    first = cells.join(places, "col").groupBy("patient").agg(F.min(F.struct("place", "col", "value")).alias("s"))
    return first.select("s.place", "s.col", "patient", "s.value").orderBy("place", "value", "patient")


def combine_rows(parent: DataFrame, other: DataFrame, tag: str) -> DataFrame:
    """Rows of other under the parent's columns: each behind the parent's row of its patient, others at the end."""
    cols = parent.select("col").distinct()
    extra = other.join(cols, "col", "left_semi").join(parent.select("patient").distinct().withColumn("known", F.lit(True)), "patient", "left")
    first = parent.select("patient", "sample", "col", "value", F.lit(0).alias("source"), F.lit(0).alias("block"))
    more = extra.select("patient", F.concat("sample", F.lit(f"-{tag}")).alias("sample"), "col", "value", F.lit(1).alias("source"), F.when(F.col("known"), 0).otherwise(1).alias("block"))
    return first.unionByName(more)


def combine_columns(parent: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Cells side by side: (patient, col, kind, value) with a full outer join on patient and column."""
    both = parent.select("patient", "col", F.col("value").alias("a")).join(other.select("patient", "col", F.col("value").alias("b")), ["patient", "col"], "full_outer")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).alias("value")) for n, c in zip(names, "ab", strict=True)])).alias("k")
    return both.select("patient", "col", kinds).select("patient", "col", "k.kind", "k.value")


def combine_subsets(m: DataFrame, first: object, p: Callable[[Column], Column], second: object, q: Callable[[Column], Column], how: str) -> DataFrame:
    """(patient, col, value): 1 where p holds for the first subset's cell and/or q for the second's; null counts as no."""
    v = m.groupBy("patient", "col").agg(F.max(F.when(F.col("subset") == first, F.col("value"))).alias("a"), F.max(F.when(F.col("subset") == second, F.col("value"))).alias("b"))
    a, b = F.coalesce(p(F.col("a")), F.lit(False)), F.coalesce(q(F.col("b")), F.lit(False))
    return v.select("patient", "col", (a & b if how == "and" else a | b).cast("int").alias("value"))


def sort_by_column(m: DataFrame, col: int, how: str = "average") -> DataFrame:
    """(patient, value, place): patients by their value in a column, missing first, then by name."""
    rep = representative(m.where(F.col("col") == col), how).drop("col")
    every = m.select("patient").distinct().join(rep, "patient", "left")
    return numbered(every, [F.col("value").asc_nulls_first(), F.asc("patient")], "place")


def order_by_list(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """(patient, rank, place) in a given order (name, rank) without regard to case; others follow, those with values first."""
    p = m.groupBy("patient").agg((F.count("value") > 0).alias("has_values"))
    j = p.join(wanted, F.lower(p["patient"].cast("string")) == F.lower(wanted["name"]), "left")
    group = F.when(F.col("rank").isNotNull(), 0).when(F.col("has_values"), 1).otherwise(2)
    return numbered(j.select("patient", "rank", group.alias("group")), [F.asc("group"), F.col("rank").asc_nulls_last(), F.asc("patient")], "place").drop("group")


def display_bins(m: DataFrame, size: int) -> DataFrame:
    """(bin, most): the greatest value of each run of `size` columns, on a scale to 100."""
    b = m.groupBy(F.floor(F.col("col") / size).cast("int").alias("bin")).agg(F.max("value").alias("most"))
    top = b.agg(F.max("most").alias("top"))
    return b.join(top, F.lit(True)).select("bin", "most", F.floor(F.col("most") * 100 / F.col("top")).cast("int").alias("scaled"))


def dividers(order: DataFrame) -> DataFrame:
    """(place, patient, divider): whether a new patient begins, where some patient has several rows.

    places follow each other without gaps, so a row meets the one before it in a join and no task holds all rows.
    """
    before = order.select((F.col("place") + 1).cast(order.schema["place"].dataType).alias("place"), F.col("patient").alias("last"))
    multi = order.groupBy("patient").count().agg((F.max("count") > 1).alias("multi"))  # one row
    new = F.coalesce(F.col("last") != F.col("patient"), F.lit(False))
    return order.join(before, "place", "left").join(multi, F.lit(True)).select("place", "patient", (new & F.col("multi")).alias("divider"))


def statistics(m: DataFrame, by: str) -> DataFrame:
    """Mean, middle element (place n/2), population variance and deviation, and half width of the 95 % interval."""
    v = F.col("value").cast("double")
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").cast(m.schema["value"].dataType)  # counts of values, not their list
    return m.where("value is not null").groupBy(by).agg(
        F.avg(v).alias("mean"), middle.alias("median"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"), (1.96 * F.stddev_pop(v) / F.sqrt(F.count(F.lit(1)))).alias("bound")
    )


def subset_columns(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """m with the wanted columns alone, numbered anew from 0; null columns are left out."""
    new = numbered(wanted.where("col is not null").select("col").distinct(), [F.asc("col")], "new")
    return m.join(new, "col").select("sample", (F.col("new") - 1).cast("int").alias("col"), "value")
