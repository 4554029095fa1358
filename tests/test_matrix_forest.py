"""Pairs within a threshold that join the same samples as all of them, and no more than that."""

import random

from varispark.operators import matrix as ops


def test_forest_joins_what_all_pairs_join(spark):
    rng = random.Random(5)
    cells = [(s, c, (s % 3) * 40 + rng.randrange(3)) for s in range(60) for c in range(8)] + [(100 + s, c, 1000 * s + c + 1000) for s in range(5) for c in range(8)]
    m = spark.createDataFrame(cells, "sample long, col int, value int")
    every = ops.pair_distances(m, "euclidean", within=30.0, block=16)
    some = ops.pair_distances(m, "euclidean", within=30.0, block=16, forest=True)
    pairs, few = {tuple(r) for r in every.collect()}, {tuple(r) for r in some.collect()}
    assert len(pairs) == 3 * 20 * 19 // 2
    assert few < pairs
    assert len(few) < 15 * 2 * 30  # fewer than the samples of two blocks for each pair of blocks
    group = lambda e: sorted(map(tuple, ops.components(e.selectExpr("a AS u", "b AS v")).collect()))
    assert group(every) == group(some)


def test_clusters_write_few_pairs(spark, monkeypatch):
    """All samples alike: pairs grow with the square, what is written doesn't."""
    m = spark.createDataFrame([(s, c, c * c + s) for s in range(200) for c in range(6)], "sample long, col int, value int")
    rows, kept = {}, ops._kept

    def counted(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ops, "_kept", counted)
    assert {r["cluster"] for r in ops.cluster(m, "pearson", 0.9, "minimum").collect()} == {0}
    assert rows["near"] == 199
