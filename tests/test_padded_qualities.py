"""Qualities of padded reads, laid out in batches."""

from pyspark.sql import functions as F

from varispark.functions import batches, scales


def test_qualities_stand_between_pads(spark):
    rows = [(1, "A*C", [1, 2], False), (2, "A*CG", [1, 2, 3], True), (3, "", [], False), (4, None, [1], False), (5, "AC*G", [7], False), (6, "*é*A", [4, 5], False), (7, "AC", None, False)]
    df = spark.createDataFrame(rows, "k int, b string, q array<int>, c boolean").coalesce(1)
    laid = df.select("k", scales.padded_qualities(F.col("b"), F.col("q"), F.col("c")).alias("x"))
    got = {r["k"]: r["x"] for r in laid.collect()}
    assert got == {1: [1, -1, 2], 2: [3, -1, 2, 1], 3: [], 4: None, 5: [7, None, -1, None], 6: [-1, 4, -1, 5], 7: [None, None]}
    assert batches.spread_qualities.__name__ in laid._jdf.queryExecution().optimizedPlan().toString()  # a batch at once
