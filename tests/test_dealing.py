"""Ranges found from a number alone: equal ones, in order, and no other column made twice."""

from pyspark.sql import functions as F

from varispark.functions import dealing


def test_ranges_are_in_order_and_rows_made_once(spark, monkeypatch):
    monkeypatch.setattr(dealing, "RANGE_ROWS", 100)
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def text(n):
        made.add(1)
        return n

    rows = spark.range(0, 1000, 1, 5).select((F.col("id") * 37 % 1000).alias("k"), text("id").alias("x"))
    ends = dealing.bounds(rows, F.col("k"))
    dealt = dealing.by_ranges(rows, F.col("k"), ends).withColumn("part", F.spark_partition_id())
    got = [tuple(r) for r in dealt.select("part", "k", "x").collect()]
    assert made.value == 1000 and len(ends) == 3
    of = {p: sorted(k for q, k, _ in got if q == p) for p in range(4)}
    assert sum((of[p] for p in range(4)), []) == list(range(1000))
    assert all(200 <= len(x) <= 300 for x in of.values())


def test_no_rows_and_one_number(spark):
    assert dealing.bounds(spark.range(0), F.col("id")) == []
    rows = spark.range(50).select(F.lit(3).cast("long").alias("k"))
    assert dealing.by_ranges(rows, F.col("k"), dealing.bounds(rows, F.col("k"))).count() == 50
