"""Rows dealt out by ranges of a whole number that are found from that number alone.

repartitionByRange() samples the whole plan below it, so all columns of all rows are made once more; here Spark makes only
what the number needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a range is made for, as long as there are no more ranges than shuffle partitions.
RANGE_ROWS = 20_000


def bounds(rows: DataFrame, place: Column) -> list[int]:
    """Upper ends, in order, of all ranges but the last, of about equal numbers of rows."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / most) for k in range(1, most)]) if most > 1 else F.array(F.lit(0.5))
    n, ends = rows.select(place.alias("p")).agg(F.count(F.lit(1)), F.percentile_approx("p", shares, 10_000)).first()
    parts = max(1, min(most, -(-n // RANGE_ROWS)))
    return sorted({ends[k * most // parts - 1] for k in range(1, parts)}) if ends else []


def range_of(place: Column, ends: list[int], first: int = 0) -> Column:
    """How many of the ends lie below place, by halves; nulls are in the last range."""
    if not ends:
        return F.lit(first)
    m = len(ends) // 2
    return F.when(place <= ends[m], range_of(place, ends[:m], first)).otherwise(range_of(place, ends[m + 1 :], first + m + 1))


def by_ranges(rows: DataFrame, place: Column, ends: list[int]) -> DataFrame:
    return rows.repartitionById(len(ends) + 1, range_of(place, ends))
