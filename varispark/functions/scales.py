"""Scales and small encodings: phred, intensities, gradient buckets, masks of alleles, comment options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches


def phred_probability(q: Column) -> Column:
    """Error probability by whole decades of a quality: 19 counts as 10."""
    return F.pow(F.lit(10.0), -F.floor(q / 10).cast("double"))


def allele_mask(bases: Column) -> Column:
    """A 1, C 2, G 4, T 8, added up over the bases of a text."""
    bit = lambda b, n: F.when(F.upper(bases).contains(b), n).otherwise(0)
    return bit("A", 1) + bit("C", 2) + bit("G", 4) + bit("T", 8)


def normalised_alleles(observed: Column, strand: Column) -> Column:
    """Alleles like A/G on the plus strand."""
    return F.when(strand == "-", F.translate(observed, "ACGT", "TGCA")).otherwise(observed)


def intensity_by_level(df: DataFrame, field: str) -> DataFrame:
    """df with intensity: the place of a value among the field's distinct values, from 0 to 1."""
    w = Window.orderBy(field)
    levels = df.select(field).distinct().where(F.col(field).isNotNull()).withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    scaled = levels.select(F.col(field).alias("__v"), F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(1.0).alias("intensity"))
    return df.join(scaled, F.col(field) == F.col("__v"), "left").drop("__v")


def shaded(value: Column, most: Column) -> Column:
    """Half intensity at 0, full at most, in proportion between."""
    return 0.5 + 0.5 * F.least(F.greatest(value / most, F.lit(0.0)), F.lit(1.0))


def gradient_bucket(value: Column, rungs: list[int]) -> Column:
    """0 below the first rung, then the number of rungs reached; the last one goes on to the clamp."""
    out = F.lit(0)
    for k, r in enumerate(sorted(rungs), 1):
        out = F.when(F.abs(value) >= r, k).otherwise(out)
    return out


def bucket_intensity(bucket: Column, n: int, least: int = 40) -> Column:
    """Percent: even steps from the least intensity to 100."""
    step = (100 - least) / (n - 1) if n > 1 else 0
    return F.when(bucket == 0, 0.0).otherwise(F.lit(float(least)) + (bucket - 1) * F.lit(float(step)))


def comment_option(line: Column) -> Column:
    """struct<key, value> of '#key=value', null fields for other lines."""
    part = lambda k: F.nullif(F.regexp_extract(line, "^#([^=]+)=(.*)$", k), F.lit(""))
    return F.struct(part(1).alias("key"), part(2).alias("value"))


def neutral_level(text: Column) -> Column:
    """Average of comma-separated levels."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def quality_runs(qual: Column, quality: int, least: int) -> Column:
    """Whether qualities hold a run of `least` equal to `quality`."""
    text = F.array_join(F.transform(qual, lambda q: F.when(q == quality, "x").otherwise(".")), "")
    return text.contains("x" * least)


def saturated_bytes(counts: Column) -> Column:
    """Counts as unsigned 16-bit little-endian binary, held at 65535."""
    one = lambda c: F.concat(F.lpad(F.hex(F.least(c, F.lit(65535)).cast("long") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.least(c, F.lit(65535)) / 256)), 2, "0"))
    return F.unhex(F.array_join(F.transform(counts, one), ""))


def masked_range(values: Column, start: Column, end: Column) -> Column:
    """An array without the places start to end, from 0 and inclusive."""
    return F.filter(values, lambda _, i: ~i.between(start, end))


def padded_qualities(bases: Column, qual: Column, complemented: Column) -> Column:
    """Qualities for a padded read: turned round if it is complemented, -1 at pads."""
    return F.arrow_udf(batches.spread_qualities, "array<int>")(bases, F.when(complemented, F.reverse(qual)).otherwise(qual))
