"""CIGAR strings as column expressions: operations, aligned blocks, ends, indel events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that use up reference positions in an alignment, and those that use up read bases.
ON_REFERENCE, ON_READ, ALIGNED = ["M", "=", "X", "D", "N"], ["M", "=", "X", "I", "S"], ["M", "=", "X"]


def operations(cigar: Column) -> Column:
    """array<struct<op string, len int>>; empty for null and '*'."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len")))


def _total(cigar: Column, ops: list[str]) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda n, x: n + F.when(x["op"].isin(ops), x["len"]).otherwise(0))


def aligned_length(cigar: Column) -> Column:
    return _total(cigar, ALIGNED)


def reference_span(cigar: Column) -> Column:
    return _total(cigar, ON_REFERENCE)


def end_position(cigar: Column, pos: Column) -> Column:
    """Last reference position of the alignment, 1-based."""
    return pos + reference_span(cigar) - 1


def _clip(cigar: Column, pattern: str) -> Column:
    clips = F.regexp_extract_all(F.regexp_extract(F.coalesce(cigar, F.lit("")), pattern, 0), F.lit(r"(\d+)"), F.lit(1))
    return F.aggregate(clips, F.lit(0), lambda n, x: n + x.cast("int"))


def unclipped_start(cigar: Column, pos: Column) -> Column:
    """Alignment start less clipped bases before it, hard and soft."""
    return pos - _clip(cigar, r"^(?:\d+[SH])+")


def unclipped_end(cigar: Column, pos: Column) -> Column:
    return end_position(cigar, pos) + _clip(cigar, r"(?:\d+[SH])+$")


def blocks(cigar: Column, pos: Column) -> Column:
    """Aligned runs, array<struct<read_start int (0-based), ref_start int, len int>>; neighbouring runs stay apart."""
    zero = F.struct(F.lit(0).alias("read_i"), pos.cast("int").alias("ref_i"), F.array().cast("array<struct<read_start:int,ref_start:int,len:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        run = F.array(F.struct(s["read_i"].alias("read_start"), s["ref_i"].alias("ref_start"), x["len"].alias("len")))
        return F.struct(
            (s["read_i"] + F.when(x["op"].isin(ON_READ), x["len"]).otherwise(0)).alias("read_i"),
            (s["ref_i"] + F.when(x["op"].isin(ON_REFERENCE), x["len"]).otherwise(0)).alias("ref_i"),
            F.when(x["op"].isin(ALIGNED), F.concat(s["out"], run)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(operations(cigar), zero, step, lambda s: s["out"])


def indels(cigar: Column, pos: Column) -> Column:
    """array<struct<kind string, site int, len int, read_i int>>: deletions and insertions in order.

    site is the first deleted position, or the position that follows an insertion; read_i the first base read after
    a deletion, or the first inserted base. Skipped regions (N) are no deletions.
    """
    zero = F.struct(F.lit(0).alias("read_i"), pos.cast("int").alias("ref_i"), F.array().cast("array<struct<kind:string,site:int,len:int,read_i:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kind = F.when(x["op"] == "D", "deletion").otherwise("insertion")
        one = F.array(F.struct(kind.alias("kind"), s["ref_i"].alias("site"), x["len"].alias("len"), s["read_i"].alias("read_i")))
        return F.struct(
            (s["read_i"] + F.when(x["op"].isin(ON_READ), x["len"]).otherwise(0)).alias("read_i"),
            (s["ref_i"] + F.when(x["op"].isin(ON_REFERENCE), x["len"]).otherwise(0)).alias("ref_i"),
            F.when(x["op"].isin("D", "I"), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(operations(cigar), zero, step, lambda s: s["out"])


def compact(cigar: Column) -> Column:
    """Operations with the letter before the length, as in M32."""
    return F.array_join(F.transform(operations(cigar), lambda x: F.concat(x["op"], x["len"].cast("string"))), "")
