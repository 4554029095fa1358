"""Streaming: pileups behind a moving frontier, bounded duplicate removal, batches of reads, event windows.

Reads sorted by place behave like a stream whose event time is the position: a site is final once reads begin beyond
it. Positions become timestamps, so Spark's watermark is the frontier and drops state as sites become final.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_time(pos: Column, chrom: Column | None = None, lengths: dict[str, int] | None = None, margin: int = 0) -> Column:
    """A position as a timestamp: one second a base.

    With a chromosome and the dictionary of lengths, in the order of the stream, chromosomes follow each other `margin`
    bases apart, so the frontier goes on when reads change to the next one. Null where the dictionary lacks the name.
    """
    return F.timestamp_seconds(((pos if lengths is None else pos + starts(chrom, lengths, margin))).cast("long"))


def starts(chrom: Column, lengths: dict[str, int], margin: int = 0) -> Column:
    """Bases before a chromosome, from a dictionary that is as long as the genome has sequences."""
    before, at = {}, 0
    for name, n in lengths.items():
        before[name] = at
        at += n + margin + 1
    return F.create_map(*[F.lit(x) for item in before.items() for x in item])[chrom].cast("long")


def pileup(obs: DataFrame, lateness: int = 0, lengths: dict[str, int] | None = None) -> DataFrame:
    """(pos, base, n) of streamed observations (pos, base), given out once no read can reach the site any more.

    Observations more than `lateness` bases behind the frontier are dropped, as late data are. With `lengths`,
    observations carry `chrom` as well and come by it in that order; the first reads of a chromosome, beyond `lateness`
    bases of it, make all sites of those before final (Spark tells late ones by the frontier of the batch before). Observations of a chromosome that `lengths` lacks are dropped.
    """
    if lengths is None:
        timed = obs.withColumn("t", place_time(F.col("pos"))).withWatermark("t", f"{lateness} seconds")
        return timed.groupBy(F.window("t", "1 second"), "base").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("window.start").alias("pos"), "base", "n")
    timed = obs.withColumn("t", place_time(F.col("pos"), F.col("chrom"), lengths, lateness)).where("t is not null").withWatermark("t", f"{lateness} seconds")
    sites = timed.groupBy(F.window("t", "1 second"), "chrom", "base").agg(F.count(F.lit(1)).alias("n"))
    return sites.select("chrom", (F.unix_timestamp("window.start") - starts(F.col("chrom"), lengths, lateness)).alias("pos"), "base", "n")


def distinct_reads(reads: DataFrame, span: int, lengths: dict[str, int] | None = None) -> DataFrame:
    """Streamed reads without those whose name, place and strand were seen within `span` bases.

    With `lengths`, reads come by rname in that order; those of names that it lacks are dropped.
    """
    timed = reads.withColumn("t", place_time(F.col("pos"), F.col("rname"), lengths, span)).where("t is not null").withWatermark("t", f"{span} seconds")
    return timed.dropDuplicatesWithinWatermark(["qname", "rname", "pos", "strand"]).drop("t")


def pairs(first: DataFrame, second: DataFrame, span: int, lengths: dict[str, int] | None = None) -> DataFrame:
    """First and second reads (qname, pos) of a name that begin within `span` bases of each other.

    Both sides carry a watermark, so reads wait for their mates no longer than the span and state stays bounded. With
    `lengths`, both sides carry `chrom` and come by it in that order; mates on two chromosomes aren't near.
    """
    held = span + 1  # chromosomes lie farther apart than the span
    place = lambda c: place_time(F.col("pos"), F.col("chrom") if lengths else None, lengths, held).alias(c)
    own = ["chrom"] if lengths else []
    a = first.select(F.col("qname").alias("name_a"), F.col("pos").alias("pos_a"), *own, place("t_a")).withWatermark("t_a", f"{span} seconds")
    b = second.select(F.col("qname").alias("name_b"), F.col("pos").alias("pos_b"), place("t_b")).withWatermark("t_b", f"{span} seconds")
    near = F.expr(f"name_a = name_b and t_b >= t_a - interval {span} seconds and t_b <= t_a + interval {span} seconds")
    return a.join(b, near).select(F.col("name_a").alias("qname"), *own, "pos_a", "pos_b")


def in_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Run work on each micro-batch; with the batch's number it can make its writes repeatable."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Events of a user that follow each other within a gap, coalesced."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
