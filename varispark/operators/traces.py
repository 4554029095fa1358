"""Chromatograms: peaks, alternate calls, re-calling, normalisation, positions packed in tags, amplitude reports."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHANNELS = "acgt"


def samples(traces: DataFrame) -> DataFrame:
    """(name, channel, at, v) of traces with an array for each channel."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("values")) for c in CHANNELS])).alias("x")
    return traces.select("name", each).select("name", "x.channel", F.posexplode("x.values").alias("at", "v"))


def peaks(points: DataFrame, least: float = 0.05) -> DataFrame:
    """(name, channel, at, height): tops and the middles of level tops that reach a share of the trace's highest value.

    Level stretches are folded into one row with a window over each channel; a peak is one higher than both neighbours.
    """
    w = Window.partitionBy("name", "channel").orderBy("at")
    step = points.withColumn("new", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(1)))
    flat = step.withColumn("run", F.sum("new").over(w)).groupBy("name", "channel", "run", "v").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    r = Window.partitionBy("name", "channel").orderBy("run")
    top = flat.withColumn("l", F.lag("v").over(r)).withColumn("h", F.lead("v").over(r)).withColumn("most", F.max("v").over(Window.partitionBy("name")))
    good = (F.col("v") > F.col("l")) & (F.col("v") > F.col("h")) & (F.col("v") >= least * F.col("most"))
    return top.where(good).select("name", "channel", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("at"), F.col("v").alias("height"))


def alternates(calls: DataFrame, found: DataFrame) -> DataFrame:
    """(name, i, base, alt, alt_height) of calls (name, i, base, place): the strongest peak of another channel nearer this call than its neighbours.

    Each call owns the places between the middles to its neighbours; a running maximum carries calls to peaks, so the
    range join is a sort within each trace.
    """
    w = Window.partitionBy("name").orderBy("place")
    mid = F.coalesce((F.lag("place").over(w) + F.col("place")) / 2, F.lit(-1.0))
    own = calls.withColumn("from", mid).select("name", F.col("from").alias("at"), F.struct("i", "base", "place").alias("call"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("height"), F.lit(0).alias("kind"))
    pts = found.select("name", F.col("at").cast("double").alias("at"), F.lit(None).cast(own.schema["call"].dataType).alias("call"), "channel", F.col("height").cast("double").alias("height"), F.lit(1).alias("kind"))
    v = Window.partitionBy("name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = own.unionByName(pts).withColumn("call", F.last("call", True).over(v)).where("kind = 1 and call is not null")
    other = at.where(F.lower("call.base") != F.col("channel"))
    best = other.groupBy("name", F.col("call.i").alias("i")).agg(F.max(F.struct("height", "channel")).alias("best"))
    return calls.join(best, ["name", "i"], "left").select("name", "i", "base", F.upper("best.channel").alias("alt"), F.col("best.height").alias("alt_height"))


def recall(found: DataFrame) -> DataFrame:
    """(name, i, base, place): base calls from peaks: the strongest at each place, thinned where they stand too close.

    The least spacing is the greater of mean - 1.96 deviations and a third of the median; the weaker of two peaks
    closer than it goes, again and again. That is a loop over one trace, so each trace is a group of its own.
    """

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["at", "height", "channel"], ascending=[True, False, True]).drop_duplicates("at").reset_index(drop=True)
        while len(f) > 2:
            gap = np.diff(f["at"].to_numpy())
            least = max(gap.mean() - 1.96 * gap.std(), np.ceil(0.33 * np.median(gap)))
            k = int(np.argmin(gap))
            if gap[k] >= least:
                break
            f = f.drop(index=k if f["height"][k] < f["height"][k + 1] else k + 1).reset_index(drop=True)
        return pd.DataFrame({"name": key[0], "i": range(len(f)), "base": f["channel"].str.upper(), "place": f["at"]})

    return found.groupBy("name").applyInPandas(one, "name string, i int, base string, place int")


def normalised(points: DataFrame, found: DataFrame) -> DataFrame:
    """points with each channel scaled so that its highest peak matches that of the highest channel."""
    top = found.groupBy("name", "channel").agg(F.max("height").alias("top"))
    top = top.withColumn("most", F.max("top").over(Window.partitionBy("name")))
    j = points.join(top, ["name", "channel"], "left")
    return j.select("name", "channel", "at", F.coalesce(F.col("v") * F.col("most") / F.col("top"), F.col("v").cast("double")).alias("v"))


def unpacked_positions(packed: Column, base: Column, reverse: Column) -> Column:
    """Peak positions from text of steps, one character less 33 each, from a first position; turned round on the minus strand."""
    steps = F.transform(F.filter(F.split(packed, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    at = F.aggregate(steps, F.array().cast("array<int>"), lambda out, s: F.concat(out, F.array(F.coalesce(F.element_at(F.when(F.size(out) > 0, out), -1), base) + s)))
    return F.when(reverse, F.reverse(at)).otherwise(at)


def amplitude_ratios(packed: Column) -> Column:
    """Ratios from text, one character less 33, of 92, as a share of 100."""
    return F.transform(F.filter(F.split(packed, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33) * 100.0 / 92)


def turned(trace: DataFrame) -> DataFrame:
    """Traces of the other strand: channels swapped and reversed, bases complemented, places mirrored.

    A trace may lack channels: its length is that of those it has.
    """
    n = F.col("_n")
    return trace.withColumn("_n", F.greatest(*[F.size(c) for c in CHANNELS])).select(
        "name", F.reverse("t").alias("a"), F.reverse("g").alias("c"), F.reverse("c").alias("g"), F.reverse("a").alias("t"),
        F.translate(F.reverse("bases"), "ACGTacgt", "TGCAtgca").alias("bases"), F.transform(F.reverse("places"), lambda p: n - 1 - p).alias("places"),
    )


def amplitude_report(calls: DataFrame, ref: Column, var: Column) -> DataFrame:
    """calls (base, height, alt, alt_height) with the amplitudes of two bases and how the variant was seen."""
    amp = lambda b: F.when(F.upper("base") == b, F.col("height")).when(F.col("alt") == b, F.col("alt_height")).otherwise(F.lit(0.0))
    kind = F.when(F.upper("base") == var, "called").when(F.col("alt") == var, "alternate").otherwise("not called")
    return calls.withColumn("ref_amplitude", amp(ref)).withColumn("var_amplitude", amp(var)).withColumn("kind", kind)


def genotype_alleles(table: DataFrame) -> DataFrame:
    """(snp, alleles, any_heterozygous) of genotypes (snp, allele1, allele2)."""
    both = F.explode(F.array("allele1", "allele2")).alias("allele")
    a = table.select("snp", both, (F.col("allele1") != F.col("allele2")).alias("het"))
    return a.groupBy("snp").agg(F.array_join(F.array_sort(F.collect_set("allele")), "").alias("alleles"), F.bool_or("het").alias("any_heterozygous"))


