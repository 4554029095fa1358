"""Reads: why one is left out, its bases and mismatches against the reference, clips, windows, trimming."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import VariantConfig
from ..functions import batches, cigar, names
from ..functions import seq as sequences
from ..schema import DUPLICATE, MATE_REVERSE, MATE_UNMAPPED, PAIRED, REVERSE, SECONDARY, UNMAPPED


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(bit) != 0


def strand() -> Column:
    return F.when(has(REVERSE), "-").otherwise("+")


def skip_reason(cfg: VariantConfig = VariantConfig()) -> Column:
    """Why a read is left out, the first reason that holds; null for reads that stay."""
    non_primary = F.lit(cfg.skip_non_primary) & has(SECONDARY)
    return F.when(has(DUPLICATE), "duplicate").when(has(UNMAPPED), "unmapped").when(non_primary, "non_primary").when(F.col("mapq") < cfg.min_mapq, "low_mapq")


def usable_reads(reads: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    return reads.where(skip_reason(cfg).isNull())


def overlapping(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Region query: reads whose alignment touches start..end, 1-based and inclusive, under any name of chrom."""
    return reads.where((names.chromosome(F.col("rname")) == chrom) & (F.col("pos") <= end) & (cigar.end_position(F.col("cigar"), F.col("pos")) >= start))


def aligned_pieces(reads: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """Aligned blocks cut at the reference's chunks, with the reference bases under each.

    The join is on (chromosome, chunk) and moves blocks, not bases: bases are made after it.
    """
    b = reads.withColumn("b", F.explode(cigar.blocks(F.col("cigar"), F.col("pos"))))
    first, last = F.floor((F.col("b.ref_start") - 1) / chunk), F.floor((F.col("b.ref_start") + F.col("b.len") - 2) / chunk)
    b = b.withColumn("k", F.explode(F.sequence(first, last))).withColumn("chunk_start", (F.col("k") * chunk + 1).cast("int"))
    joined = b.join(reference.withColumnRenamed("chrom", "rname"), ["rname", "chunk_start"])
    start = F.greatest(F.col("b.ref_start"), F.col("chunk_start"))
    size = F.least(F.col("b.ref_start") + F.col("b.len"), F.col("chunk_start") + chunk) - start
    joined = joined.withColumn("piece_start", start).withColumn("piece_len", size)
    return joined.withColumn("piece_read", F.col("b.read_start") + F.col("piece_start") - F.col("b.ref_start")).withColumn("piece_ref", F.upper(F.col("bases").substr(F.col("piece_start") - F.col("chunk_start") + 1, F.col("piece_len")))).drop("b", "k", "bases", "chunk_start")


def laid_out(pieces: DataFrame, read_start: Column, size: Column, **more: Column) -> DataFrame:
    """pieces with a row for each of `size` bases from read_start (0-based): i, base, q, and those of further arrays.

    The arrays are zipped first, so a base's row needs neither its read's sequence nor its qualities.
    """
    i = F.sequence(F.lit(0), size - 1).alias("i")
    base = letters(F.upper(F.col("seq").substr(read_start + 1, size))).alias("base")
    q = F.coalesce(F.slice("qual", read_start + 1, size), F.array().cast("array<int>")).alias("q")
    return pieces.select("*", F.inline(F.arrays_zip(i, base, q, *[c.alias(k) for k, c in more.items()])))


def letters(text: Column) -> Column:
    return F.coalesce(F.split(text, ""), F.array().cast("array<string>"))


def bases(pieces: DataFrame) -> DataFrame:
    """One row for each aligned base: pos_at, read_i (0-based), base, q and ref beside the read's columns."""
    e = laid_out(pieces, F.col("piece_read"), F.col("piece_len"), ref=letters(F.col("piece_ref")))
    e = e.withColumn("pos_at", F.col("piece_start") + F.col("i")).withColumn("read_i", F.col("piece_read") + F.col("i"))
    return e.drop("i", "piece_start", "piece_len", "piece_read", "piece_ref")


def _differing(read: pa.Array, ref: pa.Array, qual: pa.Array) -> pa.Array:
    """For each piece the places, from 0, where read and reference differ, with quality; N on the reference is unknown."""
    n_rows = len(read)

    def flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = x.cast(pa.large_binary()) if not pa.types.is_list(x.type) else x
        lists = pa.types.is_list(x.type)
        size = np.asarray((x.value_lengths() if lists else pc.binary_length(x)).fill_null(0), np.int64)
        if lists:
            data = np.asarray(x.flatten().fill_null(-1), np.int64)
        else:
            data = np.frombuffer(b"".join(v or b"" for v in x.to_pylist()), np.uint8)
        return data, np.cumsum(size) - size, size

    (a, a_at, a_n), (b, b_at, b_n), (q, q_at, q_n) = flat(read), flat(ref), flat(qual)
    n = np.minimum(a_n, b_n)
    row = np.repeat(np.arange(n_rows), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x, y = a[a_at[row] + i], b[b_at[row] + i]
    hit = np.flatnonzero((x != y) & (y != ord("N")))
    row, i = row[hit], i[hit]
    known = i < q_n[row]
    quality = np.where(known, q[np.minimum(q_at[row] + i, max(len(q) - 1, 0))] if len(q) else -1, -1)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows)))).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(quality.astype(np.int32), mask=quality < 0), pa.array([chr(v) for v in x[hit].tolist()], pa.string()), pa.array([chr(v) for v in y[hit].tolist()], pa.string())], ["i", "q", "base", "ref"])
    return pa.ListArray.from_arrays(pa.array(offsets), cells)


def mismatch_bases(pieces: DataFrame) -> DataFrame:
    """The rows of bases() that differ from a known reference base, and no others: pieces are compared whole, in Arrow
    batches, so rows are made for mismatches alone."""
    at, n = F.col("piece_read"), F.col("piece_len")
    found = F.arrow_udf(_differing, "array<struct<i:int,q:int,base:string,ref:string>>")(F.upper(F.col("seq").substr(at + 1, n)), F.col("piece_ref"), F.slice("qual", at + 1, n))
    e = pieces.withColumn("mm", found).select("*", F.inline("mm")).withColumn("pos_at", F.col("piece_start") + F.col("i")).withColumn("read_i", at + F.col("i"))
    return e.drop("mm", "i", "piece_start", "piece_len", "piece_read", "piece_ref")


_MISMATCHES = "array<struct<pos_at:int,read_i:int,base:string,q:int,ref:string>>"


def read_mismatches(reads: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """reads with mm, an array of what mismatch_bases() has rows for: one row a read, so what is judged by read needs no shuffle.

    A read that lies within two neighbouring chunks meets both in one join; only longer ones are cut into pieces, whose
    mismatches are gathered by read_id. Without a mismatch, or without a reference, mm is empty.
    """
    none = F.array().cast(_MISMATCHES)
    near = within_two_chunks(chunk)
    own = with_windows(reads.where(near), reference, chunk)
    found = F.arrow_udf(batches.differing_cells, _MISMATCHES)("cigar", "pos", "seq", "qual", "chunk_start", "_window")
    own = own.withColumn("mm", found).select(*reads.columns, "mm")
    far = reads.where(~near)
    pieces = mismatch_bases(aligned_pieces(far.select("read_id", "rname", "pos", "cigar", "seq", "qual"), reference, chunk))
    mm = pieces.groupBy("read_id").agg(F.collect_list(F.struct("pos_at", "read_i", "base", "q", "ref")).alias("mm"))
    return own.unionByName(far.join(mm, "read_id", "left").select(*reads.columns, F.coalesce("mm", none).alias("mm")))


def within_two_chunks(chunk: int) -> Column:
    k = lambda at: F.floor((at - 1) / chunk)
    return F.coalesce(k(cigar.end_position(F.col("cigar"), F.col("pos"))) - k(F.col("pos")) <= 1, F.lit(True))


def with_windows(reads: DataFrame, reference: DataFrame, chunk: int, absent: str = "N") -> DataFrame:
    """reads with chunk_start and _window, the reference's bases of the chunk where a read begins and the next one; `absent` fills a
    first chunk that the reference lacks, N one that is short."""
    part = lambda start, after: F.struct(start.alias("chunk_start"), F.lit(after).alias("after"))
    start = F.col("chunk_start")
    two = reference.select(F.col("chrom").alias("rname"), "bases", F.inline(F.array(part(start, False), part(start - chunk, True))))
    text = lambda after: F.coalesce(F.rpad(F.max(F.when(F.col("after") == after, F.col("bases"))), chunk, "N"), F.lit("" if after else absent * chunk))
    windows = two.groupBy("rname", "chunk_start").agg(F.concat(text(False), text(True)).alias("_window"))
    return reads.withColumn("chunk_start", (F.floor((F.col("pos") - 1) / chunk) * chunk + 1).cast("int")).join(windows, ["rname", "chunk_start"], "left")


def overlapping_namesakes(reads: DataFrame) -> DataFrame:
    """(read_id) of reads whose span another read of the same name overlaps; reads without a name have one in common."""
    r = reads.select("read_id", "qname", "rname", "pos", cigar.end_position(F.col("cigar"), F.col("pos")).alias("_end"))
    w = Window.partitionBy("qname", "rname").orderBy("pos", "read_id")
    before = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_touches", (before >= F.col("pos")) | (F.lead("pos").over(w) <= F.col("_end")))
    return r.where("_touches").select("read_id").distinct()


def mismatch_rows(judged: DataFrame) -> DataFrame:
    """read_mismatches() as the rows of mismatch_bases()."""
    return judged.select("*", F.inline("mm")).drop("mm")


def passes(cfg: VariantConfig = VariantConfig()) -> Column:
    """The verdict of mismatch_counts() on a row of read_mismatches()."""
    n = lambda q: F.size(F.filter("mm", lambda m: m["q"] >= q))
    return few_mismatches(n(cfg.mismatch_lq_quality), n(cfg.mismatch_hq_quality), cfg)


def near_bad_ends(judged: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """end_blacklist() of rows of read_mismatches()."""
    good = F.transform(F.filter("mm", lambda m: m["q"] >= cfg.min_quality), lambda m: m["read_i"])
    j = judged.where(F.size("mm") > 0).withColumn("_at", good)
    return mismatch_rows(j.withColumn("_bad", _near_ends("_at", F.length("seq"), cfg)).where(F.size("_bad") > 0)).where(F.array_contains("_bad", F.col("read_i"))).drop("_at", "_bad")


def densest(span: int, least: int) -> Column:
    """densest_window() on a row of read_mismatches(), 0 without such mismatches."""
    good = F.transform(F.filter("mm", lambda m: m["q"] >= least), lambda m: m["pos_at"])
    return F.coalesce(F.array_max(F.transform(good, lambda x: F.size(F.filter(good, lambda y: (y <= x) & (y >= x - span))))), F.lit(0))


def aligned_bases(reads: DataFrame) -> DataFrame:
    """bases() without a reference: no join at all, and reads are laid out in Arrow batches."""
    cells = F.arrow_udf(batches.aligned_cells, "array<struct<pos_at:int,read_i:int,base:string,q:int>>")("cigar", "pos", "seq", "qual")
    return reads.withColumn("_cells", cells).select("*", F.inline("_cells")).drop("_cells")


def flanking_quality(window: int, least: int, read_i: str = "read_i", qual: str = "qual", between: bool = False) -> Column:
    """Whether all qualities within `window` of a base reach `least`, the base itself left out.

    between: the place lies before the base at read_i, as for a deletion, and that base counts.
    """
    i, q = F.col(read_i), F.col(qual)
    first = F.greatest(i - window, F.lit(0))
    before = F.slice(q, first + 1, i - first)
    after = F.slice(q, i + (1 if between else 2), F.lit(window))
    return F.forall(F.concat(before, after), lambda x: x >= least)


def flanked_bases(reads: DataFrame, quality: int, window: int, least: int) -> DataFrame:
    """(rname, base, n): aligned bases of `quality` or more that pass flanking_quality(), counted in the batches of reads that hold them."""
    own = reads.select("rname", "cigar", "pos", "seq", "qual")
    n = own.mapInArrow(lambda r: batches.flanked_counts(r, quality, window, least), "rname string, base string, n long")
    return n.groupBy("rname", "base").agg(F.sum("n").alias("n"))


def forgiven(b: DataFrame, known: DataFrame | None) -> DataFrame:
    """bases() with `wrong`: a mismatch with a known reference base that isn't between two alleles of a dbSNP entry.

    known: (chrom, pos, mask), A 1, C 2, G 4, T 8.
    """
    wrong = (F.col("ref") != "N") & (F.col("base") != F.col("ref"))
    if known is None:
        return b.withColumn("wrong", wrong)
    bits = F.create_map(*[F.lit(x) for k, base in enumerate("ACGT") for x in (base, 1 << k)])
    k = known.groupBy(F.col("chrom").alias("rname"), F.col("pos").alias("pos_at")).agg(F.collect_set("mask").alias("masks"))
    both = F.exists("masks", lambda m: (m.cast("int").bitwiseAND(bits[F.col("base")]) != 0) & (m.cast("int").bitwiseAND(bits[F.col("ref")]) != 0))
    return b.join(k, ["rname", "pos_at"], "left").withColumn("wrong", wrong & ~F.coalesce(both, F.lit(False))).drop("masks")


def mismatch_counts(b: DataFrame, cfg: VariantConfig = VariantConfig(), known: DataFrame | None = None) -> DataFrame:
    """(read_id, lq, hq, passed) of bases() or mismatch_bases(): mismatches at the lower and the higher quality, reference N left out.

    Reads without mismatches have no row. known: a dbSNP table whose alleles are forgiven.
    """
    n = forgiven(b, known).where("wrong").groupBy("read_id").agg(F.count_if(F.col("q") >= cfg.mismatch_lq_quality).alias("lq"), F.count_if(F.col("q") >= cfg.mismatch_hq_quality).alias("hq"))
    return n.withColumn("passed", few_mismatches(F.col("lq"), F.col("hq"), cfg))


def few_mismatches(lq: Column, hq: Column, cfg: VariantConfig) -> Column:
    return (lq <= cfg.mismatch_max_lq) & (hq <= cfg.mismatch_max_hq)


def _between(array: str, first: Column, last: Column) -> Column:
    return F.filter(array, lambda i: (i >= first) & (i <= last))


def _near_ends(at: str, n: Column, cfg: VariantConfig) -> Column:
    """Of places in a read of n bases those near an end that has too many of them."""
    bad = F.filter(at, lambda i: F.lit(False))
    for size, most in cfg.end_mismatch_windows:
        for first, last in ((F.lit(0), F.lit(size - 1)), (n - size, n - 1)):
            own = _between(at, first, last)
            bad = F.when(F.size(own) >= most, F.array_union(bad, own)).otherwise(bad)
    return bad


def verdicts(wrong: DataFrame, cfg: VariantConfig = VariantConfig(), known: DataFrame | None = None) -> DataFrame:
    """(read_id, passed, bad) of reads with mismatches, from mismatch_bases(): the verdict of mismatch_counts(), and the
    places in the read, from 0, of good mismatches near an end that has too many of them. One group by read."""
    m = forgiven(wrong, known)
    count = lambda q: F.count_if(F.col("wrong") & (F.col("q") >= q))
    good = F.col("q") >= cfg.min_quality
    g = m.groupBy("read_id").agg(count(cfg.mismatch_lq_quality).alias("lq"), count(cfg.mismatch_hq_quality).alias("hq"), F.max(F.length("seq")).alias("n"), F.collect_list(F.when(good, F.col("read_i"))).alias("at"))
    return g.select("read_id", few_mismatches(F.col("lq"), F.col("hq"), cfg).alias("passed"), _near_ends("at", F.col("n"), cfg).alias("bad"))


def densest_window(b: DataFrame, span: int, least: int) -> DataFrame:
    """(read_id, best): most mismatches of quality `least` or more whose positions lie within `span` of each other."""
    wrong = b.where((F.col("ref") != "N") & (F.col("base") != F.col("ref")) & (F.col("q") >= least))
    w = Window.partitionBy("read_id").orderBy("pos_at").rangeBetween(-span, 0)
    return wrong.withColumn("n", F.count(F.lit(1)).over(w)).groupBy("read_id").agg(F.max("n").alias("best"))


def end_blacklist(wrong: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """The rows of mismatch_bases() that are good mismatches near an end of a read that has too many of them there."""
    bad = verdicts(wrong, cfg).where(F.size("bad") > 0).select("read_id", F.explode("bad").alias("read_i"))
    return wrong.join(bad, ["read_id", "read_i"], "left_semi")


def end_base_mismatch() -> tuple[Column, Column]:
    """(mismatch at the first base as sequenced, mismatch at the last one) of rows of bases()."""
    first, last = F.col("read_i") == 0, F.col("read_i") == F.length("seq") - 1
    wrong = F.col("base") != F.col("ref")
    return wrong & F.when(has(REVERSE), last).otherwise(first), wrong & F.when(has(REVERSE), first).otherwise(last)


def soft_clips(least_len: int, least_quality: float) -> Column:
    """array<struct<side, start, len, mean_quality>> of a read's soft clips that are long and good enough."""
    lead = F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1)
    tail = F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1)
    both = F.regexp_extract("cigar", r"^(?:\d+H)?\d+S$", 0) != ""
    size = lambda t: F.coalesce(F.nullif(t, F.lit("")).cast("int"), F.lit(0))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    head_n, tail_n = size(lead), F.when(both, F.lit(0)).otherwise(size(tail))
    head_q, tail_q = F.slice("qual", F.lit(1), head_n), F.slice("qual", F.length("seq") - tail_n + 1, tail_n)
    one = lambda side, start, n, q: F.struct(F.lit(side).alias("side"), start.cast("int").alias("start"), n.alias("len"), mean(q).alias("mean_quality"))
    every = F.array(one("start", F.lit(0), head_n, head_q), one("end", F.length("seq") - tail_n, tail_n, tail_q))
    return F.filter(every, lambda c: (c["len"] >= least_len) & (c["mean_quality"] >= least_quality))


def interesting_bits(hq_window: Column, hq_clipped: Column, has_indel: Column, least: int = 4) -> Column:
    """Bit flags of why a read is worth extracting: 1 unmapped, 2 mate unmapped, 4 mismatches, 8 clipped, 16 indel."""
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return bit(has(UNMAPPED), 1) + bit(has(PAIRED) & has(MATE_UNMAPPED), 2) + bit(hq_window + hq_clipped >= least, 4) + bit(hq_clipped > 0, 8) + bit(has_indel, 16)


def numbered_names(reads: DataFrame) -> DataFrame:
    """reads with unique_name: name, F or R, and how many times name and strand were seen so far in order of place."""
    w = Window.partitionBy("qname", strand()).orderBy("rname", "pos", "read_id")
    return reads.withColumn("unique_name", F.concat("qname", F.lit("."), F.when(has(REVERSE), "R").otherwise("F"), F.row_number().over(w).cast("string")))


def mates(reads: DataFrame) -> DataFrame:
    """(read_id, mate_id): reads of one name, with the mate at the place and on the strand that the read names."""
    a = reads.select("read_id", "qname", F.col("pnext").alias("at"), has(MATE_REVERSE).alias("back"))
    b = reads.select(F.col("read_id").alias("mate_id"), "qname", F.col("pos").alias("at"), has(REVERSE).alias("back"))
    return a.join(b, ["qname", "at", "back"]).where("read_id <> mate_id").select("read_id", "mate_id")


def trim_adapter(reads: DataFrame, adapter: str, least: int) -> DataFrame:
    """(read_id, trimmed): bases to cut where the read runs into the adapter, 0 for none.

    A read is cut from the first place, as sequenced, where the rest of it and the adapter agree over `least` bases
    or more up to the end of either.
    """
    s = F.upper(F.coalesce("seq", F.lit("")))
    turned = F.when(has(REVERSE), sequences.reverse_complement(s)).otherwise(s)
    r = reads.select("read_id", turned.alias("s")).withColumn("n", F.length("s"))
    agrees = lambda k: F.col("s").substr(k + 1, F.lit(len(adapter))) == F.substring(F.lit(adapter), F.lit(1), F.least(F.lit(len(adapter)), F.col("n") - k))
    places = F.when(F.col("n") >= least, F.sequence(F.lit(0), F.col("n") - least)).otherwise(F.array().cast("array<int>"))
    cut = F.coalesce(F.get(F.filter(places, agrees), F.lit(0)), F.col("n"))
    return r.select("read_id", (F.col("n") - cut).cast("int").alias("trimmed"))


def thin_deep_sites(obs: DataFrame, limit: int, exempt: int = 10) -> DataFrame:
    """Observations of deep sites thinned to about `limit`: strata of T/N, strand and start mod 5 keep their best.

    Strata of `exempt` or fewer stay whole; the others keep a share in proportion, by quality and distance to the
    ends of the read. This is a sampling operator: the limit is its purpose. Depths are counts that tasks add up, and no
    stratum keeps more than `limit` rows, so each task passes on so many of a stratum at most (Spark cuts ranks before
    the shuffle up to spark.sql.optimizer.windowGroupLimitThreshold); no window holds a site.
    """
    keys = ["chrom", "pos", "tn", "strand", "_five"]
    worth = F.col("qual") * F.when(F.col("flank") >= 10, 100).otherwise(1)
    o = obs.withColumn("_five", F.pmod("unclipped_start", F.lit(5)))
    sizes = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    depths = sizes.groupBy("chrom", "pos").agg(F.sum("_size").alias("_depth"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(worth.desc(), "qname"))
    best = o.withColumn("_rank", rank).where(F.col("_rank") <= max(limit, exempt))
    named = sizes.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_size")
    deep = depths.select(F.col("chrom").alias("_dchrom"), F.col("pos").alias("_dpos"), "_depth")
    same = lambda mark, cols: [F.col(k).eqNullSafe(F.col(f"_{mark}{k}")) for k in cols]
    all_of = lambda cs: reduce(lambda a, b: a & b, cs)
    out = best.join(named, all_of(same("s", keys))).join(deep, all_of(same("d", keys[:2])))
    target = F.greatest(F.floor(F.col("_size") * limit / F.col("_depth")), F.lit(1))
    return out.where((F.col("_depth") <= limit) | (F.col("_size") <= exempt) | (F.col("_rank") <= target)).select(*obs.columns)


def check_poolable(dictionaries: list[DataFrame], orders: list[str], one_reference: bool = False) -> list[str]:
    """Names in dictionary order, if sources may be pooled: all sorted by coordinate, with equal dictionaries (rank, name,
    length). With one reference alone, only its order matters. Raises ValueError otherwise. Dictionaries are as long as
    a genome has sequences."""
    if wrong := [o for o in orders if o != "coordinate"]:
        raise ValueError(f"sources must be sorted by coordinate, not {wrong[0]}")
    found = [[(r["name"], r["length"]) for r in d.orderBy("rank").collect()] for d in dictionaries]
    for other in found[1:]:
        if not one_reference and [n for n, _ in other] != [n for n, _ in found[0]]:
            raise ValueError("sources have different sequences, or in another order")
        if not one_reference and other != found[0]:
            raise ValueError("sources have sequences of different lengths")
    return [n for n, _ in found[0]] if found else []


def order_breaks(rows: DataFrame, names: list[str]) -> DataFrame:
    """(file, breaks): how often a read of a file begins before the one ahead of it, by dictionary rank and place.

    rows: (file, block, rname, pos) in the order of the file, block telling its pieces apart in order. A task counts the
    breaks within its pieces; the pieces' ends, a row each, are compared afterwards.
    """
    rank = {n: i for i, n in enumerate(names)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[tuple, list] = {}
        for f in frames:
            place = f["rname"].map(rank).fillna(len(rank)).to_numpy("int64") << 32 | f["pos"].fillna(0).to_numpy("int64")
            for key, at in f.groupby(["file", "block"], sort=False).indices.items():
                own = place[at]
                e = ends.setdefault(key, [own[0], own[0], 0])
                e[2] += int((own[1:] < own[:-1]).sum()) + int(own[0] < e[1])
                e[1] = own[-1]
        yield pd.DataFrame([(*k, *v) for k, v in ends.items()], columns=["file", "block", "first", "last", "breaks"])

    parts = rows.select("file", "block", "rname", "pos").mapInPandas(run, "file string, block long, first long, last long, breaks long")
    w = Window.partitionBy("file").orderBy("block")
    between = F.coalesce((F.col("first") < F.lag("last").over(w)).cast("int"), F.lit(0))
    return parts.withColumn("b", F.col("breaks") + between).groupBy("file").agg(F.sum("b").alias("breaks"))


def pooled(sources: list[DataFrame], names: list[str], one_reference: str | None = None) -> DataFrame:
    """Reads of all sources with source_idx, in one order: by dictionary rank, then place, then source, then read_id.

    Ties of place go to the source of the lowest index, so the order is the same in every run. Reads without a sequence of the
    dictionary come last; with one_reference its reads alone are pooled. Ranges of the order are sorted one a task.
    """
    every = [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
    both = both if one_reference is None else both.where(F.col("rname") == one_reference)
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.col("rname")], F.lit(len(names))) if names else F.lit(0)
    return both.withColumn("_rank", rank).orderBy("_rank", "pos", "source_idx", "read_id").drop("_rank")
