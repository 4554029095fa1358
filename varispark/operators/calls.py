"""Site evidence and calls: pileups, allele choice, joint score, strand skew, somatic, germline and LOH calls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import VariantConfig
from ..sources.paths import written

ColumnOrName = Column | str

SITE = ["chrom", "pos"]


def joint_score(ref_decades: Column, alt_decades: Column, cfg: VariantConfig = VariantConfig()) -> Column:
    """Probability that a site is polymorphic, from the sums of quality div 10 of reference and variant reads."""
    r, v = F.pow(F.lit(10.0), -ref_decades.cast("double")), F.pow(F.lit(10.0), -alt_decades.cast("double"))
    poly = cfg.prior_poly * (1 - r) * (1 - v)
    return poly / (poly + (1 - cfg.prior_poly) * ((1 - r) * v + r * (1 - v)))


def share(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def loh_call(ref_n: Column, ref_t: Column, alt_n: Column, alt_t: Column) -> dict[str, Column]:
    """Columns callable, call ('S', 'G', '' or '0' for too little data) and loh ('LOH_reference', 'LOH_variant', '', '0')."""
    n, t = ref_n + alt_n, ref_t + alt_t
    fn, ft, rn, rt = share(alt_n, n), share(alt_t, t), share(ref_n, n), share(ref_t, t)
    diff = ft - fn
    callable_ = ((ref_n >= 4) & (alt_t >= 4)) | ((n > 4) & (t > 4))
    level = lambda low, high, refs, alts: (diff >= low) & (diff < high) & (fn <= 0.01) & (ref_n >= refs) & (alt_t >= alts)
    somatic = level(0.5, 2.0, 4, 5) | level(0.2, 0.5, 20, 4) | level(0.1, 0.2, 30, 4)
    both = (rn >= 0.15) & (fn >= 0.15)
    loh = F.when(both & (ft >= 0.15) & (rt <= 0.05), "LOH_reference").when(both & (rt >= 0.15) & (ft <= 0.05), "LOH_variant").otherwise("")
    call = F.when(somatic, "S").when(fn >= 0.15, "G").otherwise("")
    return {"callable": callable_, "call": F.when(callable_, call).otherwise("0"), "loh": F.when(callable_, loh).otherwise("0"), "ratio_normal": fn, "ratio_tumor": ft, "ratio_diff": diff}


def strand_skew(cov_plus: Column, cov_minus: Column, var_plus: Column, var_minus: Column, cfg: VariantConfig = VariantConfig()) -> tuple[Column, Column]:
    """(share of the variant on the plus strand with strands scaled alike, null if not evaluable; whether it fails)."""
    plus = F.when(cov_plus > cov_minus, var_plus.cast("double")).otherwise(var_plus * (cov_minus / cov_plus))
    minus = F.when(cov_plus > cov_minus, var_minus * (cov_plus / cov_minus)).otherwise(var_minus.cast("double"))
    total = var_plus + var_minus
    enough = (total >= cfg.skew_call_variants) & (cov_plus >= cfg.skew_call_coverage) & (cov_minus >= cfg.skew_call_coverage)
    skew = F.when(enough, plus / (plus + minus))
    deep = (total >= cfg.skew_filter_variants) & (cov_plus >= cfg.skew_filter_coverage) & (cov_minus >= cfg.skew_filter_coverage)
    return skew, F.coalesce(deep & ((skew >= cfg.skew_share) | (skew <= 1 - cfg.skew_share)), F.lit(False))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _fisher(frame: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Two-tailed exact probabilities of the tables ((a, b), (c, d))."""

    def one(a: int, b: int, c: int, d: int) -> float:
        row, col, n = a + b, a + c, a + b + c + d
        low = max(0, row + col - n)
        p = [math.exp(_log_choose(col, k) + _log_choose(n - col, row - k) - _log_choose(n, row)) for k in range(low, min(row, col) + 1)]
        return min(1.0, sum(x for x in p if x <= p[a - low] * (1 + 1e-7)))

    for a, b, c, d in frame:
        yield pd.Series([one(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)


def fisher_two_tailed(a: ColumnOrName, b: ColumnOrName, c: ColumnOrName, d: ColumnOrName) -> Column:
    """Two-tailed Fisher's exact test of ((a, b), (c, d)): no built-in function has it, so Arrow batches go to Python."""
    return F.pandas_udf(_fisher, "double")(a, b, c, d)


def pileup(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of observations by site and base, and by further columns if given. Partial sums leave each task."""
    return obs.where(F.col("base").isin(*"ACGT")).groupBy(*SITE, "ref", "base", *(by or [])).agg(F.count(F.lit(1)).alias("n"))


def candidate_sites(obs: DataFrame, cfg: VariantConfig = VariantConfig(), per_name: int | None = None, weight: str | None = None) -> DataFrame:
    """(chrom, pos, ref, coverage, top, second, alt, other): sites with two bases, the reference counting as one.

    Ranked by count, then by base; alt is the first of the two best that isn't the reference. Per site one row of
    four counts is aggregated, so neither a window nor a second shuffle is needed.

    per_name: so many observations at most has a name at a site. Then sites are left out that call_snps can't call: with
    A of alt and O of other, at most A names have both, so at most (per_name - 1) A of the others go with those names.
    weight: a column with how many observations a row stands for.
    """
    each = F.lit(1) if weight is None else F.col(weight)
    counts = [F.sum(F.when(F.col("base") == b, each).otherwise(0)).alias(f"n_{b}") for b in "ACGT"]
    s = obs.groupBy(*SITE, "ref").agg(*counts)
    return _chosen(s, cfg, per_name).select(*SITE, "ref", "coverage", "top", "second", "alt", "other")


def _chosen(s: DataFrame, cfg: VariantConfig, per_name: int | None = None) -> DataFrame:
    """Rows of candidate_sites() from rows with a site's counts n_A to n_T, further columns kept."""
    seen = F.array(*[F.struct((-F.col(f"n_{b}")).alias("k"), F.lit(b).alias("base")) for b in "ACGT"])
    ranked = F.array_sort(F.filter(seen, lambda x: (x["k"] < 0) | (x["base"] == F.col("ref"))))
    s = s.withColumn("ranked", ranked).withColumn("coverage", sum(F.col(f"n_{b}") for b in "ACGT"))
    s = s.where((F.size("ranked") >= 2) & (F.col("coverage") >= cfg.min_coverage) & F.col("ref").isin(*"ACGT"))
    top, second = F.get("ranked", F.lit(0))["base"], F.get("ranked", F.lit(1))["base"]
    if per_name is not None:
        n = [-F.get("ranked", F.lit(k))["k"] for k in (0, 1)]
        most, others = F.when(top != F.col("ref"), n[0]).otherwise(n[1]), F.when(top != F.col("ref"), n[1]).otherwise(n[0])
        left = F.greatest(others - (per_name - 1) * most, F.lit(0))
        s = s.where((most >= max(cfg.min_alt_allele_count, 1)) & (most / (most + left) >= cfg.min_minor_allele_frequency))
    return s.withColumns({"top": top, "second": second}).withColumn("alt", F.when(F.col("top") != F.col("ref"), F.col("top")).otherwise(F.col("second"))).withColumn("other", F.when(F.col("top") != F.col("ref"), F.col("second")).otherwise(F.col("top")))


def disagreeing_mates(chosen: DataFrame, tolerated: int = 1) -> DataFrame:
    """(chrom, pos, qname) of names seen with both of a site's two bases, where there are more than are tolerated."""
    bad = chosen.groupBy(*SITE, "qname").agg(F.min("base").alias("a"), F.max("base").alias("b")).where("a <> b").select(*SITE, "qname")
    many = bad.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tolerated)
    return bad.join(many, SITE, "left_semi")


def inside_deletions(chosen: DataFrame, deletions: DataFrame, distance: int) -> DataFrame:
    """chosen without variant observations near a read's end where a called deletion (chrom, start, len) lies.

    Deletions are laid out by position, so the interval join is an equi-join.
    """
    at = deletions.select("chrom", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    hit = chosen.join(at.withColumn("deleted", F.lit(True)), SITE, "left")
    return hit.where(~(F.coalesce("deleted", F.lit(False)) & (F.col("base") == F.col("alt")) & (F.col("flank") < distance))).drop("deleted")


def without_variant_reads(chosen: DataFrame) -> DataFrame:
    """Reference observations whose read, by name and strand, doesn't carry the variant at the site as well."""
    alt = chosen.where("base = alt").select(*SITE, "qname", "strand").distinct()
    return chosen.where("base = ref").join(alt, [*SITE, "qname", "strand"], "left_anti")


def call_snps(obs: DataFrame, cfg: VariantConfig = VariantConfig(), deletions: DataFrame | None = None, suspicious: DataFrame | None = None, known: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """SNP calls from observations (chrom, pos, base, ref, tn, strand, qual, qname, unclipped_start, mapq, flank).

    suspicious: (chrom, pos, base, suspicious) good mismatches of reads that were rejected; known: dbSNP (chrom, pos,
    rs, mask); sites: candidate_sites() of all observations, where obs has those at these sites alone.
    Names that a site has more than once are found first and written, a table of few rows as a rule, whose size Spark knows when it plans
    the rest. Sites without such names are summed by base and start at once, and their alleles chosen from those sums; observations
    at the others are written and go through call_groups(). obs is read three times; no task holds a whole site.
    """
    good = obs.where((F.col("qual") >= cfg.min_quality) & F.col("base").isin(*"ACGT") & F.col("ref").isin(*"ACGT") & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    own = {"n": F.lit(1), "decades": F.floor(F.col("qual") / 10), "flanked": (F.col("flank") >= cfg.alt_flank_window).cast("int"), "mapq_sum": F.col("mapq"), "named": F.col("qname").isNotNull(), "near": F.col("flank") < cfg.mismapped_deletion_distance}
    again = good.groupBy(*SITE, "qname").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    again = written(again, "names")
    met = again.select(*SITE).distinct()
    some = written(good.join(met, SITE, "left_semi"), "observations")
    # Those without a name have one in common.
    twice = again.withColumnsRenamed({k: f"_{k}" for k in (*SITE, "qname")})
    told = some.join(twice, (F.col("chrom") == F.col("_chrom")) & (F.col("pos") == F.col("_pos")) & F.col("qname").eqNullSafe(F.col("_qname")), "left").withColumn("alone", F.col("_times").isNull())
    s = _group_sums(told.withColumns(own), written(candidate_sites(some, cfg), "sites") if sites is None else sites, cfg, deletions)
    rest = _base_sums(_alone(_inside(good.join(met, SITE, "left_anti").withColumns(own), deletions)))
    if sites is None:
        site = Window.partitionBy(*SITE, "ref")
        chosen = _chosen(rest.withColumns({f"n_{b}": F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))).over(site), F.lit(0)) for b in "ACGT"}), cfg)
    else:
        chosen = rest.join(sites, [*SITE, "ref"])
    return _judged(_site_sums(chosen).unionByName(s), cfg, suspicious, known)


def _by_name(shared: DataFrame, cfg: VariantConfig) -> DataFrame:
    """Observations at chosen sites whose name may have others there, without those of too many disagreeing mates.

    free: whether a reference observation counts as such, as its read doesn't carry the variant; names: 1 on one variant row of each name.
    """
    stays = ~((F.col("base") == F.col("alt")) & F.col("gone"))
    alt = (F.col("base") == F.col("alt")) & stays
    has = {c: F.max(F.col("base") == F.col(c)) for c in ("top", "second")}
    bad = shared.groupBy(*SITE, "qname").agg(*[c.alias(k) for k, c in has.items()]).where("top and second")
    many = bad.groupBy(*SITE).agg(F.count(F.lit(1)).alias("_bad")).where(F.col("_bad") > cfg.mate_disagreement_tolerated)
    name = Window.partitionBy(*SITE, "qname")
    carrying = {s: F.max(alt & (F.col("strand") == s)).over(name) for s in "+-"}
    one = F.row_number().over(name.orderBy(F.coalesce(alt, F.lit(False)).desc())) == 1
    out = shared.withColumn("bad", has["top"].over(name) & has["second"].over(name))
    out = out.withColumn("free", (F.col("base") != F.col("ref")) | ~F.when(F.col("strand") == "+", carrying["+"]).otherwise(carrying["-"])).withColumn("names", F.when(alt & F.col("named") & one, 1))
    return out.where(stays).join(many, SITE, "left").where(~(F.col("bad") & F.col("_bad").isNotNull()))


def call_groups(groups: DataFrame, sites: DataFrame, cfg: VariantConfig = VariantConfig(), deletions: DataFrame | None = None, suspicious: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """call_snps() from groups of n good observations: those whose name has no other at the site (alone) may be summed already.

    groups: (chrom, pos, base, ref, tn, strand, qname, unclipped_start, near, alone, n, decades, flanked, mapq_sum, named); of rows that aren't
    alone each is one observation. Only those meet the sites and windows by name (mates that disagree, reference reads that carry the
    variant); then all are summed by base and start, with partial sums in the tasks that read them, and by base. A site's few rows
    of bases meet its alleles last, so no observation that is alone is joined with them and no task holds a whole site.
    groups and sites are read more than once.
    """
    return _judged(_group_sums(groups, sites, cfg, deletions), cfg, suspicious, known)


def _group_sums(groups: DataFrame, sites: DataFrame, cfg: VariantConfig, deletions: DataFrame | None) -> DataFrame:
    o = _inside(groups, deletions)
    met = o.where(~F.col("alone")).join(sites, [*SITE, "ref"]).where(F.col("base").isin(F.col("alt"), F.col("other"), F.col("ref")))
    return _site_sums(_base_sums(_alone(o.where("alone")), _by_name(met, cfg)).join(sites, [*SITE, "ref"]))


def _inside(groups: DataFrame, deletions: DataFrame | None) -> DataFrame:
    """groups with gone: near a read's end where a deletion lies, so that they don't count as variant."""
    if deletions is None:
        return groups.withColumn("gone", F.lit(False))
    at = deletions.select("chrom", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().withColumn("deleted", F.lit(True))
    return groups.join(at, SITE, "left").withColumn("gone", F.coalesce("deleted", F.lit(False)) & F.col("near")).drop("deleted")


def _alone(o: DataFrame) -> DataFrame:
    return o.withColumns({"free": F.lit(True), "names": F.when(F.col("named"), F.col("n"))})


_CELLS = [(t, s, k) for t in "NT" for s, k in (("+", "fwd"), ("-", "rev"))]


def _base_sums(*parts: DataFrame) -> DataFrame:
    """(chrom, pos, ref, base, gone, sums, starts) of groups with free and names, in whose starts a base counts each once; the
    reference is no variant, so its starts aren't told apart."""
    base, summed = [*SITE, "ref", "base", "gone"], ["n", "decades", "flanked", "mapq_sum", "names"]
    cells = {f"{t}_{k}": F.when(F.col("free") & (F.col("tn") == t) & (F.col("strand") == s), F.col("n")) for t, s, k in _CELLS}
    start = F.when(F.col("base") != F.col("ref"), F.col("unclipped_start")).alias("start")
    rows = [p.select(*base, start, *summed, *[c.alias(k) for k, c in cells.items()]) for p in parts]
    out, sums = rows[0], [F.sum(k).alias(k) for k in (*summed, *cells)]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*base, "start").agg(*sums).groupBy(*base).agg(*sums, F.count("start").alias("starts"))


def _site_sums(chosen: DataFrame) -> DataFrame:
    """Sums of a site's alleles from _base_sums() with top, alt and other."""
    is_alt, is_other, is_ref = (F.col("base") == F.col(c) for c in ("alt", "other", "ref"))
    total = lambda c, what: F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0)).cast("long")
    s = chosen.where((is_alt & ~F.col("gone")) | is_other | is_ref)
    return s.groupBy(*SITE, "ref", "alt", "top", "coverage").agg(
        total(is_alt, "n").alias("alt_count"), total(is_other, "n").alias("other_count"), total(is_alt, "decades").alias("alt_decades"), total(is_other, "decades").alias("other_decades"),
        total(is_alt, "flanked").alias("flanked"), total(is_alt, "mapq_sum").alias("mapq_sum"), total(is_alt, "names").alias("unique_names"), total(is_alt, "starts").alias("unique_starts"),
        *[total(c, f"{t}_{k}").alias(f"{a}_{t}_{k}") for a, c in (("alt", is_alt), ("ref", is_ref)) for t, _, k in _CELLS],
    )


def _judged(s: DataFrame, cfg: VariantConfig, suspicious: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """Calls from the sums of sites."""
    freq = F.try_divide("alt_count", F.col("alt_count") + F.col("other_count"))
    s = s.withColumn("alt_freq", freq).where((F.col("alt_count") >= cfg.min_alt_allele_count) & (freq >= cfg.min_minor_allele_frequency))
    many = F.col("alt_count") >= cfg.min_alt_count_for_filters
    s = s.where(~many | ((F.col("flanked") >= cfg.min_alt_reads_with_flank) & (F.col("unique_starts") >= min(cfg.min_unique_starts, cfg.min_alt_allele_count))))
    if suspicious is not None:
        s = s.join(suspicious.withColumnRenamed("base", "alt"), [*SITE, "alt"], "left").where(F.coalesce(F.col("suspicious") / F.col("alt_count"), F.lit(0.0)) < cfg.mismap_frequency).drop("suspicious")
    # Against a consensus that isn't the reference, or with no reference read left, the reference counts as one read of quality 50.
    decades = F.when((F.col("top") == F.col("ref")) & (F.col("other_count") > 0), F.col("other_decades")).otherwise(5)
    s = s.withColumn("score", joint_score(decades, F.col("alt_decades"), cfg)).where((F.col("score") >= cfg.min_score) & (F.col("unique_names") >= cfg.min_unique_read_names))
    c = {f"{a}_{t}_{k}": F.col(f"{a}_{t}_{k}") for a in ("alt", "ref") for t in "NT" for k in ("fwd", "rev")}
    vp, vm = c["alt_N_fwd"] + c["alt_T_fwd"], c["alt_N_rev"] + c["alt_T_rev"]
    rp, rm = c["ref_N_fwd"] + c["ref_T_fwd"], c["ref_N_rev"] + c["ref_T_rev"]
    skew, fails = strand_skew(vp + rp, vm + rm, vp, vm, cfg)
    if cfg.fishers_exact:
        one_strand = (F.least(vp, vm) == 0) & (vp + rp > 0) & (vm + rm > 0)
        fails = one_strand & (fisher_two_tailed(rp, rm, vp, vm) < cfg.fishers_cutoff)
    calls = loh_call(c["ref_N_fwd"] + c["ref_N_rev"], c["ref_T_fwd"] + c["ref_T_rev"], c["alt_N_fwd"] + c["alt_N_rev"], c["alt_T_fwd"] + c["alt_T_rev"])
    s = s.where(~fails)
    out = s.select(
        *SITE, "ref", "alt", "coverage", "alt_count", "other_count", "alt_freq", "score", "unique_names", "unique_starts", *c,
        (F.col("mapq_sum") / F.col("alt_count")).cast("long").alias("avg_mapq"),
        ((vp > 0) & (vm > 0)).cast("int").alias("both_strands"), skew.alias("strand_skew"), *[v.alias(k) for k, v in calls.items() if k != "callable"],
    )
    return out if known is None else with_dbsnp(out, known)


def with_dbsnp(calls: DataFrame, known: DataFrame) -> DataFrame:
    """calls with dbsnp: 'rsN' of the least entry at the place whose mask (A 1, C 2, G 4, T 8) has both bases."""
    bits = F.create_map(*[F.lit(x) for k, b in enumerate("ACGT") for x in (b, 1 << k)])
    both = calls.select(*SITE, "ref", "alt").join(known, SITE)
    hit = both.where((F.col("mask").cast("int").bitwiseAND(bits[F.col("ref")]) != 0) & (F.col("mask").cast("int").bitwiseAND(bits[F.col("alt")]) != 0))
    return calls.join(hit.groupBy(*SITE, "ref", "alt").agg(F.concat(F.lit("rs"), F.min("rs").cast("string")).alias("dbsnp")), [*SITE, "ref", "alt"], "left")
