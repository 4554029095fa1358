"""Chromosome, sample and read names, locations and small text forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Names that chromosome() leaves as they are; told without a regular expression.
_PLAIN = [f"chr{x}" for x in (*range(1, 23), "X", "Y", "M")]


def chromosome(s: Column) -> Column:
    """'chrN' for 1-22, X, Y and M with or without chr in any case, MT as M; other names as they are."""
    core = F.upper(F.regexp_replace(F.trim(s), "(?i)^chr", ""))
    core = F.when(core == "MT", "M").otherwise(core)
    return F.when(s.isin(_PLAIN), s).when(core.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y|M)$"), F.concat(F.lit("chr"), core)).otherwise(s)


def chromosome_number(s: Column) -> Column:
    """1-22, X 23, Y 24, M 25; null for others."""
    core = F.regexp_replace(chromosome(s), "^chr", "")
    return F.when(core == "X", 23).when(core == "Y", 24).when(core == "M", 25).otherwise(core.try_cast("int"))


def is_canonical(s: Column) -> Column:
    return F.when(s.isin(_PLAIN), True).otherwise(chromosome_number(s).isNotNull())


def bucket_chromosome(s: Column) -> Column:
    return F.when(is_canonical(s), chromosome(s)).otherwise("other")


def alternates(s: Column) -> Column:
    """Names under which a reference may be known: with and without chr, M and MT."""
    core = F.regexp_replace(s, "(?i)^chr", "")
    both = F.when(F.upper(core).isin("M", "MT"), F.array(F.lit("MT"), F.lit("M"))).otherwise(F.array(core))
    return F.array_distinct(F.concat(F.array(s), F.flatten(F.transform(both, lambda x: F.array(x, F.concat(F.lit("chr"), x))))))


def printable_read(qname: Column, flag: Column) -> Column:
    return F.concat(qname, F.when(flag.bitwiseAND(16) != 0, ".R").otherwise(".F"))


def strip_read_suffix(qname: Column) -> Column:
    return F.regexp_replace(qname, r"\.[FR]\d+$", "")


def indel_key(kind: Column, length: Column) -> Column:
    return F.concat(kind, length.cast("string"))


def location(s: Column) -> Column:
    """struct<chrom, start, end> of 'chrN:start-end', null fields if it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(s, r"^([^:]+):(\d+)-(\d+)$", k), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def megabase_label(s: Column) -> Column:
    """struct<chrom, start, end> of 'chr3:215.4-215.6MB'."""
    part = lambda k: F.nullif(F.regexp_extract(s, r"^([^:]+):([0-9.]+)-([0-9.]+)MB$", k), F.lit(""))
    base = lambda k: F.round(part(k).cast("double") * 1_000_000).cast("long")
    return F.struct(part(1).alias("chrom"), base(2).alias("start"), base(3).alias("end"))


def id_level(s: Column, fields: int) -> Column:
    """The first `fields` fields of a dashed or dotted sample barcode: 3 patient, 4 sample, 5 analyte, 7 aliquot."""
    return F.array_join(F.slice(F.split(F.replace(s, F.lit("."), F.lit("-")), "-"), 1, fields), "-")


def fuzzy_id(s: Column) -> Column:
    """Barcode for matching: of four fields or more, the fourth without its vial letter ends it."""
    parts = F.split(s, "-")
    vial = F.regexp_replace(F.element_at(parts, 4), "[A-Z]$", "")
    return F.when(s.startswith("TCGA-") & (F.size(parts) >= 4), F.concat_ws("-", F.slice(parts, 1, 3), vial)).otherwise(s)


def strip_subset(s: Column, subsets: list[str]) -> Column:
    """A dashed id without the fields that name a subset."""
    return F.array_join(F.filter(F.split(s, "-"), lambda x: ~x.isin(subsets)), "-")


def standard_date(s: Column) -> Column:
    """yyyy-MM-dd of a short date M/d/yy, any other text as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(s, F.lit("M/d/yy")), "yyyy-MM-dd"), s)


def usable(s: Column) -> Column:
    """Whether an annotation value says something."""
    # Texts that stand for a missing annotation.
    missing = ["", "-", "NASS", "UNKNOWN", "NOT COMPUTABLE", "NULL", "NA", "N/A", "NONE"]
    return ~F.upper(F.trim(F.coalesce(s, F.lit("")))).isin(missing)


def data_scale(s: Column) -> Column:
    """struct<level, low, low_open, high, high_open> of a text like '-4:0<=v<0.3'."""
    rx = r"^(-?\d+):(-?[0-9.]+)(<=?)v(<=?)(-?[0-9.]+)$"
    part = lambda k: F.nullif(F.regexp_extract(s, rx, k), F.lit(""))
    return F.struct(part(1).cast("int").alias("level"), part(2).cast("double").alias("low"), (part(3) == "<").alias("low_open"), part(5).cast("double").alias("high"), (part(4) == "<").alias("high_open"))


def log_q(q: Column, cap: float = 37.0) -> Column:
    """-floor(log10 q) of a q value, the cap for 0 and beyond."""
    return F.when(q <= 0, F.lit(cap)).otherwise(F.least(-F.floor(F.log10(q)).cast("double"), F.lit(cap)))


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x)


def basename(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def strict_int(s: Column) -> Column:
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("int"))


def is_accession(s: Column) -> Column:
    """Whether a name looks like a GenBank accession."""
    return s.rlike(r"^[A-Z]{1,2}_?\d{5,8}(\.\d+)?$")
