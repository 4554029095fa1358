"""Text sinks: SAM, FASTQ, FASTA, tab-delimited reports, WIG and matrices as lines, and partitioned files.

Lines are made by column expressions and written by Spark, whose committer publishes a job's files together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..schema import REVERSE


def quality_text(qual: Column) -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")


def fastq(reads: DataFrame, tags: list[Column] | None = None, as_sequenced: bool = False) -> DataFrame:
    """(value): a record of four lines for each read; empty reads and those with other counts of qualities are an error.

    as_sequenced turns reads of the minus strand back and marks them rc_fixed.
    """
    back = F.lit(as_sequenced) & (F.col("flag").bitwiseAND(REVERSE) != 0)
    s = F.when(back, seq.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    q = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    fine = (F.length("seq") > 0) & (F.size("qual") == F.length("seq"))
    marks = F.concat_ws(",", *(tags or []), F.when(back, F.lit("rc_fixed")))
    name = F.concat(F.lit("@"), F.col("qname"), F.when(marks != "", F.concat(F.lit(" "), marks)).otherwise(""))
    record = F.concat_ws("\n", name, s, F.lit("+"), quality_text(q))
    return reads.select(F.when(fine, record).otherwise(F.raise_error(F.concat(F.lit("bad sequence or quality of "), F.col("qname")))).alias("value"))


def sam_lines(reads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(value): alignment lines of SAM text, beside the columns to keep."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])), "\t")
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext"]
    line = F.concat_ws("\t", *[star(c) for c in cols], F.lit("0"), star("seq"), F.coalesce(quality_text(F.col("qual")), F.lit("*")), F.nullif(tags, F.lit("")))
    return reads.select(*(keep or []), line.alias("value"))


def fasta(records: DataFrame, width: int = 60) -> DataFrame:
    """(value) of (name, bases): a header and lines of `width` bases."""
    lines = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), lines).alias("value"))


def described_fasta(records: DataFrame, fields: list[str]) -> DataFrame:
    """FASTA records whose description is k=v|k=v of the given columns."""
    about = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in fields])
    return records.select(F.concat(F.lit(">"), F.col("name"), F.lit(" "), about, F.lit("\n"), F.col("bases")).alias("value"))


def report(df: DataFrame, columns: list[str], path: str) -> None:
    """A tab-delimited report with a header and columns in order; null is empty, a column it doesn't know an error."""
    if extra := [c for c in df.columns if c not in columns]:
        raise ValueError(f"the report has no column {extra}")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the rows have no column {missing}")
    df.select(columns).write.option("header", True).option("sep", "\t").option("emptyValue", "").mode("error").csv(path)


def wig(coverage: DataFrame, chrom: str) -> DataFrame:
    """(value): fixedStep lines of coverage (pos, coverage), a header where positions begin anew, in order."""
    return wig_lines(coverage.withColumn("chrom", F.lit(chrom))).select("value")


def wig_lines(coverage: DataFrame) -> DataFrame:
    """(chrom, value): the lines of wig() of all chromosomes of coverage (chrom, pos, coverage), in order of chromosome and place."""
    before = coverage.select("chrom", (F.col("pos") + 1).alias("pos")).distinct().withColumn("new", F.lit(False))
    c = coverage.join(before, ["chrom", "pos"], "left").withColumn("new", F.coalesce("new", F.lit(True)))
    head = F.concat(F.lit("fixedStep chrom="), F.col("chrom"), F.lit(" start="), F.col("pos").cast("string"), F.lit(" step=1\n"))
    return c.orderBy("chrom", "pos").select("chrom", F.concat(F.when(F.col("new"), head).otherwise(""), F.col("coverage").cast("string")).alias("value"))


def matrix_lines(m: DataFrame, encoding: str | None = None) -> DataFrame:
    """(value): a line for each sample of (sample, col, value), cells in order of all columns of the matrix; NA for null
    values and for cells that a sample lacks."""
    every = m.agg(F.collect_set("col").alias("every"))  # one row: as long as the header
    own = m.groupBy("sample").agg(F.collect_list(F.struct("col", "value")).alias("own")).join(every, F.lit(True))
    kind = dict(m.dtypes)["value"]
    lacking = F.transform(F.array_except("every", F.transform("own", lambda x: x["col"])), lambda c: F.struct(c.alias("col"), F.lit(None).cast(kind).alias("value")))
    rows = own.select("sample", F.transform(F.array_sort(F.concat("own", lacking)), lambda x: F.coalesce(x["value"].cast("string"), F.lit("NA"))).alias("cells"))
    if encoding == "rle":
        runs = F.transform("cells", lambda x: F.concat_ws("\t", x, F.lit("1")))
        return rows.select(F.concat_ws("\t", F.col("sample").cast("string"), F.array_join(runs, "\t")).alias("value"))
    return rows.select(F.concat_ws("\t", F.col("sample").cast("string"), F.array_join("cells", "\t")).alias("value"))


def by_place(reads: DataFrame, size: int, path: str) -> None:
    """Files by chromosome and by bucket of `size` positions."""
    reads.withColumn("bucket", F.floor(F.col("pos") / size)).repartition("rname", "bucket").write.partitionBy("rname", "bucket").mode("error").parquet(path)
