"""Text sources: SAM, FASTA, matrices, delimited tables, assemblies, chromatogram calls.

All are read with Spark's text reader, so files split into tasks and may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatrixConfig
from ..functions import names


def sam_reads(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text in READS order without sample columns; '*' gives null sequence and qualities."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    known = lambda c: F.nullif(c, F.lit("*"))
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f), F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), t.substr(F.lit(6), F.length(t)))))
    qual = F.transform(F.filter(F.split(known(at(10)), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return lines.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), at(3).cast("int").alias("pos"), at(4).cast("int").alias("mapq"), known(at(5)).alias("cigar"),
        at(6).alias("rnext"), at(7).cast("int").alias("pnext"), known(at(9)).alias("seq"), qual.alias("qual"), tags.alias("tags"),
    )


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields): header lines as maps, kind SQ, RG, PG or HD."""
    lines = spark.read.text(path).where(F.col("value").rlike("^@[A-Z]{2}\t"))
    every = F.split("value", "\t")
    f = F.slice(every, F.lit(2), F.size(every))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(f, lambda t: F.struct(F.substring(t, 1, 2), t.substr(F.lit(4), F.length(t))))).alias("fields"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, bases) of each record; a record is one row, cut by chunked() for random access."""
    rec = spark.read.option("lineSep", "\n>").text(path)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>|\r$", "")
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return rec.where("value <> ''").select(F.substring_index(head, " ", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("description"), body.alias("bases"))


def chunked(records: DataFrame, size: int) -> DataFrame:
    """REFERENCE chunks of sequences (name, bases)."""
    n = F.ceil(F.length("bases") / F.lit(size)).cast("int")
    k = records.where("bases <> ''").select("name", "bases", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return k.select(F.col("name").alias("chrom"), (F.col("k") * size + 1).alias("chunk_start"), F.col("bases").substr(F.col("k") * size + 1, F.lit(size)).alias("bases"))


def fasta_qualities(spark: SparkSession, path: str) -> DataFrame:
    """(name, qual) of FASTA-like quality files."""
    rec = spark.read.option("lineSep", "\n>").text(path)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return rec.where("value <> ''").select(F.substring_index(head, " ", 1).alias("name"), F.transform(F.regexp_extract_all(body, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("qual"))


def _cell(text: Column, cfg: MatrixConfig) -> Column:
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(-cfg.clamp), F.least(F.lit(cfg.clamp), F.round(number))).cast("tinyint"))


def matrix(spark: SparkSession, path: str, cfg: MatrixConfig = MatrixConfig()) -> DataFrame:
    """(sample, col, marker, value) of a matrix text file: comments '#k=v', a header line, a line a sample.

    Cells that are no numbers are null, others are rounded and held within the clamp. With the comment
    sample_data_encoding=rle a line has values each with how often it repeats. Only comments and the header, which
    are small, are looked at first. The header is one line of a file: a sample with the same text stays.
    """
    lines = spark.read.text(path)
    options = {r["k"]: r["v"] for r in lines.where(F.col("value").rlike("^#[^=]+=")).select(F.regexp_extract("value", "^#([^=]+)=", 1).alias("k"), F.regexp_extract("value", "^#[^=]+=(.*)$", 1).alias("v")).collect()}
    plain = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    header = plain.first()
    text = header["value"] if header else ""
    markers = text.split("\t")[1:] if header else []
    alike = plain.where(F.col("value") == text).groupBy(F.col("_metadata.file_path")).agg((F.count(F.lit(1)) - 1).alias("n"))
    rows = plain.where(F.col("value") != text).union(alike.select(F.explode(F.array_repeat(F.lit(text), F.col("n").cast("int")))))
    f = F.slice(F.split("value", "\t", -1), 2, 1 << 30)
    if options.get("sample_data_encoding") == "rle":
        pairs = F.sequence(F.lit(0), F.greatest(F.floor(F.size(f) / 2).cast("int") - 1, F.lit(0)))
        f = F.flatten(F.transform(pairs, lambda i: F.array_repeat(F.get(f, 2 * i), F.get(f, 2 * i + 1).cast("int"))))
    cells = rows.select(F.substring_index("value", "\t", 1).alias("sample"), F.posexplode(f).alias("col", "text"))
    labels = F.split(F.lit("\t".join(markers)), "\t")
    return cells.select("sample", "col", F.get(labels, F.col("col")).alias("marker"), _cell(F.col("text"), cfg).alias("value"))


def delimited(spark: SparkSession, path: str, comment: str | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """A table with comma or tab, whichever splits the first line into more parts; fields trimmed, dates standardised."""
    lines = spark.read.text(path)
    first = (lines.where(~F.col("value").startswith(comment)) if comment else lines).first()
    sep = "\t" if first and first["value"].count("\t") >= first["value"].count(",") else ","
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    t = (reader.option("comment", comment) if comment else reader).csv(path)
    return t.withColumns({c: names.standard_date(F.col(c)) for c in dates})


def bins(spark: SparkSession, path: str) -> DataFrame:
    """(name, first, last) of a bin set, whose first column is Chromosome or BinName."""
    t = delimited(spark, path)
    name = "Chromosome" if "Chromosome" in t.columns else "BinName"
    return t.select(F.col(name).alias("name"), F.col("c1").cast("int").alias("first"), F.col("c2").cast("int").alias("last"))


def tracks(text: str) -> list[tuple[int, int, int | None]]:
    """(start, end, value) of 'a-b:v,c,...': column ranges of a comment option."""
    out = []
    for part in text.split(","):
        span, _, value = part.strip().partition(":")
        a, _, b = span.partition("-")
        out.append((int(a), int(b or a), int(value) if value else None))
    return out


def assembly(spark: SparkSession, path: str) -> DataFrame:
    """(contig, kind, name, complemented, start, bases) of an ACE file: contigs (kind CO) and their reads (kind RD)."""
    rec = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", r"^\n+", "")).alias("value"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    from pyspark.sql.window import Window

    head = F.split(F.substring_index("value", "\n", 1), " ")
    r = rec.withColumn("kind", F.get(head, F.lit(0))).withColumn("name", F.get(head, F.lit(1))).withColumn("file", F.input_file_name())
    contig = F.last(F.when(F.col("kind") == "CO", F.col("name")), True).over(Window.partitionBy("file").orderBy("at"))
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    af = F.regexp_extract_all("value", F.lit(r"(?m)^AF (\S+ [UC] -?\d+)"), F.lit(1))
    r = r.withColumn("contig", contig)
    places = r.where("kind = 'BQ' or kind = 'AF'").select("contig", F.explode(af).alias("a")).select("contig", F.get(F.split("a", " "), F.lit(0)).alias("name"), (F.get(F.split("a", " "), F.lit(1)) == "C").alias("complemented"), F.get(F.split("a", " "), F.lit(2)).cast("int").alias("start"))
    own = r.where("kind in ('CO', 'RD')").select("contig", "kind", "name", body.alias("bases"))
    return own.join(places, ["contig", "name"], "left").select("contig", "kind", "name", "complemented", "start", "bases")


def phd(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, base, qual, place): called bases between BEGIN_DNA and END_DNA."""
    whole = spark.read.text(path, wholetext=True)
    name = F.trim(F.regexp_extract("value", r"BEGIN_SEQUENCE (\S+)", 1))
    calls = F.split(F.trim(F.regexp_extract("value", r"(?s)BEGIN_DNA\s*\n(.*?)\s*END_DNA", 1)), "\n")
    row = whole.select(name.alias("name"), F.posexplode(calls).alias("i", "line")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    return row.where("line <> ''").select("name", "i", F.get("f", F.lit(0)).alias("base"), F.get("f", F.lit(1)).cast("int").alias("qual"), F.get("f", F.lit(2)).cast("int").alias("place"))


def gistic_lines(spark: SparkSession, path: str) -> DataFrame:
    """(subtype, sign, q, chrom, start, end, markers, z) of peak lines."""
    f = F.split("value", ",")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    loc = names.location(at(3))
    rest = F.transform(F.slice(f, F.lit(5), F.size(f)), F.trim)
    z = F.array_position(rest, "_Zsc")
    markers = F.when(z > 0, F.slice(rest, F.lit(1), (z - 1).cast("int"))).otherwise(rest)
    return spark.read.text(path).where("value <> ''").select(at(0).alias("subtype"), at(1).alias("sign"), at(2).cast("double").alias("q"), loc["chrom"].alias("chrom"), loc["start"].alias("start"), loc["end"].alias("end"), markers.alias("markers"), F.when(z > 0, F.get(rest, z.cast("int")).cast("double")).alias("z"))


def genotypes(spark: SparkSession, path: str) -> DataFrame:
    """A genotype table; traces with two orientations are an error that the caller finds with two_way_traces()."""
    return delimited(spark, path)


def two_way_traces(table: DataFrame) -> DataFrame:
    return table.groupBy("TRACEID").agg(F.count_distinct("ORIENTATION").alias("n")).where("n > 1").select("TRACEID")
