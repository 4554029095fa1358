"""Sources beside files of one format: tables over JDBC, markup files, path resolution, format detection, expression reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names


def jdbc(spark: SparkSession, url: str, query: str, snapshot: str | None = None, **options: str) -> DataFrame:
    """Rows of a query; with a snapshot path, read once and from then on from there, an empty result included.

    flush a snapshot by deleting its folder.
    """
    if snapshot and exists(spark, f"{snapshot}/_SUCCESS"):
        return spark.read.parquet(snapshot)
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    if snapshot:
        rows.write.mode("overwrite").parquet(snapshot)
        return spark.read.schema(rows.schema).parquet(snapshot)
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def genes_in_region(genes: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Genes (chrom, tx_start, tx_end) that overlap a region; the test reaches the scan as a pushed filter."""
    return genes.where((F.col("chrom") == chrom) & ~((F.col("tx_end") < start) | (F.col("tx_start") > end)))


def newest_snp_table(tables: list[str]) -> str | None:
    """Of table names snpN, the one with the greatest number."""
    found = [t for t in tables if t.startswith("snp") and t[3:].isdigit()]
    return max(found, key=lambda t: int(t[3:]), default=None)


def markup(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields) of a markup file: a keyword and tab-separated fields a line."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(F.get(f, F.lit(0)).alias("kind"), F.slice(f, F.lit(2), F.size(f)).alias("fields"))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, chrom, start, end) of a gene list, names in upper case for look-up without regard to case."""
    t = spark.read.option("sep", "\t").schema("name string, chrom string, start int, end int").csv(path)
    return t.withColumn("name", F.upper("name")).withColumn("chrom", names.chromosome(F.col("chrom")))


def is_binary_matrix(spark: SparkSession, path: str) -> bool:
    """Whether a matrix file is binary: text begins with '#'. Two bytes are read, whatever the file's size."""
    raw = first_bytes(spark, path, 2)
    return bool(raw) and raw[:1] != b"#" and raw != b"\x1f\x8b"


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """At most n bytes from the beginning of the first file of a path, through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    while found and found[0].isDirectory():
        found = [x for x in fs.listStatus(found[0].getPath()) if not x.getPath().getName().startswith(("_", "."))]
    if not found:
        return b""
    stream = fs.open(found[0].getPath())
    try:
        out = bytearray()
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def pathways(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, name, gene) of lines of a pathway, its name and as many genes as it has."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(F.get(f, F.lit(0)).alias("pathway"), F.get(f, F.lit(1)).alias("name"), F.explode(F.slice(f, F.lit(3), F.size(f))).alias("gene")).where("gene <> ''")


def expression_report(spark: SparkSession, path: str) -> DataFrame:
    """(marker, log_ratio) of an expression report: rows DATA under the columns of the row FEATURES, markers chr… alone."""
    lines = spark.read.text(path).where(F.col("value").startswith("FEATURES") | F.col("value").startswith("DATA"))
    head = lines.where(F.col("value").startswith("FEATURES")).first()["value"].split("\t")
    f = F.split("value", "\t")
    name, ratio = head.index("SystematicName"), head.index("LogRatio")
    return lines.where(F.col("value").startswith("DATA")).select(F.get(f, F.lit(name)).alias("marker"), F.get(f, F.lit(ratio)).try_cast("double").alias("log_ratio")).where(F.col("marker").startswith("chr"))


def poly_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, base, place, area, rel, alt, alt_place, alt_area, alt_rel) of poly files; 'nan' is 0, N no alternate."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.split(F.trim("value"), "\n")
    head = F.split(F.get(rows, F.lit(0)), r"\s+")
    r = whole.select(F.get(head, F.lit(0)).alias("name"), F.posexplode(F.slice(rows, F.lit(2), F.size(rows))).alias("i", "line")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    number = lambda k: F.coalesce(F.nanvl(F.get("f", F.lit(k)).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return r.where("line <> ''").select("name", "i", F.get("f", F.lit(0)).alias("base"), number(1).alias("place"), number(2).alias("area"), number(3).alias("rel"), F.get("f", F.lit(4)).alias("alt"), number(5).alias("alt_place"), number(6).alias("alt_area"), number(7).alias("alt_rel"))


def missing_names(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Names that were asked for and didn't come."""
    return wanted.select(key).distinct().join(got.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: of files that are loaded anew, the newest counts."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
