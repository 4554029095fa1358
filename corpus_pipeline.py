"""From raw documents to packed training sequences, in stages that are each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.llm import crf, lines, packing, rules, simhash
from varispark.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts and the n-gram regression keep; null, empty and blank texts go. Repeated rows are
    judged apart, extra columns stay, an empty table stays empty."""
    return rules.filter_documents(docs, rules.trained(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.7 or more, null texts as one line without words; repeated rows are judged
    apart, extra columns stay, an empty table stays empty."""
    return crf.filter_documents(docs, crf.trained(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that equal or nearly equal an earlier one; n_chars follows the text.

    A document may end without text; null texts stay null, rows equal in doc_id and text get the same result.
    """
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.exists("line_dups", lambda x: x["removed"]), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each SimHash group; null and empty texts are one group.

    Texts that share a doc_id are judged apart; rows equal in both stay or go together; null doc_ids come last.
    """
    return simhash.simhash_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with digests of their ids; null texts are their end id alone, repeated doc_ids are
    packed apart."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("packing", pack),
]

#: Trained scores, edit joins and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
