"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of documents; the last returns a
row for each packed piece.

Defined cases: a null text fails the base rule, so it goes at the first stage; a
document that line dedup empties stays, as an empty text; of equal rows and of equal
texts one row stays after near-duplicates; mixing may then repeat it. Ties go to the
smaller doc_id, and null ids count as the last. Empty tables give no rows. Further
columns, whatever their names, go along up to packing, which keeps doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import lines, mixing, neardup, packing, quality
from contactspark.llm.common import fresh_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the forest finds anomalous go. Null texts fail; without labels the base rule decides alone."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines leave the texts, and n_chars follows; every document stays. The first place of a run, by doc_id, keeps it."""
    cleaned = lines.dedup_runs(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, and one row of it; null texts all stay."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source has its target of words; null is a source, and a document without words is drawn by its chance."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; a null or empty text is a piece of the end token alone."""
    return packing.pack(docs, ["doc_id"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", neardup_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Forest, signatures and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    raise AssertionError
