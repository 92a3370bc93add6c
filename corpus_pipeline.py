"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, then packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the
next stage. All but the last return the columns of documents; other columns of docs go. Nulls, empty texts,
repeated rows and empty tables have the results that the operators state: a null or short text fails the
quality rules, and of equal rows the join keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, packing, repetition, secret_scan
from corpusloom.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.judged(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: one that has the group's lowest id.

    All but the rows of that id drop out by a comparison; only what is left is ranked. Where every id of a
    group is null, or rows repeat the lowest id, the lowest row stays.
    """
    found = jaccard_join.linked(docs.select(COLUMNS))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    place = F.row_number().over(W.partitionBy("component").orderBy("text", "lang", "source", "n_chars"))
    return first.withColumn("_place_", place).where("_place_ = 1").select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text where that changed."""
    scans = secret_scan.scanned(docs.select(COLUMNS))
    found = F.size(secret_scan.all_spans()) > 0
    changed = secret_scan.redacted(scans).withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, each source at its share of the tokens."""
    return packing.packed(docs.select(COLUMNS))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_passages), ("secret scans", secrets), ("packing", pack)]

#: Packing works on tokens, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"pipeline-{number}")
    return docs
