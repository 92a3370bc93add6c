"""Documents taken in as their files arrive, each exactly once, with a record of what was processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming.progress import arriving_sentences


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def processed(spark: SparkSession, store: str) -> DataFrame:
    """name and batch of all documents that were taken in; none where nothing was yet."""
    return _read(spark, f"{store}/processed", "name string, batch long")


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the batches that are on record, with their batch: those of a batch that failed before its record was written are not seen."""
    return spark.read.parquet(f"{store}/rows").join(F.broadcast(processed(spark, store).select("batch").distinct()), "batch", "left_semi")  # a row for each batch


def ingest(spark: SparkSession, folder: str, store: str, rows_of: Callable[[SparkSession, str], DataFrame] = arriving_sentences) -> None:
    """Takes in what has arrived in a folder since the last call: rows and the record of their documents.

    rows_of makes a stream of rows with the name of their file. A batch writes its rows and then its record, both in
    folders of its number that replace what an earlier attempt of the same batch left there; the checkpoint gives a
    batch that is run again the same files. So each file counts once, however often a batch fails or is repeated.
    Files without rows are not on record and are not read again either.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
        batch.select("name").distinct().write.mode("overwrite").parquet(f"{store}/processed/batch={number}")
        batch.unpersist()

    query = rows_of(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
