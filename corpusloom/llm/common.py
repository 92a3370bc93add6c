"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import gone_at_exit
from corpusloom.sources.shared import path as shared_path
from corpusloom.sources.shared import written

__all__ = ["fold_ascii", "gone_at_exit", "id_remainder", "shared_path", "table", "with_struct", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_struct(df: DataFrame, value: Column, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """df with the fields of a struct column; they replace columns of the same names (in any case)."""
    taken = {n.lower() for n in names}
    columns = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    held = "_struct_"
    while held in df.columns:
        held += "_"
    return df.withColumn(held, value).select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{held}`.`{n}`") for n in names])


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor
