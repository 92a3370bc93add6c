"""The queries of this package for the driver: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, jaccard_join, language_id, packing, periodic_runs, pitman_yor, quality_machine, quotation, repetition, secret_scan, sharding, warc, whitening
from corpusloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_pitman_yor": _over("documents", pitman_yor.op1_pitman_yor),
        "op2_jaccard_join": _over("documents", jaccard_join.op2_jaccard_join),
        "op3_histogram_sort": _over("documents", sharding.op3_histogram_sort),
        "op4_warc": _over("pages", warc.op4_warc),
        "op5_decontamination": lambda spark, sf_dir: decontamination.op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op6_mixture_packing": _over("documents", packing.op6_mixture_packing),
        "op7_byte_cnn": _over("documents", language_id.op7_byte_cnn),
        "op8_quotation": _over("conversations", quotation.op8_quotation),
        "op9_repetition": _over("documents", repetition.op9_repetition),
        "op10_secrets": _over("documents", secret_scan.op10_secrets),
        "op11_factorisation_machine": lambda spark, sf_dir: quality_machine.op11_factorisation_machine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op12_periodic_runs": _over("documents", periodic_runs.op12_periodic_runs),
        "op13_bit_sliced_scatter": _over("embeddings", whitening.op13_bit_sliced_scatter),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op5_decontamination": decontamination.OP5_SQL,
        "op8_quotation": quotation.OP8_SQL,
        "op9_repetition": repetition.OP9_SQL,
        "op10_secrets": secret_scan.OP10_SQL,
        "op12_periodic_runs": periodic_runs.OP12_SQL,
    }
