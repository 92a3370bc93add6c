"""Queries over the driver's tables, and the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import audit_plans, evidence_plans, norm_plans, record_plans, run_plans, text_plans

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (text_plans, run_plans, evidence_plans, norm_plans, record_plans, audit_plans)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold evidence of which benchmark items."""
    return evidence_plans.ret_benchmark_evidence(spark, sf_dir)
