"""Runs and their records: overviews, listings, evidence links, lifecycle, exports and report versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Events that end a run, and events kept for display.
FINAL_EVENTS = ("completed", "completed_with_errors", "cancelled", "failed")
LAST_EVENTS = 200


def overview(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def recent(rows: DataFrame, at: str, tie: str, n: int, keep: Column | None = None) -> DataFrame:
    """The newest n rows, optionally of one status or stage."""
    return (rows if keep is None else rows.where(keep)).orderBy(F.desc(at), tie).limit(n)


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with the number of rows of every child table."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return out


def run_status(documents: DataFrame) -> DataFrame:
    """Status of each run from its documents: all failed, some failed, or completed."""
    c = documents.groupBy("run_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return c.withColumn("status", F.when(F.col("n_failed") == F.col("n_documents"), "failed").when(F.col("n_failed") > 0, "completed_with_errors").otherwise("completed"))


def event_folds() -> list[Column]:
    """Latest stage and document, progress, status and count of events (ts, seq, event_type, stage, document_name, completed, total)."""
    at = F.struct("ts", "seq")
    done = F.col("event_type").isin("document_completed", "document_failed")
    final = F.when(F.col("event_type").isin(*FINAL_EVENTS), F.col("event_type")).when(F.col("event_type") == "started", F.lit("running"))
    last = lambda value, keep: F.max_by(value, F.when(keep, at))
    return [
        F.max_by("stage", at).alias("stage"),
        last(F.col("document_name"), F.col("document_name").isNotNull()).alias("document_name"),
        F.coalesce(last(F.col("completed"), done & F.col("completed").isNotNull()), F.lit(0)).alias("document_completed"),
        F.coalesce(last(F.col("total"), (done | (F.col("event_type") == "started")) & F.col("total").isNotNull()), F.lit(0)).alias("document_total"),
        F.coalesce(last(final, final.isNotNull()), F.lit("idle")).alias("status"),
        F.count("*").alias("n_events"),
    ]


def event_state(events: DataFrame) -> DataFrame:
    """State of each run from its events (run_id, ts, seq, event_type, stage, document_name, completed, total, metrics).

    Latest stage and document, stages in first-seen order, summed metrics, progress, final status.
    """
    base = events.groupBy("run_id").agg(*event_folds())
    stages = events.groupBy("run_id", "stage").agg(F.min(F.struct("ts", "seq")).alias("first"))
    stages = stages.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "stage"))), lambda x: x["stage"]).alias("seen_stages"))
    sums = events.select("run_id", F.explode("metrics").alias("name", "value")).groupBy("run_id", "name").agg(F.sum("value").alias("value"))
    sums = sums.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    of = lambda df: df.withColumnRenamed("run_id", "_run")
    same = F.col("run_id").eqNullSafe(F.col("_run"))  # a null run is a run
    return base.join(of(stages), same).drop("_run").join(of(sums), same, "left").drop("_run")


def last_events(events: DataFrame, n: int = LAST_EVENTS) -> DataFrame:
    """The newest n events of each run: a window group limit drops the others before the exchange."""
    return events.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("place") <= n)


def without_runs(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows that do not belong to deleted parents."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def deletion_outcomes(candidates: DataFrame, runs: DataFrame, references: DataFrame) -> DataFrame:
    """What becomes of each run asked to be deleted: missing, not_active, referenced, pending or deleted."""
    r = runs.select("run_id", F.coalesce("deletion_state", F.lit("active")).alias("state"))
    used = references.select("run_id").distinct().withColumn("_used", F.lit(True))
    out = candidates.join(r, "run_id", "left").join(used, "run_id", "left")
    return out.select(
        "run_id",
        F.when(F.col("state").isNull(), "missing").when(F.col("state") == "pending", "pending").when(F.col("state") != "active", "not_active").when(F.col("_used"), "referenced").otherwise("deleted").alias("outcome"),
    )


def publishable(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "completed") & (F.coalesce("deletion_state", F.lit("active")) == "active"))


def first_retrieval(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The hit of each key with the lowest rank, then id."""
    return hits.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("rank", "retrieval_id"))).where("_n = 1").drop("_n")


def evidence_links(triplets: DataFrame, hits: DataFrame) -> DataFrame:
    """Links of triplets to their evidence, numbered from 1; status rejected where the head has no such hit."""
    asked = triplets.select("triplet_id", "document_id", F.col("head").alias("entity"), F.posexplode("evidence_ids").alias("_i", "sentence_index"))
    found = first_retrieval(hits, ["document_id", "entity", "sentence_index"]).select("document_id", "entity", "sentence_index", "retrieval_id")
    out = asked.join(found, ["document_id", "entity", "sentence_index"], "left")
    return out.select("triplet_id", (F.col("_i") + 1).alias("evidence_order"), "sentence_index", "retrieval_id", F.when(F.col("retrieval_id").isNull(), "rejected").otherwise("linked").alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Rows by key, the newest of each: writing the same rows again changes nothing."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def unbuilt(wanted: DataFrame, indexes: DataFrame) -> DataFrame:
    """Rows whose fingerprint has no ready index yet."""
    return wanted.join(indexes.where("status = 'ready'").select("fingerprint"), "fingerprint", "left_anti")


def versioned_reports(reports: DataFrame) -> DataFrame:
    """Reports numbered within their run by creation, with the latest marked."""
    w = W.partitionBy("run_id")
    out = reports.withColumn("report_version", F.row_number().over(w.orderBy("created_at", "report_id")))
    return out.withColumn("is_latest", F.col("report_version") == F.max("report_version").over(w))


def exported(df: DataFrame) -> DataFrame:
    """All columns as export cells."""
    return df.select(*[tx.cell(F.col(n), kind).alias(n) for n, kind in df.dtypes])


def export_counts(**tables: DataFrame) -> DataFrame:
    """table_name and row_count of the tables of an export package."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        out = one if out is None else out.unionAll(one)
    return out


def write_package(path: str, **tables: DataFrame) -> None:
    """Every table as CSV with a header under path."""
    for name, df in tables.items():
        exported(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
