"""Records of runs: foreign keys, generated ids, reports, packages, persisted audit results, registered regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.norms import latest
from corpusloom.operators.ordering import numbered
from corpusloom.operators.runs import export_counts, exported


def appended(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """new under generated keys that follow the highest of old, in the given order; old rows are not touched."""
    highest = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_highest"))  # one row
    return numbered(new, order, "_number").join(F.broadcast(highest)).withColumn(key, F.col("_highest") + F.col("_number")).drop("_highest", "_number")


def with_parents(rows: DataFrame, on: list[str], parents: DataFrame, parent_id: str) -> DataFrame:
    """rows with the key of the parent that their names give; violation tells those that have none.

    parents have the columns on and parent_id, each combination once.
    """
    out = rows.join(parents.select(*on, parent_id), on, "left")
    return out.withColumn("violation", F.when(F.col(parent_id).isNull(), F.lit(f"no {parent_id}")))


def placed(rows: DataFrame, parts: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place from 1 in the listing of their part."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*parts).orderBy(*order)))


def evaluations(rows: DataFrame, gold_hash: str | None = None) -> DataFrame:
    """Evaluations of each run, newest first, of one gold hash or of all, with the triplet F1 of their summary (malformed: none)."""
    kept = rows if gold_hash is None else rows.where(F.col("gold_hash") == gold_hash)
    f1 = F.get_json_object("summary", "$.overall.triplet_f1").try_cast("double")
    return placed(kept.withColumn("triplet_f1", f1), ["run_id"], [F.desc("created_at"), F.desc("evaluation_id")])


def evaluation_report(metrics: DataFrame, alignments: DataFrame) -> DataFrame:
    """The lines of each evaluation's report: metrics by scope and name, then alignments by document, name and type."""
    m = metrics.select("evaluation_id", F.lit("metric").alias("part"), F.struct("scope_type", F.col("scope_name").alias("name"), F.col("metric_name").alias("kind")).alias("line"), F.col("value").cast("string").alias("told"))
    a = alignments.select("evaluation_id", F.lit("alignment").alias("part"), F.struct(F.lit("document").alias("scope_type"), F.concat_ws("/", "document", "name").alias("name"), F.col("type").alias("kind")).alias("line"), F.col("status").alias("told"))
    out = placed(m.unionByName(a), ["evaluation_id"], [F.desc("part"), F.col("line"), F.col("told")])
    return out.select("evaluation_id", "part", "line.*", "told", "place")


def audit_runs(runs: DataFrame, documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Audit runs with their document's name and the number of their tasks; a run of no known document is left out."""
    n = tasks.groupBy("run_id").agg(F.count("*").alias("n_tasks"))
    return runs.join(documents.select("document_id", "document_name"), "document_id").join(n, "run_id", "left").fillna(0, ["n_tasks"])


def persisted_results(results: DataFrame, evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of results (run_id, task_id, execution_status, result), their evidence and issues, numbered within the task.

    Each row is a result, a piece of evidence or an issue: run_id, task_id, kind, place and body.
    """
    r = results.select("run_id", "task_id", F.lit("result").alias("kind"), F.lit(1).alias("place"), F.concat_ws(":", "execution_status", F.coalesce("result", F.lit(""))).alias("body"))
    e = placed(evidence, ["run_id", "task_id"], ["ordinal"]).select("run_id", "task_id", F.lit("evidence").alias("kind"), "place", F.col("locator").alias("body"))
    i = placed(issues, ["run_id", "task_id"], ["category", "description"]).select("run_id", "task_id", F.lit("issue").alias("kind"), "place", F.concat_ws(": ", "category", "description").alias("body"))
    return r.unionByName(e).unionByName(i)


def task_differences(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, task_id and problem: tasks of a run without a result, and results of no task of the run. None: the sets are equal."""
    missing = tasks.join(results, ["run_id", "task_id"], "left_anti").select("run_id", "task_id", F.lit("missing").alias("problem"))
    extra = results.join(tasks, ["run_id", "task_id"], "left_anti").select("run_id", "task_id", F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra)


def gold_by_id(triplets: DataFrame, entities: DataFrame) -> DataFrame:
    """Gold triplets (doc, head_id, relation, tail_id) under the names and types of their entities (doc, entity_id, canonical_name, type).

    Ids are compared trimmed; a triplet of an unknown id or without a relation is dropped.
    """
    ends = entities.select("doc", F.trim("entity_id").alias("_id"), "canonical_name", "type")
    end = lambda name: ends.select("doc", F.col("_id").alias(f"_{name}"), F.col("canonical_name").alias(name), F.col("type").alias(f"{name}_type"))
    rows = triplets.select("doc", F.trim("head_id").alias("_head"), F.trim("relation").alias("relation"), F.trim("tail_id").alias("_tail")).where("relation <> ''")
    return rows.join(end("head"), ["doc", "_head"]).join(end("tail"), ["doc", "_tail"]).select("doc", "head", "head_type", "relation", "tail", "tail_type")


def registered(families: DataFrame, versions: DataFrame, clause_sets: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New families, versions and clause sets that incoming (family_name, version_label, content) adds.

    A family is found by its name, a version by family and label, and a clause set by version and the hash of its
    content, which never changes: what exists is reused, the rest gets the next ids. Rows that come twice count once.
    """
    rows = incoming.withColumns({"family_name": tx.collapsed(F.col("family_name")), "content_hash": F.sha2(tx.strip(F.col("content")), 256)}).select("family_name", "version_label", "content_hash").distinct()
    new_families = appended(families, rows.select("family_name").distinct().join(families, "family_name", "left_anti"), "family_id", ["family_name"])
    every_family = families.select("family_id", "family_name").unionByName(new_families.select("family_id", "family_name"))
    known = rows.join(every_family, "family_name")
    new_versions = appended(versions, known.select("family_id", "version_label").distinct().join(versions, ["family_id", "version_label"], "left_anti"), "version_id", ["family_id", "version_label"])
    every_version = versions.select("version_id", "family_id", "version_label").unionByName(new_versions.select("version_id", "family_id", "version_label"))
    sets = known.join(every_version, ["family_id", "version_label"]).select("version_id", "content_hash").distinct().join(clause_sets, ["version_id", "content_hash"], "left_anti")
    return new_families, new_versions, appended(clause_sets, sets, "clause_set_id", ["version_id", "content_hash"])


def encoder_fingerprint(model: Column, width: Column, most_tokens: Column, overlap: Column) -> Column:
    """What distinguishes the vectors of one encoder profile."""
    return tx.stable_hash(model.alias("model"), most_tokens.alias("most_tokens"), overlap.alias("overlap"), width.alias("width"))


def index_builds(clause_sets: DataFrame, clauses: DataFrame, indexes: DataFrame, encoder: Column) -> DataFrame:
    """What building the index of each version comes to: version_id, clause_set_id, fingerprint, n_clauses, status and reason.

    The newest clause set of a version (version_id, clause_set_id, created_at) counts. Its fingerprint is that of the
    encoder, the set and its clauses' hashes in order. skipped: a ready index has it; failed: no clauses, or a blank
    one; ready otherwise.
    """
    newest = latest(clause_sets.withColumn("_at", F.struct("created_at", "clause_set_id")), "version_id", "_at").select("version_id", "clause_set_id")
    c = clauses.groupBy("clause_set_id").agg(
        F.count("*").alias("n_clauses"), F.count_if(~F.col("text").rlike(r"(?U)\S")).alias("n_blank"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_index", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("content"),
    )
    out = newest.join(c, "clause_set_id", "left").fillna(0, ["n_clauses", "n_blank"])
    out = out.withColumn("fingerprint", F.sha2(F.concat_ws(":", encoder, "clause_set_id", F.coalesce("content", F.lit(""))), 256))
    ready = indexes.where("status = 'ready'").select("fingerprint", F.lit(True).alias("_ready")).distinct()
    reason = F.when(F.col("n_clauses") == 0, "no_clauses").when(F.col("n_blank") > 0, "blank_clause")
    out = out.join(ready, "fingerprint", "left").withColumn("reason", reason)
    return out.select("version_id", "clause_set_id", "fingerprint", "n_clauses", F.when(F.col("_ready"), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("ready").alias("status"), "reason")


#: The tables of an export package.
PACKAGE = ("runs", "documents", "chunks", "entities", "retrievals", "triplets", "evidence", "calls", "evaluations", "metrics", "alignments")


def export_package(path: str, run: str, **tables: DataFrame) -> DataFrame:
    """Writes all tables of one run as CSV under path, with run.json, and tells table_name and row_count as written.

    tables are those of PACKAGE, each with run_id; a table of other runs alone is written empty.
    """
    if set(tables) != set(PACKAGE):
        raise ValueError(f"an export package has the tables {PACKAGE}")
    spark = tables["runs"].sparkSession
    for name in PACKAGE:
        exported(tables[name].where(F.col("run_id") == run)).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
    tables["runs"].where(F.col("run_id") == run).write.mode("overwrite").json(f"{path}/run.json")
    read = lambda name: spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(exported(tables[name]).schema).csv(f"{path}/{name}")
    return export_counts(**{name: read(name) for name in PACKAGE})
