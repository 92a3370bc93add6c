"""Sources: text files, gold annotations, ontologies, catalogues and task libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLET = "struct<head:string,head_name:string,head_id:string,head_type:string,relation:string,tail:string,tail_name:string,tail_id:string,tail_type:string>"
GOLD = (
    "document struct<document_id:string,title:string>, entity string, sentences array<struct<sentence_id:string,text:string>>, "
    "entities array<struct<mention:string,sentence_id:string,canonical_id:string,canonical_name:string,type:string,aliases:array<string>>>, "
    "canonical_entities array<struct<entity_id:string,canonical_name:string,type:string,aliases:array<string>>>, "
    f"entity_mentions array<struct<canonical_id:string,mention:string>>, triplets array<{TRIPLET}>, _broken string"
)
#: Cells that say "not a member" in a catalogue.
NO_MEMBER = ("", "/", "-", "无")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Direct .md and .txt files of a folder by lower-cased name: path, name and length, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt,MD,TXT}").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy(F.lower("name"))


def documents(spark: SparkSession, folder: str, selected: DataFrame | None = None, processed: DataFrame | None = None) -> DataFrame:
    """name and text of the files of a folder, of the selected names and without those processed already."""
    texts = spark.read.option("pathGlobFilter", "*.{md,txt,MD,TXT}").text(folder, wholetext=True)
    out = texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    if selected is not None:
        out = out.join(selected, "name", "left_semi")
    return out if processed is None else out.join(processed, "name", "left_anti")


def gold_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold files under a folder, of any of the accepted shapes, and the files that cannot be read.

    A bare array of triplets becomes one row per triplet of the same schema.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    rows = raw.withColumn("_sound", F.try_parse_json("value").isNotNull())
    broken = rows.where(~F.col("_sound")).select("path", F.lit("malformed JSON").alias("error"))
    sound = rows.where("_sound")
    whole = sound.where("value not like '[%'").select("path", F.from_json("value", GOLD, {"columnNameOfCorruptRecord": "_broken"}).alias("g")).select("path", "g.*").drop("_broken")
    bare = sound.where("value like '[%'").select("path", F.from_json("value", f"array<{TRIPLET}>").alias("triplets"))
    return whole.unionByName(bare, allowMissingColumns=True), broken


def gold_hash(spark: SparkSession, folder: str) -> DataFrame:
    """One hash of a folder's gold files: of their relative paths and the hashes of their bytes, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), r"^\Q" + "/" + folder.split(":", 1)[-1].strip("/") + r"\E/", "")
    each = files.select(inside.alias("name"), F.sha2("content", 256).alias("h"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat_ws(":", x["name"], x["h"]))
    return each.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("gold_hash"), F.count("*").alias("n_files"))


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Types and relation rules of an ontology file; items may be names or objects with allowed types."""
    raw = spark.read.text(path, wholetext=True)
    types = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.entity_types"), "array<string>")).alias("item"))
    rules = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.relation_types"), "array<string>")).alias("item"))
    name = F.when(F.startswith("item", F.lit("{")), F.coalesce(F.get_json_object("item", "$.name"), F.get_json_object("item", "$.type"))).otherwise(F.col("item"))
    listed = lambda key: F.coalesce(F.from_json(F.get_json_object("item", f"$.{key}"), "array<string>"), F.expr("cast(array() as array<string>)"))
    return types.select(name.alias("type")), rules.select(name.alias("relation"), listed("head_types").alias("head_types"), listed("tail_types").alias("tail_types"))


def risk_catalogue(sheets: list[DataFrame], code: str = "code") -> DataFrame:
    """code -> sorted work types: columns of a sheet are work types, a cell that is no marker means membership."""
    out = None
    for sheet in sheets:
        types = [c for c in sheet.columns if c != code]
        rows = sheet.select(F.trim(F.col(code).cast("string")).alias("code"), *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in types]).unpivot("code", types, "work_type", "cell")
        rows = rows.where(~F.col("cell").isin(*NO_MEMBER)).select("code", "work_type")
        out = rows if out is None else out.union(rows)
    return out.groupBy("code").agg(F.array_sort(F.collect_set("work_type")).alias("work_types"))


def task_library(base: DataFrame, updates: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base tasks with updated fields and added tasks, in order; and ids or orders that are not unique."""
    fields = [c for c in base.columns if c != "task_id"]
    new = updates.select("task_id", *[F.col(c).alias(f"_{c}") for c in fields if c in updates.columns])
    out = base.join(new, "task_id", "left").select("task_id", *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in fields]).unionByName(added)
    twice = lambda c: out.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("field"), "value", "n")
    return out.orderBy("task_order"), twice("task_id").union(twice("task_order"))


def rule_coverage(tasks: DataFrame, rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """Deterministic tasks without a rule, rules without a task, and rules whose handler is not registered."""
    wanted = tasks.where("route = 'deterministic'").select("task_id")
    missing = wanted.join(rules, "task_id", "left_anti").select("task_id", F.lit("missing_rule").alias("problem"))
    extra = rules.join(wanted, "task_id", "left_anti").select("task_id", F.lit("unexpected_rule").alias("problem"))
    lost = rules.join(handlers, "handler", "left_anti").select("task_id", F.lit("unknown_handler").alias("problem"))
    return missing.union(extra).union(lost)
