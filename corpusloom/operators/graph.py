"""The knowledge graph as tables: entities, assertions, aggregate edges, and idempotent merging of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Qualifiers that may be cut from a name when the rest is a known entity.
PREFIXES = ("临时", "作业")
RELATION = r"^[A-Z][A-Z0-9_]*$"


def known_entities(triplets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """entity_type and name of all heads and tails, and of what the graph holds already."""
    out = triplets.select(F.col("head_type").alias("entity_type"), F.col("head").alias("name")).union(triplets.select("tail_type", "tail"))
    return (out if existing is None else out.union(existing.select("entity_type", "name"))).distinct()


def canonical_names(known: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """entity_type, name, canonical and method: a name less an approved prefix, where that is known; the longest rest wins.

    The rests are derived from each name, so the search for them is an equi-join.
    """
    rests = F.array_compact(F.array(*[F.when(F.startswith("name", F.lit(p)) & (F.length("name") > len(p)), F.substring(F.col("name"), len(p) + 1, F.length("name"))) for p in prefixes]))
    tried = known.select("entity_type", "name", F.explode(rests).alias("rest"))
    hits = tried.join(known.select("entity_type", F.col("name").alias("rest")), ["entity_type", "rest"]).groupBy("entity_type", "name").agg(F.max_by("rest", F.struct(F.length("rest"), "rest")).alias("canonical"))
    out = known.join(hits, ["entity_type", "name"], "left")
    return out.select("entity_type", "name", F.coalesce("canonical", "name").alias("canonical"), F.when(F.col("canonical").isNull(), "exact").otherwise("containment").alias("method"))


def assertions(triplets: DataFrame, names: DataFrame) -> DataFrame:
    """Assertion rows of valid triplets: id run:triplet, canonical ends, and whether the relation's name is usable."""
    head = names.select(F.col("entity_type").alias("head_type"), F.col("name").alias("head"), F.col("canonical").alias("head_name"))
    tail = names.select(F.col("entity_type").alias("tail_type"), F.col("name").alias("tail"), F.col("canonical").alias("tail_name"))
    rows = triplets.where("is_valid").join(head, ["head_type", "head"]).join(tail, ["tail_type", "tail"])
    return rows.withColumns({"assertion_id": F.concat_ws(":", "run_id", "triplet_id"), "usable": F.col("relation").rlike(RELATION)})


def merge_status(old: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """assertion_id and status of a run's merge: created, updated, deleted or kept (other runs)."""
    a = old.select("assertion_id", F.col("run_id").alias("_old"))
    b = new.select("assertion_id", F.lit(True).alias("_new"))
    both = a.join(b, "assertion_id", "full_outer")
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new"), "updated").when(F.col("_old") == run, "deleted").otherwise("kept")
    return both.select("assertion_id", status.alias("status"))


def merged(old: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """The assertions after a run is merged: those of other runs and the new ones. Merging twice changes nothing."""
    return old.where(F.col("run_id") != run).unionByName(new)


def repointed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Assertions whose ends are moved to canonical names."""
    to = lambda end: names.select(F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"), F.col("canonical").alias(f"_{end}"))
    out = edges.join(to("head"), ["head_type", "head_name"], "left").join(to("tail"), ["tail_type", "tail_name"], "left")
    return out.withColumns({"head_name": F.coalesce("_head", "head_name"), "tail_name": F.coalesce("_tail", "tail_name")}).drop("_head", "_tail")


def aliases(names: DataFrame) -> DataFrame:
    """All raw names that ended in each canonical entity."""
    return names.groupBy("entity_type", F.col("canonical").alias("name")).agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no assertion touches."""
    used = edges.select(F.col("head_type").alias("entity_type"), F.col("head_name").alias("name")).union(edges.select("tail_type", "tail_name"))
    return entities.join(used, ["entity_type", "name"], "left_anti")


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """Assertions, distinct documents and the last time of each head, relation and tail, over all runs."""
    keys = ["head_type", "head_name", "relation", "tail_type", "tail_name"]
    return edges.groupBy(*keys).agg(F.count("*").alias("assertion_count"), F.count_distinct("document_id").alias("document_count"), F.max("extracted_at").alias("last_seen"))


def edge_query(edges: DataFrame, types: list[str] | None = None, relations: list[str] | None = None, name: str | None = None, limit: int = 200) -> DataFrame:
    """The strongest aggregate edges under optional filters."""
    keep: Column = F.lit(True)
    if types:
        keep = keep & (F.col("head_type").isin(types) | F.col("tail_type").isin(types))
    if relations:
        keep = keep & F.col("relation").isin(relations)
    if name:
        keep = keep & (F.contains(F.lower("head_name"), F.lit(name.lower())) | F.contains(F.lower("tail_name"), F.lit(name.lower())))
    return edges.where(keep).orderBy(F.desc("assertion_count"), "head_name", "relation", "tail_name", "head_type", "tail_type").limit(limit)


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes of edges, with their degree."""
    ends = edges.select(F.col("head_type").alias("entity_type"), F.col("head_name").alias("name")).union(edges.select("tail_type", "tail_name"))
    return ends.groupBy("entity_type", "name").agg(F.count("*").alias("degree"))


def provenance(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """head -> assertion -> tail paths whose ends both are entities of the graph."""
    head = entities.select(F.col("entity_type").alias("head_type"), F.col("name").alias("head_name"))
    tail = entities.select(F.col("entity_type").alias("tail_type"), F.col("name").alias("tail_name"))
    return edges.join(head, ["head_type", "head_name"]).join(tail, ["tail_type", "tail_name"])
