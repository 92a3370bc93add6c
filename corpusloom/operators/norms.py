"""Regulations: clauses with heading paths, versions, coverage, segments, index builds and search results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.graph_paths import reaches_itself
from corpusloom.operators.retrieve import ranked
from corpusloom.operators.sizes import small

#: What starts a clause, and headings.
CLAUSE_HEADS = (r"^(第[一二三四五六七八九十百千万零〇0-9]+条)(.*)$", r"^(\d+(?:\.\d+){1,3})((?:\s+.*)?)$")
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
STATUSES = ("pending_confirmation", "effective", "upcoming", "superseded", "repealed")
START_WINDOW, LEAST_WINDOW, MOST_WINDOW = 3, 30, 300


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (from 0), line and its start offset."""
    split = docs.select(doc_id, F.split(text, "\n").alias("_lines"))
    out = split.select(doc_id, F.posexplode("_lines").alias("n", "line"))
    w = W.partitionBy(doc_id).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))


def clauses(docs: DataFrame, heads: tuple[str, ...] = CLAUSE_HEADS, heading: str = HEADING, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Clauses of each document: number, title, path of headings, text, offsets and parse status.

    A head line starts a clause that runs to the next head line; documents without any fall back to paragraphs.
    Heads are matched line by line: a bare number never takes the next line as its title. A heading of level k
    stands in the path as long as no heading of a level up to k comes after it.
    """
    by_doc = W.partitionBy(doc_id).orderBy("n")
    any_head = F.lit(False)
    for h in heads:
        any_head = any_head | F.col("line").rlike(h)
    rows = lines(docs, doc_id, text).withColumn("head", any_head)
    levels = range(1, 7)
    level = F.length(F.regexp_extract("line", heading, 1))
    title = F.regexp_extract("line", heading, 2)
    upto = by_doc.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"level": level, "title": title})
    rows = rows.withColumns({f"h{k}": F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(upto) for k in levels})
    path = F.array_compact(
        F.array(*[F.when(F.lit(True) if k == 1 else F.greatest(*[F.coalesce(F.col(f"h{j}.n"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) < F.col(f"h{k}.n"), F.col(f"h{k}.title")) for k in levels])
    )
    rows = rows.withColumn("path", path).withColumn("clause", F.sum(F.col("head").cast("int")).over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    numbered = rows.where("clause > 0").groupBy(doc_id, "clause").agg(
        F.min_by("line", "n").alias("first"), F.min_by("path", "n").alias("hierarchy_path"), F.min("start").alias("start_offset"), F.max(F.col("start") + F.length("line")).alias("end_offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    part = lambda g: F.coalesce(*[F.nullif(F.regexp_extract("first", h, g), F.lit("")) for h in heads])
    numbered = numbered.select(
        doc_id, F.col("clause").cast("int").alias("clause_index"), tx.strip(part(1)).alias("clause_number"), F.nullif(tx.strip(part(2)), F.lit("")).alias("clause_title"),
        "hierarchy_path", tx.strip(F.col("body")).alias("raw_text"), "start_offset", "end_offset", F.lit("structured").alias("parse_status"),
    )
    plain = rows.groupBy(doc_id).agg(F.max("clause").alias("m")).where("m = 0").select(doc_id)
    paragraphs = docs.join(plain, doc_id, "left_semi").select(doc_id, F.posexplode(F.split(text, r"\n\s*\n")).alias("i", "p")).where(F.col("p").rlike(r"(?U)\S") & ~tx.strip(F.col("p")).rlike(heading))
    fallback = paragraphs.select(
        doc_id, (F.col("i") + 1).alias("clause_index"), F.lit(None).cast("string").alias("clause_number"), F.lit(None).cast("string").alias("clause_title"),
        F.expr("cast(array() as array<string>)").alias("hierarchy_path"), tx.strip(F.col("p")).alias("raw_text"), F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"),
        F.lit("fallback").alias("parse_status"),
    )
    return numbered.unionByName(fallback)


def normal_text(text: Column) -> Column:
    """Lines without trailing white space, no blank ends."""
    return tx.strip(F.regexp_replace(text, r"(?Um)[^\S\n]+$", ""))


def version_violations(versions: DataFrame) -> DataFrame:
    """version_id and one row for every rule that a version breaks."""
    v = F.array_compact(
        F.array(
            F.when(~F.col("status").isin(*STATUSES), "unknown_status"),
            F.when(F.col("effective_year") > F.col("invalid_year"), "effective_after_invalid"),
            F.when(F.col("status").isin("superseded", "repealed") & F.col("invalid_year").isNull(), "invalid_year_missing"),
            F.when(F.col("metadata_confirmed") & (F.coalesce("metadata_hash", F.lit("")) == ""), "confirmed_without_hash"),
        )
    )
    return versions.select("version_id", F.explode(v).alias("violation"))


def supersede_cycles(versions: DataFrame) -> DataFrame:
    """Versions whose chain of superseded versions runs into a cycle."""
    return reaches_itself(versions.where("supersedes_version_id is not null").select(F.col("version_id").alias("node"), F.col("supersedes_version_id").alias("next")))


def applicable_versions(versions: DataFrame, years: DataFrame, families: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Versions that apply in each year (confirmed, from the effective to the invalid year), and same-family conflicts."""
    if families is not None:
        versions = versions.join(families, "family_id", "left_semi")
    if scope is not None:
        versions = versions.join(scope, "version_id", "left_semi")
    held = (F.col("effective_year") <= F.col("year")) & (F.col("invalid_year").isNull() | (F.col("invalid_year") >= F.col("year")))
    out = versions.where("metadata_confirmed").join(small(years), held)
    return out.withColumn("conflict", F.count("*").over(W.partitionBy("year", "family_id")) > 1)


def coverage(requested: DataFrame, candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """Status of each requested family: uncovered, cited_but_unindexed, partial or covered."""
    c = candidates.join(indexed.select("version_id").distinct().withColumn("_i", F.lit(1)), "version_id", "left")
    counts = c.groupBy("family_id").agg(F.count("*").alias("n_versions"), F.count("_i").alias("n_indexed"))
    out = requested.join(counts, "family_id", "left").fillna(0, ["n_versions", "n_indexed"])
    n, i = F.col("n_versions"), F.col("n_indexed")
    return out.withColumn("coverage_status", F.when(n == 0, "uncovered").when(i == 0, "cited_but_unindexed").when(i < n, "partial").otherwise("covered"))


def prefix(family: Column, path: Column, number: Column) -> Column:
    """The identity that heads every segment."""
    where = F.when(F.size(path) > 0, F.array_join(path, "/")).otherwise(F.lit("正文"))
    return F.concat(F.lit("【规范："), family, F.lit(" "), where, F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit(" "), number)).otherwise(F.lit("")), F.lit("】"))


def segments(clauses_: DataFrame, most: int = 128, overlap: int = 8) -> DataFrame:
    """Segments of at most most words of each clause (prefix, raw_text): short clauses stay whole, others overlap.

    A word costs one token and a joint; the prefix's words are taken from every segment's budget.
    """
    head = F.col("prefix")

    def pieces(words: Column, n_prefix: Column) -> Column:
        n = F.size(words)
        per = F.greatest(F.floor((F.lit(most) - n_prefix) / 2).cast("int"), F.lit(1))
        step = F.greatest(per - overlap, F.lit(1))
        # full segments follow one another by step; behind the first that reaches the end, ever shorter ones repeat its tail
        last = F.ceil(F.greatest(n - per, F.lit(0)) / step).cast("int")
        tail = F.greatest(F.least(F.lit(overlap), n - last * step - 1), F.lit(0))
        starts = F.concat(F.transform(F.sequence(F.lit(0), last), lambda k: k * step), F.when(tail > 0, F.sequence(n - tail, n - 1)).otherwise(F.expr("cast(array() as array<int>)")))
        cut = F.transform(starts, lambda i: F.concat(head, F.lit("\n"), F.array_join(F.slice(words, i + 1, per), " ")))
        return F.when(n_prefix + n <= most, F.array(F.concat(head, F.lit("\n"), F.col("raw_text")))).otherwise(cut)

    words = F.filter(F.split("raw_text", r"(?U)\s+"), lambda w: w != "")
    n_prefix = F.size(F.split("prefix", r"(?U)\s+"))
    # both are bound once, as elements of an array: an expression would be computed wherever it is used
    bound = F.array(F.struct(words.alias("words"), n_prefix.alias("n")))
    out = clauses_.withColumn("pieces", F.element_at(F.transform(bound, lambda x: pieces(x["words"], x["n"])), 1))
    return out.select(*clauses_.columns, F.posexplode("pieces").alias("segment_index", "segment")).withColumn("text_hash", F.sha2("segment", 256))


def _spans(costs: np.ndarray, room: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that cost at most room each, but hold one word at least; the next begins overlap words back."""
    sums = np.concatenate(([0], np.cumsum(costs)))
    starts = np.arange(len(costs))
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + room, side="right") - 1, starts + 1)
    follows = np.maximum(ends - overlap, starts + 1)
    at = 0
    while at < len(costs):
        yield at, int(ends[at])
        at = int(follows[at])


#: Clauses whose segments leave Python together.
COSTED_CLAUSES = 64


def costed_segments(clauses_: DataFrame, cost: Callable[[str], int], most: int = 128, overlap: int = 8) -> DataFrame:
    """As segments(), for any tokenizer: cost gives the tokens of a text; a word costs one more, its space.

    Clauses have clause_id, prefix and raw_text (null: empty); one that fits as it is stays whole. Of an Arrow batch
    only the words of one clause, and the segments of COSTED_CLAUSES, are in Python's memory at once.
    """

    def segments_of(head: str, text: str) -> list[str]:
        if cost(f"{head}\n{text}") <= most:
            return [f"{head}\n{text}"]
        words = text.split()
        costs = np.array([cost(w) + 1 for w in words], dtype=np.int64)
        return [f"{head}\n{' '.join(words[a:b])}" for a, b in _spans(costs, most - cost(head), overlap)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COSTED_CLAUSES):
                ids, heads, texts = batch.slice(at, COSTED_CLAUSES).columns
                found = [segments_of(h, t) for h, t in zip(heads.to_pylist(), texts.to_pylist(), strict=True)]
                owner = pa.array([k for k, one in enumerate(found) for _ in one], pa.int64())
                yield pa.record_batch(
                    [ids.take(owner), pa.array([n for one in found for n in range(len(one))], pa.int32()), pa.array([s for one in found for s in one], pa.string())],
                    names=["clause_id", "segment_index", "segment"],
                )

    texts = clauses_.select("clause_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("prefix", "raw_text")])
    kind = texts.schema["clause_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"clause_id {kind}, segment_index int, segment string")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def release(members: DataFrame) -> DataFrame:
    """Fingerprint of each release: the hash of its sorted index ids."""
    ids = F.array_sort(F.collect_set(F.col("index_id").cast("string")))
    return members.groupBy("release_id").agg(F.size(ids).alias("n_members"), F.sha2(F.to_json(ids), 256).alias("fingerprint"))


def clause_hits(hits: DataFrame, k: int) -> DataFrame:
    """Segment hits (query_id, clause_id, segment_index, score) as the k best clauses of each query."""
    best = hits.groupBy("query_id", "clause_id").agg(F.max_by("segment_index", F.struct("score", -F.col("segment_index"))).alias("segment_index"), F.max("score").alias("score"))
    return ranked(best, ["query_id"], [F.desc("score"), F.col("clause_id")]).where(F.col("rank") <= k)


def search_windows(hits: DataFrame, k: int) -> DataFrame:
    """The window of ranked hits (query_id, clause_id, rank) that a widening search ends with, and why it stops.

    Windows start at three times k (30 at least) and double up to 300: the last is the first that holds k clauses
    or is not filled. Found from the ranks alone, without a loop.
    """
    sizes = [max(START_WINDOW * k, LEAST_WINDOW)]
    while sizes[-1] < MOST_WINDOW:
        sizes.append(min(2 * sizes[-1], MOST_WINDOW))
    tried = hits.groupBy("query_id", "clause_id").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= s).alias(f"c{s}") for s in sizes])
    totals = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    out = tried.join(totals, "query_id")
    window, reason = F.lit(sizes[-1]), F.lit("limit")
    for s in reversed(sizes):
        enough, spent = F.col(f"c{s}") >= k, F.col("n_hits") < s
        window = F.when(enough | spent, F.lit(s)).otherwise(window)
        reason = F.when(enough, F.lit("enough")).when(spent, F.lit("exhausted")).otherwise(reason)
    return out.select("query_id", window.alias("search_window"), reason.alias("stop_reason"))
