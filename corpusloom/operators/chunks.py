"""Sentences and chunks of documents, with offsets into the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Fixed value: sentence ends.
DELIMITERS = "。！？；\n"


def sentence_array(text: Column, delimiters: str = DELIMITERS, least: int = 6) -> Column:
    """Sentences of a text as structs of index, content, start_offset and end_offset (code points).

    Runs between delimiters are trimmed and kept from least characters on; indices count what is kept. A null or empty
    text has none.
    """
    cut = "".join("\\" + d if d in "\\]^-[" else d for d in delimiters)
    runs = F.regexp_extract_all(text, F.lit(f"[^{cut}]+|[{cut}]"), F.lit(0))
    none = F.expr("cast(array() as array<struct<index:int,content:string,start_offset:int,end_offset:int>>)")
    return F.coalesce(F.get(F.transform(F.filter(F.array(runs), lambda r: F.size(r) > 0), lambda r: _kept(r, least)), 0), none)


def _kept(runs: Column, least: int) -> Column:
    """Runs of least characters or more, trimmed, with where they stand.

    The characters before a run are those of the blocks of runs before its own, and those before it in its block, so
    that no array is copied for each run, and a text of n runs takes n times the root of n additions at most.
    """
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda n, x: n + x)
    told = F.transform(F.array(runs), lambda r: F.struct(r.alias("runs"), F.transform(r, F.length).alias("lengths"), F.ceil(F.sqrt(F.size(r))).cast("int").alias("w")))
    blocks = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t["runs"]) - 1) / t["w"]).cast("int")), lambda b: total(F.slice(t["lengths"], b * t["w"] + 1, t["w"])))
    told = F.transform(told, lambda t: F.struct(t["runs"].alias("runs"), t["lengths"].alias("lengths"), t["w"].alias("w"), blocks(t).alias("blocks")))
    told = F.transform(told, lambda t: F.struct(t["runs"].alias("runs"), t["lengths"].alias("lengths"), t["w"].alias("w"), F.transform(t["blocks"], lambda x, b: total(F.slice(t["blocks"], 1, b))).alias("before")))

    def sentences_of(t: Column) -> Column:
        at = lambda i: F.get(t["before"], F.floor(i / t["w"]).cast("int")) + total(F.slice(t["lengths"], (F.floor(i / t["w"]) * t["w"] + 1).cast("int"), i % t["w"]))
        long = F.transform(t["runs"], lambda r, i: F.when(F.length(r) >= least, F.struct(F.regexp_replace(r, r"(?U)^\s+", "").alias("tail"), F.length(r).alias("n"), i.alias("i"))))
        trimmed = F.transform(F.filter(long, lambda x: x.isNotNull()), lambda x: F.struct(F.regexp_replace(x["tail"], r"(?U)\s+$", "").alias("content"), (x["n"] - F.length(x["tail"])).alias("lead"), x["i"].alias("i")))
        kept = F.transform(F.filter(trimmed, lambda x: F.length(x["content"]) >= least), lambda x: F.struct(x["content"].alias("content"), (at(x["i"]) + x["lead"]).alias("start")))
        return F.transform(kept, lambda x, k: F.struct(k.alias("index"), x["content"].alias("content"), x["start"].alias("start_offset"), (x["start"] + F.length(x["content"])).alias("end_offset")))

    return F.element_at(F.transform(told, sentences_of), 1)


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", delimiters: str = DELIMITERS, least: int = 6) -> DataFrame:
    """One row per sentence: doc_id, index, content, start_offset, end_offset."""
    return docs.select(doc_id, F.inline(sentence_array(F.col(text), delimiters, least)))


def fixed_chunks(text: Column, size: int) -> Column:
    """Pieces of size code points."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def heading_chunks(text: Column, size: int = 2000) -> Column:
    """Chunks of a Markdown text: sections by headings, packed greedily up to size characters.

    The joining newline is not counted, so a chunk may be longer by it. Longer sections are cut at size, and their tail
    goes on collecting. A text without headings is cut at size.
    """
    heading = r"(?m)^#{1,6}\s+"
    parts = F.split(text, r"(?m)(?=^#{1,6}\s+)")
    sections = F.filter(F.transform(parts, tx.strip), lambda p: p != "")
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(s: Column, section: Column) -> Column:
        fits = F.length(s["open"]) + F.length(section) <= size
        closed = F.when(s["open"] != "", F.array_append(s["done"], tx.strip(s["open"]))).otherwise(s["done"])
        pieces = fixed_chunks(section, size)
        return F.when(fits, F.struct(s["done"].alias("done"), F.when(s["open"] != "", F.concat(s["open"], F.lit("\n"), section)).otherwise(section).alias("open"))).otherwise(
            F.struct(F.concat(closed, F.slice(pieces, 1, F.size(pieces) - 1)).alias("done"), F.element_at(pieces, -1).alias("open"))
        )

    packed = F.aggregate(sections, zero, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], tx.strip(s["open"]))).otherwise(s["done"]))
    plain = F.when(F.length(text) <= size, F.array(text)).otherwise(fixed_chunks(text, size))
    return F.when(text.rlike(heading), packed).otherwise(plain)


def verbatim_entities(entities: DataFrame, docs: DataFrame, expert: DataFrame | None = None) -> DataFrame:
    """Entities (doc_id, name, type, seq) that occur in their document, last one wins by name.

    expert (name, type) adds names that a document holds and no extraction gave.
    """
    inside = entities.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("name")))
    out = inside.groupBy("doc_id", "name").agg(F.max_by("type", "seq").alias("type"))
    if expert is not None:
        words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("name"))
        out = out.unionByName(words.join(expert, "name").select("doc_id", "name", "type").join(out, ["doc_id", "name"], "left_anti"))
    return out
