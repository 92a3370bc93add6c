"""Tables in the library's shapes, derived from the driver's tables by expressions that Spark and SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.sizes import dealt

#: Documents, parts and lines of one task where they are dealt.
DOCUMENTS_EACH, PARTS_EACH, LINES_EACH = 5_000, 20_000, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt: their file may be one task's, and what is made of a text costs more than to move it."""
    return dealt(table(spark, sf_dir, "documents"), "doc_id", each=DOCUMENTS_EACH)


#: One number for every line: order and place alone are not unique.
LINE_ID = "(l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 31 + l_suppkey * 7 + CAST(floor(l_extendedprice) AS BIGINT) * 1009) % 1000000"

#: name -> (driver table, expressions)
SHAPES: dict[str, tuple[str, dict[str, str]]] = {
    # lines as triplets: order = document, supplier group = run
    "triplets": (
        "lineitem",
        {
            "triplet_id": LINE_ID,
            "run_id": "concat('run-', l_suppkey % 7)",
            "document_id": "l_orderkey",
            "seq": "l_linenumber",
            "head": "concat(CASE WHEN l_quantity > 40 THEN 'temp ' ELSE '' END, 'part ', l_partkey % 300)",
            "head_type": "CASE l_partkey % 3 WHEN 0 THEN 'Device' WHEN 1 THEN 'Material' ELSE 'Site' END",
            "relation": "CASE l_linenumber % 4 WHEN 0 THEN 'USES' WHEN 1 THEN 'NEEDS' WHEN 2 THEN 'LOCATED_AT' ELSE 'bad relation' END",
            "tail": "concat('supplier ', l_suppkey % 50)",
            "tail_type": "CASE l_suppkey % 4 WHEN 0 THEN 'Device' WHEN 1 THEN 'Person' WHEN 2 THEN 'Site' ELSE 'Material' END",
            "is_valid": "l_returnflag <> 'R'",
            "extracted_at": "l_shipdate",
        },
    ),
    # customers as runs, orders as documents
    "runs": (
        "customer",
        {
            "run_id": "c_custkey", "name": "c_name", "status": "CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 6000 THEN 'completed' ELSE 'running' END",
            "deletion_state": "CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'deleted' WHEN 2 THEN NULL ELSE 'active' END", "segment": "c_mktsegment",
        },
    ),
    "run_documents": ("orders", {"document_id": "o_orderkey", "run_id": "o_custkey", "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END", "started_at": "o_orderdate", "chars": "o_totalprice"}),
    "hits": (
        "lineitem",
        {
            "retrieval_id": LINE_ID, "document_id": "l_orderkey", "entity": "concat('part ', l_partkey % 5)", "sentence_index": "CAST(l_linenumber AS INT)",
            "rank": "CAST(l_quantity AS INT)", "score": "1 - l_discount", "match_type": "CASE WHEN l_returnflag = 'N' THEN 'semantic' ELSE 'direct' END", "alias": "concat('alias ', l_suppkey % 3)",
            "seq": "l_linenumber", "index": "CAST(l_partkey % 6 AS INT)",
        },
    ),
    "run_events": (
        "events",
        {
            "run_id": "user_id", "ts": "ts", "seq": "event_id", "stage": "event_type", "document_name": "CASE WHEN event_id % 3 = 0 THEN concat('doc-', event_id % 11) END",
            "event_type": "CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'document_failed' WHEN 'purchase' THEN 'document_completed' WHEN 'view' THEN 'progress' ELSE CASE WHEN event_id % 7 = 0 THEN 'completed' ELSE 'progress' END END",
            "completed": "CASE WHEN event_id % 2 = 0 THEN event_id % 13 END", "total": "CASE WHEN event_id % 5 <> 0 THEN event_id % 17 END",
        },
    ),
    "versions": (
        "part",
        {
            "version_id": "p_partkey", "family_id": "p_partkey % 150", "effective_year": "2000 + p_size % 25", "invalid_year": "CASE WHEN p_size % 3 = 0 THEN 2005 + p_partkey % 15 END",
            "metadata_confirmed": "p_partkey % 4 <> 0", "status": "CASE p_partkey % 6 WHEN 0 THEN 'effective' WHEN 1 THEN 'superseded' WHEN 2 THEN 'repealed' WHEN 3 THEN 'odd' ELSE 'upcoming' END",
            "metadata_hash": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END",
            "supersedes_version_id": "CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN p_partkey ELSE p_partkey - 1 END",
        },
    ),
    "calls": ("conversations", {"call_id": "conv_id * 100 + turn", "run_id": "conv_id", "stage": "role", "created": "turn", "response": "text"}),
}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = SHAPES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def cte(*names: str) -> str:
    """The same shapes as common table expressions."""
    return ",\n".join(f"{n} AS (SELECT {', '.join(f'{e} AS {chr(34)}{c}{chr(34)}' for c, e in SHAPES[n][1].items())} FROM {SHAPES[n][0]})" for n in names)


#: Ontology of the triplets: relation, head types, tail types (empty: any).
RULES = [("USES", ["Device", "Site"], ["Material", "Device"]), ("NEEDS", [], ["Person", "Material"]), ("LOCATED_AT", ["Device"], ["Site"])]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "relation string, head_types array<string>, tail_types array<string>")


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {h}::VARCHAR[], {t}::VARCHAR[])" for r, h, t in RULES) + ") r(relation, head_types, tail_types))"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as document blocks: nav items are TOC entries, h1 a heading, paragraphs text; document_id, ordinal, block_type, level, text."""
    found = F.regexp_extract_all("html", F.lit(r"<(h1|p|li)>([^<]*)"), F.lit(1)), F.regexp_extract_all("html", F.lit(r"<(h1|p|li)>([^<]*)"), F.lit(2))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(F.arrays_zip(found[0].alias("tag"), found[1].alias("text"))).alias("ordinal", "b"))
    tag = F.col("b.tag")
    kind = F.when(tag == "li", "toc_entry").when(tag == "h1", "heading").otherwise("paragraph")
    return rows.select("document_id", "ordinal", kind.alias("block_type"), F.when(tag == "h1", 1).alias("level"), F.trim("b.text").alias("text"))


BLOCKS_SQL = r"""b0 AS (SELECT page_id AS document_id, unnest(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 2)) AS x,
  unnest(range(0, len(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 1)))) AS ordinal FROM pages),
blocks AS (SELECT document_id, ordinal, CASE tag WHEN 'li' THEN 'toc_entry' WHEN 'h1' THEN 'heading' ELSE 'paragraph' END AS block_type, CASE WHEN tag = 'h1' THEN 1 END AS level, trim(x, ' ') AS text FROM b0)"""
