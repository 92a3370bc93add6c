"""Regulations, alignment and audit rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import align, audit, graph_paths, norms, retrieve
from corpusloom.operators.sizes import dealt
from corpusloom.plans.shapes import BLOCKS_SQL, LINES_EACH, blocks, cte, documents, shape, table
from corpusloom.sources import files

#: In the documents' prose a clause starts at a line whose first word ends in a full stop.
HEADS = (r"^([^\s.]+\.)(.*)$",)


def nrm_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = norms.clauses(table(spark, sf_dir, "documents").select("doc_id", "text"), HEADS)
    return out.select("doc_id", "clause_index", "clause_number", F.sha2("raw_text", 256).alias("text_hash"), "start_offset", "end_offset", "parse_status")


NRM_CLAUSES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, regexp_matches(line, '^([^\s.]+\.)(.*)$') AS head FROM l),
c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM o),
a AS (SELECT doc_id, k::INT AS clause_index, regexp_extract(arg_min(line, n), '^([^\s.]+\.)(.*)$', 1) AS clause_number, sha256(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g')) AS text_hash, min(start) AS start_offset, max(start + length(line))::INT AS end_offset,
  'structured' AS parse_status FROM c WHERE k > 0 GROUP BY doc_id, k),
p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, unnest(range(1, len(regexp_split_to_array(text, '\n\s*\n')) + 1))::INT AS i FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a))
SELECT * FROM a UNION ALL SELECT doc_id, i, NULL, sha256(regexp_replace(p, '^\s+|\s+$', '', 'g')), NULL, NULL, 'fallback' FROM p WHERE regexp_matches(p, '\S') AND NOT regexp_matches(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^(#{1,6})\s+([^\n]+?)\s*$')
"""


def nrm_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms.version_violations(shape(spark, sf_dir, "versions"))


NRM_VIOLATIONS = f"""
WITH {cte('versions')} SELECT version_id, 'unknown_status' AS violation FROM versions WHERE status NOT IN {norms.STATUSES} UNION ALL SELECT version_id, 'effective_after_invalid' FROM versions WHERE effective_year > invalid_year
UNION ALL SELECT version_id, 'invalid_year_missing' FROM versions WHERE status IN ('superseded', 'repealed') AND invalid_year IS NULL UNION ALL SELECT version_id, 'confirmed_without_hash' FROM versions WHERE metadata_confirmed AND metadata_hash = ''
"""


def nrm_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms.supersede_cycles(shape(spark, sf_dir, "versions"))


NRM_CYCLES = f"""
WITH RECURSIVE {cte('versions')}, e AS (SELECT version_id AS v, supersedes_version_id AS n FROM versions WHERE supersedes_version_id IS NOT NULL),
r AS (SELECT v, n, 1 AS k FROM e UNION ALL SELECT r.v, e.n, k + 1 FROM r JOIN e ON e.v = r.n WHERE k < 30) SELECT DISTINCT v AS node FROM r WHERE k = 30
"""


def nrm_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that apply in each year of the orders."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return norms.applicable_versions(shape(spark, sf_dir, "versions"), years).select("year", "version_id", "family_id", "conflict")


NRM_APPLICABLE = f"""
WITH {cte('versions')}, y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)
SELECT year, version_id, family_id, count(*) OVER (PARTITION BY year, family_id) > 1 AS conflict FROM versions JOIN y ON metadata_confirmed AND effective_year <= year AND (invalid_year IS NULL OR invalid_year >= year)
"""


def nrm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the families that customers ask for; versions sold in lines over forty are indexed."""
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 170).alias("family_id")).distinct()
    v = shape(spark, sf_dir, "versions").where("metadata_confirmed")
    indexed = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("version_id"))
    return norms.coverage(asked, v.select("family_id", "version_id"), indexed)


NRM_COVERAGE = f"""
WITH {cte('versions')}, a AS (SELECT DISTINCT c_custkey % 170 AS family_id FROM customer), i AS (SELECT DISTINCT l_partkey AS version_id FROM lineitem WHERE l_quantity > 48),
c AS (SELECT family_id, count(*) AS n, count(i.version_id) AS k FROM versions v LEFT JOIN i ON i.version_id = v.version_id WHERE metadata_confirmed GROUP BY family_id)
SELECT a.family_id, coalesce(n, 0) AS n_versions, coalesce(k, 0) AS n_indexed, CASE WHEN n IS NULL THEN 'uncovered' WHEN k = 0 THEN 'cited_but_unindexed' WHEN k < n THEN 'partial' ELSE 'covered' END AS coverage_status FROM a LEFT JOIN c ON c.family_id = a.family_id
"""


def _clause_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = norms.prefix(F.col("source"), F.array("lang"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("clause_id"), head.alias("prefix"), F.col("text").alias("raw_text"))


def nrm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms.segments(_clause_texts(spark, sf_dir)).select("clause_id", "segment_index", "text_hash")


NRM_SEGMENTS = r"""
WITH c AS (SELECT doc_id, '【规范：' || source || ' ' || lang || ' ' || doc_id || '】' AS p, text, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM documents),
s AS (SELECT doc_id, p, text, w, 3 + len(w) <= 128 AS whole FROM c),
m AS (SELECT *, ceil(greatest(len(w) - 62, 0) / 54.0)::INT AS last FROM s WHERE NOT whole),
k AS (SELECT doc_id, p, w, unnest(list_concat([x * 54 for x in range(0, last + 1)], range(len(w) - greatest(least(8, len(w) - last * 54 - 1), 0), len(w)))) AS i FROM m),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM k)
SELECT doc_id AS clause_id, 0 AS segment_index, sha256(p || chr(10) || text) AS text_hash FROM s WHERE whole
UNION ALL SELECT doc_id, n::INT, sha256(p || chr(10) || array_to_string(w[i + 1:i + 62], ' ')) FROM j
"""


def nrm_costed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments under a tokenizer that counts a token for every four letters."""
    out = norms.costed_segments(_clause_texts(spark, sf_dir), lambda t: sum(-(-len(w) // 4) for w in t.split()), 128, 8)
    return out.select("clause_id", "segment_index", F.sha2("segment", 256).alias("text_hash"))


def nrm_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("release_id"), F.col("l_partkey").alias("index_id"))
    return norms.release(members)


NRM_RELEASE = """
WITH m AS (SELECT DISTINCT l_suppkey AS release_id, l_partkey::VARCHAR AS i FROM lineitem)
SELECT release_id, count(*)::INT AS n_members, sha256('[' || string_agg('"' || i || '"', ',' ORDER BY i) || ']') AS fingerprint FROM m GROUP BY release_id
"""


def _segment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as ranked hits: order-status groups of suppliers as queries, parts as clauses."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("query_id"), (F.col("l_partkey") % 60).alias("clause_id"), F.expr("cast(l_orderkey * 10 + l_linenumber as int)").alias("segment_index"), (1 - F.col("l_discount")).alias("score"), F.col("l_extendedprice").alias("tie")
    )


def nrm_clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = norms.clause_hits(_segment_hits(spark, sf_dir), 10)
    return out.select("query_id", "clause_id", "segment_index", F.round("score", 6).alias("score"), "rank")


NRM_SEARCH = """
WITH h AS (SELECT l_suppkey % 40 AS query_id, l_partkey % 60 AS clause_id, (l_orderkey * 10 + l_linenumber)::INT AS s, 1 - l_discount AS score FROM lineitem),
b AS (SELECT query_id, clause_id, arg_max(s, (score, -s)) AS segment_index, max(score) AS score FROM h GROUP BY ALL)
SELECT query_id, clause_id, segment_index, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id))::INT AS rank FROM b QUALIFY rank <= 10
"""


def nrm_search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieve.ranked(_segment_hits(spark, sf_dir), ["query_id"], [F.desc("score"), F.col("segment_index"), F.col("tie"), F.col("clause_id")])
    return norms.search_windows(rows, 45)


NRM_WINDOWS = """
WITH h AS (SELECT l_suppkey % 40 AS q, l_partkey % 60 AS c, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY 1 - l_discount DESC, l_orderkey * 10 + l_linenumber, l_extendedprice, l_partkey % 60) AS rank FROM lineitem),
w AS (SELECT unnest([135, 270, 300]) AS s), n AS (SELECT q, count(*) AS n FROM h GROUP BY q),
t AS (SELECT n.q, s, n, (SELECT count(DISTINCT c) FROM h WHERE h.q = n.q AND rank <= s) AS k FROM n, w)
SELECT q AS query_id, coalesce(min(s) FILTER (k >= 45 OR n < s), 300)::INT AS search_window, CASE WHEN count(*) FILTER (k >= 45 OR n < s) = 0 THEN 'limit' WHEN arg_min(k, s) FILTER (k >= 45 OR n < s) >= 45 THEN 'enough' ELSE 'exhausted' END AS stop_reason FROM t GROUP BY q
"""


def nrm_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a line or a version's chain refers to: they must not be deleted."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 47").select(F.col("l_partkey").alias("p_partkey")).union(shape(spark, sf_dir, "versions").where("version_id % 13 = 0").select("supersedes_version_id"))
    return p.join(used, "p_partkey", "left_semi")


NRM_REFERENCED = f"""
WITH {cte('versions')} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47) OR p_partkey IN (SELECT supersedes_version_id FROM versions WHERE version_id % 13 = 0)
"""

# --- alignment ---


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: names with a brand, in documents of forty parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_partkey").alias("seq"), F.floor(F.col("p_partkey") / 40).alias("doc_id"), F.expr("concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' (x)' ELSE '' END)").alias("name"),
        F.col("p_type").alias("type"), F.when(F.col("p_size") > 25, "spec").otherwise("case").alias("source_type"),
    )


def aln_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("entity_id", align.name_score(F.col("name"), F.col("source_type"), ("partblue", "x")).cast("long").alias("score"))


ALN_SCORES = r"""
WITH n AS (SELECT p_partkey AS entity_id, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' (x)' ELSE '' END) AS name, p_size > 25 AS spec FROM part)
SELECT entity_id, length(name) + CASE WHEN spec THEN 20 ELSE 0 END - CASE WHEN regexp_replace(lower(name), '[\s\-_()]', '', 'g') IN ('partblue', 'x') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(name, '\d{2,}') THEN 12 ELSE 0 END
  - CASE WHEN length(name) <= 2 OR regexp_full_match(name, '[A-Za-z0-9]+') THEN 8 ELSE 0 END AS score FROM n
"""


def aln_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' parts as extracted entities of their order: one row per name, the best kept."""
    rows = shape(spark, sf_dir, "triplets").select(F.col("document_id").alias("doc_id"), F.col("head").alias("name"), F.col("head_type").alias("type"), F.when(F.col("is_valid"), "spec").otherwise("case").alias("source_type"), F.col("triplet_id").alias("seq"))
    out = align.deduplicated(rows)
    first = align.first_by_name(rows).select("doc_id", "name", F.col("seq").alias("first_seq"))
    return out.join(first, ["doc_id", "name"]).select("doc_id", "name", "seq", "first_seq")


ALN_DEDUPLICATED = f"""
WITH {cte('triplets')} SELECT document_id AS doc_id, head AS name, arg_min(triplet_id, (NOT is_valid, triplet_id)) AS seq, min(triplet_id) AS first_seq FROM triplets GROUP BY ALL
"""


def aln_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names within documents and types."""
    return align.candidate_pairs(_names(spark, sf_dir), ["doc_id"], 0.95).select("doc_id", "a", "b")


def aln_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with vectors: pairs within documents and types of which one holds the other or whose vectors are alike."""
    names = _names(spark, sf_dir).withColumn("type", F.expr("CASE WHEN entity_id % 3 = 0 THEN 'a' ELSE 'b' END")).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector")), "entity_id")
    return align.candidate_pairs(names.withColumn("doc_id", F.floor(F.col("entity_id") / 700)), ["doc_id"], 2.0, 0.2).select("doc_id", "a", "b")


ALN_SIMILAR = r"""
WITH e AS (SELECT p_partkey AS id, p_partkey // 700 AS doc_id, p_partkey % 3 = 0 AS t, regexp_replace(lower(concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' (x)' ELSE '' END)), '[\s\-_()]', '', 'g') AS k, embedding AS v FROM part JOIN embeddings ON vec_id = p_partkey)
SELECT x.doc_id, x.id AS a, y.id AS b FROM e AS x JOIN e AS y ON x.doc_id = y.doc_id AND x.t = y.t AND x.id < y.id
WHERE contains(x.k, y.k) OR contains(y.k, x.k) OR (list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]) >= 0.2 AND list_has_any(string_split(x.k, ''), string_split(y.k, '')))
"""


def aln_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of containing names within documents, in parts of at most five, with the decisions by rule."""
    names = _names(spark, sf_dir).withColumn("score", align.name_score(F.col("name"), F.col("source_type")))
    parts = align.groups(align.candidate_pairs(names, ["doc_id"], 2.0), names, 5)
    decisions = align.decided(parts, strong=0.8)
    whole = align.aligned(names, decisions)
    return whole.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.sum(F.size("aliases")).alias("n_aliases"))


def aln_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of parts that open and close the same order's lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    return graph_paths.components(rows.select("a", "b"))


ALN_COMPONENTS = """
WITH RECURSIVE e AS (SELECT DISTINCT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY l_orderkey HAVING a <> b), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.v) SELECT v AS node, min(root) AS component FROM r GROUP BY v
"""


def aln_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision JSON of every brand, some of it malformed, read into members."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("group_id"), F.expr("concat('{\"same_groups\":[{\"members\":[\"', p_name, '\",\"', p_brand, '\"],\"standard_name\":\"', p_brand, '\"}]', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '}' END)").alias("decision"))
    return align.parsed_decisions(p)


ALN_DECISIONS = "SELECT p_partkey AS group_id, unnest([p_name, p_brand]) AS name, p_brand AS standard FROM part WHERE p_partkey % 5 <> 0"


def aln_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and brands of parts as standard names and aliases; later parts overwrite earlier ones."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("doc_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return align.known_names(rows)


ALN_KNOWN = "SELECT p_partkey % 10 AS doc_id, name, arg_max(p_name, p_partkey) AS standard FROM (SELECT p_partkey, p_name, unnest([p_name, p_brand]) AS name FROM part) GROUP BY ALL"

# --- audit ---


def aud_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.sections(blocks(spark, sf_dir))
    return out.select("document_id", "ordinal", "block_type", F.array_join("section", "/").alias("section"))


AUD_SECTIONS = f"""
WITH {BLOCKS_SQL} SELECT document_id, ordinal::INT AS ordinal, block_type, coalesce(last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal), '') AS section FROM blocks
"""

TASKS = [("T1", ["the", "la "], []), ("T2", ["Über", "eaux", "en"], ["an", "es"]), ("T3", ["zzzz"], []), ("T4", ["工序", "on"], ["er"]), ("T5", [], ["th"])]


def _tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task_id string, locators array<string>, regions array<string>")


def aud_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks located in pages: with and without regions, with weak locators, with a region alone."""
    return audit.located(audit.sections(blocks(spark, sf_dir)), _tasks(spark), ("on",))


_KEY = r"lower(regexp_replace({0}, '[\s\x{{3000}}，,。；;：:（）()【】\[\]《》<>‘’''\"、·—-]+', '', 'g'))"
AUD_LOCATED = rf"""
WITH {BLOCKS_SQL}, s0 AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal) AS section FROM blocks),
s AS (SELECT *, {_KEY.format('text')} AS k, {_KEY.format("concat_ws(' ', coalesce(section, ''), text)")} AS pl FROM s0 WHERE block_type <> 'toc_entry'),
t AS (SELECT * FROM (VALUES {', '.join(f"('{i}', {x}::VARCHAR[], {r}::VARCHAR[])" for i, x, r in TASKS)}) t(task_id, locators, regions)),
m AS (SELECT document_id, task_id, ordinal, block_type = 'heading' AS heading, [x for x in locators if contains(k, {_KEY.format('x')})] AS f, len(regions) = 0 OR len([r for r in regions if contains(pl, {_KEY.format('r')})]) > 0 AS exact, coalesce(section, 'block:' || ordinal) AS g
  FROM s, t WHERE k <> '' AND NOT regexp_full_match(k, '\d+')),
v AS (SELECT * FROM m WHERE ((len(f) > 0 AND (exact OR heading)) OR (heading AND exact)) AND (len([x for x in f if x <> 'on']) > 0 OR heading)),
n AS (SELECT document_id, task_id, g, list_sort(list_distinct(flatten(list(f)))) AS f, arg_min(ordinal, (NOT heading, -len(f), ordinal)) AS ordinal, arg_min(heading, (NOT heading, -len(f), ordinal)) AS heading, arg_min(exact, (NOT heading, -len(f), ordinal)) AS exact FROM v GROUP BY ALL),
c AS (SELECT *, round(least(0.42 + CASE WHEN exact THEN 0.32 ELSE 0 END + CASE WHEN heading THEN 0.16 ELSE 0.06 END + least(0.08, 0.02 * len(f)), 0.99)::DOUBLE, 3) AS score FROM n),
b AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt, NOT exact OR coalesce(f = lead(f) OVER w, false) AS close, count(*) OVER (PARTITION BY document_id, task_id) AS n FROM c WINDOW w AS (PARTITION BY document_id, task_id ORDER BY score DESC, ordinal))
SELECT d.document_id, d.task_id, b.ordinal::INT AS anchor, score, coalesce(n, 0) AS n_groups, CASE WHEN score IS NULL THEN 'not_located' WHEN coalesce(close AND round(score - nxt, 3) < 0.06, false) THEN 'ambiguous' ELSE 'located' END AS status
FROM (SELECT DISTINCT document_id, task_id FROM blocks, t) d LEFT JOIN b ON b.document_id = d.document_id AND b.task_id = d.task_id AND place = 1
"""


def aud_special_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory, cover and appendix regions of pages; "Le" plays an appendix title."""
    b = blocks(spark, sf_dir)
    parts = {"toc": audit.toc_region(b), "cover": audit.cover_region(b), "appendix": audit.appendix_region(b, "Le", "^(?:Le|The)")}
    out = None
    for name, df in parts.items():
        one = df.select("document_id", F.lit(name).alias("region"), "anchor", "last", "n_blocks")
        out = one if out is None else out.unionAll(one)
    return out


AUD_SPECIAL = f"""
WITH {BLOCKS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS n FROM blocks WHERE block_type <> 'toc_entry'),
c AS (SELECT *, min(CASE WHEN n > 1 AND n <= 12 AND block_type = 'heading' THEN n END) OVER (PARTITION BY document_id) AS stop FROM b),
s AS (SELECT document_id, max(ordinal) AS a FROM b WHERE contains(text, 'Le') GROUP BY document_id),
e AS (SELECT b.document_id, min(ordinal) AS e FROM b JOIN s USING (document_id) WHERE ordinal > a AND regexp_matches(text, '^(?:Le|The)') GROUP BY b.document_id)
SELECT document_id, 'toc' AS region, min(ordinal)::INT AS anchor, max(ordinal)::INT AS last, count(*) AS n_blocks FROM blocks WHERE block_type = 'toc_entry' GROUP BY document_id
UNION ALL SELECT document_id, 'cover', min(ordinal)::INT, max(ordinal)::INT, count(*) FROM c WHERE n <= 12 AND (stop IS NULL OR n < stop) GROUP BY document_id
UNION ALL SELECT b.document_id, 'appendix', a::INT, max(ordinal)::INT, count(*) FROM b JOIN s USING (document_id) LEFT JOIN e USING (document_id) WHERE ordinal >= a AND (e IS NULL OR ordinal < e) GROUP BY b.document_id, a
"""


def aud_flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outputs, their urgent lines' parts as candidates."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("candidates"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = rows.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("task_id"), F.lit("advisories").alias("kind"), F.col("o_orderstatus").alias("summary"), F.coalesce("candidates", F.expr("cast(array() as array<string>)")).alias("candidates"))
    return audit.flat_results(out)


AUD_FLAT = """
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS c FROM lineitem WHERE l_quantity > 45), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS k FROM l)
SELECT o_orderkey AS document_id, o_orderpriority AS task_id, 'advisories' AS kind, o_orderstatus AS summary, t::INT AS candidate_total, k::INT AS place, c AS candidate FROM orders LEFT JOIN n ON l_orderkey = o_orderkey
"""


def aud_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' orders as suggestions, some of them against the contract."""
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(k) for k in (*audit.SUGGESTION_KINDS, "other")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"), F.col("p_name").alias("step"), (F.col("p_size") % 12).alias("total"), (F.col("p_size") % 10).alias("returned"),
        F.array_repeat(F.lit("x"), F.col("p_size") % 10).alias("candidates"),
    )
    return audit.advisories(p).select("p_partkey", "kind", "broken", "summary")


AUD_ADVISORIES = """
WITH p AS (SELECT (['missing_jsa_step', 'missing_hazard_group', 'missing_control_measure', 'other'])[p_partkey % 4 + 1] AS kind, p_partkey, p_name, p_size % 12 AS t, p_size % 10 AS r FROM part),
b AS (SELECT *, CASE WHEN kind = 'other' THEN 'unknown_kind' WHEN kind = 'missing_hazard_group' AND (r > 8 OR t < r) THEN 'invalid_group' END AS broken FROM p)
SELECT p_partkey, kind, broken, CASE WHEN broken IS NULL THEN CASE kind WHEN 'missing_jsa_step' THEN 'step not covered: ' || p_name WHEN 'missing_hazard_group' THEN p_name || ': ' || t || ' candidates, ' || r || ' shown' ELSE 'control measure: ' || p_name END END AS summary FROM b
"""


def aud_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from each page's heading to the next, within the limits of an evidence group."""
    b = blocks(spark, sf_dir)
    anchors = b.where("block_type = 'heading'").select("document_id", F.lit("T").alias("task_id"), F.col("ordinal").alias("anchor"), F.col("level").alias("anchor_level"))
    return audit.region_rows(b, anchors).select("document_id", "anchor", "ordinal", "n", "so_far", "truncated")


AUD_REGIONS = f"""
WITH {BLOCKS_SQL}, h AS (SELECT document_id, ordinal AS anchor, lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) AS e FROM blocks WHERE block_type = 'heading'),
r AS (SELECT h.document_id, anchor, b.ordinal, row_number() OVER w AS n, sum(length(text)) OVER w AS so_far FROM h JOIN blocks b ON b.document_id = h.document_id AND b.ordinal >= anchor AND (e IS NULL OR b.ordinal < e) WINDOW w AS (PARTITION BY h.document_id, anchor ORDER BY b.ordinal))
SELECT document_id, anchor::INT AS anchor, ordinal::INT AS ordinal, n::INT AS n, so_far::BIGINT AS so_far, truncated FROM (SELECT *, bool_or(n > 50 OR so_far > 6000) OVER (PARTITION BY document_id, anchor) AS truncated FROM r) WHERE n <= 50 AND so_far <= 6000
"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: a header and a row of cells for each line, with blanks and placeholders among them."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 9 == 0, "/").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))), F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("人"))))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(cells)).alias("rows"))
    return rows.withColumn("header", F.array(F.lit("序号"), F.lit("设备名称"), F.when(F.col("table_id") % 6 == 0, "备注").otherwise("数量/人数")))


_LINES = """x AS (SELECT l_orderkey AS table_id, CASE WHEN l_partkey % 9 = 0 THEN '/' ELSE 'part ' || l_partkey END AS name, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE l_quantity::INT || '人' END AS q FROM lineitem)"""


def aud_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_columns(_tables(spark, sf_dir), ["序号", "名称", "数量", "规格"]).select("table_id", F.array_join("missing", ",").alias("missing"))


AUD_COLUMNS = "SELECT DISTINCT l_orderkey AS table_id, CASE WHEN l_orderkey % 6 = 0 THEN '数量,规格' ELSE '规格' END AS missing FROM lineitem"


def aud_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.missing_values(_tables(spark, sf_dir), ["名称", "数量"], ["名称", "序号"])
    return out.withColumnsRenamed({"missing_名称": "missing_name", "missing_数量": "missing_quantity"})


AUD_VALUES = f"WITH {_LINES} SELECT table_id, count(*) AS n_rows, count(*) FILTER (name = '/') AS missing_name, count(*) FILTER (table_id % 6 = 0 OR q = '') AS missing_quantity FROM x GROUP BY table_id"


def aud_headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose head-count is no positive number with an optional unit."""
    t = _tables(spark, sf_dir).select("table_id", "header", F.explode("rows").alias("row"))
    v = audit.value_at(F.col("row"), audit.column_index(F.col("header"), "人数"))
    return t.where(~audit.is_positive_headcount(v)).groupBy("table_id").agg(F.count("*").alias("n_bad"))


AUD_HEADCOUNTS = f"WITH {_LINES} SELECT table_id, count(*) AS n_bad FROM x WHERE table_id % 6 = 0 OR q = '' GROUP BY table_id"


def aud_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words as fixed entries that a document must hold."""
    labels = ("the", "de la", "und", "zzz")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(audit.missing_labels(F.col("text"), labels), ",").alias("missing"), F.size(audit.missing_fixed_entries(F.col("text"))).alias("n_fixed"))


AUD_LABELS = """
WITH d AS (SELECT doc_id, replace(text, ' ', '') AS t FROM documents)
SELECT doc_id, array_to_string([x for x in ['the', 'de la', 'und', 'zzz'] if NOT contains(t, replace(x, ' ', ''))], ',') AS missing, 11 AS n_fixed FROM d
"""


def aud_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a customer's orders that conflict: said in a text, under and after a heading, and in a table's cell."""
    o, none, no_rows = table(spark, sf_dir, "orders"), F.expr("cast(array() as array<string>)"), F.expr("cast(null as array<array<string>>)")
    at = lambda k: (F.col("o_orderkey") * 4 + k).alias("ordinal")
    made = [
        ("paragraph", F.expr("concat('Priority: ', o_orderpriority, '\\nStatus： ', o_orderstatus, '平台; other: x')"), none, no_rows),
        ("heading", F.lit("1.1 Mode"), F.array(F.lit("1.1 Mode")), no_rows),
        ("paragraph", F.concat(F.lit("by "), F.substring("o_orderpriority", 1, 1)), F.array(F.lit("1.1 Mode")), no_rows),
        ("table", F.lit(""), none, F.array(F.array(F.lit("工 Status"), F.concat("o_orderstatus", F.lit("井场")), F.lit("x")))),
    ]
    b = None
    for k, (kind, text, section, rows) in enumerate(made):
        one = o.select(F.col("o_custkey").alias("document_id"), at(k), F.lit(kind).alias("block_type"), text.alias("text"), section.alias("section"), rows.alias("rows"))
        b = one if b is None else b.unionAll(one)
    labels = spark.createDataFrame([("Priority", ""), ("Status", "location"), ("Mode", "project_name")], "label string, kind string")
    out = audit.conflicts(audit.labelled_values(b, labels), ["document_id", "label"])
    return out.select("document_id", "label", "value", F.size("places").alias("n_places"), "n_values")


AUD_VALUES_SQL = """
WITH v AS (SELECT o_custkey AS document_id, unnest(['Priority', 'Status', 'Status', 'Mode']) AS label, unnest([replace(o_orderpriority, ' ', ''), o_orderstatus, o_orderstatus, 'by' || left(o_orderpriority, 1)]) AS value, unnest([0, 0, 3, 2]) + o_orderkey * 4 AS ordinal FROM orders),
p AS (SELECT document_id, label, value, count(DISTINCT ordinal)::INT AS n_places FROM v GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY document_id, label) AS n_values FROM p QUALIFY n_values > 1
"""


def aud_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned lines (open) against present ones (finished) of an order: by name, or by the members named in brackets."""
    k = F.col("l_partkey") % 12
    name = F.when((k == 0) & (F.col("l_linestatus") == "O"), "kit（unit 3、unit 5，等）").when((k == 1) & (F.col("l_linestatus") == "O"), "set (unit 2)等").otherwise(F.concat(F.lit("unit "), k.cast("string")))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3000).alias("o"), name.alias("name"), F.col("l_quantity").cast("int").alias("quantity"), "l_linestatus")
    plan, present = (lines.where(F.col("l_linestatus") == s).groupBy("o", "name").agg(F.max("quantity").alias("quantity")) for s in ("O", "F"))
    return audit.coverage(plan, present, ["o"])


AUD_EQUIPMENT = """
WITH l AS (SELECT l_orderkey % 3000 AS o, l_partkey % 12 AS k, l_quantity::INT AS quantity, l_linestatus AS s FROM lineitem),
p AS (SELECT o, CASE k WHEN 0 THEN 'kit（unit 3、unit 5，等）' WHEN 1 THEN 'set (unit 2)等' ELSE 'unit ' || k END AS name, CASE k WHEN 0 THEN 'kitunit3unit5' WHEN 1 THEN 'setunit2' ELSE 'unit' || k END AS norm, max(quantity) AS quantity, any_value(k) AS k FROM l WHERE s = 'O' GROUP BY ALL),
q AS (SELECT o, 'unit' || k AS norm, max(quantity) AS quantity FROM l WHERE s = 'F' GROUP BY ALL),
j AS (SELECT p.o, p.name, p.quantity, any_value(p.k) AS k, count(q.norm) AS n_matches, max(q.quantity) AS x FROM p LEFT JOIN q ON q.o = p.o AND (contains(p.norm, q.norm) OR contains(q.norm, p.norm)) GROUP BY ALL),
h AS (SELECT o, bool_or(contains(norm, 'unit2')) AS two, bool_or(contains(norm, 'unit3')) AND bool_or(contains(norm, 'unit5')) AS pair FROM q GROUP BY o)
SELECT j.o, name, quantity, n_matches, CASE WHEN n_matches = 0 AND coalesce(CASE k WHEN 0 THEN pair WHEN 1 THEN two END, false) THEN 'covered' WHEN n_matches = 0 THEN 'missing' WHEN n_matches = 1 AND x <> quantity THEN 'quantity_mismatch' ELSE 'covered' END AS status FROM j LEFT JOIN h ON h.o = j.o
"""


def aud_work_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written in orders, partly in small letters, against a catalogue of parts: decision by order."""
    texts = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("work "), F.when(F.col("l_linenumber") % 2 == 0, "rw-").otherwise("RW-"), (F.col("l_partkey") % 500).cast("string"), F.lit(" here")).alias("text"))
    catalogue = files.risk_catalogue([table(spark, sf_dir, "part").select(F.concat(F.lit("RW-"), F.col("p_partkey").cast("string")).alias("code"), F.when(F.col("p_size") > 5, "x").otherwise("/").alias("hot"), F.when(F.col("p_size") > 30, "1").alias("high"))])
    codes = audit.work_codes(texts, catalogue.select("code", F.array_join("work_types", ",").alias("work_type")), r"(?i)RW-\d+")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "O").alias("not_involved"), (F.col("o_orderkey") % 4 == 0).alias("confirmed"))
    first = codes.groupBy("document_id").agg(F.min(F.struct("ordinal", "code")).alias("f"))
    return audit.code_decision(codes, docs).join(first, "document_id", "left").select("document_id", "not_involved", "confirmed", "n_codes", "n_unknown", "result", F.col("f.code").alias("first_code"))


AUD_CODES = """
WITH c AS (SELECT l_orderkey AS d, l_partkey % 500 AS p, min(l_linenumber) AS l FROM lineitem WHERE l_quantity > 25 GROUP BY ALL), k AS (SELECT p_partkey AS p FROM part WHERE p_size > 5),
n AS (SELECT d, count(*) AS n_codes, count(*) FILTER (p NOT IN (SELECT p FROM k)) AS n_unknown, 'RW-' || arg_min(p, (l, 'RW-' || p)) AS first_code FROM c GROUP BY d)
SELECT o_orderkey AS document_id, o_orderstatus = 'O' AS not_involved, o_orderkey % 4 = 0 AS confirmed, coalesce(n_codes, 0) AS n_codes, coalesce(n_unknown, 0) AS n_unknown,
  CASE WHEN n_codes IS NULL AND o_orderstatus = 'O' THEN 'no_issue' WHEN n_codes IS NULL THEN 'issue_found' WHEN n_unknown > 0 AND o_orderkey % 4 <> 0 THEN 'manual_review' ELSE 'no_issue' END AS result, first_code FROM orders LEFT JOIN n ON d = o_orderkey
"""


def aud_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of every page by handler: required fields, dates, one handler that nobody registered, offline and unselected ones."""
    b = blocks(spark, sf_dir).where("block_type <> 'toc_entry'").select("document_id", "ordinal", "text")
    lib = spark.createDataFrame(
        [("F1", "deterministic", "fields", ["the或la", "e/zzz"]), ("F2", "deterministic", "fields", ["qqq"]), ("F3", "deterministic", "fields", ["专业"]), ("X1", "deterministic", "lost", []), ("O1", "offline", "", []), ("S1", "deterministic", "fields", [])],
        "task_id string, route string, handler string, required array<string>",
    )
    tasks = audit.snapshot(table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id")), lib).drop("status")
    evidence = b.join(tasks.where("handler = 'fields' and (task_id <> 'F3' or document_id % 2 = 0)").select("document_id", "task_id"), "document_id")
    fields = audit.field_results(evidence, tasks.where("handler = 'fields'").select("document_id", "task_id", "required"))
    selected = lib.where("task_id <> 'S1'").select("task_id")
    out = audit.dispatched(tasks, {"fields": fields}, selected)
    return out.join(fields.select("document_id", "task_id", F.array_join("missing", ",").alias("missing")), ["document_id", "task_id"], "left").select("document_id", "task_id", "result", "execution_status", "missing")


AUD_DISPATCH = rf"""
WITH {BLOCKS_SQL}, x AS (SELECT document_id, replace(string_agg(text, '' ORDER BY ordinal), ' ', '') AS t FROM blocks WHERE block_type <> 'toc_entry' GROUP BY document_id),
k AS (SELECT page_id AS d, unnest(['F1', 'F2', 'F3', 'X1', 'O1', 'S1']) AS task_id FROM pages),
e AS (SELECT d, task_id, CASE WHEN task_id IN ('F1', 'F2', 'S1') OR (task_id = 'F3' AND d % 2 = 0) THEN coalesce(t, '') ELSE '' END AS t FROM k LEFT JOIN x ON document_id = d),
m AS (SELECT *, CASE task_id WHEN 'F1' THEN array_to_string([f for f in ['the或la', 'e/zzz'] if NOT (CASE f WHEN 'the或la' THEN contains(t, 'the') OR contains(t, 'la') ELSE contains(t, 'e') OR contains(t, 'zzz') END)], ',')
  WHEN 'F2' THEN CASE WHEN contains(t, 'qqq') THEN '' ELSE 'qqq' END WHEN 'F3' THEN '' WHEN 'S1' THEN '' END AS missing FROM e)
SELECT d AS document_id, task_id, CASE WHEN task_id IN ('F1', 'F2', 'F3') THEN CASE WHEN NOT regexp_matches(t, '\S') OR missing <> '' THEN 'issue_found' ELSE 'manual_review' END END AS result,
  CASE task_id WHEN 'X1' THEN 'failed' WHEN 'O1' THEN 'offline' WHEN 'S1' THEN 'pending' ELSE 'completed' END AS execution_status, missing FROM m
"""


def aud_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of three tasks for every order, results dispatched, and the report; invalid results are counted."""
    lib = spark.createDataFrame([("T1", "deterministic", "status"), ("T2", "offline", ""), ("T3", "later", "")], "task_id string, route string, handler string")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    tasks = audit.snapshot(docs, lib)
    results = docs.select("document_id", F.lit("T1").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "issue_found").when(F.col("o_orderstatus") == "O", "no_issue").alias("result"))
    done = audit.dispatched(tasks.drop("status"), {"status": results})
    return audit.report(done).join(audit.violations(done).agg(F.count("*").alias("n_violations")))


AUD_REPORT = """
WITH t AS (SELECT o_orderkey AS d, CASE o_orderstatus WHEN 'F' THEN 'issue_found' WHEN 'O' THEN 'no_issue' ELSE 'pending' END AS status FROM orders UNION ALL SELECT o_orderkey, 'offline' FROM orders UNION ALL SELECT o_orderkey, 'pending' FROM orders)
SELECT status, count(*) AS n_tasks, count(DISTINCT d) AS n_documents, 0::BIGINT AS n_violations FROM t GROUP BY status
"""


def aud_task_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).where("block_type <> 'toc_entry'").withColumn("task_id", F.when(F.col("ordinal") % 2 == 0, "even").otherwise("odd"))
    return audit.task_evidence(b).select("document_id", "task_id", "n_blocks", F.sha2("evidence", 256).alias("evidence_hash"))


AUD_TASK = f"""
WITH {BLOCKS_SQL}, e AS (SELECT document_id, CASE WHEN ordinal % 2 = 0 THEN 'even' ELSE 'odd' END AS task_id, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY ordinal) AS x FROM blocks WHERE block_type <> 'toc_entry' GROUP BY ALL)
SELECT document_id, task_id, n_blocks, sha256(CASE WHEN length(x) > 32767 THEN left(x, 32747) || '[导出内容已截断，请在页面查看完整证据]' ELSE x END) AS evidence_hash FROM e
"""


def aud_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed work types against detected ones, both ways."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set("l_returnflag").alias("confirmed"), F.collect_set("l_linestatus").alias("s"))
    out = audit.confirmed_against_detected(rows.select("run_id", "confirmed", F.transform("s", lambda x: F.when(x == "F", "R").otherwise("N")).alias("detected")))
    return out.select("run_id", F.array_join("not_detected", ",").alias("not_detected"), F.array_join("not_confirmed", ",").alias("not_confirmed"))


AUD_CONTEXT = """
WITH r AS (SELECT l_orderkey AS run_id, list_distinct(list(l_returnflag)) AS c, list_distinct(list(CASE l_linestatus WHEN 'F' THEN 'R' ELSE 'N' END)) AS d FROM lineitem GROUP BY 1)
SELECT run_id, array_to_string(list_sort([x for x in c if NOT list_contains(d, x)]), ',') AS not_detected, array_to_string(list_sort([x for x in d if NOT list_contains(c, x)]), ',') AS not_confirmed FROM r
"""


def aud_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of job tables, each once: brands of parts chained in a supplier's table."""
    row = F.array(F.concat(F.lit("step "), (F.col("l_partkey") % 4).cast("string"), F.lit(" → step "), (F.col("l_partkey") % 5).cast("string")), F.lit("fall"))
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", each=LINES_EACH)
    t = lines.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return audit.step_rows(t.withColumn("header", F.array(F.lit("作业步骤"), F.lit("危害"))), "步骤", "危害").select("table_id", "place", "step", "hazard")


AUD_STEPS = """
WITH x AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_partkey AS p FROM lineitem),
s AS (SELECT table_id, n, unnest([0, 1]) AS k, 'step ' || unnest([p % 4, p % 5]) AS step FROM x), f AS (SELECT table_id, step, min((n, k)) AS o FROM s GROUP BY ALL)
SELECT table_id, (row_number() OVER (PARTITION BY table_id ORDER BY o))::INT AS place, step, 'fall' AS hazard FROM f
"""


def src_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.when(F.col("p_size") > 20, "x").otherwise("-").alias("hot"), F.when(F.col("p_retailprice") > 1500, "1").otherwise("无").alias("costly"))
    return files.risk_catalogue([sheet]).select("code", F.array_join("work_types", ",").alias("work_types"))


SRC_CATALOGUE = """
WITH m AS (SELECT p_brand AS code, 'hot' AS t FROM part WHERE p_size > 20 UNION SELECT p_brand, 'costly' FROM part WHERE p_retailprice > 1500) SELECT code, string_agg(t, ',' ORDER BY t) AS work_types FROM m GROUP BY code
"""


def src_task_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as base tasks, brands updated for large sizes, suppliers added; rules checked against the tasks."""
    base = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("task_id"), F.col("p_partkey").alias("task_order"), F.col("p_name").alias("name"), F.lit("deterministic").alias("route"))
    updates = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("task_id"), F.lit("manual").alias("route"))
    added = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("task_id"), F.col("s_suppkey").alias("task_order"), F.col("s_name").alias("name"), F.lit("deterministic").alias("route"))
    library, twice = files.task_library(base, updates, added)
    rules_ = library.where("task_order % 3 <> 0").select("task_id", F.when(F.col("task_order") % 7 == 0, "lost").otherwise("fields").alias("handler"))
    problems = files.rule_coverage(library, rules_, spark.createDataFrame([("fields",)], "handler string"))
    return problems.groupBy("problem").agg(F.count("*").alias("n")).union(twice.groupBy(F.concat(F.lit("twice_"), "field")).agg(F.count("*")))


SRC_LIBRARY = """
WITH l AS (SELECT 'P' || p_partkey AS id, p_partkey AS o, CASE WHEN p_size > 40 THEN 'manual' ELSE 'deterministic' END AS route FROM part UNION ALL SELECT 'S' || s_suppkey, s_suppkey, 'deterministic' FROM supplier)
SELECT 'missing_rule' AS problem, count(*) AS n FROM l WHERE route = 'deterministic' AND o % 3 = 0 UNION ALL SELECT 'unexpected_rule', count(*) FROM l WHERE route = 'manual' AND o % 3 <> 0
UNION ALL SELECT 'unknown_handler', count(*) FROM l WHERE o % 3 <> 0 AND o % 7 = 0 UNION ALL SELECT 'twice_task_order', count(*) FROM (SELECT o FROM l GROUP BY o HAVING count(*) > 1)
"""

_PAIRS = [
    (nrm_clauses, NRM_CLAUSES), (nrm_violations, NRM_VIOLATIONS), (nrm_cycles, NRM_CYCLES), (nrm_applicable, NRM_APPLICABLE), (nrm_coverage, NRM_COVERAGE), (nrm_segments, NRM_SEGMENTS), (nrm_costed_segments, None), (nrm_release, NRM_RELEASE),
    (nrm_clause_search, NRM_SEARCH), (nrm_search_windows, NRM_WINDOWS), (nrm_referenced, NRM_REFERENCED), (aln_scores, ALN_SCORES), (aln_deduplicated, ALN_DEDUPLICATED), (aln_pairs, None), (aln_groups, None), (aln_components, ALN_COMPONENTS), (aln_decisions, ALN_DECISIONS),
    (aln_known, ALN_KNOWN), (aln_similar, ALN_SIMILAR), (aud_sections, AUD_SECTIONS), (aud_located, AUD_LOCATED), (aud_regions, AUD_REGIONS), (aud_special_regions, AUD_SPECIAL), (aud_flat_results, AUD_FLAT), (aud_advisories, AUD_ADVISORIES), (aud_missing_columns, AUD_COLUMNS), (aud_missing_values, AUD_VALUES), (aud_headcounts, AUD_HEADCOUNTS),
    (aud_missing_labels, AUD_LABELS), (aud_values, AUD_VALUES_SQL), (aud_equipment, AUD_EQUIPMENT), (aud_work_codes, AUD_CODES), (aud_dispatch, AUD_DISPATCH), (aud_report, AUD_REPORT), (aud_task_evidence, AUD_TASK), (aud_context, AUD_CONTEXT), (aud_steps, AUD_STEPS),
    (src_catalogue, SRC_CATALOGUE), (src_task_library, SRC_LIBRARY),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS if s is not None}
