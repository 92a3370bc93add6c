"""Records, reports, packages and registers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import records
from corpusloom.operators.sizes import dealt
from corpusloom.plans.shapes import LINES_EACH, cte, shape, table
from corpusloom.sources.shared import gone_at_exit, path


def snk_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even keys as stored results, the others appended under ids above theirs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), "o_orderdate", F.col("o_orderkey").alias("source"))
    return records.appended(o.where("result_id % 2 = 0"), o.where("result_id % 2 = 1").drop("result_id"), "result_id", ["o_orderdate", "source"]).select("result_id", "source")


SNK_APPENDED = "SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS result_id, o_orderkey AS source FROM orders WHERE o_orderkey % 2 = 1"


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunk and entity records: keys of their order and supplier found by name, some of which nobody has."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc-"), "l_orderkey").alias("document_name"), F.format_string("Supplier#%09d", F.col("l_suppkey") + 2).alias("s_name"), "l_partkey", "l_linenumber")
    docs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("doc-"), "o_orderkey").alias("document_name"), F.col("o_orderkey").alias("document_id"))
    chunks = records.with_parents(lines, ["document_name"], docs, "document_id").withColumnRenamed("violation", "no_document")
    out = records.with_parents(chunks, ["s_name"], table(spark, sf_dir, "supplier").select("s_name", F.col("s_suppkey").alias("entity_id")), "entity_id")
    return out.select("document_name", "l_partkey", "l_linenumber", "document_id", "entity_id", F.concat_ws(",", "no_document", "violation").alias("violation"))


RUN_RECORDS = """
SELECT 'doc-' || l_orderkey AS document_name, l_partkey, l_linenumber, o_orderkey AS document_id, s_suppkey AS entity_id, concat_ws(',', CASE WHEN o_orderkey IS NULL THEN 'no document_id' END, CASE WHEN s_suppkey IS NULL THEN 'no entity_id' END) AS violation
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' LEFT JOIN supplier ON s_name = printf('Supplier#%09d', l_suppkey + 2)
"""


def rel_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, entities and retrieval hits of every document with their places in its listings."""
    t, h = shape(spark, sf_dir, "triplets"), shape(spark, sf_dir, "hits")
    chunks = records.placed(t.select("document_id", F.col("triplet_id").alias("key")), ["document_id"], ["key"]).withColumn("listing", F.lit("chunks"))
    names = t.select("document_id", F.concat_ws("/", "head_type", "head").alias("name")).distinct()
    entities = records.placed(names, ["document_id"], ["name"]).withColumn("listing", F.lit("entities"))
    hits = records.placed(h.select("document_id", "entity", "rank", F.col("retrieval_id").alias("key")), ["document_id"], ["entity", "rank", "key"]).withColumn("listing", F.lit("hits"))
    return chunks.unionByName(entities, True).unionByName(hits, True).select("listing", "document_id", "place", "key", "name")


REL_LISTINGS = f"""
WITH {cte('triplets', 'hits')}, n AS (SELECT DISTINCT document_id, head_type || '/' || head AS name FROM triplets)
SELECT 'chunks' AS listing, document_id, row_number() OVER (PARTITION BY document_id ORDER BY triplet_id) AS place, triplet_id AS key, NULL AS name FROM triplets
UNION ALL SELECT 'entities', document_id, row_number() OVER (PARTITION BY document_id ORDER BY name), NULL, name FROM n
UNION ALL SELECT 'hits', document_id, row_number() OVER (PARTITION BY document_id ORDER BY entity, rank, retrieval_id), retrieval_id, NULL FROM hits
"""


def rel_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as evaluations of their users' runs against one gold, newest first; some summaries are cut short."""
    e = table(spark, sf_dir, "events")
    summary = F.concat(F.lit('{"overall": {"triplet_f1": '), F.col("value").cast("string"), F.when(F.col("event_id") % 5 == 0, "").otherwise("}}"))
    rows = e.select(F.col("event_id").alias("evaluation_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("gold_hash"), F.col("ts").alias("created_at"), summary.alias("summary"))
    return records.evaluations(rows, "click").select("evaluation_id", "run_id", "place", F.round("triplet_f1", 4).alias("triplet_f1"))


REL_EVALUATIONS = """
SELECT event_id AS evaluation_id, user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS place, CASE WHEN event_id % 5 <> 0 THEN round(value, 4) END AS triplet_f1 FROM events WHERE event_type = 'click'
"""


def rel_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as evaluations: counts of their customers as metrics, their suppliers as alignments."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("evaluation_id"), "c_mktsegment").agg(F.count("*").alias("value"))
    m = c.select("evaluation_id", F.lit("document").alias("scope_type"), F.col("c_mktsegment").alias("scope_name"), F.lit("n").alias("metric_name"), "value")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("evaluation_id"), F.lit("d").alias("document"), F.col("s_name").alias("name"), F.lit("S").alias("type"), F.when(F.col("s_suppkey") % 3 == 0, "ambiguous").otherwise("matched_type").alias("status"))
    return records.evaluation_report(m, s)


REL_EVALUATION = """
WITH l AS (SELECT c_nationkey AS evaluation_id, 'metric' AS part, 'document' AS scope_type, c_mktsegment AS name, 'n' AS kind, count(*)::VARCHAR AS told FROM customer GROUP BY ALL
  UNION ALL SELECT s_nationkey, 'alignment', 'document', 'd/' || s_name, 'S', CASE WHEN s_suppkey % 3 = 0 THEN 'ambiguous' ELSE 'matched_type' END FROM supplier)
SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY part DESC, scope_type, name, kind, told) AS place FROM l
"""


def rel_audit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audit runs of their customer's document, lines as tasks; customers in debt have no document."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"))
    docs = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("document_name"))
    tasks = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("run_id"))
    return records.audit_runs(runs, docs, tasks)


REL_AUDIT = """
SELECT o_orderkey AS run_id, o_custkey AS document_id, o_orderstatus AS status, c_name AS document_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AS n_tasks FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each place of an order as the result of a task; returned ones have no result yet."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("T"), F.col("l_linenumber") % 3).alias("task_id"), "l_returnflag")
    lines = dealt(lines, "run_id", "task_id", each=LINES_EACH).groupBy("run_id", "task_id").agg(F.min("l_returnflag").alias("flag"))
    return lines.select("run_id", "task_id", F.when(F.col("flag") == "R", "pending").otherwise("completed").alias("execution_status"), F.when(F.col("flag") == "A", "issue_found").when(F.col("flag") == "N", "no_issue").alias("result"))


def aud_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of tasks with their evidence and issues, as stored rows."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("T"), F.col("l_linenumber") % 3).alias("task_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("locator"), "l_returnflag")
    evidence = line.select("run_id", "task_id", F.col("locator").alias("ordinal"), "locator")
    issues = line.where("l_returnflag = 'A'").select("run_id", "task_id", F.lit("gap").alias("category"), F.col("locator").alias("description"))
    return records.persisted_results(_results(spark, sf_dir), evidence, issues)


_RESULTS = "r AS (SELECT l_orderkey AS run_id, 'T' || (l_linenumber % 3) AS task_id, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey AS run_id, 'T' || (l_linenumber % 3) AS task_id, l_returnflag AS flag, concat_ws('/', l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem)"
AUD_PERSISTED = f"""
WITH {_RESULTS} SELECT run_id, task_id, 'result' AS kind, 1 AS place, CASE flag WHEN 'R' THEN 'pending:' WHEN 'A' THEN 'completed:issue_found' ELSE 'completed:no_issue' END AS body FROM r
UNION ALL SELECT run_id, task_id, 'evidence', row_number() OVER (PARTITION BY run_id, task_id ORDER BY x), x FROM e UNION ALL SELECT run_id, task_id, 'issue', row_number() OVER (PARTITION BY run_id, task_id ORDER BY x), 'gap: ' || x FROM e WHERE flag = 'A'
"""


def aud_task_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of orders against the tasks that each order must have: two for open ones, three for others."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.explode(F.when(F.col("o_orderstatus") == "O", F.array(F.lit("T0"), F.lit("T1"))).otherwise(F.array(F.lit("T0"), F.lit("T1"), F.lit("T2")))).alias("task_id"))
    return records.task_differences(_results(spark, sf_dir), wanted)


AUD_TASK_SETS = f"""
WITH {_RESULTS}, w AS (SELECT o_orderkey AS run_id, unnest(CASE o_orderstatus WHEN 'O' THEN ['T0', 'T1'] ELSE ['T0', 'T1', 'T2'] END) AS task_id FROM orders)
SELECT run_id, task_id, 'missing' AS problem FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = w.run_id AND r.task_id = w.task_id)
UNION ALL SELECT run_id, task_id, 'unexpected' FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE r.run_id = w.run_id AND r.task_id = w.task_id)
"""


def evl_gold_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as gold triplets of part and supplier ids, written with blanks; parts of small size are unknown."""
    p = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey", F.lit(" ")).alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit("Part").alias("type"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("Supplier").alias("type"))
    entities = p.unionByName(s).withColumn("doc", F.lit(1))
    t = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc"), F.concat(F.lit(" p"), "l_partkey").alias("head_id"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat(F.lit("FROM_"), "l_returnflag")).alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("tail_id"))
    return records.gold_by_id(t, entities).distinct()


EVL_GOLD = "SELECT DISTINCT 1 AS doc, p_name AS head, 'Part' AS head_type, 'FROM_' || l_returnflag AS relation, s_name AS tail, 'Supplier' AS tail_type FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R'"


def nrm_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as incoming regulations of their brand's family and size's version; brands of type one exist already."""
    p = table(spark, sf_dir, "part")
    incoming = p.select(F.concat(F.lit("  "), "p_brand").alias("family_name"), F.concat(F.lit("v"), "p_size").alias("version_label"), F.concat("p_type", F.lit("\n")).alias("content"))
    families = p.where("p_brand like '%#1%'").select(F.col("p_brand").alias("family_name")).distinct().withColumn("family_id", F.substring_index("family_name", "#", -1).cast("long"))
    versions = families.select("family_id", F.lit("v7").alias("version_label"), (F.col("family_id") + 100).alias("version_id"))
    sets = versions.select("version_id", F.sha2(F.lit("none"), 256).alias("content_hash"), F.col("version_id").alias("clause_set_id"))
    out = None
    for name, rows in zip(("family", "version", "clause_set"), records.registered(families, versions, sets, incoming), strict=True):
        one = rows.select(F.lit(name).alias("added"), F.col(f"{name}_id").alias("id"), *[F.col(c).cast("string").alias(f"by_{k}") for k, c in enumerate({"family": ["family_name", "family_name"], "version": ["family_id", "version_label"], "clause_set": ["version_id", "content_hash"]}[name])])
        out = one if out is None else out.unionByName(one)
    return out


NRM_REGISTERED = """
WITH i AS (SELECT DISTINCT p_brand AS f, 'v' || p_size AS v, sha256(p_type) AS h FROM part), f0 AS (SELECT DISTINCT p_brand AS f, string_split(p_brand, '#')[-1]::BIGINT AS fid FROM part WHERE p_brand LIKE '%#1%'),
f1 AS (SELECT f, (SELECT coalesce(max(fid), 0) FROM f0) + row_number() OVER (ORDER BY f) AS fid FROM (SELECT DISTINCT f FROM i WHERE f NOT IN (SELECT f FROM f0))), fa AS (FROM f0 UNION ALL FROM f1),
v0 AS (SELECT fid, 'v7' AS v, fid + 100 AS vid FROM f0), n AS (SELECT DISTINCT fid, v FROM i JOIN fa USING (f) EXCEPT SELECT fid, v FROM v0), v1 AS (SELECT fid, v, (SELECT coalesce(max(vid), 0) FROM v0) + row_number() OVER (ORDER BY fid, v) AS vid FROM n),
va AS (FROM v0 UNION ALL FROM v1), s AS (SELECT DISTINCT vid, h FROM i JOIN fa USING (f) JOIN va USING (fid, v))
SELECT 'family' AS added, fid AS id, f AS by_0, f AS by_1 FROM f1 UNION ALL SELECT 'version', vid, fid::VARCHAR, v FROM v1
UNION ALL SELECT 'clause_set', (SELECT coalesce(max(vid), 0) FROM v0) + row_number() OVER (ORDER BY vid, h), vid::VARCHAR, h FROM s
"""


def nrm_index_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clause sets of their customer's version, lines as clauses, some blank; sets of failed orders are indexed already."""
    sets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("clause_set_id"), F.col("o_orderdate").alias("created_at"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    clauses = lines.groupBy(F.col("l_orderkey").alias("clause_set_id"), F.col("l_linenumber").alias("clause_index")).agg(F.min(F.when(F.col("l_partkey") % 40 == 0, F.lit(" ")).otherwise(F.concat(F.lit("clause "), F.lpad(F.col("l_partkey").cast("string"), 9, "0")))).alias("text"))
    encoder = records.encoder_fingerprint(F.lit("model-a"), F.lit(384), F.lit(128), F.lit(8))
    built = records.index_builds(sets, clauses, spark.createDataFrame([], "fingerprint string, status string"), encoder)
    indexes = built.where("version_id % 5 = 0").select("fingerprint", F.lit("ready").alias("status"))
    return records.index_builds(sets, clauses, indexes, encoder)


NRM_BUILDS = """
WITH c AS (SELECT l_orderkey AS s, l_linenumber AS i, min(CASE WHEN l_partkey % 40 = 0 THEN ' ' ELSE 'clause ' || lpad(l_partkey::VARCHAR, 9, '0') END) AS x FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
g AS (SELECT s, count(*) AS n, count(*) FILTER (trim(x) = '') AS b, sha256(string_agg(sha256(x), ',' ORDER BY i)) AS h FROM c GROUP BY s),
v AS (SELECT o_custkey AS version_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS clause_set_id FROM orders GROUP BY o_custkey),
p AS (SELECT *, sha256(sha256('{"model":"model-a","most_tokens":128,"overlap":8,"width":384}') || ':' || clause_set_id || ':' || coalesce(h, '')) AS fingerprint FROM v LEFT JOIN g ON s = clause_set_id)
SELECT version_id, clause_set_id, fingerprint, coalesce(n, 0) AS n_clauses, CASE WHEN version_id % 5 = 0 THEN 'skipped' WHEN n IS NULL OR b > 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN n IS NULL THEN 'no_clauses' WHEN b > 0 THEN 'blank_clause' END AS reason FROM p
"""


def snk_run_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven tables of run-3 written as CSV with its run.json, and the rows that are read back."""
    t, h = shape(spark, sf_dir, "triplets"), shape(spark, sf_dir, "hits")
    of_run = h.join(t.select(F.col("triplet_id").alias("retrieval_id"), "run_id"), "retrieval_id")
    counts = t.groupBy("run_id", "relation").agg(F.count("*").alias("n"))
    tables = {
        "runs": t.groupBy("run_id").agg(F.count("*").alias("n"), F.max("extracted_at").alias("last")), "documents": t.select("run_id", "document_id").distinct(), "chunks": t.select("run_id", "document_id", "seq", "extracted_at"),
        "entities": t.select("run_id", "head", "head_type").distinct(), "retrievals": of_run, "triplets": t, "evidence": of_run.select("run_id", "retrieval_id", F.struct("entity", "index").alias("place")),
        "calls": t.select("run_id", "triplet_id", F.concat(F.lit('a "quoted", cell\nof '), "tail").alias("response")), "evaluations": counts.select("run_id", "n").distinct(), "metrics": counts, "alignments": t.select("run_id", "tail", "tail_type").distinct(),
    }
    at = path(spark, "package")
    out = records.export_package(at, "run-3", **tables)
    gone_at_exit(spark, at)
    return out


SNK_RUN_PACKAGE = f"""
WITH {cte('triplets', 'hits')}, t AS (SELECT * FROM triplets WHERE run_id = 'run-3'), r AS (SELECT run_id FROM hits JOIN triplets ON triplet_id = retrieval_id WHERE run_id = 'run-3'), c AS (SELECT relation, count(*) AS n FROM t GROUP BY relation)
SELECT 'runs' AS table_name, count(DISTINCT run_id) AS row_count FROM t UNION ALL SELECT 'documents', count(DISTINCT document_id) FROM t UNION ALL SELECT 'chunks', count(*) FROM t
UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT head, head_type FROM t) UNION ALL SELECT 'retrievals', count(*) FROM r UNION ALL SELECT 'triplets', count(*) FROM t UNION ALL SELECT 'evidence', count(*) FROM r
UNION ALL SELECT 'calls', count(*) FROM t UNION ALL SELECT 'evaluations', count(DISTINCT n) FROM c UNION ALL SELECT 'metrics', count(*) FROM c UNION ALL SELECT 'alignments', count(*) FROM (SELECT DISTINCT tail, tail_type FROM t)
"""

_PAIRS = [
    (snk_appended, SNK_APPENDED), (run_records, RUN_RECORDS), (rel_listings, REL_LISTINGS), (rel_evaluation_report, REL_EVALUATION), (rel_evaluations, REL_EVALUATIONS), (rel_audit_runs, REL_AUDIT), (aud_persisted, AUD_PERSISTED), (aud_task_sets, AUD_TASK_SETS),
    (evl_gold_by_id, EVL_GOLD), (nrm_registered, NRM_REGISTERED), (nrm_index_builds, NRM_BUILDS), (snk_run_package, SNK_RUN_PACKAGE),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS}
