"""Runs, listings, lifecycle, exports and streams over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import runs
from corpusloom.operators.norms import latest
from corpusloom.operators.sizes import dealt
from corpusloom.plans.shapes import LINES_EACH, cte, shape, table
from corpusloom.sources import shared
from corpusloom.streaming import progress
from corpusloom.streaming.progress import run_progress


def rel_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.overview(n_runs=shape(spark, sf_dir, "runs"), n_documents=shape(spark, sf_dir, "run_documents"), n_chunks=table(spark, sf_dir, "documents"), n_triplets=shape(spark, sf_dir, "triplets").where("is_valid"))


REL_OVERVIEW = f"WITH {cte('triplets')} SELECT (SELECT count(*) FROM customer) AS n_runs, (SELECT count(*) FROM orders) AS n_documents, (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM triplets WHERE is_valid) AS n_triplets"


def rel_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.counts_by(shape(spark, sf_dir, "runs"), "status")


REL_STATUS = f"WITH {cte('runs')} SELECT status, count(*) AS n FROM runs GROUP BY status"


def rel_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shape(spark, sf_dir, "run_documents")
    return runs.recent(docs, "started_at", "document_id", 25, F.col("status") == "failed").select("document_id", "run_id", F.col("started_at").cast("string").alias("started_at"))


REL_RECENT = f"WITH {cte('run_documents')} SELECT document_id, run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM (SELECT * FROM run_documents WHERE status = 'failed' ORDER BY started_at DESC, document_id LIMIT 25)"


def rel_run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shape(spark, sf_dir, "run_documents")
    lines = shape(spark, sf_dir, "triplets").select("document_id").join(docs, "document_id").select("run_id")
    return runs.with_counts(shape(spark, sf_dir, "runs").select("run_id", "name", "status"), "run_id", n_documents=docs, n_triplets=lines)


REL_DETAIL = f"""
WITH {cte('runs', 'run_documents', 'triplets')} SELECT run_id, name, status, (SELECT count(*) FROM run_documents d WHERE d.run_id = r.run_id) AS n_documents,
  (SELECT count(*) FROM triplets t JOIN run_documents d USING (document_id) WHERE d.run_id = r.run_id) AS n_triplets FROM runs r
"""


def rel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "calls").select("run_id", "stage").distinct()


REL_STAGES = f"WITH {cte('calls')} SELECT DISTINCT run_id, stage FROM calls"


def rel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.recent(shape(spark, sf_dir, "calls"), "created", "call_id", 1000, F.col("stage") == "assistant").select("call_id", "run_id", "created")


REL_CALLS = f"WITH {cte('calls')} SELECT call_id, run_id, created FROM calls WHERE stage = 'assistant' ORDER BY created DESC, call_id LIMIT 1000"


def rel_document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of every document with their place in its listing."""
    t = shape(spark, sf_dir, "triplets")
    return t.withColumn("place", F.expr("row_number() over (partition by document_id order by head, relation, tail, triplet_id)")).select("document_id", "triplet_id", "place")


REL_LISTING = f"WITH {cte('triplets')} SELECT document_id, triplet_id, (row_number() OVER (PARTITION BY document_id ORDER BY head, relation, tail, triplet_id))::INT AS place FROM triplets"


def rel_run_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shape(spark, sf_dir, "triplets").where("run_id = 'run-3' and is_valid")
    return t.groupBy("head", "relation", "tail").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head", "relation", "tail").limit(500)


REL_GRAPH = f"WITH {cte('triplets')} SELECT head, relation, tail, count(*) AS n FROM triplets WHERE run_id = 'run-3' AND is_valid GROUP BY ALL ORDER BY n DESC, head, relation, tail LIMIT 500"


def rel_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with the ordered entities of their document's hits of their sentence."""
    t, h = shape(spark, sf_dir, "triplets").where("is_valid"), shape(spark, sf_dir, "hits")
    rows = t.join(h, (t["document_id"] == h["document_id"]) & (t["seq"] == h["sentence_index"])).select("triplet_id", "rank", "retrieval_id", "entity")
    return rows.groupBy("triplet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "retrieval_id", "entity"))), lambda x: x["entity"]), "|").alias("evidence"))


REL_EVIDENCE = f"""
WITH {cte('triplets', 'hits')} SELECT triplet_id, string_agg(entity, '|' ORDER BY h.rank, retrieval_id, entity) AS evidence FROM triplets t JOIN hits h ON h.document_id = t.document_id AND h.sentence_index = t.seq WHERE is_valid GROUP BY triplet_id
"""


def rel_blind_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their run, and where there are any their lines' and customers' facts."""
    d, r = shape(spark, sf_dir, "run_documents"), shape(spark, sf_dir, "runs").withColumnRenamed("status", "run_status")
    lines = shape(spark, sf_dir, "triplets").groupBy("document_id").agg(F.count("*").alias("n"), F.min("head").alias("first_head"))
    return d.join(r, "run_id").join(lines, "document_id", "left").select("document_id", "run_id", "segment", "run_status", "n", "first_head")


REL_BLIND = f"""
WITH {cte('runs', 'run_documents', 'triplets')} SELECT d.document_id, d.run_id, segment, r.status AS run_status, n, first_head FROM run_documents d JOIN runs r ON r.run_id = d.run_id
  LEFT JOIN (SELECT document_id, count(*) AS n, min(head) AS first_head FROM triplets GROUP BY document_id) l ON l.document_id = d.document_id
"""


def rel_sync_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with their document's and run's facts, for the graph."""
    d, r = shape(spark, sf_dir, "run_documents").withColumnRenamed("run_id", "owner"), shape(spark, sf_dir, "runs").select(F.col("run_id").alias("owner"), "segment")
    t = dealt(shape(spark, sf_dir, "triplets").select("run_id", "document_id"), "document_id", each=LINES_EACH)
    return t.join(d, "document_id").join(r, "owner", "left").groupBy("run_id", "segment").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"))


REL_SYNC = f"WITH {cte('runs', 'run_documents', 'triplets')} SELECT t.run_id, segment, count(*) AS n, count(DISTINCT t.document_id) AS n_documents FROM triplets t JOIN run_documents d USING (document_id) LEFT JOIN runs r ON r.run_id = d.run_id GROUP BY ALL"


def rel_first_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_retrieval(shape(spark, sf_dir, "hits"), ["document_id", "entity"]).select("document_id", "entity", "retrieval_id", "rank")


REL_FIRST = f"WITH {cte('hits')} SELECT document_id, entity, retrieval_id, rank FROM hits QUALIFY row_number() OVER (PARTITION BY document_id, entity ORDER BY rank, retrieval_id) = 1"


def rel_evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shape(spark, sf_dir, "hits").select(F.col("retrieval_id").alias("triplet_id"), "document_id", F.col("entity").alias("head"), F.expr("array(sentence_index, sentence_index + 1)").alias("evidence_ids"))
    return runs.evidence_links(t, shape(spark, sf_dir, "hits"))


REL_LINKS = f"""
WITH {cte('hits')}, a AS (SELECT retrieval_id AS triplet_id, document_id, entity, k AS evidence_order, sentence_index + k - 1 AS s FROM hits, (VALUES (1), (2)) v(k)),
f AS (SELECT document_id, entity, sentence_index AS s, retrieval_id FROM hits QUALIFY row_number() OVER (PARTITION BY document_id, entity, sentence_index ORDER BY rank, retrieval_id) = 1)
SELECT triplet_id, evidence_order::INT AS evidence_order, s::INT AS sentence_index, retrieval_id, CASE WHEN retrieval_id IS NULL THEN 'rejected' ELSE 'linked' END AS status FROM a LEFT JOIN f USING (document_id, entity, s)
"""


def rel_json_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each event's JSON, summed by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


REL_JSON = "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type"


def rel_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes in a release, the newest of each family, and those without a ready index."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index_id"), F.col("p_brand").alias("family"), F.concat("p_type", F.lit("-"), (F.col("p_partkey") % 40).cast("string")).alias("fingerprint"), F.when(F.col("p_size") > 10, "ready").otherwise("failed").alias("status"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("index_id"))
    newest = latest(p.join(used, "index_id", "left_semi"), "family", "index_id")
    return newest.select("family", "index_id").join(runs.unbuilt(p, p.where("index_id % 2 = 0")).groupBy("family").agg(F.count("*").alias("n_unbuilt")), "family", "left")


REL_MEMBERS = """
WITH p AS (SELECT p_partkey AS index_id, p_brand AS family, p_type || '-' || (p_partkey % 40) AS fingerprint, p_size > 10 AS ready FROM part),
n AS (SELECT family, max(index_id) AS index_id FROM p WHERE index_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY family),
u AS (SELECT family, count(*) AS n_unbuilt FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE ready AND index_id % 2 = 0) GROUP BY family)
SELECT family, index_id, n_unbuilt FROM n LEFT JOIN u USING (family)
"""


def rel_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.publishable(shape(spark, sf_dir, "runs")).select("run_id", "segment")


REL_PUBLISHABLE = f"WITH {cte('runs')} SELECT run_id, segment FROM runs WHERE status = 'completed' AND coalesce(deletion_state, 'active') = 'active'"


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(shape(spark, sf_dir, "run_documents"))


RUN_STATUS = f"""
WITH {cte('run_documents')}, c AS (SELECT run_id, count(*) AS n_documents, count(*) FILTER (status = 'failed') AS n_failed FROM run_documents GROUP BY run_id)
SELECT *, CASE WHEN n_failed = n_documents THEN 'failed' WHEN n_failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM c
"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.create_map(F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")), F.col("seq") % 10)
    out = runs.event_state(shape(spark, sf_dir, "run_events").withColumn("metrics", metric))
    return out.select("run_id", "stage", "document_name", F.col("document_completed").cast("long"), F.col("document_total").cast("long"), "status", "n_events", F.array_join("seen_stages", ",").alias("seen_stages"), F.element_at("metrics", "k1").alias("k1"))


RUN_EVENTS = f"""
WITH {cte('run_events')}, s AS (SELECT run_id, string_agg(stage, ',' ORDER BY f) AS seen_stages FROM (SELECT run_id, stage, min((ts, seq)) AS f FROM run_events GROUP BY ALL) GROUP BY run_id)
SELECT run_id, arg_max(stage, (ts, seq)) AS stage, arg_max(document_name, (ts, seq)) FILTER (document_name IS NOT NULL) AS document_name,
  coalesce(arg_max(completed, (ts, seq)) FILTER (event_type IN ('document_completed', 'document_failed') AND completed IS NOT NULL), 0)::BIGINT AS document_completed,
  coalesce(arg_max(total, (ts, seq)) FILTER (event_type IN ('document_completed', 'document_failed', 'started') AND total IS NOT NULL), 0)::BIGINT AS document_total,
  coalesce(arg_max(CASE event_type WHEN 'started' THEN 'running' ELSE event_type END, (ts, seq)) FILTER (event_type IN ('started', 'completed')), 'idle') AS status,
  count(*) AS n_events, any_value(seen_stages) AS seen_stages, sum(seq % 10) FILTER (seq % 3 = 1)::BIGINT AS k1 FROM run_events JOIN s USING (run_id) GROUP BY run_id
"""


def run_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.last_events(shape(spark, sf_dir, "run_events").withColumn("run_id", F.col("run_id") % 10), 200).select("run_id", "seq", "place")


RUN_LAST = f"WITH {cte('run_events')} SELECT run_id % 10 AS run_id, seq, (row_number() OVER (PARTITION BY run_id % 10 ORDER BY ts DESC, seq DESC))::INT AS place FROM run_events QUALIFY place <= 200"


def run_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left by table after the failed runs go with their documents and lines."""
    doomed = shape(spark, sf_dir, "runs").where("status = 'failed'")
    docs = shape(spark, sf_dir, "run_documents")
    gone = docs.join(doomed, "run_id", "left_semi")
    return runs.export_counts(
        runs=runs.without_runs(shape(spark, sf_dir, "runs"), doomed, "run_id"), documents=runs.without_runs(docs, doomed, "run_id"), triplets=runs.without_runs(shape(spark, sf_dir, "triplets"), gone, "document_id")
    )


RUN_CASCADE = f"""
WITH {cte('runs', 'run_documents', 'triplets')}, d AS (SELECT run_id FROM runs WHERE status = 'failed')
SELECT 'runs' AS table_name, count(*) AS row_count FROM runs WHERE run_id NOT IN (FROM d) UNION ALL SELECT 'documents', count(*) FROM run_documents WHERE run_id NOT IN (FROM d)
UNION ALL SELECT 'triplets', count(*) FROM triplets WHERE document_id NOT IN (SELECT document_id FROM run_documents WHERE run_id IN (FROM d))
"""


def run_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    used = shape(spark, sf_dir, "run_documents").where("status = 'failed'")
    return runs.deletion_outcomes(asked, shape(spark, sf_dir, "runs"), used)


RUN_DELETIONS = f"""
WITH {cte('runs', 'run_documents')}, a AS (SELECT DISTINCT user_id AS run_id FROM events), u AS (SELECT DISTINCT run_id FROM run_documents WHERE status = 'failed')
SELECT a.run_id, CASE WHEN r.run_id IS NULL THEN 'missing' WHEN deletion_state = 'pending' THEN 'pending' WHEN coalesce(deletion_state, 'active') <> 'active' THEN 'not_active' WHEN u.run_id IS NOT NULL THEN 'referenced' ELSE 'deleted' END AS outcome
FROM a LEFT JOIN runs r ON r.run_id = a.run_id LEFT JOIN u ON u.run_id = a.run_id
"""


def snk_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of an export of each segment's runs, with their cells formatted."""
    d = shape(spark, sf_dir, "run_documents").join(shape(spark, sf_dir, "runs").where("segment = 'BUILDING'").select("run_id"), "run_id", "left_semi")
    cells = runs.exported(d)
    return cells.groupBy("status").agg(F.count("*").alias("n"), F.min("started_at").alias("first"), F.max("started_at").alias("last"))


SNK_PACKAGE = f"""
WITH {cte('runs', 'run_documents')} SELECT status, count(*) AS n, min(strftime(started_at, '%Y-%m-%d %H:%M:%S')) AS first, max(strftime(started_at, '%Y-%m-%d %H:%M:%S')) AS last
FROM run_documents WHERE run_id IN (SELECT run_id FROM runs WHERE segment = 'BUILDING') GROUP BY status
"""


def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines keyed by part and supplier: the newest stays; writing them twice changes nothing."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("fingerprint"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("created_at"), "l_orderkey")
    once = runs.upserted(rows.where("l_orderkey % 2 = 0"), rows, "fingerprint", "created_at")
    return once.select("fingerprint", "l_orderkey")


SNK_UPSERT = "SELECT l_partkey || ':' || l_suppkey AS fingerprint, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey"


def snk_report_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "run_documents").select("run_id", F.col("started_at").alias("created_at"), F.col("document_id").alias("report_id"))
    return runs.versioned_reports(rows).select("run_id", "report_id", "report_version", "is_latest")


SNK_REPORTS = f"""
WITH {cte('run_documents')}, v AS (SELECT run_id, document_id AS report_id, (row_number() OVER (PARTITION BY run_id ORDER BY started_at, document_id))::INT AS report_version FROM run_documents)
SELECT *, report_version = max(report_version) OVER (PARTITION BY run_id) AS is_latest FROM v
"""


def str_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the run-progress stream; the tests hold the stream against it."""
    rows = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 50)
    return run_progress(rows).withColumns({"total": F.round("total", 4), "last_seen": F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")})


STR_PROGRESS = """
SELECT user_id % 50 AS run_id, arg_max(event_type, (ts, event_id)) AS last_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 4) AS total FROM events GROUP BY 1
"""

def _streamed(events: DataFrame, updates: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """What a stream tells last of all events, which arrive in two lots of files, the second after a restart."""
    spark = events.sparkSession
    store = shared.path(spark, "stream")
    shared.gone_at_exit(spark, store)
    for lot in (0, 1):
        events.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == lot).write.mode("append").parquet(f"{store}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(f"{store}/in")
        progress.follow(updates(stream), f"{store}/out")
    return progress.followed(spark, f"{store}/out", keys)


def str_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_events() from a stream."""
    metric = F.create_map(F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")), F.col("seq") % 10)
    events = shape(spark, sf_dir, "run_events").withColumn("metrics", metric)
    out = progress.run_states(_streamed(events, progress.run_facts, ["run_id", "kind", "name"]))
    return out.select("run_id", "stage", "document_name", F.col("document_completed").cast("long"), F.col("document_total").cast("long"), "status", "n_events", F.array_join("seen_stages", ",").alias("seen_stages"), F.element_at("metrics", "k1").cast("long").alias("k1"))


def str_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_last_events() from a stream."""
    events = shape(spark, sf_dir, "run_events").withColumn("run_id", F.col("run_id") % 10)
    parts = _streamed(events, progress.last_events, ["run_id", "part"])
    return progress.newest_events(parts, events.schema).select("run_id", "seq", "place")


_PAIRS = [
    (rel_overview, REL_OVERVIEW), (rel_status_counts, REL_STATUS), (rel_recent_runs, REL_RECENT), (rel_run_detail, REL_DETAIL), (rel_stages, REL_STAGES), (rel_calls, REL_CALLS), (rel_document_listing, REL_LISTING), (rel_run_graph, REL_GRAPH),
    (rel_evidence, REL_EVIDENCE), (rel_blind_source, REL_BLIND), (rel_sync_source, REL_SYNC), (rel_first_retrieval, REL_FIRST), (rel_evidence_links, REL_LINKS), (rel_json_metric, REL_JSON), (rel_members, REL_MEMBERS),
    (rel_publishable, REL_PUBLISHABLE), (run_status, RUN_STATUS), (run_events, RUN_EVENTS), (run_last_events, RUN_LAST), (run_cascade_delete, RUN_CASCADE), (run_deletions, RUN_DELETIONS), (snk_package, SNK_PACKAGE),
    (snk_upsert, SNK_UPSERT), (snk_report_versions, SNK_REPORTS), (str_progress, STR_PROGRESS), (str_run_states, RUN_EVENTS), (str_last_events, RUN_LAST),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS}
