"""Cases of the third round's findings: repeated ids and items, results that must not depend on how small a table looks."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import align, graph_paths, profiles, retrieve, triplets, vector_index
from corpusloom.plans import evidence_plans as plans
from corpusloom.plans import norm_plans, record_plans, registry, run_plans, shapes, text_plans
from corpusloom.plans.shapes import rules, shape
from corpusloom.sources.shared import stored

COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@pytest.fixture(scope="module")
def repeated(spark, sf_dir, tmp_path_factory):
    """Some lines twice, alike and with another quantity, so that line ids and items repeat."""
    at = str(tmp_path_factory.mktemp("repeated"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 300")
    again = lines.where("l_orderkey % 4 = 0")
    other = lines.where("l_orderkey % 5 = 0").withColumn("l_quantity", F.when(F.col("l_quantity") > 40, 1.0).otherwise(50.0))
    lines.unionByName(again).unionByName(other).write.parquet(f"{at}/lineitem.parquet")
    return at


def agrees(spark, at, name, columns=None):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, at).toPandas(), con.execute(plans.SQL[name]).df()
    columns = columns or sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert len(want) > 0 and rows(got) == rows(want)


def test_parsed_items_that_repeat(spark, repeated):
    agrees(spark, repeated, "trp_parse")


def test_merge_of_repeated_ids(spark, repeated):
    agrees(spark, repeated, "grf_merge")


def test_review_of_repeated_ids(spark, repeated):
    """Which of two lines of one id has the lower number is left open by the SQL's order; everything else is compared."""
    agrees(spark, repeated, "evl_review", ["triplet_id", "document_code", "head", "tail", "evidence_text", "context_text"])
    agrees(spark, repeated, "evl_review", ["triplet_id", "sample_id", "document_code", "evidence_text", "context_text"])


def test_size_of_stored_texts(spark):
    """A table of repeated texts is no broadcast because its files are small."""
    rows = spark.range(300_000).select("id", F.repeat(F.lit("text "), 40).alias("text"))
    kept = stored(rows, "texts")
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 10 << 20


def test_rules_do_not_deal_triplets_by_relation(spark, sf_dir):
    out = triplets.admitted(shape(spark, sf_dir, "triplets"), rules(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_methods_do_not_multiply_triplets(spark, sf_dir):
    out = plans.trp_profiles(spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("BroadcastNestedLoopJoin" if "BroadcastNestedLoopJoin" in plan else "Join Inner") < plan.index("Aggregate")
    one = profiles.counts_by_method(spark.createDataFrame([("a", None, "rejected"), ("a", 1, "admitted"), ("b", 2, "rejected")], "run string, doc int, status string"), ["run"], "doc")
    got = {(r["method_id"], r["run"]): (r["n"], r["n_documents"]) for r in one.collect()}
    assert got[("R2", "a")] == (2, 1) and got[("D0", "a")] == (1, 1) and got[("R2", "b")] == (1, 1) and ("D0", "b") not in got


def test_sample_of_an_index_leaves_the_rest_where_it_is(spark, monkeypatch):
    """The sample is that of the lowest hashes, and no task offers the driver more than about its share of it."""
    monkeypatch.setattr(vector_index, "SAMPLE", 500)
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    want = [r["embedding"] for r in rows.orderBy(F.xxhash64(F.col("vec_id").cast("string")), "embedding").limit(500).collect()]
    assert vector_index._drawn(rows, 20_000).tolist() == want
    same = rows.withColumn("vec_id", F.lit(7))
    assert vector_index._drawn(same, 20_000).tolist() == [[float(k), 1.0] for k in range(500)]
    assert vector_index._drawn(rows.where("vec_id < 3"), 3).shape == (3, 2)
    assert not len(vector_index._drawn(rows.where("vec_id < 0"), 0))


def test_semantic_hits_in_tiles(spark, sf_dir, monkeypatch):
    """Pairs of tiles, not pairs of rows, meet; small tiles give what SQL gives."""
    monkeypatch.setattr(retrieve, "SENTENCE_TILE", 16)
    monkeypatch.setattr(retrieve, "ENTITY_TILE", 4)
    out = plans.ret_semantic(spark, sf_dir)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(plans.SQL["ret_semantic"]).fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 0


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_evaluation_reads_its_sources_once(spark, sf_dir):
    """What the groups and rates share is stored, so that none goes back to the lines."""
    assert "lineitem.parquet" not in planned(plans.evl_full(spark, sf_dir))


def test_values_are_found_once(spark, sf_dir):
    """Conflicts count the values of a key where they lie, and no filter finds a value again."""
    plan = planned(norm_plans.aud_values(spark, sf_dir))
    assert plan.count("orders.parquet") <= 16 and "Window" in plan and "Join Inner" not in plan


def test_names_are_dealt_and_their_grams_counted_apart(spark, sf_dir, monkeypatch):
    kept = {}
    whole = align.stored
    monkeypatch.setattr(align, "stored", lambda df, name: (kept.setdefault(name, planned(df)), whole(df, name))[1])
    monkeypatch.setattr(align, "ENTITIES_EACH", 20)
    assert norm_plans.aln_pairs(spark, sf_dir).count() >= 0
    assert re.search(r"hashpartitioning\(entity_id#\d+L, 10\)", kept["names"]) and "BroadcastHashJoin" in kept["ranked"]


@pytest.mark.parametrize(
    ("module", "constant", "name"),
    [
        (run_plans, "LINES_EACH", "rel_sync_source"),
        (text_plans, "PARTS_EACH", "txt_steps"),
        (record_plans, "LINES_EACH", "aud_task_sets"),
        (shapes, "DOCUMENTS_EACH", "txt_verbatim"),
        (shapes, "DOCUMENTS_EACH", "nrm_costed_segments"),
        (shapes, "DOCUMENTS_EACH", "ret_local_context"),
        (plans, "LINES_EACH", "ret_merged"),
        (norm_plans, "LINES_EACH", "aud_steps"),
        (plans, "LINES_EACH", "evl_wide"),
        (plans, "LINES_EACH", "ret_batches"),
    ],
)
def test_tasks_grow_with_the_input(spark, sf_dir, monkeypatch, module, constant, name):
    """Rows are dealt to a number of tasks that follows theirs, by keys that the query groups by."""
    monkeypatch.setattr(module, constant, 10)
    parts = re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", planned(registry.queries()[name](spark, sf_dir)))
    assert parts and int(parts[0]) >= 20


def test_batches_of_entities_that_repeat(spark):
    """Of an entity told twice the later list counts, at the earlier place; a document without entities has no batch."""
    kind = "doc_id long, entity string, seq long, ids array<int>, chars array<int>"
    rows = [(1, "a", 1, [1, 2], [10, 20]), (1, "b", 2, [2], [20]), (1, "a", 3, [7], [5]), (2, "c", 1, [1], [3])]
    got = retrieve.evidence_batches(spark.createDataFrame(rows, kind), 3, 0.4, 100)
    assert "MapInArrow" in planned(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "a", 5), (1, 1, 0, "b", 20), (2, 0, 0, "c", 3)]


def test_components_send_no_labels_to_the_driver(spark, monkeypatch):
    """Labels grow with the nodes, so no round broadcasts them, however small they look."""
    plans_, whole = [], graph_paths.stored
    monkeypatch.setattr(graph_paths, "stored", lambda df, name: (plans_.append(planned(df)), whole(df, name))[1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40) if k % 10] + [(5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph_paths.components(edges).collect()}
    assert got == {k: (k - 1) // 10 * 10 + 1 for k in range(1, 41)}
    assert any("SortMergeJoin" in p for p in plans_) and not any("Broadcast" in p for p in plans_)
