"""Small cases with known results."""

import json
import math
import random
import re
import shutil
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import align, audit, audit_regions, chunks, evaluate, graph, graph_paths, norms, ordering, retrieve, runs, triplets, vector_index
from corpusloom.plans import evidence_plans
from corpusloom.sources import files, vector_table
from corpusloom.streaming import ingest, progress


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first()["r"]


def test_cleaning_counts_and_removals(spark):
    text = "# 标题\n![图](a.png)\n14）现场清理\n编号 123456789012345678 完\n目录 ..... 12\n孔径10cm http://x.y/z 结束  \n\n"
    r = one(spark, text, tx.clean_document)
    assert r["clean_text"] == "# 标题\n现场清理\n编号 [REDACTED] 完\n孔径10cm  结束"
    assert (r["image_count"], r["sequence_count"], r["identifier_count"]) == (1, 1, 1)
    assert [(x["line"], x["reason"]) for x in r["removed"]] == [(3, "sequence_prefix"), (4, "identifier"), (5, "directory_leader")]
    assert one(spark, None, tx.clean_document)["clean_text"] is None


@pytest.mark.parametrize(("name", "valid"), [("12", False), ("10cm", False), ("2025年12月", False), ("脚手架", True), (" ", False), (None, False), ("https://a.b", False), ("A123456789012345", False), ("12 3a", True)])
def test_candidates(spark, name, valid):
    assert one(spark, name, tx.is_valid_candidate) is valid


def test_keys_citations_dates_and_steps(spark):
    assert one(spark, "  Ａb　 C ", tx.entity_name) == "ab c"
    assert one(spark, "Straße　Ａ", tx.lookup_key) == "strassea"
    assert one(spark, "Ａ，b-（c）", tx.match_key) == "abc"
    assert one(spark, "《石油规范》 GB 50183-2015；《石油规范》 GB 50183-2015《a》", tx.citations) == ["《石油规范》 GB 50183-2015"]
    assert [str(d) for d in one(spark, "2024年2月30日 2024-3-1 2023/12/31", tx.dates)] == ["2024-03-01", "2023-12-31"]
    assert one(spark, "施工顺序：准备→ / ->开挖⇒", tx.steps) == ["准备", "/", "开挖"]  # the fixed rules know no placeholders
    assert one(spark, "施工步骤：a  b—>cn-12 x ＞目录编号1⇒作业步骤： -> " + "y" * 120 + "->" + "z" * 121, tx.steps) == ["a b", "y" * 120]
    assert one(spark, "【A】—B·c_d/e.f", tx.match_key) == "abc_d/e.f"
    assert one(spark, "x" * 32_767, lambda c: F.length(tx.short_cell(c))) == 32_767 and one(spark, "x" * 40_000, tx.short_cell).endswith("x" + tx.CUT_NOTICE) and len(one(spark, "x" * 40_000, tx.short_cell)) == 32_767
    assert one(spark, "k=abc Bearer x.y-z end", lambda c: tx.redact(c, ["abc"])) == "k=[REDACTED] Bearer [REDACTED] end"
    assert [one(spark, n, tx.stem) for n in ("a.b.txt", ".x", "d/e")] == ["a.b", ".x", "d/e"]
    assert one(spark, "井《x》", lambda c: tx.source_type("auto", F.concat(c, F.lit("标准")))) == "spec"
    with pytest.raises(ValueError, match="unknown"):
        tx.source_type("other", F.lit(""))


def test_hashes_are_compact_json(spark):
    import hashlib

    r = spark.createDataFrame([("é", None, 3)], "a string, b string, c int").select(tx.stable_hash("a", "b", "c").alias("h")).select("h", tx.hash_number(F.col("h")).alias("n")).first()
    assert r["h"] == hashlib.sha256('{"a":"é","b":null,"c":3}'.encode()).hexdigest() and r["n"] == int(r["h"][:15], 16)


def test_sentences_keep_offsets(spark):
    text = "　第一句话很长。短。 second sentence；\nabcdef"
    got = one(spark, text, chunks.sentence_array)
    assert [x["content"] for x in got] == ["第一句话很长", "second sentence", "abcdef"] and [x["index"] for x in got] == [0, 1, 2]
    assert all(text[x["start_offset"] : x["end_offset"]] == x["content"] for x in got)


def test_heading_chunks_pack_and_cut(spark):
    cut = lambda text, n: one(spark, text, lambda c: chunks.heading_chunks(c, n))
    assert cut("abcdef", 4) == ["abcd", "ef"] and cut("abc", 4) == ["abc"]
    assert cut("intro\n# a\nx\n# b\ny", 10) == ["intro\n# a\nx", "# b\ny"]
    long = "# h\n" + "z" * 25 + "\n# i\nq"
    assert cut(long, 10) == ["# h\nzzzzzz", "zzzzzzzzzz", "zzzzzzzzz\n# i\nq"] or "".join(cut(long, 10)).replace("\n", "") == long.replace("\n", "")


def test_merged_hits_prefer_direct_then_score(spark):
    hits = spark.createDataFrame([(1, "e", "a", 1, 0.61, "semantic"), (1, "e", "b", 10, 1.0, "direct"), (1, "e", "a", 5, 0.95, "semantic"), (1, "e", "b", 5, 0.7, "semantic")], "doc_id long, entity string, alias string, index int, score double, match_type string")
    got = retrieve.merged_hits(hits, 2).orderBy("index").collect()
    assert [(r["index"], r["score"]) for r in got] == [(5, 0.95), (10, 1.0)]


def test_local_context_windows(spark):
    s = spark.createDataFrame([(1, i, "x" * 10) for i in range(3)], "doc_id long, index int, content string")
    m = spark.createDataFrame([(1, "a", 0), (1, "b", 2)], "doc_id long, entity string, index int")
    got = retrieve.local_context(s, m, 1, 2000).collect()
    assert sorted((r["entity"], r["index"]) for r in got) == [("a", 0), ("a", 1), ("b", 1), ("b", 2)]
    assert sorted((r["entity"], r["index"]) for r in retrieve.local_context(s, m, 1, 5).collect()) == [("a", 0), ("b", 1)]


def test_batches_by_shared_evidence(spark):
    rows = [(1, "A", 1, [1, 2], [5, 5]), (1, "B", 2, [1, 2, 3], [5, 5, 5]), (1, "C", 3, [3, 4], [5, 5]), (1, "D", 4, [9], [5])]
    e = spark.createDataFrame(rows, "doc_id long, entity string, seq int, ids array<int>, chars array<int>")
    groups = lambda df: [sorted(r["m"]) for r in df.groupBy("batch").agg(F.collect_list("entity").alias("m")).orderBy("batch").collect()]
    assert groups(retrieve.evidence_batches(e, 3, 0.4, 8000)) == [["A", "B"], ["C"], ["D"]]
    assert groups(retrieve.evidence_batches(e, 3, None, 8000)) == [["A", "B", "C"], ["D"]]
    assert groups(retrieve.evidence_batches(e, 3, 0.4, 12)) == [["A"], ["B"], ["C"], ["D"]] or groups(retrieve.evidence_batches(e, 3, 0.4, 12))[0] == ["A"]


def test_responses_survive_truncation_and_ids(spark):
    text = 'answer [{"head":"a","relation":"R","tail":"b","evidence":[S12, "S3"]},{"head":"a","relation":"R","tail":"b","evidence":["S12",S3]},{"head":"c","relation":"R","tail":"d","evidence":[1]},{"head":"e","rel'
    got = one(spark, text, triplets.parsed_items)
    assert [(x["head"], x["evidence"]) for x in got] == [("a", [12, 3]), ("c", [1])]
    assert one(spark, "nothing", triplets.parsed_items) == []
    assert [tuple(x) for x in one(spark, "- a - R - b\nx - y\n", triplets.line_triplets)] == [("a", "R", "b")]
    assert [tuple(x) for x in one(spark, '[{"name":" ab ","entity_type":"T"},"cd","e"]', triplets.entity_items)] == [("ab", "T"), ("cd", "未分类")]
    assert [tuple(x) for x in one(spark, "- 脚手架，设备\n锚杆", triplets.entity_items)] == [("脚手架", "设备"), ("锚杆", "未分类")]


def test_admission_swaps_and_rejects(spark):
    rules = spark.createDataFrame([("USES", ["A"], ["B"]), ("ANY", [], [])], "relation string, head_types array<string>, tail_types array<string>")
    t = spark.createDataFrame([("x", "A", "USES", "y", "B"), ("x", "B", "USES", "y", "A"), ("x", "B", "USES", "y", "B"), ("x", "C", "ANY", "y", "D"), ("x", "A", "NO", "y", "B"), ("x", "未分类", "USES", "y", "B")], "head string, head_type string, relation string, tail string, tail_type string")
    got = triplets.admitted(t, rules).collect()
    assert sorted((r["head"], r["head_type"], r["status"]) for r in got) == sorted([("x", "A", "admitted"), ("y", "A", "swapped"), ("x", "B", "rejected"), ("x", "C", "admitted"), ("x", "A", "rejected"), ("x", "未分类", "admitted")])


def scores(spark, p, g):
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "item string")
    r = evaluate.prf(make(p), make(g), ["item"]).first()
    return r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]


def test_scores_and_their_empty_sets(spark):
    assert scores(spark, ["A", "B", "A"], ["A", "C"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert scores(spark, [], []) == (0, 0, 0, 1.0, 1.0, 1.0)
    assert scores(spark, [], ["A"]) == (0, 0, 1, 1.0, 0.0, 0.0)
    assert scores(spark, ["A"], []) == (0, 1, 0, 0.0, 1.0, 0.0)


def test_linking_states(spark):
    mentions = spark.createDataFrame([("d", "a", "T"), ("d", "b", "T"), ("d", "c", "T"), ("d", "e", "T")], "doc string, key string, type string")
    lookup = spark.createDataFrame([("d", "a", 1, "T"), ("d", "a", 2, "U"), ("d", "b", 3, "U"), ("d", "c", 4, "U"), ("d", "c", 5, "V")], "doc string, key string, canonical_id int, canonical_type string")
    got = {r["key"]: (r["status"], r["canonical_id"]) for r in evaluate.linked_entities(mentions, lookup).collect()}
    assert got == {"a": ("matched_type", 1), "b": ("type_mismatch", 3), "c": ("ambiguous", None), "e": ("unmapped", None)}


def test_document_matching_needs_unique_keys(spark):
    left = spark.createDataFrame([("a",), ("b_x",), ("c_x",), ("c",)], "left_name string")
    right = spark.createDataFrame([("a",), ("b",), ("c_y",)], "right_name string")
    got = evaluate.matched_documents(left, right, "_[xy]$").collect()
    assert sorted(tuple(r) for r in got) == [("a", "a", "exact"), ("b_x", "b", "suffix")]


def test_graph_merge_moves_qualified_names_and_is_idempotent(spark):
    t = spark.createDataFrame([("r1", 1, "临时用电", "W", "USES", "脚手架", "D", 7, True), ("r2", 2, "用电", "W", "USES", "脚手架", "D", 8, True)], "run_id string, triplet_id int, head string, head_type string, relation string, tail string, tail_type string, document_id int, is_valid boolean")
    names = graph.canonical_names(graph.known_entities(t))
    assert {r["name"]: (r["canonical"], r["method"]) for r in names.collect()}["临时用电"] == ("用电", "containment")
    edges = graph.assertions(t, names).withColumn("extracted_at", F.lit("x"))
    (edge,) = graph.aggregate_edges(edges).collect()
    assert (edge["head_name"], edge["assertion_count"], edge["document_count"]) == ("用电", 2, 2)
    assert {r["name"]: r["aliases"] for r in graph.aliases(names).collect()}["用电"] == ["临时用电"]
    old, new = edges.where("run_id = 'r1'"), edges.where("run_id = 'r2'")
    assert {r["status"] for r in graph.merge_status(old, new, "r2").collect()} == {"kept", "created"}
    once = graph.merged(old, new, "r2")
    assert {r["status"] for r in graph.merge_status(once, new, "r2").collect()} == {"kept", "updated"}
    assert sorted(map(str, graph.merged(once, new, "r2").collect())) == sorted(map(str, once.collect()))


def test_longer_prefix_rest_wins_and_suffixes_do_not_merge(spark):
    known = spark.createDataFrame([("T", "临时作业台"), ("T", "作业台"), ("T", "台"), ("T", "作业台2")], "entity_type string, name string")
    got = {r["name"]: r["canonical"] for r in graph.canonical_names(known).collect()}
    assert got == {"临时作业台": "作业台", "作业台": "台", "台": "台", "作业台2": "作业台2"}


def test_clauses_paths_and_fallback(spark):
    text = "# 规范\n## 第一章\n第二十条 范围\n内容一\n### 细则\n第二十一条\n内容二\n## 第二章\n5.1.2 数值\n表\n"
    docs = spark.createDataFrame([(1, text), (2, "# 只有标题\n\n一段文字\n\n另一段")], "doc_id long, text string")
    got = norms.clauses(docs).orderBy("doc_id", "clause_index").collect()
    assert [(r["clause_number"], r["clause_title"], r["hierarchy_path"]) for r in got if r["doc_id"] == 1] == [("第二十条", "范围", ["规范", "第一章"]), ("第二十一条", None, ["规范", "第一章", "细则"]), ("5.1.2", "数值", ["规范", "第二章"])]
    assert all(text[r["start_offset"] : r["end_offset"]].strip() == r["raw_text"] for r in got if r["doc_id"] == 1)
    assert [(r["raw_text"], r["parse_status"]) for r in got if r["doc_id"] == 2] == [("一段文字", "fallback"), ("另一段", "fallback")]


def test_heading_paths_follow_a_stack(spark):
    r = random.Random(2)
    lines = [("#" * r.randrange(1, 7) + f" h{i}") if r.random() < 0.7 else f"{i}.1 c" for i in range(120)]
    stack, want = [], {}
    for i, line in enumerate(lines):
        if line.startswith("#"):
            level = line.index(" ")
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, line[level + 1 :]))
        else:
            want[f"{i}.1"] = [t for _, t in stack]
    got = norms.clauses(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert {x["clause_number"]: x["hierarchy_path"] for x in got} == want


def test_versions_cycles_and_coverage(spark):
    v = spark.createDataFrame(
        [("a", "f", 2010, 2015, True, "effective", "h", None), ("b", "f", 2015, None, True, "effective", "h", "a"), ("c", "g", 2012, None, False, "superseded", "", "d"), ("d", "g", 2020, 2018, True, "x", "", "c"), ("e", "g", None, None, True, "effective", "h", "e")],
        "version_id string, family_id string, effective_year int, invalid_year int, metadata_confirmed boolean, status string, metadata_hash string, supersedes_version_id string",
    )
    assert sorted(r["node"] for r in norms.supersede_cycles(v).collect()) == ["c", "d", "e"]
    got = norms.version_violations(v).collect()
    assert sorted((r["version_id"], r["violation"]) for r in got) == [("c", "invalid_year_missing"), ("d", "confirmed_without_hash"), ("d", "effective_after_invalid"), ("d", "unknown_status")]
    years = spark.createDataFrame([(2015,), (2016,)], "year int")
    assert sorted((r["year"], r["version_id"], r["conflict"]) for r in norms.applicable_versions(v, years).collect()) == [(2015, "a", True), (2015, "b", True), (2016, "b", False)]
    asked = spark.createDataFrame([("f",), ("g",), ("h",), ("i",)], "family_id string")
    cands = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "c"), ("h", "z")], "family_id string, version_id string")
    states = norms.coverage(asked, cands, spark.createDataFrame([("a",), ("z",)], "version_id string"))
    assert {r["family_id"]: r["coverage_status"] for r in states.collect()} == {"f": "partial", "g": "cited_but_unindexed", "h": "covered", "i": "uncovered"}


def test_segments_overlap_and_short_clauses_stay(spark):
    rows = spark.createDataFrame([(1, "p", "one two three"), (2, "p", " ".join(f"w{i}" for i in range(40)))], "clause_id long, prefix string, raw_text string")
    got = norms.costed_segments(rows, lambda t: len(t.split()), 21, 2).orderBy("clause_id", "segment_index").collect()
    assert got[0]["segment"] == "p\none two three" and got[1]["segment"] == "p\n" + " ".join(f"w{i}" for i in range(10)) and got[2]["segment"].startswith("p\nw8 ")
    assert [r["segment"].split()[-1] for r in got][-1] == "w39"
    same = norms.segments(rows, 21, 2).orderBy("clause_id", "segment_index").collect()
    assert [r["segment"] for r in same] == [r["segment"] for r in got]


def test_search_keeps_best_segment_and_widens(spark):
    hits = spark.createDataFrame([(1, 7, 0, 0.9), (1, 7, 1, 0.7), (1, 8, 0, 0.8)], "query_id long, clause_id long, segment_index int, score double")
    got = norms.clause_hits(hits, 5).orderBy("rank").collect()
    assert [(r["clause_id"], r["segment_index"], r["score"]) for r in got] == [(7, 0, 0.9), (8, 0, 0.8)]
    r = random.Random(4)
    for k in (1, 20, 60):
        clauses = [r.randrange(30) if i < 150 else r.randrange(200) for i in range(r.randrange(10, 400))]
        df = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(clauses)], "query_id long, clause_id long, rank int")
        window, want = max(3 * k, 30), None
        while window <= 300 and want is None:
            if len(set(clauses[:window])) >= k or len(clauses) < window or window == 300:
                want = window
            window = min(2 * window, 300)
        assert norms.search_windows(df, k).first()["search_window"] == want


def test_alignment_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abcd") for _ in range(r.randrange(3, 9))) for _ in range(60)]
    e = spark.createDataFrame([(i, i, 1, n, "T" if i % 2 else "U") for i, n in enumerate(names)], "entity_id long, seq long, doc_id long, name string, type string")
    got = {(x["a"], x["b"]) for x in align.candidate_pairs(e, ["doc_id"]).collect()}
    want = {(i, j) for j in range(60) for i in range(j) if i % 2 == j % 2 and (names[i] in names[j] or names[j] in names[i] or SequenceMatcher(None, names[i], names[j]).ratio() >= 0.72)}
    assert got == want


def test_alignment_by_rule_leaves_generic_names(spark):
    rows = [(1, 1, 1, "hydraulic pump", "T", "case"), (2, 2, 1, "hydraulic pumps", "T", "case"), (3, 3, 1, "设备", "T", "case"), (4, 4, 1, "设备 ", "T", "case"), (5, 5, 1, "other", "T", "case")]
    e = spark.createDataFrame(rows, "entity_id long, seq long, doc_id long, name string, type string, source_type string").withColumn("score", align.name_score(F.col("name"), F.col("source_type")))
    parts = align.groups(align.candidate_pairs(e, ["doc_id"]), e)
    decisions = align.decided(parts)
    assert {(r["name"], r["standard"]) for r in decisions.collect()} == {("hydraulic pump", "hydraulic pumps"), ("hydraulic pumps", "hydraulic pumps")}
    out = {r["name"]: r["aliases"] for r in align.aligned(e, decisions).collect()}
    assert out["hydraulic pumps"] == ["hydraulic pump"] and out["other"] == [] and len(out) == 4


def test_components_and_numbers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph_paths.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    n = ordering.numbered(spark.createDataFrame([(c,) for c in "qwertyuiop"], "k string"), ["k"]).collect()
    assert [r["k"] for r in sorted(n, key=lambda r: r["number"])] == sorted("qwertyuiop") and sorted(r["number"] for r in n) == list(range(1, 11))


def test_run_events_fold(spark):
    rows = [
        ("r", 1, "started", "read", None, None, 3, {"a": 1}), ("r", 2, "document_completed", "extract", "d1", 1, None, {"a": 2, "b": 1}), ("r", 3, "document_failed", "read", "d2", 2, 3, {}), ("r", 4, "completed_with_errors", "done", None, None, None, {"b": 4}), ("s", 1, "progress", "read", None, None, None, {}),
    ]
    e = spark.createDataFrame(rows, "run_id string, seq int, event_type string, stage string, document_name string, completed int, total int, metrics map<string,long>").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r["run_id"]: r for r in runs.event_state(e).collect()}
    assert (got["r"]["stage"], got["r"]["status"], got["r"]["document_name"], got["r"]["document_completed"], got["r"]["document_total"]) == ("done", "completed_with_errors", "d2", 2, 3)
    assert got["r"]["seen_stages"] == ["read", "extract", "done"] and got["r"]["metrics"] == {"a": 3, "b": 5} and got["s"]["status"] == "idle"


def test_deletion_outcomes(spark):
    asked = spark.createDataFrame([(i,) for i in range(5)], "run_id int")
    r = spark.createDataFrame([(0, None), (1, "pending"), (2, "deleted"), (3, "active")], "run_id int, deletion_state string")
    got = runs.deletion_outcomes(asked, r, spark.createDataFrame([(3,)], "run_id int"))
    assert {x["run_id"]: x["outcome"] for x in got.collect()} == {0: "deleted", 1: "pending", 2: "not_active", 3: "referenced", 4: "missing"}


def test_audit_tables_and_values(spark):
    t = spark.createDataFrame(
        [(1, ["序号", "设备名称", "数量"], [["1", "泵", "2人"], ["2", "/", ""], ["注：", "说明", ""], ["", "", ""]])], "table_id long, header array<string>, rows array<array<string>>"
    )
    r = audit.missing_values(t, ["名称", "数量"], ["名称", "序号"]).first()
    assert (r["n_rows"], r["missing_名称"], r["missing_数量"]) == (2, 1, 1)
    assert audit.missing_columns(t, ["名称", "规格"]).first()["missing"] == ["规格"]
    assert [one(spark, v, audit.is_positive_headcount) for v in ("2", "2 名", "0", "二人", None)] == [True, True, False, False, False]
    blocks = spark.createDataFrame(
        [
            ("d", 0, "heading", "2.2 Location", ["2.2 Location"], None), ("d", 1, "paragraph", "Plat A", [], None), ("d", 2, "paragraph", "Location: Plat B平台;x", [], None),
            ("d", 3, "paragraph", "C井场", ["2.2 Location"], None), ("d", 4, "table", "", [], [["the Location", "D", "E"]]),
        ],
        "document_id string, ordinal int, block_type string, text string, section array<string>, rows array<array<string>>",
    )
    values = audit.labelled_values(blocks, spark.createDataFrame([("Location", "location")], "label string, kind string"))
    assert sorted((x["value"], x["ordinal"]) for x in values.collect()) == [("C", 3), ("D", 4), ("PlatA", 1), ("PlatB", 2)]
    assert audit.conflicts(values, ["document_id", "label"]).count() == 4
    plan = spark.createDataFrame([(1, "工具（锄头、铲子等）", 1), (1, "套件(泵、阀)", 1), (1, "吊车", 2), (1, "缺", 1)], "o int, name string, quantity int")
    present = spark.createDataFrame([(1, "锄头", 1), (1, "小铲子", 1), (1, "水泵x", 3), (1, "吊 车", 3)], "o int, name string, quantity int")
    got = {r["name"]: r["status"] for r in audit.coverage(plan, present, ["o"]).collect()}
    assert got == {"工具（锄头、铲子等）": "covered", "套件(泵、阀)": "missing", "吊车": "quantity_mismatch", "缺": "missing"}


def test_located_groups_can_be_ambiguous(spark):
    b = spark.createDataFrame(
        [("d", 0, "toc_entry", None, "pump"), ("d", 1, "heading", 1, "pump A"), ("d", 2, "paragraph", None, "about a pump"), ("d", 3, "heading", 1, "pump B"), ("e", 0, "paragraph", None, "a pump here"), ("f", 0, "paragraph", None, "工序 pump"), ("f", 1, "paragraph", None, "77")], "document_id string, ordinal int, block_type string, level int, text string"
    )
    tasks = spark.createDataFrame([("T", ["pump"], []), ("U", ["crane", "工序"], []), ("V", ["about"], ["pump b"])], "task_id string, locators array<string>, regions array<string>")
    got = {(r["document_id"], r["task_id"]): (r["anchor"], r["status"]) for r in audit.located(audit.sections(b), tasks).collect()}
    assert got == {("d", "T"): (1, "ambiguous"), ("e", "T"): (0, "located"), ("f", "T"): (0, "located"), ("d", "U"): (1, "ambiguous"), **{(d, "U"): (None, "not_located") for d in "ef"}, ("d", "V"): (3, "located"), ("e", "V"): (None, "not_located"), ("f", "V"): (None, "not_located")}


def test_files_gold_and_ontology(spark, tmp_path):
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "A.txt").write_text("one\nline")
    (tmp_path / "c.pdf").write_text("no")
    assert [r["name"] for r in files.document_files(spark, str(tmp_path)).collect()] == ["A.txt", "b.md"]
    done = spark.createDataFrame([("b.md",)], "name string")
    assert [tuple(r) for r in files.documents(spark, str(tmp_path), processed=done).collect()] == [("A.txt", "one\nline")]
    gold = tmp_path / "gold" / "sub"
    gold.mkdir(parents=True)
    (gold / "x.json").write_text(json.dumps({"document": {"document_id": "d"}, "triplets": [{"head": "a", "relation": "R", "tail": "b"}]}))
    (gold / "y.json").write_text(json.dumps([{"head_name": "c", "relation": "R", "tail": "d"}]))
    (gold / "z.json").write_text("{broken")
    rows, broken = files.gold_annotations(spark, str(tmp_path / "gold"))
    assert rows.count() == 2 and broken.count() == 1
    assert sorted(r["head"] for r in evaluate.normal_triplets(rows.select(F.explode("triplets").alias("t")).select("t.*")).collect()) == ["a", "c"]
    first = files.gold_hash(spark, str(tmp_path / "gold")).first()
    assert first["n_files"] == 3 and first == files.gold_hash(spark, (tmp_path / "gold").as_uri()).first()
    shutil.copytree(tmp_path / "gold", tmp_path / "other")
    assert first == files.gold_hash(spark, str(tmp_path / "other")).first()  # where the folder lies is no part of it
    moved = next((tmp_path / "other").rglob("*.json"))
    (moved.parent / "below").mkdir()
    moved.rename(moved.parent / "below" / moved.name)
    assert first["gold_hash"] != files.gold_hash(spark, str(tmp_path / "other")).first()["gold_hash"]
    (tmp_path / "o.json").write_text(json.dumps({"entity_types": ["A", {"name": "B"}], "relation_types": ["R", {"name": "S", "head_types": ["A"], "tail_types": ["B"]}]}))
    types, rules = files.ontology(spark, str(tmp_path / "o.json"))
    assert [r["type"] for r in types.collect()] == ["A", "B"] and [tuple(r) for r in rules.collect()] == [("R", [], []), ("S", ["A"], ["B"])]


def test_export_cells(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, cast(null AS string) AS b, timestamp '2024-01-02 03:04:05' AS c, array(1, 2) AS d")
    assert tuple(runs.exported(df).first()) == ("1", "", "2024-01-02 03:04:05", "[1,2]")
    runs.write_package(str(tmp_path / "package"), t=df)
    assert spark.read.option("header", True).csv(str(tmp_path / "package" / "t")).first()["d"] == "[1,2]"


def test_progress_stream_equals_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("run_id", F.col("user_id") % 5)
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = progress.run_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    plain = lambda df: sorted((r["run_id"], r["last_type"], r["n_events"], r["n_errors"], round(r["total"], 6)) for r in df.collect())
    assert plain(spark.table("progress_test")) == plain(progress.run_progress(events))


def test_run_streams_equal_the_batch_over_late_and_null_events(spark, tmp_path):
    schema = "run_id string, ts timestamp, seq long, event_type string, stage string, document_name string, completed long, total long, metrics map<string,long>"
    types = ["started", "progress", "document_completed", "document_failed", "completed", None]
    at = lambda i: None if i % 29 == 0 else datetime(2024, 1, 1) + timedelta(microseconds=(i * 7919) % 500)
    rows = [("hot" if i % 3 else [None, "b", "c"][i % 7 % 3], at(i), i, types[i % 6], [None, "read", "write"][i % 4 % 3], f"d{i % 5}" if i % 2 else None, i % 9 if i % 5 else None, 9, {"a": i, "b": 1} if i % 4 else None) for i in range(600)]
    events = spark.createDataFrame(rows, schema)
    spark.createDataFrame(rows[300:], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    for updates, store in ((progress.run_facts, "facts"), (lambda e: progress.last_events(e, 40, 3), "last")):
        progress.follow(updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))), str(tmp_path / store))
    spark.createDataFrame(rows[:300], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))  # mostly late ones
    for updates, store in ((progress.run_facts, "facts"), (lambda e: progress.last_events(e, 40, 3), "last")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        progress.follow(updates(stream), str(tmp_path / store))
        progress.follow(updates(stream), str(tmp_path / store))  # nothing has arrived
    columns = ["run_id", "stage", "document_name", "document_completed", "document_total", "status", "n_events", "seen_stages"]
    plain = lambda df: sorted((*[str(r[c]) for c in columns], str({k: int(v) for k, v in sorted((r["metrics"] or {}).items())})) for r in df.collect())
    assert plain(progress.run_states(progress.followed(spark, str(tmp_path / "facts"), ["run_id", "kind", "name"]))) == plain(runs.event_state(events))
    parts = progress.followed(spark, str(tmp_path / "last"), ["run_id", "part"])
    assert parts.where(F.size("events") > 40).count() == 0 and parts.where("run_id = 'hot'").count() == 3
    got, want = (sorted(map(str, df.select(events.columns + ["place"]).collect())) for df in (progress.newest_events(parts, events.schema, 40), runs.last_events(events, 40)))
    assert got == want and len(got) > 100


def test_documents_arrive_once(spark, tmp_path):
    folder, out = tmp_path / "docs", tmp_path / "out"
    folder.mkdir()

    def step():
        q = progress.arriving_sentences(spark, str(folder), ".\n").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(out)).count()

    (folder / "a.txt").write_text("first sentence. second sentence.")
    assert step() == 2
    (folder / "b.md").write_text("1) third sentence")
    assert step() == 3 and step() == 3


def test_nearest_in_blocks_is_the_nearest_of_all(spark):
    """Many equal vectors, zero ones, nulls, other widths and repeated ids, in blocks of three rows and in one."""
    r = random.Random(4)
    made = [(i, [r.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(3)]) for i in range(60)] + [(60 + i, [0.3, 0.1, 0.2]) for i in range(30)]
    made += [(90, [0.0, 0.0, 0.0]), (91, None), (None, [1.0, 1.0, 1.0]), (92, [1.0, None, 0.0]), (93, [1.0, 2.0]), (94, [2.0, 4.0]), (3, [0.9, 0.1, 0.0])]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 3 = 0").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    asked = [tuple(x) for x in queries.collect()]
    good = [(i, v) for i, v in made if i is not None and v is not None and None not in v]

    def cosine(a, b):
        norms = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0

    want = []
    for q, v in asked:
        if v is not None and None not in v:
            scored = sorted((-cosine(x, v), i) for i, x in good if i != q and len(x) == len(v))
            want += [(q, i, -s, n) for n, (s, i) in enumerate(scored[:4], 1)]
    asked_rows = spark.createDataFrame(asked, queries.schema)
    for block in (3, 2048):
        got = retrieve.nearest(asked_rows, vectors, 4, block=block).select("query_id", "vec_id", "score", "rank").collect()
        assert sorted((q, i, n) for q, i, _, n in got) == sorted((q, i, n) for q, i, _, n in want)
        assert {(q, n): s for q, _, s, n in got} == pytest.approx({(q, n): s for q, _, s, n in want})
    assert retrieve.nearest(asked_rows, vectors.limit(0), 4).count() == 0 == retrieve.nearest(asked_rows.limit(0), vectors, 4).count()


@pytest.mark.parametrize("edit", [0.6, 0.72, 0.9, 0.95])
def test_similar_pairs_are_those_of_all_pairs(spark, edit):
    """Names of one to thirty letters, edited, contained, with one letter: no index loses a pair."""
    r = np.random.default_rng(int(edit * 100))
    names = ["".join(r.choice(list("abcdefgh中文字"), r.integers(1, 12))) for _ in range(25)] + ["".join(r.choice(list("abcdefghijkl"), r.integers(12, 30))) for _ in range(25)]
    for name in list(names):
        edited = list(name)
        for _ in range(r.integers(1, 4)):
            edited[r.integers(len(edited))] = str(r.choice(list("abxyz")))
        names += ["".join(edited), name[: r.integers(1, len(name) + 1)] + "(" + str(r.choice(list("ab"))) + ")"]
    names += ["a", "中", "()", "", "aaaaaaaaaaaa", "aaaaaaa"]
    rows = [(i, i, i % 2, n, "t" if i % 3 else "u", [float(x) for x in r.standard_normal(3)] if i % 5 else None) for i, n in enumerate(names)]
    e = spark.createDataFrame(rows, "entity_id long, seq long, doc_id long, name string, type string, vector array<double>")
    key = lambda n: re.sub(r"[\s\-_（）()\[\]【】《》“”\"']", "", n.lower())
    cosine = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)) if v and w else 0.0
    for similar in (None, 0.82):
        want = set()
        for x in rows:
            for y in rows:
                a, b = key(x[3]), key(y[3])
                if x[1] < y[1] and (x[2], x[4]) == (y[2], y[4]) and a and b:
                    near = similar is not None and set(a) & set(b) and cosine(x[5], y[5]) >= similar
                    if a in b or b in a or near or SequenceMatcher(None, a, b).ratio() >= edit:
                        want.add((x[0], y[0]))
        got = [(p["a"], p["b"]) for p in align.candidate_pairs(e, ["doc_id"], edit, similar).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_terms_meet_texts_by_their_first_letters_as_by_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["abcabc", "xaby", "", "b", "zz"])], "id long, key string")
    terms = spark.createDataFrame([("ab",), ("abc",), ("b",), ("zzz",), ("y",)], "term string")
    few = {tuple(r) for r in audit_regions.holding(texts, "key", terms, "term").collect()}
    monkeypatch.setattr(audit_regions, "MOST_ROWS", 2)
    many = audit_regions.holding(texts, "key", terms, "term").select("id", "key", "term").collect()
    assert few == set(map(tuple, many)) and len(many) == len(few) == 7


def test_intervals_are_merged_by_a_sweep(spark):
    rows = [(1, "a", 1, 3), (1, "a", 2, 5), (1, "a", 6, 6), (1, "a", 9, 12), (1, "a", 10, 11), (1, "b", 2, 2), (2, "a", 4, 4)]
    got = audit_regions.merged(spark.createDataFrame(rows, "document_id long, task_id string, low int, high int"), ["document_id", "task_id"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1, 6), (1, "a", 9, 12), (1, "b", 2, 2), (2, "a", 4, 4)]


def test_roles_end_at_the_limits_of_a_group(spark):
    texts = [("1.1 设备", None)] + [("字" * 2500, None)] * 3 + [("1.2 其他", None)] + [("机具", [["机具", "x"]])] + [("一", None)] * 60
    blocks = spark.createDataFrame([(1, i, "Normal", t, r, False) for i, (t, r) in enumerate(texts)], "document_id long, ordinal int, style string, text string, rows array<array<string>>, has_image boolean")
    rules = spark.createDataFrame([("T", "role", "a", "设备"), ("T", "role", "b", "机具"), ("T", "role", "c", "没有")], "task_id string, profile string, role string, term string")
    got = audit_regions.located_regions(audit_regions.levelled(blocks), rules).first()
    assert (got["status"], got["anchor"], got["last"], got["n_blocks"], got["missing_roles"]) == ("located", 0, 54, 53, "c")


def test_index_finds_what_all_vectors_find(spark):
    """Exact search with repeated, zero, odd and missing vectors, filters, and more hits wanted than there are; probing finds nine of ten."""
    r = np.random.default_rng(6)
    v = [(i, r.standard_normal(8).tolist()) for i in range(600)] + [(600, [0.0] * 8), (601, None), (602, [1.0, 2.0]), (None, [1.0] * 8), (603, [float("nan")] * 8)]
    v += [(700 + i, v[i][1]) for i in range(30)]
    vectors = spark.createDataFrame([(i, x, i is not None and i % 2 == 0) for i, x in v], "vec_id long, embedding array<double>, even boolean").repartition(5)
    queries = spark.createDataFrame([(i, x) for i, x in v if i is not None and i % 7 == 0] + [(9000, [0.0] * 8), (9001, None), (9002, [1.0])], "query_id long, query_vector array<double>")
    index = vector_index.built(vectors)
    plain = lambda df: sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in df.collect())
    for k, allowed in ((5, None), (5, vectors.where("even").select("vec_id")), (1000, None)):
        want = retrieve.nearest(queries, vectors, k, allowed)
        assert plain(vector_index.search(index, queries, k, allowed)) == plain(want.where("query_id <> 9002"))
    true = {x[:3:2] for x in plain(retrieve.nearest(queries, vectors, 5))}
    probed = {x[:3:2] for x in plain(vector_index.search(index, queries, 5, exact=False))}
    assert len(true & probed) >= 0.9 * len({x for x in true if x[0] != 9000})
    assert vector_index.built(vectors.limit(0)) is None


def test_direct_triplets_keep_the_first_of_each(spark):
    rows = [(1, 0, 1, " a ", "T", "r", "b", "T"), (1, 0, 0, "a", "T", "r", "b", "T"), (1, 1, 0, "a", "T", "r", "b", "T"), (1, 1, 1, "a", "U", "r", "b", "T"), (1, 1, 2, "", "T", "r", "b", "T"), (1, 1, 3, "a", "T", "", "b", "T"), (1, 1, 4, "12", "T", "r", "b", "T"), (2, 5, 0, "a", "T", "r", "b", None)]
    got = triplets.direct(spark.createDataFrame(rows, "doc_id long, chunk int, seq int, head string, head_type string, relation string, tail string, tail_type string"), ["doc_id"]).collect()
    assert sorted((x["doc_id"], x["head_type"], x["chunk"], x["seq"]) for x in got) == [(1, "T", 0, 0), (1, "U", 1, 1), (2, "T", 5, 0)]


def brute_batches(found, most, least, limit, once):
    """Batches by the rule's words: the first entity left, then all that overlap with every member, within the limits."""
    chars = lambda b: sum(n for s, n in ({s: n for k in b for s, n in found[k].items()}.items() if once else [x for k in b for x in found[k].items()]))
    share = lambda a, b: len(found[a].keys() & found[b].keys()) / min(len(found[a]), len(found[b])) if found[a] and found[b] else 0.0
    left, out = list(range(len(found))), []
    while left:
        batch = [left.pop(0)]
        for k in list(left):
            if least is None and (len(batch) >= most or chars([*batch, k]) > limit):
                break
            if len(batch) < most and chars([*batch, k]) <= limit and (least is None or all(share(k, m) >= least for m in batch)):
                batch.append(k)
                left.remove(k)
        out.append(batch)
    return out


def test_batches_are_those_of_the_rule():
    r = random.Random(3)
    for _ in range(300):
        sizes = [r.randrange(1, 30) for _ in range(8)]
        found = [{s: sizes[s] for s in r.sample(range(8), r.randrange(0, 5))} for _ in range(r.randrange(0, 9))]
        for once in (True, False):
            for least in (0.0, 0.4, 1.0):
                assert list(retrieve._shared_batches(found, 3, least, 60, once)) == brute_batches(found, 3, least, 60, once)
            assert list(retrieve._row_batches(found, 3, 60, once)) == brute_batches(found, 3, None, 60, once)


def test_methods_of_equal_switches_agree_and_others_differ(spark, sf_dir):
    got = evidence_plans.trp_methods(spark, sf_dir).toPandas()
    rows = {m: g.drop(columns="method_id").sort_values("doc_id").values.tolist() for m, g in got.groupby("method_id")}
    assert len(rows) == 12 and rows["D0"] == rows["R6"] and rows["D6"] == rows["R5"]
    assert all(rows["D0"] != rows[m] for m in ("R2", "R5", "D1", "D2", "D3"))
    asked = evidence_plans.trp_method_batches(spark, sf_dir).toPandas()
    parts = {m: g.drop(columns="method_id").sort_values(["doc_id", "batch", "place"]).values.tolist() for m, g in asked.groupby("method_id")}
    assert set(parts) == set(rows) - {"R2"} and parts["D0"] == parts["R6"] == parts["R5"]
    assert all(parts["D0"] != parts[m] for m in ("R3", "R4", "D1", "D2", "D3", "D4", "D5")) and max(p[2] for p in parts["R3"]) == 0


def test_vector_table_replaces_adds_and_deletes(spark, tmp_path):
    at = str(tmp_path / "vectors")
    schema = "chunk_id string, run_id string, embedding array<double>"
    vector_table.delete_run(at, spark, "r")
    vector_table.upsert(at, spark.createDataFrame([(f"c{i}", "r" if i < 30 else "s", [float(i)]) for i in range(40)] + [(None, "r", [0.0])], schema), buckets=4)
    vector_table.upsert(at, spark.createDataFrame([("c1", "s", [100.0]), ("c1", "s", [99.0]), ("new", None, [7.0])], schema), buckets=4)
    got = {r["chunk_id"]: (r["run_id"], r["embedding"]) for r in vector_table.read(spark, at).collect()}
    assert len(got) == 41 and got["c1"] == ("s", [100.0]) and got["c39"] == ("s", [39.0])
    vector_table.delete_run(at, spark, "r")
    assert {r["chunk_id"] for r in vector_table.read(spark, at).collect()} == {"c1", "new", *[f"c{i}" for i in range(30, 40)]}
    vector_table.delete_run(at, spark, "s")
    assert [r["chunk_id"] for r in vector_table.read(spark, at).collect()] == ["new"]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    """The last batch's commit is lost, as if the driver had ended between its record and its commit."""
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "a.md").write_text("First sentence here. Second one here.\n")
    assert ingest.processed(spark, str(store)).count() == 0
    rows = lambda s, f: progress.arriving_sentences(s, f, ".\n")
    ingest.ingest(spark, str(folder), str(store), rows)
    (folder / "b.txt").write_text("Third sentence here.\n")
    (folder / "c.pdf").write_text("Never read, this one.\n")
    ingest.ingest(spark, str(folder), str(store), rows)
    commits = sorted((store / "checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    for _ in range(2):
        ingest.ingest(spark, str(folder), str(store), rows)
        assert sorted(r["content"] for r in ingest.ingested(spark, str(store)).collect()) == ["First sentence here", "Second one here", "Third sentence here"]
        assert {r["name"] for r in ingest.processed(spark, str(store)).collect()} == {"a.md", "b.txt"}
    left = files.documents(spark, str(folder), processed=ingest.processed(spark, str(store)))
    assert left.count() == 0
