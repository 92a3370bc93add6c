"""Decontamination, Jaccard join, archives and quotations."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, quotation, warc
from corpusloom.llm.components import components


def test_decontamination_blocks_short_items_and_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "a b c d e f g h i j k l"), (2, "x y"), (3, None), (4, "..."), (5, "A B C D E F G H I J zz"), (None, "n1 n2 n3 n4 n5 n6")], "item_id long, text string"
    )
    docs = spark.createDataFrame(
        [
            (1, "z A,b c d e f g h i j. q", "k"), (2, "x  y x y", "k"), (2, "x  y x y", "k"), (3, None, "k"), (4, "", None), (5, "b c d e f g h i j k l a b c", "k"),
            (6, "n1 n2 n3 n4 n5 n6 n7", "k"), (None, "w " * 50_000 + "x y", "k"), (8, "a b c d e f g h i", "k"),
        ],
        "doc_id long, text string, Contaminated string",
    )
    whole = decontamination.contaminated(docs, items)
    assert [c.lower() for c in whole.columns].count("contaminated") == 1
    rows = {r["doc_id"]: r for r in whole.collect()}
    hit = {k: (r["n_words"], r["n_hit"], r["item_ids"]) for k, r in rows.items()}
    assert hit[1] == (12, 10, ["1", "5"]) and hit[2] == (4, 4, ["2"]) and hit[3] == (0, 0, []) and hit[4] == (0, 0, [])
    assert hit[5] == (14, 11, ["1"]) and hit[6] == (7, 6, ["null"]) and hit[None] == (50_002, 2, ["2"]) and hit[8][1] == 0
    assert rows[1]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest() and not rows[8]["contaminated"]
    blocks = decontamination.contaminated(docs, items, block_bytes=40)
    assert sorted(map(str, blocks.drop("_x").collect())) == sorted(map(str, whole.collect()))
    assert decontamination.op5_decontamination(docs.limit(0), items).count() == 0
    assert decontamination.op5_decontamination(docs, items.limit(0)).where("contaminated").count() == 0


def brute_links(docs):
    sets = {}
    for _, t in docs:
        words = (t or "").lower().split()
        sets[t or ""] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    texts = list(sets)
    links = {t: set() for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    return links


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(30, 200))]
        for _ in range(r.choice([1, 2, 40])):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = f"v{r.randrange(9)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one two"), (None, "solo " * 9), (5, docs[5][1]), (906, "long " + " ".join(f"u{i}" for i in range(30_000)))]
    got = jaccard_join.linked(spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, N_LINKS string")).collect()
    assert len(got) == len(docs)
    links = brute_links(docs)
    ids = {}
    for i, t in docs:
        ids.setdefault(t or "", []).append(i)
    low = lambda xs: min((x for x in xs if x is not None), default=None)
    for row in got:
        text = row["text"] or ""
        seen, todo = {text}, [text]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert row["n_links"] == len(links[text]) and row["n_copies"] == len(ids[text]) and row["copy_id"] == low(ids[text])
        assert row["class_id"] == low([i for t in seen for i in ids[t]])
        assert row["n_linked_docs"] == sum(len(ids[t]) for t in links[text])


def test_a_cluster_of_five_thousand_is_dealt_in_block_pairs(spark):
    """Near copies, all linked with all, and one text of which a third of the rows are copies."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base, f"z{i}"]) for i in range(5000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, "one hot text of some words " * 3) for i in range(3000)] + [(9000, "alone " * 7)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.linked(docs).drop("text").collect()
    assert len(got) == 8001
    near = [x for x in got if x["doc_id"] < 5000]
    assert {(x["n_links"], x["n_linked_docs"], x["class_id"], x["n_copies"]) for x in near} == {(4999, 4999, 0, 1)}
    assert {(x["class_id"], x["copy_id"], x["n_copies"], x["n_links"]) for x in got if 5000 <= x["doc_id"] < 9000} == {(5000, 5000, 3000, 0)}
    members = docs.where("doc_id < 5000").select(F.unhex(F.md5("text")).alias("node"), F.lit(1).alias("cluster"))
    dealt = jaccard_join._dealt(members, "cluster", F.lit(-(-5000 // jaccard_join.BLOCK)))
    assert dealt.count() == 5000 * 10 and dealt.groupBy("x", "y").count().agg(F.max("count")).first()[0] <= 2.3 * jaccard_join.BLOCK


def test_blocks_and_batches_of_long_texts_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "SIGNED_CHARS", 5_000)
    rows = [(i, " ".join([*(f"w{j}" for j in range(1500)), f"z{i}"])) for i in range(30)] + [(99, None)]
    got = jaccard_join.op2_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["n_links"], x["class_id"]) for x in got if x["doc_id"] < 99} == {(29, 0)} and len(got) == 31


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.op2_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_matches_is_monotone_and_keeps_likely_pairs():
    least = [jaccard_join.least_matches(0.8, n, 1e-6) for n in range(30, 151, 30)]
    assert least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(30, 151, 30), strict=True))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(200)} == {1000}


def test_warc_round_trip_of_odd_pages(spark):
    pages = [(3, "http://a/", "<p>é</p>", "k"), (1, "http://b/\r\nX: y", "<p>é</p>", "k"), (2, None, None, "k"), (5, "http://c/", "", "k"), (None, "http://d/", "WARC/1.1\r\n\r\nWARC-Type: response", "k"), (9, "u", "x" * 3_000_000, "k"), (9, "u", "x" * 3_000_000, "k")]
    got = warc.op4_warc(spark.createDataFrame(pages, "page_id long, url string, html string, payload string")).collect()
    assert len(got) == 7
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    assert (1, "response", None, 9) in rows and (3, "revisit", 1, 9) in rows and (2, "response", None, 0) in rows and (5, "revisit", 2, 0) in rows
    assert (9, "response", None, 3_000_000) in rows and (9, "revisit", 9, 3_000_000) in rows and (None, "response", None, 31) in rows
    by = {(r["page_id"], r["record_type"]): r["payload_digest"] for r in got}
    assert by[3, "revisit"] == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert warc.op4_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("most", [warc.BROADCAST_ROWS, 0])
def test_warc_of_null_repeated_and_text_ids_equals_its_sql(spark, monkeypatch, most):
    import duckdb
    import pandas as pd

    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)

    pages = [(None, "a", "same"), (7, "b", "same"), (9, "c", "same"), (7, "b", "same"), (None, "d", None), (4, "e", ""), (None, "f", "only"), (None, "f", "only"), (-3, "g", "own" * 9000), (8, "h", "own" * 9000)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_matches", "n_requests"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({warc.OP4_SQL})").fetchall()
    got = warc.op4_warc(spark.createDataFrame(pages, "page_id long, url string, html string")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    texts = warc.op4_warc(spark.createDataFrame([(f"id {p}-<x>\r\n" if p is not None else None, u, h) for p, u, h in pages], "page_id string, url string, html string")).collect()
    assert len(texts) == 10
    assert {r["page_id"] for r in texts} == {None, *(f"id {p}-<x>\r\n" for p in (7, 9, 4, -3, 8))} and {r["refers_to"] for r in texts} == {None, *(f"id {p}-<x>\r\n" for p in (7, 4, -3))}


def test_warc_of_rows_in_another_order_at_each_evaluation(spark):
    """A source that deals its rows in a new order whenever it is read still has one response for each payload."""

    def anyhow(batches):
        for batch in batches:
            yield batch.sample(frac=1)

    pages = [(i % 90, f"http://x/{i % 3}", ["", "a", "b" * 20_000, "c" * 300_000][i % 4]) for i in range(400)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.op4_warc(rows.mapInPandas(anyhow, rows.schema)).collect()
    least = {}
    for p, _, h in pages:
        least[len(h)] = min(p, least.get(len(h), p))
    assert len(got) == len(pages) and all(r["digest_matches"] for r in got)
    assert sorted((r["payload_bytes"], r["page_id"]) for r in got if r["record_type"] == "response") == sorted(least.items())
    assert all(r["refers_to"] == least[r["payload_bytes"]] for r in got if r["record_type"] == "revisit")


def test_warc_files_are_cut_by_bytes_and_members_are_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    pages = [(i, "u", ("abcdefgh" * 40_000 if i % 4 == 0 else f"small {i} ") + str(i)) for i in range(40)]
    path = f"{tmp_path}/w"
    warc.write_captures(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    files = [f for f in (tmp_path / "w").rglob("*.gz")]
    assert len(files) > 10 and max(len(gzip.decompress(f.read_bytes())) for f in files) < 1 << 20
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(h for _, _, h in pages) and all(r["digest_matches"] for r in got)
    monkeypatch.setattr(warc._Reader, "PIECE", 7)
    plain = [gzip.decompress(f.read_bytes()) for f in sorted(files, key=lambda f: f.stat().st_size)[:3]]
    whole = b"".join(map(gzip.compress, plain))
    few = list(warc.parse(whole))
    monkeypatch.setattr(warc._Reader, "PIECE", 1 << 20)
    assert few == list(warc.parse(whole)) == list(warc.parse(b"".join(plain))) and len(few) >= 9


def test_revisits_of_missing_or_other_responses_do_not_match(spark):
    schema = "capture_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, digest_matches boolean"
    rows = [("r1", "response", None, 5, "A", True), ("v1", "revisit", "r1", 9, "A", None), ("v2", "revisit", "r1", 5, "B", None), ("v3", "revisit", "gone", 5, "A", None)]
    got = {r["capture_id"]: (r["payload_bytes"], r["digest_matches"]) for r in warc.resolved(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r1": (5, True), "v1": (5, True), "v2": (5, False), "v3": (5, False)}


def test_warc_links_in_both_directions(spark, tmp_path):
    lines = lambda *x: "\r\n".join(x) + "\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\n\r\nbody"
    data = lines("WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:i>", "Content-Length: 3") + "a=b\r\n\r\n"
    data += lines("WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:r>", "WARC-Concurrent-To: <urn:q>", "Content-Type: application/http", f"Content-Length: {len(http)}") + http + "\r\n\r\n"
    data += lines("WARC/1.0", "WARC-Type: request", "WARC-Record-ID: <urn:q>", "Content-Length: 2") + "GE\r\n\r\n"
    data += lines("WARC/1.0", "WARC-Type: metadata", "WARC-Record-ID: <urn:m>", "WARC-Concurrent-To: <urn:r>", "WARC-Concurrent-To: <urn:z>", "Content-Length: 0") + "\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(data.encode())
    (row,) = warc.assemble(warc.read_records(spark, tmp_path.as_uri())).collect()
    assert row["capture_id"] == "urn:r" and bytes(row["payload"]) == b"body"
    assert [x["record_id"] for x in row["requests"]] == ["urn:q"] and [x["record_id"] for x in row["metadata"]] == ["urn:m"]


def test_quotations_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Hello there, this is the first message.\nIt has two lines of some length."),
        (1, 1, "assistant", "> Hello there, this is the first message.\n> It has two lines of some length.\n\nThanks! I answer here with words."),
        (1, 2, "user", "Unrelated remark.\n\nSecond paragraph here."),
        (1, 3, "assistant", "On Monday, Bob wrote:\n> > It has two lines of some length.\n> Thanks! I answer  here with words.\nDeep reply."),
        (1, 4, "user", ">second   paragraph here.\nok\n\n"),
        (1, 5, "user", "> never said\nhm"),
        (1, 5, "user", "> never said\nhm"),
        (2, 0, "user", None),
        (None, 0, "user", "> a\nb"),
        (3, None, "user", "> Hello\nz"),
        (4, 0, "user", "ping"),
        (4, 400, "user", "> ping\n>\n" + "> filler\n" * 3000 + "pong"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotation.linked(messages).collect()}
    assert len(got) == 11
    told = {k: (r["reply_to"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"]) for k, r in got.items()}
    assert told[1, 1] == (0, 0, 1, 1, 1) and told[1, 3] == (1, 0, 2, 2, 2) and told[1, 4] == (2, 2, 1, 1, 1)
    assert told[1, 5] == (None, 5, 0, 1, 0) and told[None, 0] == (None, 0, 0, 1, 0) and told[3, None] == (None, None, 0, 1, 0) and told[4, 400][:2] == (0, 0)
    assert got[1, 3]["clean"] == "Deep reply." and got[1, 1]["clean"] == "Thanks! I answer here with words." and got[2, 0]["clean"] == "" and got[4, 400]["clean"] == "pong"
    talks = {r["conv_id"]: [m["turn"] for m in r["messages"]] for r in quotation.conversations(messages).collect()}
    assert talks[1] == [0, 1, 3, 2, 4, 5] and talks[4] == [0, 400]
    assert quotation.op8_quotation(messages.limit(0)).count() == 0


def test_long_conversations_follow_on_in_bounded_rows(spark, monkeypatch):
    """With a low bound the rows of a conversation, put together by piece, are its one row under a high bound."""
    rows = [*[(None, i % 2, "user", f"text {i:02}", "k") for i in range(40)], *[(7, None, "user", f"note {i}", "k") for i in range(4)], *[(8, i, "user", f"turn {i} " * (i % 5), None) for i in range(300)]]
    rows += [(8, 300 + i, "assistant", f"> turn {i} " + f"turn {i} " * (i % 5 - 1) + f"\nanswer {i}", "k") for i in range(1, 300, 2) if i % 5 > 2]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string")
    held = {r["conv_id"]: r["messages"] for r in quotation.conversations(messages).collect()}
    assert len(held) == 3 and {k: len(v) for k, v in held.items()}.keys() == {None, 7, 8} and len(held[None]) == 40
    assert [m["text"] for m in held[None]][:3] == ["text 00", "text 02", "text 04"] and any(m["depth"] for m in held[8])
    monkeypatch.setattr(quotation, "PIECE", 500)
    cut = quotation.conversations(messages).collect()
    assert len(cut) > 20 and max(sum(len(m["text"]) + quotation.MESSAGE for m in r["messages"]) for r in cut) <= 500 + 100 + quotation.MESSAGE
    for conv, whole in held.items():
        assert sum((r["messages"] for r in sorted((r for r in cut if r["conv_id"] == conv), key=lambda r: r["piece"])), []) == whole


def test_passages_equal_a_plain_loop(spark):
    r = random.Random(4)
    texts = ["\n".join(r.choice(["", "> a", "> b", ">> c", "d", "e", " ", "X wrote:", ">", "> > f"]) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    lines = quotation._lines(F.col("text"))
    for row in df.select("i", lines.alias("lines"), quotation._passages(lines).alias("p")).collect():
        want, level = [], -1
        for x in row["lines"]:
            if not x["body"].strip(" ") or (x["level"] == 0 and not x["kept"]):
                level = -1
            elif x["level"] == level:
                want[-1] = (level, want[-1][1] + "\n" + x["body"])
            else:
                level = x["level"]
                want.append((level, x["body"]))
        assert [(p["level"], p["body"]) for p in row["p"]] == want


def test_messages_with_swapped_nulls_are_told_apart_as_in_sql(spark):
    """A null stands in its own column: neither it nor the digits of two numbers may run together."""
    rows = [(None, 5, "user", "one text"), (5, None, "user", "one text"), (1, 11, "user", "a"), (11, 1, "user", "a"), (5, 6, None, None), (5, 6, None, ""), (None, None, None, None), (None, None, "user", None)]
    rows += [(5, 7, "bot", "> one text\nyes"), (5, 8, "bot", "> yes\n> > one text\nno"), (5, 5, "user", "one text")] * 2
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")
    assert {(r["conv_id"], r["turn"], r["role"]) for r in quotation.linked(messages).collect()} == {r[:3] for r in rows}
    got = quotation.op8_quotation(messages).toPandas()
    con = duckdb.connect()
    con.register("held", messages.toPandas())
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM held")
    want = con.execute(quotation.OP8_SQL).df()[got.columns]
    plain = lambda df: sorted(str([int(x) if isinstance(x, float) else x for x in row]) for row in df.fillna(-1).astype(object).values.tolist())
    assert plain(got) == plain(want)
    assert got.n_messages.sum() == len(set((*r[:3], r[3] or "") for r in rows))
