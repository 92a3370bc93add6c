"""Scoring, language identification, packing and the pipeline."""

import collections
import functools
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import language_id, packing, pitman_yor, repetition

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a", 0, "k"), (2, "", None, None, None, None), (2, "", None, None, None, None), (None, "hi there", "en", "", 8, "k"), (4, "12 34", "en", "b", 5, "k"), (5, "word " * 40_000, "en", "a", 1, "k")]
    return spark.createDataFrame(rows, SCHEMA)


def test_base_scores_and_perplexity(spark, sf_dir, documents):
    got = pitman_yor.op1_pitman_yor(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().set_index("doc_id")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)), None] for i, t in zip(documents.doc_id, documents.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[i])
        assert math.isclose(row.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_probabilities_of_all_short_texts_add_up_to_one(spark):
    """Two known words and one unknown: all texts of up to six words hold nearly the whole probability, and no more."""
    r = np.random.default_rng(3)
    train = [(i, " ".join(r.choice(["aa", "bb"], r.geometric(0.6) - 1))) for i in range(400)]
    texts = [" ".join(x) for n in range(7) for x in itertools.product(["aa", "bb", "unseen"], repeat=n)]
    docs = spark.createDataFrame([*train, *[(1000 + k, t) for k, t in enumerate(texts)]], "doc_id long, text string")
    scores = [x["score"] for x in pitman_yor.scored(docs, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()]
    assert len(scores) == len(texts) and 0.98 < sum(10**x for x in scores) < 1 + 1e-6


def test_scores_do_not_depend_on_the_number_of_parts(spark, sf_dir, monkeypatch):
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for chars in (1 << 40, 1000):  # 4 parts, and one for every 1000 characters
        monkeypatch.setattr(pitman_yor, "PART_CHARS", chars)
        found.append(pitman_yor.scored(docs, F.lit(True)).toPandas().sort_values("doc_id"))
    few, many = (f.score.values / f.n_tokens.values for f in found)
    assert abs((few - many).mean()) < 0.002 and np.abs(few - many).max() < 0.1


def test_stirling_numbers():
    totals = pitman_yor.log_stirling(0.75, 6)
    assert math.isclose(math.exp(totals[2, 1]), 0.25) and math.isclose(math.exp(totals[3, 2]), 0.25 + 0.5, rel_tol=1e-9)


def test_table_draws_follow_their_law():
    """Numbers of tables of 4 customers: frequencies against the exact law."""
    seating = pitman_yor._Seating(0.5, 1.0, np.random.default_rng(1))
    n = 40_000
    t = seating.draw(np.full(n, 4), np.ones(n, dtype=np.int64), np.full(n, 3), np.full(n, 0.2))
    weight = [math.exp(seating.stirling[4, k]) * math.prod(1.0 + 0.5 * (3 + j) for j in range(k)) * 0.2**k for k in range(1, 5)]
    got = np.bincount(t, minlength=5)[1:] / n
    assert np.abs(got - np.array(weight) / sum(weight)).max() < 0.01
    many = seating.draw(np.array([100_000]), np.array([1]), np.array([10]), np.array([0.01]))
    assert 1 <= many[0] <= 100_000


def test_scores_of_odd_rows(spark, odd):
    got = pitman_yor.op1_pitman_yor(odd).collect()
    assert len(got) == 6 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 3, 3, 40_001]
    assert pitman_yor.op1_pitman_yor(odd.limit(0)).count() == 0
    nothing = pitman_yor.scored(odd, F.lit(False)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_held_out_languages_are_told(spark, sf_dir, documents):
    got = language_id.op7_byte_cnn(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().merge(documents, on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_network_gradients():
    net = language_id.Network.fresh(["a", "b"], 3)
    for p in net.parameters():
        p += 0.01
    x, y = np.random.default_rng(0).integers(97, 105, (6, 24)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    _, grads = net.train_step(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = net.train_step(x, y)[0]
        p[at] = old - 1e-2
        down = net.train_step(x, y)[0]
        p[at] = old
        assert math.isclose((up - down) / 2e-2, g[at], rel_tol=0.15, abs_tol=2e-3)


def test_languages_of_odd_rows(spark, odd):
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.op7_byte_cnn(odd).collect()]
    assert collections.Counter(got) == collections.Counter([(1, "und"), (2, "und"), (2, "und"), (None, "en"), (4, "und"), (5, "en")])
    assert language_id.op7_byte_cnn(odd.limit(0)).count() == 0


def test_every_label_is_sampled_within_the_bound_in_a_fixed_order(spark, monkeypatch):
    """Many labels, one repeated row without end, and words that stand only far inside a long text."""
    monkeypatch.setattr(language_id, "MAX_PER_CLASS", 4)
    far = "x " * 150_000
    rows = [(i, f"text {i} of label {i % 700}", f"l{i % 700}") for i in range(2100)] + [(1, "again and again", "hot")] * 3000 + [(i, f"hot text {i}", "hot") for i in range(2, 60)] + [(5, far + "zq" * 300_000, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.sample(docs)
    assert found == language_id.sample(docs.repartition(7))
    per = collections.Counter(label for _, label in found)
    assert len(per) == 702 and set(per.values()) <= {3 * k for k in range(1, 5)} and per["hot"] == 12 and per["l3"] == 9
    assert any(b"zq" in part for part, label in found if label == "far") and all(0 < len(part) <= language_id.WINDOW for part, _ in found)
    monkeypatch.setattr(language_id, "MAX_TEXTS", 1404)
    assert max(collections.Counter(label for _, label in language_id.sample(docs)).values()) == 6


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(pieces, texts):
    """texts: doc_id -> text, ids distinct."""
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array(ids_of(texts[i]), dtype="<u4")
        assert g.start.iloc[0] == 0 and (g.start.values[1:] == (g.start + g.length).values[:-1]).all() and g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in g.itertuples())
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and (g.offset.values[1:] == (g.offset + g.length).values[:-1]).all() and g.length.sum() <= packing.SEQUENCE


def test_packing_is_exact_and_mixed(spark, sf_dir, documents):
    got = packing.op6_mixture_packing(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)).toPandas()
    assert set(got.doc_id) == set(documents.doc_id)
    check_packing(got, dict(zip(documents.doc_id, documents.text, strict=True)))
    n = got.length.sum()
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1 == -(-n // packing.SEQUENCE)
    shares = got.groupby("queue").length.sum() / n
    rows = got.groupby(["queue", "sequence_id"]).length.sum().unstack(fill_value=0).cumsum(axis=1)
    ahead = rows.sub(np.outer(shares, np.arange(1, rows.shape[1] + 1) * packing.SEQUENCE))
    assert ahead.abs().iloc[:, :-20].max().max() <= 3 * packing.GRAIN  # no queue is ever far from what it is owed


def test_packing_of_odd_rows(spark, odd):
    texts = [(i, t) for i, t in enumerate([None, "", "a  b   c", "x <|endoftext|> y", " lead", "tail ", "é　  z \n w", "word " * 5000])]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "s") for i, t in texts], "doc_id long, text string, source string")
    check_packing(packing.op6_mixture_packing(docs).toPandas(), dict(texts))
    assert packing.op6_mixture_packing(odd).where("doc_id = 2").count() == 2
    assert packing.op6_mixture_packing(odd.limit(0)).count() == 0


def test_dealing_with_targets_and_many_queues():
    tokens = {f"q{i}": n for i, n in enumerate([5000, 64, 1, 200_000, 77_777])}
    for targets in (None, {"q0": 0.5, "q3": 0.5}):
        plan = packing.Dealing(tokens, targets)
        places = {q: plan.grain(q, np.arange(-(-n // packing.GRAIN))) for q, n in tokens.items()}
        every = np.sort(np.concatenate(list(places.values())))
        assert (every == np.arange(len(every))).all() and all((np.diff(p) > 0).all() for p in places.values())
    head = {q: (plan.grain(q, np.arange(10)) < 25).sum() for q in ("q0", "q3")}
    assert head["q0"] >= 10 or head == {"q0": 10, "q3": 10}


def test_small_sources_are_dealt_at_their_share_to_the_end():
    """Sources far below one grain in 8192 are spread over the whole corpus, and no large one lags behind."""
    grains = {"tiny": 3, "small": 60, "a": 1_000_000, "b": 700_000, "c": 300_000, "single1": 1, "single2": 1}
    for targets in (None, {q: n / 3 for q, n in grains.items() if q != "c"}):
        plan = packing.Dealing({q: n * packing.GRAIN for q, n in grains.items()}, targets)
        places = {q: plan.grain(q, np.arange(n)) for q, n in grains.items()}
        assert (np.sort(np.concatenate(list(places.values()))) == np.arange(sum(grains.values()))).all()
        dealt = sum(n for q, n in grains.items() if targets is None or q in targets)
        for q, n in grains.items():
            if targets is None or q in targets:
                share = n / dealt
                assert np.abs(np.arange(n) + 0.5 - (places[q] + 0.5) * share).max() <= 2


def test_tokens_before_a_grain_are_those_of_all_grains_before_it():
    r = np.random.default_rng(2)
    tokens = {f"q{i}": int(n) for i, n in enumerate(np.append(r.integers(1, 200, 300), [5000, 64, 128]))}
    for targets in (None, {q: 1.0 for q in list(tokens)[::2]}):
        plan = packing.Dealing(tokens, targets)
        rows = sorted((int(g), int(t), min(packing.GRAIN, n - packing.GRAIN * i)) for q, n in tokens.items() for i, (g, t) in enumerate(zip(*plan.places(q, np.arange(-(-n // packing.GRAIN))), strict=True)))
        assert [t for _, t, _ in rows] == np.cumsum([0, *[n for *_, n in rows]])[:-1].tolist()


def test_many_small_sources_leave_no_padding(spark):
    for n_sources, n_tokens in ((500, 70), (900, 5), (900, 1)):
        docs = spark.createDataFrame([(i, " ".join(["a"] * (n_tokens - 1)), f"s{i}") for i in range(n_sources)], "doc_id long, text string, source string")
        got = packing.op6_mixture_packing(docs).toPandas()
        check_packing(got, {i: " ".join(["a"] * (n_tokens - 1)) for i in range(n_sources)})
        assert got.sequence_id.nunique() == -(-got.length.sum() // packing.SEQUENCE)


def test_very_many_sources_are_dealt_by_sorting_as_by_arithmetic(spark, monkeypatch):
    """2000 sources with targets for most of them: both ways give the same rows, and every source keeps its share in every window."""
    r = np.random.default_rng(5)
    texts = {i: " ".join(["word"] * int(n)) for i, n in enumerate(np.append(r.geometric(1 / 60, 4000), [60_000, 9000, 5]))}
    docs = spark.createDataFrame([(i, t, f"s{i % 2000}" if i < 4000 else "big") for i, t in texts.items()], "doc_id long, text string, source string")
    sizes = docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).toPandas().set_index("source").n
    sizes = {q: n + (4000 + 3 if q == "big" else 2) for q, n in sizes.items()}  # about: the end tokens too
    targets = {q: float(-(-n // packing.GRAIN)) for q, n in sizes.items() if not q.endswith("7")}
    for aims in (None, targets):
        monkeypatch.setattr(packing, "FEW", 10_000)
        few = packing.packed(docs, targets=aims).toPandas()
        monkeypatch.setattr(packing, "FEW", 5)
        many = packing.packed(docs.repartition(3), targets=aims)
        assert len(few) == many.count()
        # places within a queue follow the partitions, so pieces are compared by what they hold of each queue
        key = lambda f: sorted(f.groupby(["sequence_id", "queue"]).length.sum().reset_index().itertuples(index=False))
        assert key(few) == key(many.toPandas())
        assert few.sequence_id.nunique() == few.sequence_id.max() + 1 == -(-few.length.sum() // packing.SEQUENCE)  # no padding but in the last
    check_packing(few.assign(ids_crc32=few.ids.map(zlib.crc32)), texts)
    plan, dealt = packing.Dealing({q: int(x) * packing.GRAIN for q, x in targets.items()}, targets), sum(targets.values())
    for q, n in targets.items():  # every grain is within two of where its share owes it
        assert np.abs(np.arange(n) + 0.5 - (plan.grain(q, np.arange(int(n))) + 0.5) * n / dealt).max() <= 2


def test_chunked_encoding_equals_the_tokenizer(documents):
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    texts = [*documents.text[:80], "don't  stop", "a\tb c", "1 2  3", "x  y"]
    texts += ["ends in a space ", "or a line\n", "a line\nand more\tof it", " ", "", None, "it's we'll", "é ü 漢字 🙂 x"]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def test_pipeline_stages_follow_brute_force(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = docs.toPandas().set_index("doc_id")
    a, b, c, d = kept.values()
    judged = {i: t for i, t in zip(documents.doc_id, documents.text, strict=True)}
    assert set(a.index) == {r["doc_id"] for r in repetition.judged(spark.createDataFrame(list(judged.items()), "doc_id long, text string")).where("kept").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in a.text.items() for w in [t.translate(LOW).split()]}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                low, high = sorted((group[x], group[y]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert set(b.index) == set(group.values())
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW)) for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text]
    windows = {" ".join(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    words = {i: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))) for i, t in b.text.items()}
    assert set(c.index) == {i for i, t in words.items() if not any(f" {w} " in f" {t} " for w in windows)}
    assert set(d.index) == set(c.index)
    for i, t in d.text.items():
        assert (t == c.text[i]) == (d.n_chars[i] == c.n_chars[i]) or t != c.text[i]
        assert not re.search(r"(?i)token = \"[0-9a-f]{24}", t)
    pieces = corpus_pipeline.pack(spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids")).toPandas()
    check_packing(pieces, d.text.to_dict())
    assert set(pieces.doc_id) == set(d.index)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd):
    rows = odd.unionByName(spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(90)), None, None, None, "k")] * 3 + [(None, " ".join(f"x{i}" for i in range(90)), "en", "a", 3, "k")] * 2, SCHEMA))
    for start in (rows, rows.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "odd")
            if name == "n-gram Jaccard join" and start is rows:
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["7", "None"]
        assert (docs.count() > 0) == (start is rows)


def test_every_context_has_a_restaurant_of_its_own(spark):
    """More contexts than any fixed number of restaurants held before: texts alike in all but their words score alike."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("concat('c', id, ' w', id)").alias("text"))
    score = np.array([r["score"] for r in pitman_yor.scored(docs, F.lit(True)).collect()])
    assert len(score) == n and np.ptp(score) < 1e-9
    # a context of one customer and table: (1 - d + (s + d) * base) / (s + 1); a word's base is its discounted customer and its share of the rest, together 1
    base = 1 / (10 + 3 * n)
    two = (0.25 + (2 + 0.75 * n) * base) / (2 + n) * (0.25 + 2.75 * base) / 3
    low, high = (math.log10(two * (0.25 + 2.75 * end) / 3) for end in (0.28, 0.34))  # the end is a third of the parent's customers
    assert low < score[0] < high



def test_hot_words_are_dealt_to_several_parts(spark, sf_dir, monkeypatch):
    """Scores by the same law whether the pairs of frequent words lie in one part or in several."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for hot in (1 << 40, 100):
        monkeypatch.setattr(pitman_yor, "HOT", hot)
        found.append(pitman_yor.scored(docs, F.lit(True)).toPandas().sort_values("doc_id"))
    one, several = (f.score.values / f.n_tokens.values for f in found)
    assert (found[0].base_score.values == found[1].base_score.values).all()
    assert abs((one - several).mean()) < 0.002 and np.abs(one - several).max() < 0.1
