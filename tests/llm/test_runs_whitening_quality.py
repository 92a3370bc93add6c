"""Periodic runs, embedding whitening and the quality classifier, against brute force and held-out labels."""

import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import periodic_runs, quality_machine, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a", 0, "k", "k"), (2, "", None, None, None, None, None), (2, "", None, None, None, None, None), (None, "hi there", "en", "", 8, "k", "k")]
    rows += [(4, "12 34\t12 34\n12 34 12 34", "en", "b", 5, "k", "k"), (5, "word " * 40_000, "en", "a", 1, "k", "k"), (6, " \t\n", "de", "a", 3, "k", "k")]
    return spark.createDataFrame(rows, SCHEMA)


def brute_runs(words):
    """Every stretch and period by definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, length = i, j - i + q
            smaller = any(all(words[x] == words[x + p] for x in range(s, s + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(words, doc_id):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(text, doc_id):
    words = changed((text or "").encode().split(), doc_id)
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_random_words_are_those_of_the_definition():
    r = np.random.default_rng(5)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < r.integers(0, 90):
            part = r.integers(0, r.integers(1, 4), r.integers(1, 12)).tolist()
            words += part * int(r.integers(1, 8)) + part[: r.integers(0, len(part))]
        texts.append([bytes([97 + w]) for w in words])
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]
    assert sum(map(len, periodic_runs.runs_of(texts))) > 300 and periodic_runs.runs_of([]) == []


def test_runs_follow_their_contract_on_changed_texts(spark):
    r = np.random.default_rng(8)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "é"], r.integers(0, 60)))) for i in range(300)]
    got = periodic_runs.op12_periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {x["doc_id"]: tuple(x[c] for c in columns) for x in got} == {i: expected(t, i) for i, t in rows}


def test_runs_of_odd_rows(spark, odd):
    got = periodic_runs.op12_periodic_runs(odd)
    assert got.count() == 7 and periodic_runs.op12_periodic_runs(odd.limit(0)).count() == 0
    by_id = {x["doc_id"]: x for x in got.where("doc_id <> 2").collect()}
    assert (by_id[5].start, by_id[5].length, by_id[5].period) == (0, 40_000, 1) and by_id[4].n_runs == 1 and by_id[1].n_runs == by_id[6].n_runs == 0
    plain = {x["doc_id"]: x for x in periodic_runs.detected(odd).collect()}
    assert plain[5].collapsed == "word" and plain[4].collapsed == "12 34" and plain[1].collapsed == "" and plain[5].runs[0].period == 1


def test_long_texts_take_time_in_proportion():
    """Hundreds of thousands of words with every lag alive: one block each level moves one diagonal."""
    words = [b"a", b"b", b"a", b"c"] * 100_000
    assert periodic_runs.runs_of([words]) == [[(0, 400_000, 4)]]


def test_runs_agree_with_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(docs).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(periodic_runs.OP12_SQL).df().sort_values("doc_id")[got.columns]
    assert got.fillna(-1).values.tolist() == want.fillna(-1).values.tolist()
    assert (got.n_runs > 0).sum() > 5


def brute_whitening(vectors):
    """Fit list, sums, covariance and deviations in exact arithmetic."""
    xs = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(len(s))] for i in range(len(s))])
    return xs, fit, n, s, cov


def test_whitening_is_exact(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    few = spark.createDataFrame([(r["vec_id"], [float(x) for x in r["embedding"][:20]]) for r in emb.limit(150).collect()] * 2, "vec_id long, embedding array<double>").repartition(5)
    rows = few.collect()
    xs, fit, n, s, cov = brute_whitening([r["embedding"] for r in rows])
    got = whitening.op13_bit_sliced_scatter(few).toPandas()
    assert len(got) == len(rows) * 16 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(cov))
    want = {r["vec_id"]: (sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), (np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)]) @ vectors)[:16] / np.sqrt(values[:16])) for r, x in zip(rows, xs, strict=True)}
    for vec_id, g in got.groupby("vec_id"):
        g = g.sort_values("component").drop_duplicates("component")
        assert set(g.deviation) == {want[vec_id][0]} and np.allclose(np.abs(g.whitened), np.abs(want[vec_id][1]), atol=1e-8)
        assert np.allclose(g.explained, values[:16] / np.trace(cov), rtol=1e-9)
    white = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").values
    assert np.abs(np.cov(np.unique(white, axis=0).T, bias=True) - np.eye(16)).max() < 1e-9  # one sign for all rows


def test_scatter_of_any_integers_is_exact():
    r = np.random.default_rng(2)
    for m, d, size in ((1, 1, 5), (70, 7, 40), (4096, 5, 1 << 20), (33, 4, 1 << 62), (100, 3, 1)):
        z = r.integers(-size, size, (m, d))
        z[:, 0] = size  # one dimension without planes of its own
        ones = np.hstack([z.astype(object), np.ones((m, 1), dtype=object)])
        assert (whitening.scatter(z) == np.triu(ones.T @ ones)).all()
        total = whitening.scatter(z)[0]
        assert (whitening._of_limbs(whitening._to_limbs(total)) == total).all() and (whitening._of_limbs(whitening._to_limbs(-total)) == -total).all()


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (3, None), (4, []), (5, [0.1, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [2.0]), (9, [1e300, -1e300, 0.0]), (10, [-1e300, 1e300, 0.0])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened string")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(docs).collect()}
    assert {k[0] for k in got} == {1, None, 8, 9, 10} and whitening.whitened(docs).count() == 2 * 3 + 1 + 3 * 2
    assert got[8, 1].whitened == 0 and got[8, 1].identity_error == 0 and got[8, 1].deviation == 0 and got[8, 1].n == 1
    assert got[1, 1].n == 2 and abs(abs(got[1, 1].whitened) - 1) < 1e-12 and got[1, 2].whitened == 0 and got[1, 1].explained == 1
    assert got[9, 1].deviation is None and abs(got[9, 1].whitened + got[10, 1].whitened) < 1e-12
    assert whitening.op13_bit_sliced_scatter(docs.limit(0)).count() == 0


def test_pairs_by_the_identity_equal_pairs_one_by_one():
    r = np.random.default_rng(4)
    machine = quality_machine.Machine.fresh(1)
    machine.weights += r.standard_normal(len(machine.weights)).astype(np.float32)
    machine.factors *= 10
    texts = ["", "one", "One two two; three 3\nfour | five", "the " * 30]
    number, value, each = quality_machine.features([*texts, None], np.array([0, 3, 30, np.nan, np.nan]))
    got, at = machine.margins(number, value, each)[0], 0
    for margin, n in zip(got, each, strict=True):
        x, v = value[at : at + n], machine.factors[number[at : at + n]]
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(n) for j in range(i + 1, n))
        assert abs(margin - (machine.bias + float(machine.weights[number[at : at + n]] @ x) + pairs)) < 1e-4
        at += n
    assert (each == [quality_machine.SIZE - quality_machine.BUCKETS] // np.array(quality_machine.BINS) + np.array([0, 1, 8, 1, 0])).all()


def test_machine_gradients():
    machine = quality_machine.Machine.fresh(3)
    machine.factors = machine.factors.astype(np.float64) * 5
    machine.weights = machine.weights.astype(np.float64)
    number, value, each = quality_machine.features(["a b c a", "d e f 9"], np.array([7.0, 7.0]))
    target = np.array([1.0, 0.0])
    _, by_bias, by_weight, by_factor = machine.gradients(number, value, each, target)
    for held, g, at in ((machine.weights, np.bincount(number, by_weight, minlength=quality_machine.SIZE), number[0]), (machine.factors, None, (number[0], 2)), (machine.weights, np.bincount(number, by_weight, minlength=quality_machine.SIZE), number[-1])):
        g = g[at] if g is not None else by_factor[number == at[0], at[1]].sum()
        old = held[at]
        held[at] = old + 1e-3
        up = machine.gradients(number, value, each, target)[0]
        held[at] = old - 1e-3
        down = machine.gradients(number, value, each, target)[0]
        held[at] = old
        assert abs((up - down) / 2e-3 - g) < 1e-4 + 0.02 * abs(g)
    assert np.isfinite(by_bias)


def test_held_out_labels_are_told(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_machine.op11_factorisation_machine(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = (held[held.quality == k].score.to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97 and (held[held.quality == 1].predicted == 1).mean() > 0.97 and (held.predicted == held.quality).mean() > 0.93
    # neither labels of held-out rows nor lang, source and doc_id reach a score
    other = quality_machine.op11_factorisation_machine(
        docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).repartition(7), labels.withColumn("quality", F.when(quality_machine.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    ).toPandas()
    both = got.merge(other, on="doc_id")
    assert np.allclose(both.score_x, both.score_y, atol=1e-6)


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0, 0), (4, 0, 0), (5, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_machine.op11_factorisation_machine(odd, labels).toPandas()
    assert len(got) == 7 and got.score.between(0, 1).all() and got.doc_id.isna().sum() == 1
    assert got[got.doc_id == 2].score.nunique() == 1 and quality_machine.op11_factorisation_machine(odd.limit(0), labels).count() == 0
    nothing = quality_machine.op11_factorisation_machine(odd, labels.limit(0)).toPandas()
    assert set(nothing.score) == {0.5} and set(nothing.predicted) == {1}
    told = quality_machine.judged(odd.drop("n_chars"), quality_machine.Machine.fresh())
    assert told.columns == ["doc_id", "text", "lang", "source", "runs", "score", "predicted"] and told.count() == 7


def test_the_sample_is_bounded_and_in_a_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(quality_machine, "MAX_TEXTS", 20)
    monkeypatch.setattr(quality_machine, "LEAST_STEPS", 5)
    docs = spark.createDataFrame([(i % 50, f"text {i} of some words", 10) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    one, two = (quality_machine.learned(d, labels) for d in (docs, docs.repartition(7)))
    assert (one.weights == two.weights).all() and (one.factors == two.factors).all()
    seen = []
    monkeypatch.setattr(quality_machine, "train", lambda rows, target: seen.append(len(rows)))
    quality_machine.learned(docs, labels)
    assert seen == [20]
