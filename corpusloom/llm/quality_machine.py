"""Quality classification by a factorisation machine.

A text's features are its words, hashed into buckets, statistics of its structure and its stated length, each
statistic as the one of BINS cells that it falls in. The machine scores them with a weight each and the products of
all pairs, weighted by the inner product of the pair's factors; the sum over pairs is half of the squared sum less
the sum of squares, so that a text takes time in proportion to its features.

Training takes a bounded sample, MAX_TEXTS labelled texts with the lowest hashes of their ids: their features are
computed whole on the executors, and the machine is fitted in numpy by stochastic gradients on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_remainder, with_struct
from corpusloom.llm.words import SPACED, hashes

BUCKETS = 1 << 13
BINS = 16
FACTORS = 8
#: Bound of the sample of labelled texts.
MAX_TEXTS = 8000
#: A sample is gone through EPOCHS times, and a small one more often, for LEAST_STEPS steps of a batch.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 12, 1000, 64, 0.05, 2e-4
#: Characters of texts whose features are computed together.
TOGETHER = 1 << 20
LIMIT = 0.3

#: Kinds of bytes: upper case, digits, symbols, other punctuation, line ends, other white space, beyond ASCII, rest.
_KINDS = np.full(256, 7, dtype=np.int64)
_KINDS[128:] = 6
_KINDS[[9, 11, 12, 13, 32]] = 5
_KINDS[10] = 4
_KINDS[list(b"\"'(),-./:;?!_[]{}\\^`~@+=")] = 3
_KINDS[list(b"#*$%&|<>")] = 2
_KINDS[48:58] = 1
_KINDS[65:91] = 0
#: Statistics: the values of the first and the last cell's edge. All but the lengths are shares, on a scale of square roots.
STATISTICS = {
    "log_words": (0, 12), "log_bytes": (0, 16), "log_stated": (0, 16), "word_bytes": (1, 12), "long_words": (0, 0.6), "short_words": (0, 1), "distinct": (0, 1), "top_word": (0, 1),
    "upper": (0, 1), "digits": (0, 0.8), "symbols": (0, 0.8), "punctuation": (0, 0.7), "lines": (0, 0.5), "spaces": (0, 1), "beyond": (0, 1), "stated_gap": (0, 4),
}
SIZE = BUCKETS + BINS * len(STATISTICS)


def features(texts: list, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of the texts, one text after another, and the number of features of each.

    stated is the length that the metadata tell, not a number where they tell none. Words weigh by the logarithm of
    their count, so that the squares of a text's word values add up to 1.
    """
    n = len(texts)
    data = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(x) for x in data], dtype=np.int64)
    raw = np.frombuffer(b"".join([x + b" " for x in data]), dtype=np.uint8)
    owner = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(owner * 8 + _KINDS[raw], minlength=n * 8).reshape(n, 8)
    kinds[:, 5] -= 1  # the space behind each text
    blank = (_KINDS[raw] == 4) | (_KINDS[raw] == 5)
    edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length, of = ends - begins, owner[begins] if len(begins) else begins
    words, counts = hashes([x.translate(SPACED) for x in data])
    doc = np.repeat(np.arange(n), counts)
    cell, times = np.unique(doc * BUCKETS + (words & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    holder = cell // BUCKETS
    distinct = np.bincount(holder, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, holder, times)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(holder, value * value, minlength=n))
    word_values = value / norm[holder]

    total, all_bytes = np.maximum(counts, 1), np.maximum(size, 1)
    share = lambda x, of: np.sqrt(np.maximum(x, 0) / of)
    told = np.where(np.isfinite(stated), np.maximum(stated, 0), 0)
    characters = size - np.bincount(owner, (raw >> 6) == 2, minlength=n)
    statistics = {
        "log_words": np.log1p(counts), "log_bytes": np.log1p(size), "log_stated": np.log1p(told), "word_bytes": (kinds[:, [0, 1, 2, 3, 6, 7]].sum(axis=1)) / total,
        "long_words": share(np.bincount(of, length > 12, minlength=n), total), "short_words": share(np.bincount(of, length == 1, minlength=n), total),
        "distinct": distinct / total, "top_word": share(top, total), "upper": share(kinds[:, 0], all_bytes), "digits": share(kinds[:, 1], all_bytes), "symbols": share(kinds[:, 2], all_bytes),
        "punctuation": share(kinds[:, 3], all_bytes), "lines": share(kinds[:, 4], all_bytes), "spaces": share(kinds[:, 5], all_bytes), "beyond": share(kinds[:, 6], all_bytes),
        "stated_gap": np.where(np.isfinite(stated), np.abs(np.log1p(told) - np.log1p(characters)), 4),
    }
    cells = [np.clip((statistics[name] - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64) + BUCKETS + BINS * k for k, (name, (low, high)) in enumerate(STATISTICS.items())]

    k = len(cells)
    each = distinct + k
    at = np.cumsum(each) - each
    number, out = np.empty(int(each.sum()), dtype=np.int32), np.ones(int(each.sum()), dtype=np.float32)
    place = np.arange(len(cell)) - (np.cumsum(distinct) - distinct)[holder] + at[holder]
    number[place], out[place] = cell % BUCKETS, word_values
    for j, c in enumerate(cells):
        number[at + distinct + j], out[at + distinct + j] = c, 1 / np.sqrt(k)
    return number, out, each


@dataclass
class Machine:
    """bias + sum of weight * x + sum over pairs of <factor, factor> * x * x, of SIZE features."""

    bias: float
    weights: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x FACTORS

    @staticmethod
    def fresh(seed: int = 0) -> Machine:
        return Machine(0.0, np.zeros(SIZE, np.float32), (np.random.default_rng(seed).standard_normal((SIZE, FACTORS)) * 0.05).astype(np.float32))

    def margins(self, number: np.ndarray, value: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the sums of the factors, of each text; every text has features."""
        at = np.cumsum(each) - each
        own = self.factors[number] * value[:, None]
        sums = np.add.reduceat(own, at)
        squares = np.add.reduceat(np.einsum("ij,ij->i", own, own), at)
        return self.bias + np.add.reduceat(self.weights[number] * value, at) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, number: np.ndarray, value: np.ndarray, each: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(number, value, each)[0].astype(np.float64), -40, 40))) if len(each) else np.zeros(0)

    def gradients(self, number: np.ndarray, value: np.ndarray, each: np.ndarray, target: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Mean loss, and its gradients by the bias and by the weight and the factors of each entry of number."""
        margin, sums = self.margins(number, value, each)
        loss = float(np.mean(np.logaddexp(0, margin) - target * margin))
        slope = ((1 / (1 + np.exp(-margin)) - target) / len(each)).astype(np.float32)
        back = np.repeat(slope, each)
        by_factor = (back * value)[:, None] * (np.repeat(sums, each, axis=0) - self.factors[number] * value[:, None])
        return loss, float(slope.sum()), back * value, by_factor


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int = 0) -> Machine:
    """Adagrad over shuffled batches of texts (feature numbers and values), with decay of all weights in use."""
    machine, r = Machine.fresh(seed), np.random.default_rng(seed)
    share = float(np.clip(target.mean(), 0.01, 0.99))
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_f, seen_b = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH)))):
        order = r.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            number, value = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
            _, by_bias, by_weight, by_factor = machine.gradients(number, value, np.array([len(rows[i][0]) for i in pick]), target[pick])
            used, inverse = np.unique(number, return_inverse=True)
            order_in = np.argsort(inverse, kind="stable")
            first = np.searchsorted(inverse[order_in], np.arange(len(used)))
            g_w = np.add.reduceat(by_weight[order_in], first) + DECAY * machine.weights[used]
            g_f = np.add.reduceat(by_factor[order_in], first) + DECAY * machine.factors[used]
            seen_w[used] += g_w * g_w
            seen_f[used] += g_f * g_f
            seen_b += by_bias * by_bias
            machine.weights[used] -= RATE * g_w / np.sqrt(seen_w[used])
            machine.factors[used] -= RATE * g_f / np.sqrt(seen_f[used])
            machine.bias -= RATE * by_bias / float(np.sqrt(seen_b))
    return machine


def _in_parts(texts: pd.Series, stated: pd.Series) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Features of texts, some at a time."""
    size = texts.str.len().fillna(0).to_numpy().cumsum() if len(texts) else np.zeros(0)
    told = pd.to_numeric(stated, errors="coerce").to_numpy(dtype=np.float64, na_value=np.nan)
    group = (size // TOGETHER).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield a, b, features(texts.iloc[a:b].tolist(), told[a:b])


def _feature_rows(texts: pd.Series, stated: pd.Series) -> pd.DataFrame:
    number, value = [], []
    for _, _, (n, v, each) in _in_parts(texts, stated):
        cuts = np.cumsum(each)[:-1]
        number += np.split(n, cuts)
        value += np.split(v, cuts)
    return pd.DataFrame({"number": number, "value": value})


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stated: str = "n_chars", label: str = "quality") -> Machine | None:
    """The machine of a bounded sample of the labelled texts; None without any.

    labels has doc_id and label (1: good; other values: not; null: no label). Of labels and of texts those with
    the lowest hashes count, MAX_TEXTS each, in a fixed order, however rows are dealt to tasks.
    """
    told = labels.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("_id"), (F.col(f"`{label}`") == 1).cast("int").alias("_target")).where("_id is not null").distinct()
    some = told.withColumn("_h", F.xxhash64("_id", "_target")).orderBy("_h", "_id", "_target").limit(MAX_TEXTS)
    given = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), _stated(docs, stated).alias("_stated"))
    near = given.join(F.broadcast(some), "_id")  # at most MAX_TEXTS slim rows
    told = F.pandas_udf(_feature_rows, "struct<number: array<int>, value: array<float>>")
    rows = near.select("_h", "_id", "_target", F.xxhash64("_text", "_stated").alias("_t"), told("_text", "_stated").alias("_f"))
    found = rows.orderBy("_h", "_id", "_target", "_t").limit(MAX_TEXTS).collect()
    if not found:
        return None
    return train([(np.array(r["_f"]["number"], np.int32), np.array(r["_f"]["value"], np.float32)) for r in found], np.array([r["_target"] for r in found], np.float32))


def _stated(docs: DataFrame, stated: str) -> Column:
    return F.expr(f"try_cast(`{stated}` as double)") if stated in docs.columns else F.lit(None).cast("double")


def _predict(machine: Broadcast | None) -> Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stated in batches:
            score = np.full(len(texts), 0.5)
            if machine is not None:
                for a, b, found in _in_parts(texts, stated):
                    score[a:b] = machine.value.scores(*found)
            yield pd.DataFrame({"score": score})

    return run


def judged(docs: DataFrame, machine: Machine | None, text: str = "text", stated: str = "n_chars") -> DataFrame:
    """docs with score (0 to 1, higher: the better label is likelier) and predicted (1 if score is LIMIT or more).

    A null text counts as empty, and an empty text is scored by its statistics; a column of stated lengths may be
    missing, or null. Where nothing was learned every score is 0.5. Each row is scored by itself, so repeated rows
    have equal results, and an empty table stays empty. Columns of docs with the names of results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine) if machine else None
    score = F.pandas_udf(_predict(shared), "struct<score: double>")
    out = with_struct(docs, score(F.col(f"`{text}`").cast("string"), _stated(docs, stated)), ["score"])
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 5) == 0


def op11_factorisation_machine(docs: DataFrame, labels: DataFrame) -> DataFrame:
    train_labels = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    machine = learned(docs.select("doc_id", "text", "n_chars"), train_labels)
    return judged(docs.select("doc_id", "text", "n_chars"), machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
