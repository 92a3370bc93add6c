"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved at several widths, rectified, max-pooled over the window and classed by softmax.
Windows have a fixed length; a text is cut into as many as it needs and the mean of their class probabilities
(weighted by bytes) is the text's. For prediction the embedding is folded into the filters: each place of a
filter becomes a table of 256 rows, so that a convolution is a few table look-ups.

Training takes windows of a bounded sample of the labelled texts: of each label MAX_PER_CLASS texts at most, and
MAX_TEXTS in all, picked by hash; a text's windows are cut from anywhere in it before they leave the executors.
Every label is learnt, however rare, and prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import id_remainder, with_struct

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 12
#: Bound of the sample: texts of each label, texts of all labels together, windows of each text.
MAX_PER_CLASS, MAX_TEXTS, WINDOWS_PER_TEXT = 400, 200_000, 3
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # width x EMBEDDING x FILTERS
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(labels: list[str], seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        scale = lambda *shape, n: (r.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
        return Network(
            labels, scale(256, EMBEDDING, n=EMBEDDING), [scale(w, EMBEDDING, FILTERS, n=w * EMBEDDING / 2) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            scale(FILTERS * len(WIDTHS), len(labels), n=FILTERS * len(WIDTHS)), np.zeros(len(labels), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.offset]

    def train_step(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of a batch and the gradients of parameters()."""
        n, length = windows.shape
        x = self.embedding[windows]  # n x length x EMBEDDING
        pooled, kept = [], []
        for f, b in zip(self.filters, self.biases, strict=True):
            w = len(f)
            columns = np.concatenate([x[:, j : length - w + 1 + j] for j in range(w)], axis=2)
            z = columns @ f.reshape(-1, FILTERS) + b
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None], axis=1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((best, top > 0))
        h = np.concatenate(pooled, axis=1)
        p = softmax(h @ self.dense + self.offset)
        loss = float(-np.log(p[np.arange(n), target] + 1e-9).mean())
        p[np.arange(n), target] -= 1
        p /= n
        grads = [np.zeros_like(g) for g in self.parameters()]
        k = len(WIDTHS)
        grads[-2], grads[-1] = h.T @ p, p.sum(axis=0)
        back = p @ self.dense.T
        rows = np.arange(n)[:, None]
        for i, f in enumerate(self.filters):
            best, active = kept[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * active  # n x FILTERS
            grads[1 + k + i] = g.sum(axis=0)
            for j in range(len(f)):
                codes = windows[rows, best + j]  # n x FILTERS
                grads[1 + i][j] = np.einsum("nfe,nf->ef", self.embedding[codes], g)
                np.add.at(grads[0], codes.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
        return loss, grads

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.embedding @ f[j]) for j in range(len(f))] for f in self.filters]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(parts: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Adam over shuffled windows of at most WINDOW bytes; labels weigh alike, however many windows they have."""
    names = sorted(set(labels))
    net = Network.fresh(names, seed)
    r = np.random.default_rng(seed)
    number = {name: k for k, name in enumerate(names)}
    x = np.stack([np.frombuffer(part.ljust(WINDOW, b" "), np.uint8) for part in parts])
    y = np.array([number[label] for label in labels])
    share = np.bincount(y, minlength=len(names))
    odds = (1 / share[y]) / (1 / share[y]).sum()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = r.choice(len(y), size=len(y), p=odds)
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            _, grads = net.train_step(x[pick], y[pick])
            step += 1
            for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def apply(net: Network, tables: list[list[np.ndarray]], texts: list) -> tuple[list[str | None], np.ndarray]:
    """Label and probability of each text; None for a text without bytes."""
    pieces, owner, weight = [], [], []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        n = -(-len(data) // WINDOW)
        pieces.append(data.ljust(n * WINDOW, b" "))
        owner += [i] * n
        weight += [WINDOW] * (n - 1) + [len(data) - WINDOW * (n - 1)] * (n > 0)
    windows = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, WINDOW)
    total = np.zeros((len(texts), len(net.labels)))
    h = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
    for a in range(0, len(windows), 16):  # what one step touches stays in the processor's cache
        block = windows[a : a + 16]
        for i, parts in enumerate(tables):
            last = WINDOW - len(parts) + 1
            z = parts[0].take(block[:, :last], axis=0)
            for j in range(1, len(parts)):
                z += parts[j].take(block[:, j : last + j], axis=0)
            h[a : a + 16, i * FILTERS : (i + 1) * FILTERS] = np.maximum(z.max(axis=1) + net.biases[i], 0)
    if len(windows):
        np.add.at(total, np.array(owner), softmax(h @ net.dense + net.offset).astype(np.float64) * np.array(weight)[:, None])
    sums = total.sum(axis=1)
    best = total.argmax(axis=1)
    score = np.divide(total[np.arange(len(texts)), best], sums, out=np.zeros(len(texts)), where=sums > 0)
    return [net.labels[b] if s > 0 else None for b, s in zip(best.tolist(), sums.tolist(), strict=True)], np.clip(score, 0, 1)


def sample(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> list:
    """Windows (part, label) of the texts of each label with the lowest hashes of id and text, in a fixed order.

    A label has MAX_PER_CLASS texts, or an equal share of MAX_TEXTS where there are very many labels, and one at
    least. A share of the hash range that holds these is kept first; equal rows count once, and rows beyond the
    bound are dropped before the exchange. Nothing here depends on how rows are dealt to tasks.
    """
    t = F.col(f"`{text}`")
    usable = docs.where(F.col(f"`{label}`").isNotNull() & t.rlike(r"\p{L}")).select(t.alias("text"), F.col(f"`{label}`").cast("string").alias("label"), F.xxhash64(F.col(f"`{doc_id}`"), t).alias("h"))
    counts = usable.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()  # the network has an output for each label
    if not counts:
        return []
    most = max(1, min(MAX_PER_CLASS, MAX_TEXTS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["label"], int(min(1.0, (most * 1.4 + 40) / max(r["n"], 1)) * 2**62)) for r in counts], "label string, most long")
    near = usable.join(F.broadcast(shares), "label").where(F.shiftrightunsigned("h", 2) <= F.col("most"))
    data = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    drawn = lambda k, n: F.pmod(F.xxhash64("h", F.lit(k)), n.cast("long")).cast("int")
    cuts = [F.substring(data, drawn(2 * k, F.greatest(size - WINDOW + 1, F.lit(1))) + 1, drawn(2 * k + 1, F.lit(WINDOW - WINDOW // 4 + 1)) + WINDOW // 4) for k in range(WINDOWS_PER_TEXT)]  # short texts exist: short windows too
    rows = near.select("label", "h", F.array(*cuts).alias("parts")).dropDuplicates(["label", "h"])
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("h"))).where(F.col("n") <= most)
    return [(bytes(part), r["label"]) for r in sorted(first.collect(), key=lambda r: (r["label"], r["n"])) for part in r["parts"]]


def _predict(net: Network | None) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else []
        for texts in batches:
            labels: list[str | None] = []
            scores: list[float] = []
            for a in range(0, len(texts), 64):
                part = texts.iloc[a : a + 64].tolist()
                if net:
                    found, score = apply(net, tables, part)
                    labels += found
                    scores += score.tolist()
                else:
                    labels += [None] * len(part)
                    scores += [0.0] * len(part)
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    return run


def identified(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (mean probability of the label, 0 to 1).

    A null text, one without a letter, and any text where nothing was learned, has lang_pred "und" and score 0.
    Texts are read whole, row by row: repeated rows get equal answers. Columns of docs with the names of
    results are replaced.
    """
    t = F.col(f"`{text}`")
    predict = F.pandas_udf(_predict(net), "struct<lang_pred: string, score: double>")
    found = predict(F.when(t.rlike(r"\p{L}"), t))
    out = with_struct(docs, found, ["lang_pred", "score"])
    return out.withColumns({"lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN)), "score": F.coalesce("score", F.lit(0.0))})


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) == 2


def op7_byte_cnn(docs: DataFrame) -> DataFrame:
    rows = sample(docs.where(~held_out(F.col("doc_id"))))
    net = train([t for t, _ in rows], [label for _, label in rows]) if rows else None
    return identified(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
