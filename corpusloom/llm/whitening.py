"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers. Over blocks of rows each dimension is shifted to start at 0 and cut into bit planes; a
plane's bits of 64 rows make one word. The population counts of two planes' conjunction, weighted by the planes'
powers of two, add up to the exact cross-product of their dimensions. A dimension of ones rides along, so that
sums and the number of rows come out of the same counts. Blocks are added up as integers of any size, first within
a task and then by Spark, and centred as integers (n * products less the product of sums); only then does the
covariance become floating point and go to eigh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Steps of a unit, and what is added to make the integers positive.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows whose planes are counted together.
BLOCK = 1 << 12
#: Entries beyond this count as this, so that integers stay within 63 bits.
LARGEST = 1 << 62
#: Dimensions of one piece of a row of the scatter matrix.
PIECE = 128
#: Bits of a limb, and limbs of an integer between tasks.
LIMB, LIMBS = 40, 5


def _integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length and their entries as integers less SHIFT, for each length above 0; other rows are left out.

    Left out are null vectors, and those with a null or non-finite entry.
    """
    size = np.diff(vectors.offsets.to_numpy())
    begin = vectors.offsets.to_numpy()[:-1]
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is not a number
    good = np.isfinite(values)
    bad = np.append(0, np.cumsum(~good))
    usable = np.flatnonzero((size > 0) & (bad[begin + size] == bad[begin]) & vectors.is_valid().to_numpy(zero_copy_only=False))
    for n in np.unique(size[usable]).tolist():
        rows = usable[size[usable] == n]
        for a in range(0, len(rows), BLOCK):
            some = rows[a : a + BLOCK]
            with np.errstate(over="ignore"):
                steps = np.floor(SCALE * values[begin[some][:, None] + np.arange(n)])
            yield some, np.clip(steps, -LARGEST, LARGEST).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors as bytes of the least width that holds them, so that equal ones are equal bytes."""
    for batch in batches:
        for _, z in _integers(batch.column(0)):
            n = z.shape[1]
            most = np.maximum(z.max(axis=1), ~z.min(axis=1))
            width = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, side="right")
            for w in np.unique(width).tolist():
                some = np.ascontiguousarray(z[width == w].astype(f"<i{w}"))
                offsets = np.arange(len(some) + 1, dtype=np.int32) * (n * w)
                body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(some)])
                yield pa.record_batch([pa.array(np.full(len(some), n, np.int32)), pa.array(np.full(len(some), w, np.int32)), body], names=["d", "width", "body"])


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The integer vectors of a batch of keys, by length and width."""
    d, width = (batch.column(k).to_numpy() for k in (0, 1))
    for n, w in sorted(set(zip(d.tolist(), width.tolist(), strict=True))):
        body = batch.column(2).take(pa.array(np.flatnonzero((d == n) & (width == w)))).to_pylist()
        for a in range(0, len(body), BLOCK):
            yield np.frombuffer(b"".join(body[a : a + BLOCK]), dtype=f"<i{w}").reshape(-1, n).astype(np.int64)


def scatter(z: np.ndarray) -> np.ndarray:
    """Exact upper triangle of the cross-products of columns, with a column of ones behind them, as integers of any size."""
    m, d = z.shape
    low = z.min(axis=0)
    y = z.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, so exact
    bits = [max(1, int(x).bit_length()) for x in y.max(axis=0)] + [1]
    y = np.hstack([y, np.ones((m, 1), np.uint64)])
    dim = np.repeat(np.arange(d + 1), bits)
    first = np.cumsum(bits) - bits
    power = np.arange(len(dim)) - first[dim]
    planes = np.zeros((len(dim), -(-m // 64) * 8), dtype=np.uint8)
    for k in range(len(dim)):
        packed = np.packbits((y[:, dim[k]] >> np.uint64(power[k])) & np.uint64(1) != 0)
        planes[k, : len(packed)] = packed
    words = planes.view(np.uint64)
    wide = 2 * max(bits) + m.bit_length() > 62
    power = power.astype(object) if wide else power.astype(np.int64)
    cross = np.zeros((d + 1, d + 1), dtype=object if wide else np.int64)
    for k in range(len(dim)):
        i = dim[k]
        counts = np.bitwise_count(words[k] & words[first[i] :]).sum(axis=1, dtype=np.int64)
        weighted = counts.astype(object) * 2 ** (power[first[i] :] + power[k]) if wide else counts << (power[first[i] :] + power[k])
        cross[i, i:] += np.add.reduceat(weighted, first[i:] - first[i])
    cross = cross.astype(object)
    shift = np.append(low.astype(object), 0)
    total = cross[:, d].copy()
    return np.triu(cross + np.outer(shift, total) + np.outer(total, shift) + m * np.outer(shift, shift))


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the scatter matrices of a task's rows, for each length, in pieces of their rows."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for z in _blocks(batch):
            n = z.shape[1]
            totals[n] = totals[n] + scatter(z) if n in totals else scatter(z)
    for n, total in totals.items():
        yield _pieces([(n, i, b, total[i, b * PIECE : (b + 1) * PIECE]) for i in range(n + 1) for b in range(i // PIECE, n // PIECE + 1)])


def _pieces(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    d, i, b, values = zip(*rows, strict=True)
    return pa.record_batch([*[pa.array(x, pa.int32()) for x in (d, i, b)], pa.array([_to_limbs(v).tobytes() for v in values], pa.binary())], names=["d", "i", "b", "limbs"])


def _to_limbs(values: np.ndarray) -> np.ndarray:
    """Integers as limbs, the last one signed."""
    out = np.zeros((LIMBS, len(values)), dtype=np.int64)
    for k in range(LIMBS - 1):
        out[k] = (values & ((1 << LIMB) - 1)).astype(np.int64)
        values = values >> LIMB
    out[-1] = values.astype(np.int64)
    return out


def _of_limbs(limbs: np.ndarray) -> np.ndarray:
    values = limbs.reshape(LIMBS, -1).astype(object)
    return sum(values[k] * (1 << LIMB * k) for k in range(LIMBS))


def _added(rows: pa.Table) -> pa.Table:
    """One piece of one row of the matrix, added up over tasks."""
    total = np.zeros(len(rows.column("limbs")[0].as_py()) // 8, dtype=np.int64)
    for x in rows.column("limbs"):
        total += np.frombuffer(x.as_py(), dtype=np.int64)  # limbs leave room for 2**23 tasks
    return pa.Table.from_batches([_pieces([(*(rows.column(c)[0].as_py() for c in ("d", "i", "b")), _of_limbs(total))])])


@dataclass
class Fit:
    """n vectors with sums (of the integers less SHIFT); values and vectors of the leading components, and each one's share."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @staticmethod
    def of(total: np.ndarray) -> Fit:
        """From the scatter matrix with its column of ones."""
        d = len(total) - 1
        n, sums = total[d, d], total[:d, d]
        full = total[:d, :d] + np.triu(total[:d, :d], 1).T
        centred = n * full - np.outer(sums, sums)
        v = np.array([x / (n * n) for x in centred.ravel()], dtype=np.float64).reshape(d, d)  # rounded once
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
        trace = float(np.trace(v))
        k = min(d, COMPONENTS)
        return Fit(n, sums, values[:k], vectors[:, :k], values[:k] / trace if trace > 0 else np.zeros(k))

    def flat(self) -> np.ndarray:
        """Components along which the vectors do not differ, beyond rounding."""
        return self.values <= max(self.values[0], 0.0) * len(self.sums) * 1e-15

    def whiten(self, z: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviations, exact (null beyond 63 bits), and whitened components of integer vectors."""
        largest = (int(np.abs(z).max(initial=0)) * self.n + max(abs(s) for s in self.sums)) + 1
        if largest < LARGEST:
            gap = self.n * z - self.sums.astype(np.int64)
            deviation = (gap * gap).sum(axis=1).tolist()
            centred = gap / self.n
            beyond = np.flatnonzero(np.square(gap.astype(np.float64)).sum(axis=1) > LARGEST).tolist()
        else:
            gap = self.n * z.astype(object) - self.sums
            deviation = [None] * len(gap)
            centred = (gap / self.n).astype(np.float64)
            beyond = range(len(gap))
        for r in beyond:
            exact = sum(int(x) ** 2 for x in gap[r])
            deviation[r] = exact if exact < 1 << 63 else None
        flat = self.flat()
        out = centred @ self.vectors / np.sqrt(np.where(flat, 1.0, self.values))
        out[:, flat] = 0.0
        return deviation, out


def _products(fits: Broadcast) -> Callable:
    """Sums of the products of whitened components, and of the components, over a task's distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for z in _blocks(batch):
                w = np.hstack([fits.value[z.shape[1]].whiten(z)[1], np.ones((len(z), 1))])
                totals[z.shape[1]] = totals.get(z.shape[1], 0.0) + w.T @ w
        for d, total in totals.items():
            i, j = np.divmod(np.arange(total.size), len(total))
            yield pa.record_batch([pa.array(np.full(total.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["d", "i", "j", "x"])

    return run


def _output(fits: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in _integers(batch.column(1)):
                fit: Fit = fits.value[z.shape[1]]
                deviation, white = fit.whiten(z)
                k = white.shape[1]
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * k, fit.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(white.ravel()), pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(len(rows) * k, fit.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def fitted(vectors: DataFrame, embedding: str = "embedding") -> dict[int, Fit]:
    """The fit of the distinct integer vectors of each length. What reaches the driver grows with the dimensions only."""
    spark = vectors.sparkSession
    keys = vectors.select(F.col(f"`{embedding}`").cast("array<double>").alias("v")).mapInArrow(_keys, "d int, width int, body binary")
    distinct = written(keys.dropDuplicates(["d", "width", "body"]), "vectors")
    parts = distinct.mapInArrow(_scattered, "d int, i int, b int, limbs binary")
    totals: dict[int, np.ndarray] = {}
    for r in parts.groupBy("d", "i", "b").applyInArrow(_added, "d int, i int, b int, limbs binary").collect():
        total = totals.setdefault(r["d"], np.zeros((r["d"] + 1, r["d"] + 1), dtype=object))
        total[r["i"], r["b"] * PIECE : (r["b"] + 1) * PIECE] = _of_limbs(np.frombuffer(r["limbs"], dtype=np.int64))
    fits = {d: Fit.of(total) for d, total in totals.items()}
    shared = spark.sparkContext.broadcast(fits)
    products = distinct.mapInArrow(_products(shared), "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect()
    sums = {(r["d"], r["i"], r["j"]): r["x"] for r in products}
    for d, fit in fits.items():
        k = len(fit.values)
        kept = np.flatnonzero(~fit.flat())
        mean = np.array([sums[d, i, k] / fit.n for i in range(k)])
        covariance = np.array([[sums[d, i, j] / fit.n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        fit.identity_error = float(np.abs((covariance - np.eye(k))[np.ix_(kept, kept)]).max(initial=0.0))
    return fits


def whitened(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and leading component.

    Rows whose vector is null or has a null or non-finite entry are left out; an empty vector has no components.
    Other rows are all returned, repeated ones and null ids too, while the fit takes each distinct integer vector
    once. Vectors of each length are fitted by themselves. Entries beyond 2**62 / 64 count as that. A deviation
    beyond 63 bits is null. A component along which the vectors do not differ has whitened 0 and is not part of
    identity_error, which is measured on the whitened vectors of the fit. Without rows there are none; extra
    columns are not read.
    """
    spark = vectors.sparkSession
    fits = spark.sparkContext.broadcast(fitted(vectors, embedding))
    kind = vectors.schema[vec_id].dataType.simpleString()
    given = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    return given.mapInArrow(_output(fits), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_bit_sliced_scatter(embeddings: DataFrame) -> DataFrame:
    return whitened(embeddings.select("vec_id", "embedding"))
