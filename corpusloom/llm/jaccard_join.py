"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. MinHash bands bring texts together that may be similar; the MinHash values
of a pair are then compared in steps, and the pair goes as soon as the posterior probability (uniform prior) that
its similarity reaches the threshold falls below a tolerance. What is left is verified on the exact sets.

Equal texts are one class and enter once. A bucket or cluster of any size is dealt to tasks as pairs of blocks of
at most BLOCK texts, and a task returns, for each of its texts, the number of links and one root per component:
links are counted, not written out. The join runs twice over ever smaller parts: candidates without texts, whose
survivors make clusters; then the texts of clusters only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import with_struct, written
from corpusloom.llm.components import components
from corpusloom.llm.words import SPACED, encode, hashes, mix, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 30, 5
#: MinHash values compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 30, 1e-6
#: Texts in one block, and about the most bytes of them; a task sees at most two blocks at once.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Texts that are signed at a time, and about the most characters of them.
SIGNED, SIGNED_CHARS = 128, 4 << 20
#: A class that holds more than one in so many documents meets its documents by broadcast: there are fewer such classes.
HOT_CLASSES = 2000
#: Rows of slim tables that are still broadcast.
BROADCAST_ROWS = 1_000_000

N = BANDS * BAND_ROWS
_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(0, 1 << 32, N, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, N, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

RESULTS = ["class_id", "copy_id", "n_copies", "n_links", "n_linked_docs", "component"]


def least_matches(threshold: float, n: int, tolerance: float) -> int:
    """Fewest of n equal MinHash values at which P(similarity >= threshold) is at least the tolerance."""
    p = 0.0
    for m in range(n + 1):
        p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than five words has one, of all its words."""
    h, counts = hashes(encode(texts, SPACED))
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(shingles(h[at : at + n], min(SHINGLE, n))) if n else np.zeros(0, dtype=np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row for each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), N), dtype=np.uint32)
    for i in range(N):
        v = x * _A[i]
        v ^= v >> np.uint32(16)
        v *= _B[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def _band_keys(values: np.ndarray) -> np.ndarray:
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(values), axis=0)
    for r in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r::BAND_ROWS])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            most = SIGNED_CHARS + (chars[a - 1] if a else 0)
            piece = batch.slice(a, max(1, min(SIGNED, int(np.searchsorted(chars, most, side="right")) - a)))
            a += piece.num_rows
            sets = shingle_sets(piece.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                values = signatures([sets[i] for i in full])
                # 16 bits of each value do for comparing: unequal values agree on them once in 65536 times
                short = (values & np.uint32(0xFFFF)).astype("<u2")
                keys = _band_keys(values)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch([piece.column(0).take(pa.array(full)), pa.array([r.tobytes() for r in short], pa.binary()), bands], names=["node", "sig", "bands"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in pieces that never cut a group, with a number for each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            column = t[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(pc.equal(held[0].column(k)[0], batch.column(k)[batch.num_rows - 1]).as_py() for k in keys):
            continue  # one group so far
        t = pa.Table.from_batches(held)
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, numbered(t)


def _pairs(group: np.ndarray, cross: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, distance by distance; in a cross group only between its two sides."""
    for k in range(1, len(group)):
        same = group[:-k] == group[k:]
        if not same.any():
            return
        i = np.flatnonzero(same & (~cross[:-k] | (side[:-k] != side[k:])))
        if len(i):
            yield i, i + k


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step of the comparison drops."""
    matched = np.zeros(len(i), dtype=np.int32)
    for step, most in enumerate(least):
        a = step * STEP
        matched += (sig[i, a : a + STEP] == sig[j, a : a + STEP]).sum(axis=1, dtype=np.int32)
        keep = matched >= most
        i, j, matched = i[keep], j[keep], matched[keep]
        if not len(i):
            break
    return i, j


class _Roots:
    """Union-find over the rows of a batch; labels are the lowest rows."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        if not apart.any():
            return
        parent = self.label
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        self.label = parent


def _signature_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), dtype="<u2").reshape(t.num_rows, N)


def _taken(values: pa.Array, places: np.ndarray) -> pa.Array:
    out = values.take(pa.array(places))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _prune(least: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, ["bucket", "x", "y"]):
            sig, node = _signature_rows(t), t["node"].combine_chunks()
            cross, side = t["x"].to_numpy() != t["y"].to_numpy(), t["block"].to_numpy() == t["x"].to_numpy()
            roots = _Roots(t.num_rows)
            for i, j in _pairs(group, cross, side):
                apart = roots.label[i] != roots.label[j]  # a tree of survivors is enough here
                if apart.any():
                    roots.join(*_survivors(sig, i[apart], j[apart], least))
            linked = np.flatnonzero(roots.label != np.arange(t.num_rows))
            yield pa.record_batch([_taken(node, linked), _taken(node, roots.label[linked])], names=["a", "b"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over a few thousand shingles at a time."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    use = shared[inverse]
    row, column = row[use], rank[inverse[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        m = np.zeros((len(sets), min(4096, int(shared.sum()) - a)), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)  # exact: counts stay below 2**24


def _verify(least: list[int], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, ["cluster", "x", "y"]):
            sig, node, copies = _signature_rows(t), t["node"].combine_chunks(), t["n_copies"].to_numpy()
            x, block = t["x"].to_numpy(), t["block"].to_numpy()
            cross, side = x != t["y"].to_numpy(), block == x
            n_links, n_docs = np.zeros(t.num_rows, dtype=np.int64), np.zeros(t.num_rows, dtype=np.int64)
            roots = _Roots(t.num_rows)
            bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), t.num_rows)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = shingle_sets(t["text"].slice(a, b - a).to_pylist())
                sizes = np.array([len(s) for s in sets])
                both = _intersections(sets)
                for i, j in _pairs(group[a:b], cross[a:b], side[a:b]):
                    i, j = _survivors(sig[a:b], i, j, least)
                    k = both[i, j]
                    real = k >= threshold * (sizes[i] + sizes[j] - k) - 1e-9
                    i, j = i[real] + a, j[real] + a
                    n_links += np.bincount(i, minlength=t.num_rows) + np.bincount(j, minlength=t.num_rows)
                    np.add.at(n_docs, i, copies[j])
                    np.add.at(n_docs, j, copies[i])
                    roots.join(i, j)
            got = np.flatnonzero(n_links)
            yield pa.record_batch([_taken(node, got), _taken(node, roots.label[got]), pa.array(n_links[got]), pa.array(n_docs[got])], names=["node", "root", "n_links", "n_linked_docs"])

    return run


def _dealt(members: DataFrame, key: str, n_blocks: Column) -> DataFrame:
    """members with their block and once for every pair of blocks (x <= y) that their block is in."""
    out = members.withColumn("_n", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_n")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "_n")
    return out.repartition(F.col(key), F.col("x"), F.col("y")).sortWithinPartitions(key, "x", "y", "node")


def _node(text: Column) -> Column:
    """What tells texts apart: 128 bits, so that no two of even 10**12 texts meet by chance."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def linked(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with class_id, copy_id, n_copies, n_links, n_linked_docs and component.

    copy_id is the lowest id among documents of equal text and n_copies their number; n_links is the number of
    different texts whose similarity to this one reaches the threshold and n_linked_docs the number of their
    documents; class_id is the lowest id in the component of links and copies, and component a key of that component
    which does not rest on ids. A null text is the empty one;
    texts without words link to none. A null id is never the lowest unless a class has no other. Repeated rows
    are copies; an empty table stays empty; columns of docs with the names of results are replaced.
    """
    least = [least_matches(threshold, n, tolerance) for n in range(STEP, N + 1, STEP)]
    ids = F.col(f"`{doc_id}`")
    slim = docs.select(_node(F.col(f"`{text}`")).alias("node"), ids.alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    classes = written(slim.groupBy("node").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"), F.max(F.octet_length("text")).cast("long").alias("bytes")), "classes")
    signed = written(slim.select("node", "text").mapInArrow(_sign, "node binary, sig binary, bands array<long>").dropDuplicates(["node"]), "signatures")

    banded = signed.select("node", F.explode("bands").alias("bucket"))
    # buckets of equal members hold the same pairs: one of them is enough
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("q")).where("n > 1")
    buckets = written(buckets.groupBy("n", "p", "q").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    members = banded.join(_small(buckets), "bucket")
    candidates = members.join(signed.select("node", "sig"), "node")
    survivors = _dealt(candidates, "bucket", F.ceil(F.col("n") / BLOCK)).drop("n").mapInArrow(_prune(least), "a binary, b binary")
    clusters = components(survivors)

    known = clusters.join(classes, "node")
    sizes = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("n"))
    wanted = written(known.join(sizes, "component").withColumnRenamed("component", "cluster").drop("bytes"), "clusters")
    chosen = slim.withColumnRenamed("node", "own").join(_small(wanted), (F.col("id").eqNullSafe(F.col("copy_id"))) & (F.col("own") == F.col("node")))
    texts = chosen.drop("own", "id", "copy_id").dropDuplicates(["node"]).join(signed.select("node", "sig"), "node")
    found = _dealt(texts, "cluster", F.col("n")).drop("n").mapInArrow(_verify(least, threshold), "node binary, root binary, n_links long, n_linked_docs long")
    found = written(found, "links")
    counted = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.join(counted, "node", "left").join(parts, "node", "left")
    lowest = joined.where("component is not null").groupBy("component").agg(F.min("copy_id").alias("class_id"))
    result = joined.join(lowest, "component", "left").select(
        F.col("node").alias("_node_"),
        "n_copies",
        F.struct(
            F.when(F.col("component").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
            "copy_id",
            "n_copies",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
            F.coalesce("component", "node").alias("component"),
        ).alias("_links_"),
    )
    result = written(result, "results")
    bound = (result.agg(F.sum("n_copies").alias("n")).first()["n"] or 0) / HOT_CLASSES
    hot = result.where(F.col("n_copies") > bound).select(F.col("_node_").alias("_hot_"), F.col("_links_").alias("_known_"))  # fewer than HOT_CLASSES rows
    own = docs.withColumn("_own_", _node(F.col(f"`{text}`"))).join(F.broadcast(hot), F.col("_own_") == F.col("_hot_"), "left")
    # a document that has its answer goes anywhere: its key is no text's
    own = own.withColumn("_key_", F.when(F.col("_hot_").isNull(), F.col("_own_")).otherwise(F.unhex(F.hex(F.monotonically_increasing_id()))))
    out = own.join(result.where(F.col("n_copies") <= bound).drop("n_copies"), F.col("_key_") == F.col("_node_"), "left")
    return with_struct(out, F.coalesce("_known_", "_links_"), RESULTS, docs.columns)


def op2_jaccard_join(docs: DataFrame) -> DataFrame:
    return linked(docs.select("doc_id", "text")).select("doc_id", *RESULTS[:-1])


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, min(doc_id) AS copy_id, count(*) AS n_copies FROM d GROUP BY t),
w AS (SELECT copy_id, n_copies, [x for x in regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM c),
s AS (SELECT DISTINCT copy_id, n_copies, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT copy_id, any_value(n_copies) AS n_copies, count(*) AS n FROM s GROUP BY copy_id),
k AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.copy_id <> b.copy_id GROUP BY ALL),
e AS (SELECT a, b, y.n_copies AS m FROM k JOIN n x ON x.copy_id = a JOIN n y ON y.copy_id = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9),
r AS (SELECT DISTINCT a AS v, a AS root FROM e UNION SELECT e.b AS v, r.root FROM r JOIN e ON e.a = r.v),
o AS (SELECT v, min(root) AS class_id FROM r GROUP BY v),
l AS (SELECT a, count(*) AS n_links, sum(m)::BIGINT AS n_linked_docs FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, copy_id) AS class_id, copy_id, n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM d JOIN c USING (t) LEFT JOIN l ON a = copy_id LEFT JOIN o ON v = copy_id
"""
