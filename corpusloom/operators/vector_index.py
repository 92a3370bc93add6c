"""An inverted index of vectors: cells by k-means on a bounded sample, every vector in a cell, exact or probed search.

Cells are found on at most SAMPLE vectors with the lowest hashes of their ids; all vectors are then put into the cell
whose centre is nearest by angle. A search looks into the PROBES nearest cells first. No vector of a cell can be
nearer to a query than the angle to the cell's centre less the cell's widest angle, so an exact search then looks
into those cells alone that may still hold one of the k best: it returns what a search over all vectors returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.retrieve import _best_pairs, ranked
from corpusloom.sources.shared import stored

#: Bounds of the sample that the cells are fitted on, and of their number.
SAMPLE, MOST_CELLS = 20_000, 1024
ROUNDS = 12
#: Cells that an exact search looks into before its bounds, and the share of cells that a probed one looks into: as much as vectors without clusters need for nine of ten hits.
PROBES, PROBED = 8, 2 / 3
#: Vectors that meet queries as one product.
BLOCK = 1024
#: Queries that meet all centres at once, and bytes of vectors that go out in one batch: each query goes out once for every cell that it asks.
ASKING, OUT_BYTES = 256, 16 << 20
#: Slack of a bound, for rounding.
SLACK = 1e-9


@dataclass
class Index:
    """Centres (cells x width, of length 1), the widest angle of each cell, and the vectors with their cell, stored."""

    centres: np.ndarray
    widest: np.ndarray
    vectors: DataFrame


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def fitted_centres(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centres of cells by angle: k-means on unit vectors, from distinct rows drawn at random."""
    unit = np.unique(_unit(sample), axis=0)
    r = np.random.default_rng(seed)
    centres = unit[r.choice(len(unit), size=min(cells, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(unit[a : a + BLOCK] @ centres.T).argmax(axis=1) for a in range(0, len(unit), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        kept = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(kept[:, None], _unit(sums), centres)
    return centres


def _usable(df: DataFrame, row_id: str, vector: str, width: int) -> DataFrame:
    """Rows with an id and a whole vector of the width, as doubles."""
    v = F.col(vector)
    return df.where(F.col(row_id).isNotNull() & v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).withColumn(vector, v.cast("array<double>"))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _placed(centres: Broadcast) -> Callable:
    """Adds each vector's cell and its angle to the centre; a zero vector is at a right angle to every centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, BLOCK):
            v = _unit(batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy().reshape(batch.num_rows, -1))
            near = v @ centres.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return run


def _drawn(rows: DataFrame, n: int) -> np.ndarray:
    """The SAMPLE vectors of n with the lowest hashes of their ids.

    Each task would hand its own SAMPLE lowest rows to the driver, which is every row of a large table. So only rows
    below a hash that about SAMPLE of them are below are sorted; where ids repeat so much that fewer are, the hash is
    raised, and where more are, each task's hand is no larger than before.
    """
    hashed = rows.select("embedding", F.xxhash64(F.col("vec_id").cast("string")).alias("h"))
    share = min(1.0, 1.1 * SAMPLE / max(n, 1))
    while True:
        low = hashed if share >= 1 else hashed.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
        found = low.orderBy("h", "embedding").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        if share >= 1 or len(found) >= SAMPLE:
            return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.empty((0, 0))
        share = min(1.0, 4 * share)


def built(vectors: DataFrame, cells: int | None = None) -> Index | None:
    """The index of vectors (vec_id, embedding and any others); None without usable vectors.

    Vectors of the commonest width are indexed (of equally common ones the least); others, and those with null or
    NaN entries, are left out, as are null ids. The number of cells is the root of the number of vectors.
    """
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    widths = whole.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths or not widths[0]["w"]:
        return None
    rows = _usable(vectors, "vec_id", "embedding", widths[0]["w"])
    drawn = _drawn(rows, widths[0]["n"])
    if not len(drawn):
        return None
    n = cells or max(1, min(MOST_CELLS, round(widths[0]["n"] ** 0.5)))
    spark = vectors.sparkSession
    centres = fitted_centres(drawn, n)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, angle double"
    lists = stored(rows.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), schema), "lists")
    found = {r["cell"]: r["a"] for r in lists.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row for each cell
    return Index(centres, np.array([found.get(c, -1.0) for c in range(len(centres))]), lists)


def _cells_of(index: Broadcast, probes: int, rest: bool) -> Callable:
    """Cells to look into for each query: the nearest ones, or those beyond them that may hold a better vector than worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, widest = index.value
        for batch in _pieces(batches, ASKING):
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            zero = ~q.any(axis=1)
            angle = np.arccos(np.clip(_unit(q) @ centres.T, -1, 1))
            order = np.argsort(np.where(widest < 0, np.inf, angle), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(q), axis=0), axis=1)
            asked = place < probes
            if rest:
                best = np.cos(np.maximum(angle - widest[None, :], 0.0))
                best = np.where(zero[:, None] | (widest[None, :] >= np.pi / 2), np.maximum(best, 0.0), best)  # a zero vector has cosine 0
                worst = batch.column(2).to_numpy(zero_copy_only=False)
                asked = ~asked & (np.isnan(worst)[:, None] | (best >= worst[:, None] - SLACK))
            at, cell = np.nonzero(asked & (widest >= 0)[None, :])
            most = max(1, OUT_BYTES // (8 * q.shape[1]))
            for a in range(0, len(at), most):
                asking = pa.array(at[a : a + most])
                yield pa.record_batch([batch.column(0).take(asking), batch.column(1).take(asking), pa.array(cell[a : a + most].astype(np.int32))], names=["query_id", "query_vector", "cell"])

    return run


def _blocks(rows: DataFrame, row_id: str, vector: str, prefix: str) -> DataFrame:
    """Rows of each cell in blocks of BLOCK: ids, width and matrix."""
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batch: pa.Table) -> pa.Table:
        matrix = np.array(batch.column(vector).to_pylist(), dtype="<f8")
        return pa.table({"cell": pa.array([batch.column("cell")[0].as_py()], pa.int32()), "ids": pa.array([batch.column(row_id).to_pylist()], pa.list_(batch.schema.field(row_id).type)), "width": pa.array([matrix.shape[1]], pa.int32()), "matrix": pa.array([matrix.tobytes()], pa.binary())})

    tiled = rows.withColumn("tile", F.pmod(F.xxhash64(F.col(row_id).cast("string")), F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))))
    out = tiled.select("cell", "tile", row_id, vector).groupBy("cell", "tile").applyInArrow(run, f"cell int, ids array<{kind}>, width int, matrix binary")
    return out.select("cell", *[F.col(c).alias(prefix + c) for c in ("ids", "width", "matrix")])


def _sized(rows: DataFrame) -> DataFrame:
    """rows with the number of rows of their cell, by which the cell is cut into blocks."""
    return rows.join(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell")


def _looked_up(asked: DataFrame, lists: DataFrame, k: int, schema: str) -> DataFrame:
    pairs = lists.join(_blocks(_sized(asked), "query_id", "query_vector", "q_"), "cell").select("v_ids", "v_width", "v_matrix", "q_ids", "q_width", "q_matrix")
    return pairs.mapInArrow(_best_pairs(k), schema)


def search(index: Index, queries: DataFrame, k: int, allowed: DataFrame | None = None, exact: bool = True, probes: int | None = None) -> DataFrame:
    """The k most similar vectors of each query (query_id, query_vector): query_id, vec_id, score and rank, by cosine, then id.

    allowed (vec_id) restricts the vectors before the search. With exact the result is that of all vectors; without
    it only the probed cells are looked into, and all cells for a query that finds fewer than k there. A vector is no
    hit of a query of its own id. Queries that are null, not whole or of another width find nothing.
    """
    spark = queries.sparkSession
    probes = probes or (PROBES if exact else int(np.ceil(PROBED * len(index.centres))))
    shared = spark.sparkContext.broadcast((index.centres, index.widest))
    width = index.centres.shape[1]
    kind, vec_kind = queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["vec_id"].dataType.simpleString()
    asked = stored(_usable(queries, "query_id", "query_vector", width).select("query_id", "query_vector"), "queries")
    kept = index.vectors if allowed is None else index.vectors.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    lists = stored(_blocks(_sized(kept.select("cell", "vec_id", "embedding")), "vec_id", "embedding", "v_"), "lists")
    schema, cells = f"query_id {kind}, vec_id {vec_kind}, score double", f"query_id {kind}, query_vector array<double>, cell int"
    best = lambda found: ranked(found, ["query_id"], [F.desc("score"), F.col("vec_id")]).where(F.col("rank") <= k)
    first = stored(best(_looked_up(asked.mapInArrow(_cells_of(shared, probes, False), cells), lists, k, schema)).drop("rank"), "probed")
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    open_ = asked.join(worst, "query_id", "left").select("query_id", "query_vector", F.when(F.col("n") == k, F.col("worst")).otherwise(F.lit(float("nan"))).alias("worst"))
    if not exact:
        open_ = open_.where(F.isnan("worst"))
    further = _looked_up(open_.mapInArrow(_cells_of(shared, probes, True), cells), lists, k, schema)
    return best(first.unionByName(further))
