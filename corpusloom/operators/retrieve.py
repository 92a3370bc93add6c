"""Evidence retrieval: direct and semantic hits, their merging, context windows, and batches of entities."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored

TOP_N, LEAST_SCORE = 10, 0.60


def l2_normalised(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def direct_hits(sentences: DataFrame, entities: DataFrame, top_n: int | None = TOP_N) -> DataFrame:
    """The first top_n sentences of a document that hold an entity's name (None: all): doc_id, entity, index, score 1.0."""
    both = sentences.join(entities, "doc_id").where((F.col("entity") != "") & F.contains("content", F.col("entity")))
    first = both if top_n is None else ranked(both, ["doc_id", "entity"], [F.col("index")]).where(F.col("rank") <= top_n)
    return first.select("doc_id", "entity", "index", F.lit(1.0).alias("score"), F.lit("direct").alias("match_type"))


def direct_hits_in(docs: DataFrame, sentences: str = "sentences", names: str = "names", top_n: int | None = TOP_N) -> DataFrame:
    """direct_hits() of documents that hold their sentences and their entities' names in arrays: doc_id, entity, index, content, score.

    Names are looked for in the document's row, and only hits leave it, so nothing is exchanged.
    """

    def hits(name: Column) -> Column:
        found = F.filter(sentences, lambda s: F.contains(s["content"], name))
        return found if top_n is None else F.slice(found, 1, top_n)

    wanted = F.filter(F.array_distinct(F.col(names)), lambda n: n.isNotNull() & (n != ""))
    each = docs.select("doc_id", F.explode(F.transform(wanted, lambda n: F.struct(n.alias("entity"), hits(n).alias("hits")))).alias("e"))
    return each.select("doc_id", "e.entity", F.explode("e.hits").alias("h")).select("doc_id", "entity", "h.index", "h.content", F.lit(1.0).alias("score"), F.lit("direct").alias("match_type"))


#: Sentences and entities of one tile: a pair of tiles is one product.
SENTENCE_TILE, ENTITY_TILE = 4096, 1024


def _tiled(rows: DataFrame, item: str, vector: str, most: int, prefix: str) -> DataFrame:
    """Whole vectors of each document in tiles of about so many: doc_id, tile, the document's number of tiles, width and rows."""
    v = F.col(vector)
    whole = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select("doc_id", F.col(item).alias("item"), v.cast("array<double>").alias("v"))
    n = whole.groupBy("doc_id").agg(F.ceil(F.count("*") / most).alias("n_tiles"))
    placed = whole.join(n, "doc_id").withColumn("tile", F.pmod(F.xxhash64("item", "v"), F.col("n_tiles")))
    tiles = placed.groupBy("doc_id", "tile", "n_tiles", F.size("v").alias("width")).agg(F.collect_list(F.struct("item", "v")).alias("rows"))
    return tiles.select("doc_id", *[F.col(c).alias(prefix + c) for c in ("tile", "n_tiles", "width", "rows")])


def _best_in_tiles(k: int, least: float, margin: float = 1e-9) -> Callable:
    """For each pair of tiles (doc_id, sentences, entities) the k best sentences of every entity that reach least: a product chooses, exact cosines rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (own, v), (names, q) = ((side.field("item"), side.field("v")) for side in (batch.column(c)[i].values for c in (1, 2)))
                v, q = (m.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for m, x in ((v, own), (q, names)))
                v_norm, q_norm = np.sqrt(_in_order(v, v)), np.sqrt(_in_order(q, q))
                scale = lambda n: np.where(n == 0, 1.0, n)
                score = (q / scale(q_norm)[:, None]) @ (v / scale(v_norm)[:, None]).T
                top = min(k, score.shape[1])
                worst = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
                at, of = np.nonzero(score >= np.maximum(worst, least)[:, None] - margin)
                norms = v_norm[of] * q_norm[at]
                exact = np.where(norms == 0, 0.0, _in_order(v[of], q[at]) / scale(norms))
                order = np.lexsort((own.to_numpy(zero_copy_only=False)[of], -exact, at))
                at, of, exact = at[order], of[order], exact[order]
                kept = (np.arange(len(at)) - np.searchsorted(at, at) < k) & (exact >= least)
                at, of, exact = at[kept], of[kept], exact[kept]
                doc = batch.column(0).take(pa.array(np.full(len(at), i)))
                yield pa.record_batch([doc, names.take(pa.array(at)), own.take(pa.array(of)), pa.array(exact)], names=["doc_id", "entity", "index", "score"])

    return run


def semantic_hits(sentences: DataFrame, entities: DataFrame, direct: DataFrame, top_n: int = TOP_N, least: float = LEAST_SCORE) -> DataFrame:
    """Direct hits, then the best other sentences by cosine (score, then index), top_n in all.

    Entities whose direct hits fill top_n need no vectors and are left out of the similarity join. The others meet
    their document's sentences in pairs of tiles, spread over tasks by the sentences' tile, as matrix products; of
    each pair twice top_n sentences are enough, since fewer than top_n of them are direct hits. Vectors that are null
    or hold null or NaN, or of another width, have no score.
    """
    counts = direct.groupBy("doc_id", "entity").agg(F.count("*").alias("n"))
    open_ = entities.join(counts.where(F.col("n") >= top_n), ["doc_id", "entity"], "left_anti")
    s, e = _tiled(sentences, "index", "sentence_vector", SENTENCE_TILE, "s_"), _tiled(open_, "entity", "entity_vector", ENTITY_TILE, "e_")
    places = s.select("doc_id", "s_tile", F.col("s_width").alias("e_width")).join(e.select("doc_id", "e_tile", "e_width"), ["doc_id", "e_width"])
    pairs = places.join(e, ["doc_id", "e_tile", "e_width"]).withColumnRenamed("e_width", "s_width").join(s, ["doc_id", "s_tile", "s_width"]).select("doc_id", "s_rows", "e_rows")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((sentences, "doc_id"), (entities, "entity"), (sentences, "index"))) + ", score double"
    scored = pairs.mapInArrow(_best_in_tiles(2 * top_n, least), schema).join(direct, ["doc_id", "entity", "index"], "left_anti")
    both = direct.unionByName(scored.withColumn("match_type", F.lit("semantic")))
    order = [F.col("match_type"), F.when(F.col("match_type") == "direct", F.col("index")), F.desc("score"), F.col("index")]
    return ranked(both, ["doc_id", "entity"], order).where(F.col("rank") <= top_n)


def merged_hits(hits: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Hits of an entity's aliases as one list: the best of each sentence, direct first, cut to top_n, by index."""
    direct = F.col("match_type") == "direct"
    best = ranked(hits, ["doc_id", "entity", "index"], [F.desc(direct), F.desc("score"), F.col("alias")], "n").where("n = 1").drop("n")
    return ranked(best, ["doc_id", "entity"], [F.desc(direct), F.desc("score"), F.col("index")]).where(F.col("rank") <= top_n)


def local_context(sentences: DataFrame, mentions: DataFrame, window: int = 1, most_chars: int = 2000) -> DataFrame:
    """Sentences around an entity's mentions (doc_id, entity, index), in order, up to most_chars; the first always stays."""
    around = mentions.select("doc_id", "entity", F.explode(F.sequence(F.col("index") - window, F.col("index") + window)).alias("index")).distinct()
    w = W.partitionBy("doc_id", "entity").orderBy("index")
    out = around.join(sentences, ["doc_id", "index"]).withColumns({"so_far": F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, 0)), "n": F.row_number().over(w)})
    return out.where((F.col("so_far") <= most_chars) | (F.col("n") == 1)).select("doc_id", "entity", "index", "content", "so_far")


def evidence_text(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The text of chosen sentences in index order."""
    rows = F.array_sort(F.collect_set(F.struct("index", "content")))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n").alias("context"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set that is in the other; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def overlap_pairs(evidence: DataFrame, group: str, entity: str, item: str) -> DataFrame:
    """Overlap of all pairs of entities of a group that share an item: left, right, shared, overlap."""
    rows = evidence.select(group, entity, item).distinct()
    sizes = rows.groupBy(group, entity).agg(F.count("*").alias("n"))
    left, right = rows.withColumnRenamed(entity, "left"), rows.withColumnRenamed(entity, "right")
    shared = left.join(right, [group, item]).where("left < right").groupBy(group, "left", "right").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.withColumnsRenamed({entity: "left", "n": "n_left"}), [group, "left"]).join(sizes.withColumnsRenamed({entity: "right", "n": "n_right"}), [group, "right"])
    return out.select(group, "left", "right", "shared", (F.col("shared") / F.least("n_left", "n_right")).alias("overlap"))


def deduplicated_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One hit for each key: the best score, the first on ties."""
    return ranked(hits, keys, [F.desc("score"), F.col("seq")], "n").where("n = 1").drop("n")


_BATCHES = "doc_id long, batch int, place int, entity string, context_chars long"


def _shared_batches(found: list[dict], most: int, least: float, limit: int, once: bool = True) -> Iterator[list[int]]:
    """Batches of entities (each a map from sentence to characters) around the first ones left, as lists of places.

    With a positive overlap only entities that occur in a sentence of the first one can follow it, so these are
    looked up by sentence, and no other pair is compared. The overlap with an entity without sentences is 0. Shared
    sentences count once towards the limit, or each time.
    """
    by_sentence: dict = {}
    for place, sentences in enumerate(found):
        for s in sentences:
            by_sentence.setdefault(s, []).append(place)
    free = [True] * len(found)
    for first, sentences in enumerate(found):
        if not free[first]:
            continue
        free[first] = False
        near = {k for s in sentences for k in by_sentence[s]} if least > 0 else set(range(len(found)))
        batch, context, spent = [first], set(sentences), sum(sentences.values())
        for k in sorted(k for k in near if free[k]):
            if len(batch) == most:
                break
            alike = all(len(found[k].keys() & found[m].keys()) / max(1, min(len(found[k]), len(found[m]))) >= least for m in batch)
            added = sum(n for s, n in found[k].items() if not once or s not in context)
            if alike and spent + added <= limit:
                batch.append(k)
                free[k] = False
                context |= found[k].keys()
                spent += added
        yield batch


def _row_batches(found: list[dict], most: int, limit: int, once: bool = True) -> Iterator[list[int]]:
    """Batches in input order, closed where one more entity would break a limit; one that is too large stands alone."""
    start, context, spent = 0, set(), 0
    for place, sentences in enumerate(found):
        added = sum(n for s, n in sentences.items() if not once or s not in context)
        if place > start and (place - start == most or spent + added > limit):
            yield list(range(start, place))
            start, context, spent, added = place, set(), 0, sum(sentences.values())
        context |= sentences.keys()
        spent += added
    if found:
        yield list(range(start, len(found)))


def context_chars(found: list[dict], batch: list[int], once: bool = True) -> int:
    """Characters of a batch's sentences, shared ones once or each time."""
    if not once:
        return int(sum(sum(found[k].values()) for k in batch))
    union: dict = {}
    for k in reversed(batch):
        union |= found[k]
    return int(sum(union.values()))


def _batched(most: int, least: float | None, limit: int) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in frames:
            out = []
            held = rows.column(1)
            bounds, entities = held.offsets.to_pylist(), held.values
            all_names = entities.field("entity").to_pylist()
            # the ids and characters of all entities of a batch become Python's at once, not entity by entity
            ids, chars = ((entities.field(c).offsets.to_pylist(), entities.field(c).values.to_pylist()) for c in ("ids", "chars"))
            pick = lambda told, k: told[1][told[0][k] : told[0][k + 1]]
            for i in range(rows.num_rows):
                known = {all_names[k]: dict(zip(pick(ids, k), pick(chars, k), strict=True)) for k in range(bounds[i], bounds[i + 1])}
                names, found = list(known), list(known.values())
                batches = _row_batches(found, most, limit) if least is None else _shared_batches(found, most, least, limit)
                for number, batch in enumerate(batches):
                    spent = context_chars(found, batch)
                    out += [(i, number, place, names[k], spent) for place, k in enumerate(batch)]
            owner, *columns = zip(*out, strict=True) if out else ([],) * 5
            kinds = (pa.int32(), pa.int32(), entities.field("entity").type, pa.int64())
            yield pa.record_batch([rows.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "batch", "place", "entity", "context_chars"])

    return run


def evidence_batches(evidence: DataFrame, max_entities: int = 3, min_overlap: float | None = 0.4, max_chars: int = 8000) -> DataFrame:
    """Entities of a document in batches with shared evidence; evidence has doc_id, entity, seq, ids and chars.

    A batch starts with the first entity left and takes those that overlap with all its members, within the
    limits of entities and characters. Without min_overlap batches are cut in input order. The greedy order is
    sequential within a document, so one row holds a document's entities.
    """
    rows = evidence.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "entity", "ids", "chars"))).alias("entities"))
    return rows.mapInArrow(_batched(max_entities, min_overlap, max_chars), _BATCHES)


def _packed(rows: int) -> Callable:
    """Rows of an id and a vector as blocks of so many: ids, width, a matrix of float64 and the block's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def block(width: int) -> pa.RecordBatch:
            ids, vectors = held.pop(width)
            matrix = np.array(vectors, dtype="<f8").tobytes()
            return pa.record_batch([pa.array([ids], pa.list_(kind)), pa.array([width], pa.int32()), pa.array([matrix], pa.binary()), pa.array([next(numbers)], pa.int64())], names=["ids", "width", "matrix", "block"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for one, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(one)
                vectors.append(vector)
                if len(ids) == rows:
                    yield block(len(vector))
        for width in list(held):
            yield block(width)

    return run


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, added from the first to the last: equal vectors have equal sums wherever they stand."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _best_pairs(k: int, margin: float = 1e-9) -> Callable:
    """For each pair of blocks the k best vectors of every query: a matrix product chooses, exact cosines rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, width, matrix), (query_ids, query_width, query_matrix) = ([batch.column(c)[i] for c in cs] for cs in ((0, 1, 2), (3, 4, 5)))
                if width.as_py() != query_width.as_py():
                    continue
                v, q = (np.frombuffer(m.as_py(), dtype="<f8").reshape(len(x), width.as_py()) for m, x in ((matrix, ids), (query_matrix, query_ids)))
                v_norm, q_norm = np.sqrt(_in_order(v, v)), np.sqrt(_in_order(q, q))
                scale = lambda n: np.where(n == 0, 1.0, n)
                score = (q / scale(q_norm)[:, None]) @ (v / scale(v_norm)[:, None]).T
                own, own_query = np.array(ids.as_py()), np.array(query_ids.as_py())
                score[own_query[:, None] == own[None, :]] = -np.inf
                top = min(k, score.shape[1])
                least = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
                at, of = np.nonzero((score >= least[:, None] - margin) & np.isfinite(score))
                exact = np.empty(len(at))
                for a in range(0, len(at), 1 << 16):
                    x, y = at[a : a + (1 << 16)], of[a : a + (1 << 16)]
                    norms = v_norm[y] * q_norm[x]
                    exact[a : a + (1 << 16)] = np.where(norms == 0, 0.0, _in_order(v[y], q[x]) / scale(norms))
                order = np.lexsort((own[of], -exact, at))
                at, of, exact = at[order], of[order], exact[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                kept = place < k
                columns = [query_ids.values.take(pa.array(at[kept])), ids.values.take(pa.array(of[kept])), pa.array(exact[kept])]
                yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """The k most similar vectors (vec_id, embedding) of each query (query_id, query_vector), by cosine, then id.

    allowed restricts the vectors first. Both sides are packed where they lie into blocks of rows, which are stored;
    every block of queries meets every block of vectors once, by their numbers, as a matrix product, and at most k
    rows a query leave a pair of blocks. Rows with a null id, a null vector or one that holds a null or NaN are left out, and vectors of another width
    than the query's; a zero vector has cosine 0.
    """
    if allowed is not None:
        vectors = vectors.join(allowed, "vec_id", "left_semi")

    def packed(df: DataFrame, row_id: str, vector: str, prefix: str) -> DataFrame:
        kind = df.schema[row_id].dataType.simpleString()
        whole = df.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
        blocks = whole.select(row_id, F.col(vector).cast("array<double>")).mapInArrow(_packed(block), f"ids array<{kind}>, width int, matrix binary, block long")
        return stored(blocks.toDF(*[prefix + c for c in blocks.columns]), "blocks")

    v, q = packed(vectors, "vec_id", "embedding", "v_"), packed(queries, "query_id", "query_vector", "q_")
    numbers = v.select("v_block", "v_width").join(q.select("q_block", "q_width"), F.col("v_width") == F.col("q_width")).select("v_block", "q_block")
    pairs = numbers.join(v, "v_block").join(q, "q_block").select("v_ids", "v_width", "v_matrix", "q_ids", "q_width", "q_matrix")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    return ranked(pairs.mapInArrow(_best_pairs(k), schema), ["query_id"], [F.desc("score"), F.col("vec_id")]).where(F.col("rank") <= k)
