"""Benchmark decontamination by a prefix-filtered set join.

Windows of item words (ten, or a shorter item whole) are sets of shingles. A window that occurs in a document
has all its shingles there, so its necessary prefix is one shingle: the rarest, by exact counts over all
documents. Documents join windows on that shingle alone. A joined pair gives the window's only possible place
(positional bound) and must leave room for its length (length bound); the words are then compared one by one.

The windows are the fixed side. They go to the executors in blocks of bounded bytes, and the documents pass
all blocks in one job; no document is moved or grouped, so copies and common passages cannot pile up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fold_ascii, with_struct
from corpusloom.llm.words import ALNUM, encode, hashes, shingles

WINDOW = 10
SHINGLE = 5
#: Most bytes of window words in one block; a benchmark of more has more blocks.
BLOCK_BYTES = 32 << 20

RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "item_ids", "hit_from", "hit_to", "contaminated"]


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows with their words and the sorted distinct ids (as strings) of the items they stand in."""
    folded = fold_ascii(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    words = F.expr(r"regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    split = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), folded.alias("t")).select("item", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = split.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, window), " "))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class _Index:
    """One block of windows, found by the hash of a shingle of theirs."""

    def __init__(self, rows: list) -> None:
        self.words = [r["words"].encode().split() for r in rows]
        self.items = [list(r["items"]) for r in rows]
        whole, counts = hashes([r["words"].encode() for r in rows])
        ends = np.cumsum(counts)
        self.hashes = []
        for n, end in zip(counts, ends, strict=True):
            k = min(SHINGLE, int(n))
            self.hashes.append((k, shingles(whole[end - n : end], k)))

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Width -> sorted distinct hashes of all shingles of the windows."""
        out: dict[int, list[np.ndarray]] = {}
        for k, h in self.hashes:
            out.setdefault(k, []).append(h)
        return {k: np.unique(np.concatenate(hs)) for k, hs in out.items()}

    def prefixes(self, rarity: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Width -> hashes in order, with the window and the offset of each window's rarest shingle."""
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for n, (k, h) in enumerate(self.hashes):
            at = min(range(len(h)), key=lambda i: (rarity.get((k, int(h[i])), 0), i))
            chosen.setdefault(k, []).append((int(h[at]), n, at))
        out = {}
        for k, rows in chosen.items():
            rows.sort()
            out[k] = tuple(np.array(x, dtype=t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        return out


def _member(values: np.ndarray, known: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Indices of the values that are among the sorted known ones; mask answers for most of the others."""
    near = np.flatnonzero(mask[values >> np.uint64(44)])
    if not len(near):
        return near
    at = np.minimum(np.searchsorted(known, values[near]), len(known) - 1)
    return near[known[at] == values[near]]


def _mask(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[known >> np.uint64(44)] = True
    return out


def _slices(texts: list, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, so that numpy's arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count_rarity(known: Broadcast) -> Callable:
    """Partial counts of the known shingles in documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: (h, _mask(h), np.zeros(len(h), dtype=np.int64)) for k, h in known.value.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                h, counts = hashes(encode(texts[a:b], ALNUM))
                doc = np.repeat(np.arange(b - a), counts)
                for k, (values, mask, total) in tables.items():
                    s = shingles(h, k)
                    if len(s):
                        s = s[doc[: len(s)] == doc[k - 1 :]]
                        found = s[_member(s, values, mask)]
                        total += np.bincount(np.searchsorted(values, found), minlength=len(values))
        for k, (values, _, total) in tables.items():
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(len(seen), k, dtype=np.int32)), pa.array(values[seen].view(np.int64)), pa.array(total[seen])], names=["k", "h", "n"])

    return run


def _find(index: Broadcast) -> Callable:
    """Adds what one block's windows hit to each document: word ranges and item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, prefixes = index.value
        tables = {k: (*rows, _mask(rows[0])) for k, rows in prefixes.items()}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text_")).to_pylist()
            found = batch.column(batch.schema.get_field_index("_found_")).to_pylist()
            n_words = np.zeros(len(texts), dtype=np.int64)
            for a, b in _slices(texts):
                encoded = encode(texts[a:b], ALNUM)
                h, counts = hashes(encoded)
                n_words[a:b] = counts
                first = np.cumsum(counts) - counts
                doc = np.repeat(np.arange(b - a), counts)
                candidates: dict[int, list[tuple[int, int]]] = {}
                for k, (values, window, offset, mask) in tables.items():
                    s = shingles(h, k)
                    if not len(s):
                        continue
                    at = _member(s, values, mask)
                    at = at[doc[at] == doc[at + k - 1]]
                    low, high = np.searchsorted(values, s[at], "left"), np.searchsorted(values, s[at], "right")
                    for place, lo, hi in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                        for j in range(lo, hi):
                            candidates.setdefault(int(doc[place]), []).append((place - int(first[doc[place]]) - int(offset[j]), int(window[j])))
                for d, pairs in candidates.items():
                    words = encoded[d].split()
                    ranges, items = set(map(tuple, found[a + d]["ranges"])), set(found[a + d]["items"])
                    for start, w in pairs:
                        end = start + len(block.words[w])
                        if start >= 0 and end <= len(words) and words[start:end] == block.words[w]:
                            ranges.add((start, end))
                            items.update(block.items[w])
                    found[a + d] = {"ranges": _joined(ranges), "items": sorted(items)}
            columns = [
                pa.array(n_words) if name == "_n_words_" else pa.array(found, type=_FOUND) if name == "_found_" else batch.column(i) for i, name in enumerate(batch.schema.names)
            ]
            yield pa.record_batch(columns, names=batch.schema.names)

    return run


_FOUND = pa.struct([("ranges", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _joined(ranges: set) -> list[list[int]]:
    """Sorted ranges without overlaps."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, item_ids, the hit word ranges and contaminated.

    A null text has no words; an item without words has no window; a null item id counts as the string
    "null". Items with equal windows all count. Repeated rows get equal results; with no items or no documents nothing is hit.
    Columns of docs with the names of results are replaced.
    """
    spark = docs.sparkSession
    items = items.withColumn(item_id, F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")))
    windows = _windows(items, item_id, item_text, window)
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length(F.array_join("items", ","))).alias("b")).first()["b"] or 0
    n_blocks = size // block_bytes + 1
    block_of = F.pmod(F.xxhash64("words"), F.lit(n_blocks))
    source = docs.select(F.col(f"`{text}`").alias("_text_"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row_"), F.col(f"`{text}`").alias("_text_"))
    held = held.withColumn("_n_words_", F.lit(0).cast("long")).withColumn("_found_", F.expr("named_struct('ranges', cast(array() as array<array<bigint>>), 'items', cast(array() as array<string>))"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in held.schema])
    for n in range(n_blocks):
        # at most about block_bytes come here: a share of the distinct windows
        rows = sorted(windows.where(block_of == n).collect(), key=lambda r: r["words"])
        block = _Index(rows)
        known = spark.sparkContext.broadcast(block.all_shingles())
        counted = source.mapInArrow(_count_rarity(known), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
        rarity = {(r["k"], r["h"] & (1 << 64) - 1): r["n"] for r in counted.collect()} if rows else {}  # of the block's shingles only
        index = spark.sparkContext.broadcast((block, block.prefixes(rarity)))
        held = held.mapInArrow(_find(index), schema)
    ids = F.col("_found_.items")
    ranges = F.col("_found_.ranges")
    result = F.struct(
        F.col("_n_words_").alias("n_words"),
        F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ids.alias("item_ids"),
        F.transform(ranges, lambda r: r[0]).alias("hit_from"),
        F.transform(ranges, lambda r: r[1]).alias("hit_to"),
        (F.size(ranges) > 0).alias("contaminated"),
    )
    names = {r.lower() for r in RESULTS}
    out = held.select(result.alias("_result_"), *[F.col("_row_").getField(c).alias(c) for c in docs.columns if c.lower() not in names])
    return with_struct(out, F.col("_result_"), RESULTS, [c for c in docs.columns if c.lower() not in names])


def op5_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_words_sql('text')} AS ws FROM benchmark),
i AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS p FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS n, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS x FROM i),
lengths AS (SELECT DISTINCT n FROM w),
q AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
g AS (SELECT r, p, n, array_to_string(ws[p:p + n - 1], ' ') AS x FROM q, lengths WHERE p + n - 1 <= len(ws)),
m AS (SELECT r, p, n, item FROM g JOIN w USING (n, x)),
h AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT r, p, unnest(range(0, n)) AS j FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
