"""Periodic runs of words, by an online sparse dynamic program over diagonals.

A diagonal is a lag, and its match length the number of words in a row that equal the word so far before them. A
run of smallest period q is a diagonal of lag q whose match length has grown to its length less q; when the next
word does not continue it, the diagonal ends and its run is emitted at once.

Following every earlier occurrence of every word would take time with the square of a frequent word's count. So
words are followed at levels: level k knows blocks of 2**k words, and a block continues only the diagonal of its
nearest earlier copy, if that lag is above 2**(k-1) and at most 2**k. This loses no run: where the smallest period
is q and 2**k >= q, a block has no copy nearer than q inside the run, or q would not be smallest; and it finds no
other, since the nearest copy gives the smallest period. Each word so moves one diagonal a level at most, and only
blocks with a copy in their text go on to the next level, so that plain text ends after a few levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has LEAST words, and TIMES periods, at least.
LEAST, TIMES = 6, 4
#: Bytes of texts that are searched together; a longer text is searched with those before it.
TOGETHER = 1 << 19

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _diagonals(places: np.ndarray, lags: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the runs of one level: its words one after another, each with the lag that it continues."""
    lag = start = matched = 0
    last = -2
    for i, own in zip(places.tolist(), lags.tolist(), strict=True):
        if own == lag and i == last + 1:
            matched += 1
        else:
            if matched and (length := matched + lag + block - 1) >= max(LEAST, TIMES * lag):
                yield start, length, lag
            lag, start, matched = own, i - own, 1
        last = i
    if matched and (length := matched + lag + block - 1) >= max(LEAST, TIMES * lag):
        yield start, length, lag


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each sequence of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.append(0, np.cumsum(sizes + 1))  # a gap after each text, so that no block reaches into the next
    known: dict[bytes, int] = {}
    place = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(a, a + n) for a, n in zip(begin.tolist(), sizes.tolist(), strict=False)]])
    word = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    key = word * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    number = np.full(int(begin[-1]) + 1, -1, dtype=np.int64)
    numbered = place[:0]
    block = 1
    most = int(sizes.max(initial=0)) // TIMES  # the longest period
    while len(place) and block < 2 * most:
        order = np.argsort(key, kind="stable")
        ranked, at = key[order], place[order]
        same = ranked[1:] == ranked[:-1]
        lag = at[1:] - at[:-1]
        hit = np.flatnonzero(same & (lag <= block) & (lag > block // 2))
        if len(hit):
            inorder = np.argsort(at[hit + 1])
            for start, length, period in _diagonals(at[hit + 1][inorder], lag[hit][inorder], block):
                text = int(np.searchsorted(begin, start, side="right")) - 1
                out[text].append((start - int(begin[text]), length, period))
        again = np.zeros(len(at), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        number[numbered] = -1
        number[at[again]] = np.cumsum(np.append(0, ~same))[again]
        numbered = place = np.sort(at[again])
        place = place[place + block < len(number)]
        place = place[number[place + block] >= 0]
        key = number[place] * (len(ranked) + 1) + number[place + block]
        block *= 2
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of groups that end where their sizes reach a bound."""
    a = total = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= most or i == len(sizes):
            yield a, i
            a, total = i, 0


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a text in UTF-8, which gives way to what is found in it."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_pylist()
        for a, b in _groups(sizes, TOGETHER):
            batch = whole.slice(a, b - a)
            group = [(t or b"").split() for t in batch.column(batch.num_columns - 1).to_pylist()]  # at \x20 and \x09-\x0D
            found = [(len(w), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(w, runs)) for w, runs in zip(group, runs_of(group), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.list_(_RUN), pa.binary()), strict=True)]
            columns[2] = columns[2].cast(pa.string())
            yield pa.record_batch([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (array of start, length and period, by start, then period) and collapsed.

    Words stand between the characters \\x20 and \\x09-\\x0D and are equal only if they are identical. A run is a
    stretch of words with a smallest period, LEAST words and TIMES periods or more, that cannot be made longer;
    runs may overlap. collapsed holds the words that no run contains after its first period, joined by one space.
    A null or empty text has no words, no runs and an empty collapsed text. Each row is searched by itself and
    whole, so repeated rows have equal results, and an empty table stays empty. Columns of docs with the names of
    results are replaced.
    """
    taken = {"n_words", "runs", "collapsed"}
    kept = [c for c in docs.columns if c.lower() not in taken]
    held = "_text_"
    while held in docs.columns:
        held += "_"
    fields = [T.StructField(c, docs.schema[c].dataType) for c in kept]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(held))
    return given.mapInArrow(_search, T.StructType([*fields, *T.StructType.fromDDL(_FOUND)]))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def repeated(text: Column, doc_id: Column) -> Column:
    """The text; where crc32 of the id ends in 0, its words from a given one on repeat those from there with a period.

    A null id counts as the empty text, a null text as empty.
    """
    told = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(told / 10)
    given = F.transform(F.filter(F.array(words), lambda ws: F.size(ws) > 0), lambda ws: F.struct(ws.alias("ws"), F.pmod(g, F.size(ws).cast("long")).alias("a"), (3 + g % 8).alias("times")))
    given = F.transform(given, lambda x: F.struct(x["ws"].alias("ws"), x["a"].alias("a"), (F.lit(1) + F.floor((F.size(x["ws"]) - x["a"]) / x["times"])).alias("p")))
    again = F.transform(given, lambda x: F.array_join(F.transform(x["ws"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["ws"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "))
    return F.when(told % 10 == 0, F.array_join(again, "")).otherwise(text)


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    found = detected(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    best = longest(F.col("runs"))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# crc32 of a short ASCII text, bit by bit over its bytes
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
)
#: Diagonals are joined on five words, which every run of six words or four periods matches in a row.
OP12_SQL = f"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS s, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS o FROM documents),
h AS (SELECT r, doc_id, o, len(o) AS n, {_CRC} AS h FROM c),
a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT]) ELSE o END AS w FROM p),
w AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM d WHERE n >= {LEAST}),
f AS (SELECT r, n, i, [x, lead(x) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v] AS y FROM w WINDOW v AS (PARTITION BY r ORDER BY i) QUALIFY lead(x, 4) OVER v IS NOT NULL),
m AS (SELECT b.r, b.i, b.i - f.i AS q FROM f AS b JOIN f ON b.r = f.r AND b.y = f.y AND f.i < b.i AND (b.i - f.i) * {TIMES} <= b.n),
v AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
z AS (SELECT r, q, min(i) - q AS s, count(*) + 4 + q AS len FROM v GROUP BY r, q, island),
y AS (SELECT * FROM z WHERE len >= greatest({LEAST}, {TIMES} * q)),
u AS (SELECT * FROM y WHERE NOT EXISTS (FROM y AS k WHERE k.r = y.r AND k.q < y.q AND k.s <= y.s AND k.s + k.len >= y.s + y.len)),
e AS (SELECT r, count(*) AS n_runs, arg_max(struct_pack(s, len, q), (len, -s, -q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM u GROUP BY r),
gone AS (SELECT r, list_distinct(flatten(list(range(s + q, s + len)))) AS x FROM u GROUP BY r),
k AS (SELECT d.r, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d SEMI JOIN gone USING (r)) AS d
  ANTI JOIN (SELECT r, unnest(x) AS i FROM gone) AS gone ON gone.r = d.r AND gone.i = d.i GROUP BY d.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(e.t, '')) AS runs_sha256, sha256(CASE WHEN e.r IS NULL THEN array_to_string(w, ' ') ELSE k.t END) AS collapsed_sha256
FROM d LEFT JOIN e USING (r) LEFT JOIN k USING (r)
"""
