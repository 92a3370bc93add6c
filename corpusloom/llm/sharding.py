"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, 23 of the row's id. Equal texts thus stand together,
yet a group of copies of any size can be cut where the shards' bytes ask for it. Each round counts the exact bytes
below 256 evenly spaced probes inside every key range that still holds an unsettled splitter (a grouped sum over all
partitions, of which at most 256 rows for each splitter reach the driver), until the bytes below some probe are
within tolerance of each splitter's target. Then rows are exchanged once.

A shard goes to tasks in pieces, which are key ranges too: their splitters come from the same counts at a loose
tolerance. Where the rows ask for more pieces than the driver should count, each is cut further into cells of even
width, whose rows are counted by Spark alone. A row's slot is its place in its cell and the rows of the cells before,
so slots follow the key through the whole shard, however many cells it has.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import written

KEY_BITS, ID_BITS, FIRST_BITS, ROUND_BITS = 63, 23, 12, 8
#: Of the mean shard: how far a splitter may lie from its target. Of the mean piece: how far a piece's may.
TOLERANCE, PIECE_TOLERANCE = 0.0005, 0.25
#: Rows that one task sorts, most pieces of a shard, beyond which pieces have cells, and most cells that are broadcast.
SLOT_ROWS, MOST_PIECES, BROADCAST_CELLS = 50_000, 256, 100_000

RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def splitters(keys: DataFrame, n_ranges: int, slack: list[float] | None = None) -> list[int]:
    """n_ranges - 1 keys in order, so that the ranges between them hold nearly equal sums of size.

    keys has columns key (0 to 2**63 - 1) and size; slack says how many bytes each splitter may lie from its target.
    A key whose rows outweigh the slack cannot be cut; the nearer of its two sides is taken then.
    """
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    targets = [total * i / n_ranges for i in range(1, n_ranges)]
    slack = slack or [total / n_ranges * TOLERANCE] * len(targets)
    found: list[int | None] = [None] * len(targets)
    # open ranges of keys: prefix at the current shift -> bytes below the range
    shift, ranges = KEY_BITS, {0: 0}
    while any(f is None for f in found):
        step = min(FIRST_BITS if shift == KEY_BITS else ROUND_BITS, shift)
        inside = keys if shift == KEY_BITS else keys.where(F.shiftright("key", shift).isin(list(ranges)))
        shift -= step
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy(F.shiftright("key", shift).alias("probe")).agg(F.sum("size").alias("n")).collect():
            counts.setdefault(r["probe"] >> step, []).append((r["probe"], r["n"]))
        probes, below = [], []  # every probe of the open ranges and the exact bytes below it
        for prefix, n in sorted(ranges.items()):
            for probe, size in sorted(counts.get(prefix, [])):
                probes.append(probe)
                below.append(n)
                n += size
            probes.append(prefix + 1 << step)
            below.append(n)
        ranges = {}
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            at = min(max(bisect_left(below, target), 1), len(below) - 1) if len(below) > 1 else 0
            near = min({max(at - 1, 0), at}, key=lambda k: (abs(below[k] - target), k))
            if abs(below[near] - target) <= slack[i] or shift == 0 or not total:
                found[i] = min(probes[near] << shift, (1 << KEY_BITS) - 1)
            else:
                ranges[probes[at - 1]] = below[at - 1]
    return sorted(f for f in found if f is not None)


def _range_of(rows: DataFrame, cuts: list[int], n_cells: int = 1) -> DataFrame:
    """rows with their range among cuts and their cell in it, one of n_cells of even width.

    The range is found by the first bits of the key and then by the few cuts that begin with the same. The table of
    first bits has 4096 rows at any size of input, so it is broadcast.
    """
    spark: SparkSession = rows.sparkSession
    shift, last = KEY_BITS - FIRST_BITS, (1 << KEY_BITS) - 1
    inside: dict[int, list[int]] = {}
    for c in cuts:
        if c & (1 << shift) - 1:
            inside.setdefault(c >> shift, []).append(c)
    table = []
    for start in range(1 << FIRST_BITS):
        first, own = bisect_left(cuts, (start << shift) + 1), inside.get(start, [])
        after = first + len(own)
        table.append((start, first, own, cuts[first - 1] if first else 0, cuts[after] if after < len(cuts) else last))
    table = spark.createDataFrame(table, "start long, first int, cuts array<long>, low long, high long")
    placed = rows.join(F.broadcast(table), F.shiftright(rows["key"], shift) == table["start"])
    low = F.coalesce(F.array_max(F.filter("cuts", lambda c: c <= F.col("key"))), F.col("low"))
    high = F.coalesce(F.array_min(F.filter("cuts", lambda c: c > F.col("key"))), F.col("high"))
    part = (F.col("key") - low).cast("double") * n_cells / F.greatest(high - low, F.lit(1)).cast("double")  # never falls as the key grows
    cell = F.least(F.floor(part), F.lit(n_cells - 1)).cast("int") if n_cells > 1 else F.lit(0)
    return placed.withColumns({"range": F.col("first") + F.size(F.filter("cuts", lambda c: c <= F.col("key"))), "cell": cell}).drop("start", "first", "cuts", "low", "high")


def _bits(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def sharded(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size (UTF-8 bytes of the text plus 1), text_crc32, law ("bytes"), shard, slot and grown_shard (null).

    Sums of size differ between shards by the tolerance and the rows that share one key (equal rows). A null text has
    no bytes, a null id counts as the empty one; slots are gapless from 0 within a shard, in the order of keys and,
    among equal keys, of ids and hashes; an empty table has no shards. Columns of docs with the names of results are
    replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = {r.lower() for r in RESULTS}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]).alias("row")
    own = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    key = F.shiftleft(_bits(t, 10), ID_BITS).bitwiseOR(F.shiftright(_bits(own, 6), 24 - ID_BITS))
    rows = docs.select(row, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), key.alias("key"), own.alias("own"), F.xxhash64(t).alias("tie"))
    keys = written(rows.select("key", "size"), "shard-keys")
    totals = keys.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n_pieces = min(max(1, -(-totals["n"] // (n_shards * SLOT_ROWS))), MOST_PIECES)
    n_cells = max(1, -(-totals["n"] // (n_shards * n_pieces * SLOT_ROWS)))
    mean = (totals["bytes"] or 0) / n_shards
    slack = [mean * tolerance if i % n_pieces == 0 else mean / n_pieces * PIECE_TOLERANCE for i in range(1, n_shards * n_pieces)]
    cuts = splitters(keys, n_shards * n_pieces, slack)
    counted = _range_of(keys, cuts, n_cells).groupBy("range", "cell").agg(F.count("*").alias("n"))
    shard_of = lambda r: F.floor(r / n_pieces).cast("int")
    before = F.expr("coalesce(sum(n) over (partition by shard order by range, cell rows between unbounded preceding and 1 preceding), 0)")
    offsets = counted.withColumn("shard", shard_of(F.col("range"))).select("range", "cell", before.alias("offset"))
    if n_shards * n_pieces * n_cells <= BROADCAST_CELLS:
        offsets = F.broadcast(offsets)  # else the rows stay where their cells were sorted, and the offsets come to them
    placed = _range_of(rows, cuts, n_cells).withColumn("place", F.expr("row_number() over (partition by range, cell order by key, own, tie)") - 1)
    out = placed.join(offsets, ["range", "cell"])
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in names],
        "size", "text_crc32", F.lit("bytes").alias("law"), shard_of(F.col("range")).alias("shard"), (F.col("place") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_histogram_sort(docs: DataFrame) -> DataFrame:
    return sharded(docs.select("doc_id", "text")).select("doc_id", *RESULTS)
