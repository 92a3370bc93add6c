"""Mixture-controlled packing.

Every source is a queue of tokens, cut into grains. A queue of share p is owed its grain j at the time (j + u) / p,
where u in (0, 1) is the queue's own and keeps small queues from being owed all at once; grains are dealt to
sequences in the order of these times. How many grains of any queue come before a time is arithmetic, and so is the
sequence and place of any grain: no queue is ever a grain from what it is owed by then, however small its share, and
deficits carry over from sequence to sequence and across partitions though no partition waits for another. When a
queue runs empty the others go on at the same times, in the proportions of their shares. A grain begins where the
tokens of all grains before it end, and the row of all tokens is cut into sequences: only the last one is not full,
however many queues end in a short grain.

Documents are tokenised once and stored in the shared folder with their places among their queue's tokens of the
same partition; sums by partition and queue give the places in the whole queue. Up to FEW queues, each task finds
the places of its grains by arithmetic; of more, all grains are sorted by time over all tasks and numbered, which
gives the same places without any table of queues in one process.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.operators.ordering import numbered, running

SEQUENCE = 1024
#: Tokens dealt at once; a document is cut at grains, or where it starts or ends.
GRAIN = 64
#: Numbers of queues by numbers of grains that are compared at once.
COMPARED = 1 << 20
#: Queues whose totals go to every task; more are dealt by sorting.
FEW = 1000
#: Grains of one queue that a task lists at once.
LISTED = 1 << 12
GOLDEN = 0.6180339887498949
#: Rows of the table of places that are still broadcast.
BROADCAST_ROWS = 500_000
END_ID = 0
#: A tokenizer and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Characters of texts whose words are encoded together.
TOGETHER = 8 << 20
#: Tokens of documents that are cut together.
CUT = 1 << 20
#: Words whose ids are gathered at once.
GATHERED = 1 << 18

#: White space beside a space, in the commonest forms, and all white space but these.
_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Encoder:
    """Token ids of texts: each distinct word of a group of texts is encoded once, and its ids are gathered.

    A word here begins after a single space. Where no space stands beside other white space, a byte-level BPE
    pre-tokenizer always cuts before a space, so the words' ids, each with its space, are those of the text; other
    texts, and those that spell a special token, go to the tokenizer whole. With ranks (the same vocabulary as a
    tiktoken file) words are encoded several times faster; the ids are the tokenizer's own, which the tests hold
    them against. Nothing is remembered from group to group.
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.odd = (*_BESIDE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.rare = re.compile(_RARE)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.spaced = np.zeros(max(table.values()) + 1, dtype=bool)
            self.spaced[[rank for token, rank in table.items() if token.startswith(b" ")]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return self._whole(texts)
        return [self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype) for text in texts]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each after a space, in a row, and the number of each word's ids."""
        if self.fast is None:
            found = self._ids([" " + w for w in words.to_pylist()])
            return np.concatenate([np.zeros(0, dtype=self.dtype), *found]), np.array([len(x) for x in found], dtype=np.int64)
        # only a word's first id begins with a space, so the ids of all words in a row show where each begins
        ids = self.fast.encode_to_numpy(" ".join(["", *words.to_pylist()]), disallowed_special=()) if len(words) else np.zeros(0, dtype=np.int64)
        return ids.astype(self.dtype), np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def _is_odd(self, text: str) -> bool:
        return any(x in text for x in self.odd) or self.rare.search(text) is not None

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with the end id, one text after another, and the number of each text's ids; a null text has the end id alone.

        White space that ends a text is cut off by a pre-tokenizer too, and is encoded with the end.
        """
        heads: list[np.ndarray] = []
        tails: list[str | None] = []
        behind: dict[int, np.ndarray] = {}
        end = np.array([END_ID], dtype=self.dtype)
        for i, text in enumerate(texts):
            if text and self._is_odd(text):
                heads += self._whole([text])
                tails.append(None)
                continue
            plain = (text or "").rstrip()
            if text and len(plain) < len(text):
                behind[i] = np.append(self._ids([text[len(plain) :]])[0], end)
            head, space, tail = plain.partition(" ")
            heads += self._ids([head])
            tails.append(tail if space else None)
        words = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        word_ids, per_word = self._words(coded.dictionary)
        ids = np.concatenate([end, *heads, *behind.values(), word_ids])
        size = np.concatenate([[1], [len(x) for x in heads], [len(x) for x in behind.values()], per_word]).astype(np.int64)
        begin = np.cumsum(size) - size
        # the units of a text: its head, its words, the end
        stop = np.cumsum(n_words + 2)
        unit = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.int64)
        is_word = np.ones(len(unit), dtype=bool)
        is_word[stop - 1] = is_word[stop - n_words - 2] = False
        unit[stop - n_words - 2] = 1 + np.arange(len(texts))
        unit[stop[np.array(list(behind), dtype=np.int64)] - 1] = 1 + len(texts) + np.arange(len(behind))
        unit[is_word] = 1 + len(texts) + len(behind) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for a in range(0, len(unit), GATHERED):
            some = unit[a : a + GATHERED]
            n = size[some]
            out.append(ids[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return np.concatenate(out), np.add.reduceat(size[unit], stop - n_words - 2)


@functools.lru_cache(maxsize=1)
def encoder(path: str, ranks: str | None) -> Encoder:
    """The encoder of a worker process, loaded once for all its tasks."""
    return Encoder(path, ranks)


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of groups that end where their sizes reach a bound."""
    a = total = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= most or i == len(sizes):
            yield a, i
            a, total = i, 0


def _tokenise(path: str, ranks: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, ranks), TaskContext.get().partitionId()
        places: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups([len(t or "") for t in texts], TOGETHER):
                piece = batch.slice(a, b - a)
                ids, counts = own.encode(texts[a:b])
                before = []
                for queue, n in zip(piece.column(2).to_pylist(), counts.tolist(), strict=True):
                    before.append(places.get(queue, 0))
                    places[queue] = before[-1] + n
                yield pa.record_batch(
                    [piece.column(0), piece.column(2), pa.array([part] * (b - a), pa.int32()), pa.array(before, pa.int64()), pa.array(counts), _binary(ids, counts)],
                    names=["doc_id", "queue", "part", "place", "doc_tokens", "ids"],
                )

    return run


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts numbers each, one after another."""
    offsets = np.append(0, np.cumsum(counts, dtype=np.int64)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Dealing:
    """Where each grain of each queue goes. tokens: queue -> number of tokens; targets: queue -> share, or by size.

    Queues without a target follow when those with one are empty, in the proportions of their sizes.
    """

    def __init__(self, tokens: dict[str, int], targets: dict[str, float] | None = None) -> None:
        self.tokens = {q: n for q, n in sorted(tokens.items()) if n}
        self.number = {q: k for k, q in enumerate(self.tokens)}
        self.grains = np.array([-(-n // GRAIN) for n in self.tokens.values()], dtype=np.int64)
        aimed = np.array([max((targets or {}).get(q, 0.0), 0.0) for q in self.tokens])
        self.late = aimed == 0
        self.step = 1 / np.where(self.late, self.grains, aimed)  # times between the grains of a queue
        by_size = np.empty(len(self.grains), dtype=np.int64)
        by_size[np.argsort(-self.grains, kind="stable")] = np.arange(len(self.grains))
        self.first = (0.5 + by_size * GOLDEN) % 1  # spread evenly, also over queues of one size
        self.sizes = np.array(list(self.tokens.values()), dtype=np.int64)

    def places(self, queue: str, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the grains with the given numbers in their queue: the numbers of grains and of tokens before them."""
        k = self.number[queue]
        peers = np.flatnonzero(self.late == self.late[k])
        first, step, most, ahead, size = self.first[peers], self.step[peers], self.grains[peers], peers < k, self.sizes[peers]
        sooner = np.flatnonzero(~self.late) if self.late[k] else peers[:0]
        out, tokens = np.empty(len(numbers), dtype=np.int64), np.empty(len(numbers), dtype=np.int64)
        width = max(1, COMPARED // len(peers))
        for a in range(0, len(numbers), width):
            time = ((numbers[a : a + width] + self.first[k]) * self.step[k])[:, None]

            def before(number: np.ndarray, time: np.ndarray = time) -> np.ndarray:
                other = (number + first) * step
                return (other < time) | ((other == time) & ahead)

            n = np.clip(np.ceil(time / step - first).astype(np.int64), 0, most)
            n -= (n > 0) & ~before(n - 1)  # the quotient may be rounded over a whole number
            n += (n < most) & before(n)
            out[a : a + width] = self.grains[sooner].sum() + n.sum(axis=1)
            tokens[a : a + width] = self.sizes[sooner].sum() + np.minimum(n * GRAIN, size).sum(axis=1)
        return out, tokens

    def grain(self, queue: str, numbers: np.ndarray) -> np.ndarray:
        """Places among all grains of those with the given numbers in their queue."""
        return self.places(queue, numbers)[0]


def grain_numbers(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of n tokens from a place of their queues: document and number of every grain that holds some of them."""
    first = place // GRAIN
    k = (place + n - 1) // GRAIN + 1 - first
    doc = np.repeat(np.arange(len(n)), k)
    return doc, np.arange(len(doc)) + (first - (np.cumsum(k) - k))[doc]


def pieces(place: np.ndarray, n: np.ndarray, doc: np.ndarray, number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start, length, sequence and offset of the documents' pieces, given where their grains begin among all tokens."""
    start = np.maximum(number * GRAIN, place[doc])
    end = np.minimum((number + 1) * GRAIN, (place + n)[doc])
    at = at + start - number * GRAIN
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != (at + end - start)[:-1])
    heads = np.flatnonzero(fresh)
    stop = end[np.append(heads[1:], len(doc)) - 1] - start[heads] + at[heads]  # what stands together, from at to stop
    k = (stop - 1) // SEQUENCE + 1 - at[heads] // SEQUENCE
    of = np.repeat(heads, k)
    sequence = at[of] // SEQUENCE + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    low, high = np.maximum(at[of], sequence * SEQUENCE), np.minimum(np.repeat(stop, k), (sequence + 1) * SEQUENCE)
    return doc[of], start[of] - place[doc[of]] + low - at[of], high - low, sequence, low - sequence * SEQUENCE


def _cut(dealing: Broadcast | None, itemsize: int) -> Callable:
    """Cuts documents into pieces: by arithmetic, or by where their grains begin, which comes with them then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Dealing | None = dealing.value if dealing else None
        for whole in batches:
            for a, b in _groups(whole.column(3).to_pylist(), CUT):
                batch = whole.slice(a, b - a)
                place, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                doc, number = grain_numbers(place, n)
                if plan:
                    begin = np.empty(len(doc), dtype=np.int64)
                    coded = batch.column(1).dictionary_encode()
                    queue = coded.indices.to_numpy()[doc]
                    for k, name in enumerate(coded.dictionary.to_pylist()):
                        held = np.flatnonzero(queue == k)
                        begin[held] = plan.places(name, number[held])[1]
                else:
                    begin = batch.column(5).flatten().to_numpy()
                of, start, length, sequence, offset = pieces(place, n, doc, number, begin)
                # a document's pieces follow one another in it, so the ids of all pieces in a row are those of the documents
                ids = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=f"<u{itemsize}").astype("<u4")
                at = pa.array(of)
                yield pa.record_batch(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(length), _binary(ids, length), batch.column(3).take(at), pa.array(sequence), pa.array(offset)],
                    names=["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def _sorted_grains(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """queue, number and at (the tokens before it) of every grain, by one sort of all grains by their times.

    totals has queue and n. The times are those of Dealing, by the same operations on the same numbers.
    """
    spark = totals.sparkSession
    queues = numbered(totals.where("n > 0").withColumns({"grains": F.ceil(F.col("n") / GRAIN)}).withColumn("by_size", -F.col("grains")), ["by_size", "queue"], "number")
    aims = spark.createDataFrame([(q, max(float(x), 0.0)) for q, x in (targets or {"": 0.0}).items()], "queue string, aimed double")
    told = queues.join(aims, "queue", "left").withColumn("aimed", F.coalesce("aimed", F.lit(0.0)))
    told = told.withColumn("late", F.col("aimed") == 0).withColumn("step", 1 / F.when(F.col("late"), F.col("grains").cast("double")).otherwise(F.col("aimed")))
    told = told.withColumn("first", (F.lit(0.5) + (F.col("number") - 1) * F.lit(GOLDEN)) % 1)
    blocks = told.select("queue", "n", "grains", "late", "step", "first", F.explode(F.sequence(F.lit(0), F.floor((F.col("grains") - 1) / LISTED))).alias("block")).repartition("queue", "block")
    each = F.explode(F.sequence(F.col("block") * LISTED, F.least(F.col("block") * LISTED + LISTED, F.col("grains")) - 1)).alias("number")
    grains = blocks.select("queue", "n", "late", "step", "first", each)
    timed = grains.select("queue", "number", "late", ((F.col("number") + F.col("first")) * F.col("step")).alias("time"), F.least(F.lit(GRAIN), F.col("n") - F.col("number") * GRAIN).alias("length"))
    return running(timed, ["late", "time", "queue"], "length", "at").select("queue", "number", "at")


def packed(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, targets: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Pieces of documents in sequences: doc_id, queue, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    targets gives each source's share of every sequence; without it the shares are the sources' own, so that
    all queues last to the end. A null text is empty and holds the end id alone; a null source is the empty
    one; repeated rows are packed each. Without documents there are no pieces. Every sequence
    but the last is full; extra columns are not read.
    """
    spark = docs.sparkSession
    path, ranks = (tokenizer, ranks) if tokenizer else (public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    itemsize = Encoder(path).dtype.itemsize
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("queue"))
    tokens = written(rows.mapInArrow(_tokenise(path, ranks), f"doc_id {kind}, queue string, part int, place long, doc_tokens long, ids binary"), "tokens")
    sums = written(tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    sizes = {r["queue"]: r["n"] for r in totals.limit(FEW + 1).collect()}
    before = F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    places = sums.select("queue", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if sums.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = tokens.join(places, ["queue", "part"]).select("doc_id", "queue", (F.col("place") + F.col("before")).alias("place"), "doc_tokens", "ids")
    out = f"doc_id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    if len(sizes) <= FEW:
        return placed.mapInArrow(_cut(spark.sparkContext.broadcast(Dealing(sizes, targets)), itemsize), out)
    grains = written(_sorted_grains(totals, targets), "grains")
    last = F.floor((F.col("place") + F.col("doc_tokens") - 1) / GRAIN)
    asked = placed.select("queue", "place", F.explode(F.sequence(F.floor(F.col("place") / GRAIN), last)).alias("number"))
    answers = asked.join(grains, ["queue", "number"]).groupBy("queue", "place").agg(F.array_sort(F.collect_list(F.struct("number", "at"))).alias("g"))
    answers = answers.select("queue", "place", F.col("g.at").alias("begins"))
    return placed.join(answers, ["queue", "place"]).select("doc_id", "queue", "place", "doc_tokens", "ids", "begins").mapInArrow(_cut(None, itemsize), out)


def op6_mixture_packing(docs: DataFrame) -> DataFrame:
    pieces = packed(docs.select("doc_id", "text", "source"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
