"""LM scoring with a hierarchical Pitman-Yor bigram model.

Every context (the word before) is a Chinese restaurant of its own whose new tables send a customer to one shared
parent, the unigram restaurant, whose base measure is uniform over the known words and one unknown. Gibbs sampling
draws the tables of each dish in each restaurant; predictive probabilities are averaged over several samples.

The corpus is read once: each task turns its documents into chunks. The chunks' words go to parts by their hash, where
each gets a number of its own; then the chunks' pairs of word and context go, as numbers, to the part of the word, packed
in byte blocks. A part holds all customers of its words, so pairs of one frequent word are counts, never rows of
occurrences; the pairs of a word of more than HOT occurrences are dealt to several parts by their contexts.

Each token of a document is followed by one, the end by the first, so a context has as many customers as its word has
occurrences. Its tables are its customers less those of each dish beyond the dish's tables, which only dishes of two or more
customers can have. Parts draw those dishes alone, and after each sweep send what they lack to the part that owns the
context's word, which sums it and sends each the tables of its contexts; the parent's totals are summed over all parts. So the
number of parts is no part of the law. The sums of the samples' own sweeps give the predictive probabilities, which
therefore add up to one. The answers return to the chunks by the chunk's number.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_remainder, written
from corpusloom.llm.words import SPACED, encode, hashes, mix
from corpusloom.sources.shared import removed

#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: Sweeps before samples are taken, and samples.
BURN_IN, SAMPLES = 2, 3
#: Characters and documents of one chunk; characters of the corpus to one part.
CHUNK_CHARS, CHUNK_DOCS, PART_CHARS = 12 << 20, 50_000, 12 << 20
#: Occurrences of a word for each part that holds its pairs.
HOT = 1 << 20
#: Parts whose words' contexts are summed together, so that parts send one another fewer messages.
OWNERS = 32
#: Dishes of so many customers at most are drawn from the exact law of their number of tables.
EXACT = 128

_END = np.uint64(0xE7037ED1A0B428DB)  # the hash of the end token, which no word's text has


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte planes apart and empty ones left out: small numbers take no more room in a wide type."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
        some = planes.any(axis=1)
        out += [some.tobytes(), *(planes[i].tobytes() for i in np.flatnonzero(some))]
    return zlib.compress(b"".join(out), 3)


def _unpack(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zlib.decompress(data), np.uint8), [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        held = np.zeros((n, width), dtype=np.uint8)
        some = np.flatnonzero(raw[at : at + width])
        at += width
        for i in some:
            held[:, i] = raw[at : at + n]
            at += n
        out.append(held.view(kind).ravel())
    return out


def _steps(ranked: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    """Differences of ranked numbers, begun anew in each group of so many."""
    out = np.diff(ranked, prepend=0)
    if each is not None and len(ranked):
        first = (np.cumsum(each) - each)[each > 0]
        out[first] = ranked[first]
    return out


def _from_steps(steps: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    out = np.cumsum(steps, dtype=np.int64)
    if each is not None and len(steps):
        first = (np.cumsum(each, dtype=np.int64) - each)[each > 0]
        out -= np.repeat(out[first] - steps[first].astype(np.int64), each[each > 0])
    return out


def _runs(ranked: np.ndarray) -> np.ndarray:
    """How often each of the ranked numbers is there."""
    return np.diff(np.append(np.flatnonzero(np.diff(ranked, prepend=-1)), len(ranked)))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


#: Parts below 0 are a chunk's own rows: what its documents hold, and which pairs it has.
_DOCUMENTS, _PAIRS = -1, -2
_CHUNK_SCHEMA = "chunk long, part int, n_words int, n_pairs int, block binary, doc_ids array<string>, n_tokens array<long>"


def _chunked(n_parts: int) -> Callable:
    """Rows for each chunk: its documents' tokens, its pairs by place of word and context, and words with counts for each part."""

    def chunk_rows(number: int, ids: list, trained: list[bool], texts: list) -> pa.RecordBatch:
        encoded = encode(texts, SPACED)
        h, counts = hashes(encoded)
        n = counts + 1  # and the end
        stop = np.cumsum(n)
        token = np.empty(int(stop[-1]), dtype=np.uint64)
        is_end = np.zeros(len(token), dtype=bool)
        is_end[stop - 1] = True
        token[is_end], token[~is_end] = _END, h
        del encoded, h, is_end
        words, word = np.unique(token, return_inverse=True)
        del token
        part = (mix(words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        words, part = words[by_part], part[by_part]
        rank = np.empty(len(words), dtype=np.int64)
        rank[by_part] = np.arange(len(words))
        word = rank[word]
        context = np.roll(word, 1)
        context[stop - n] = word[stop - 1]  # the end stands before the first
        doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        learn = np.array(trained)[doc]
        came = np.bincount(word[learn], minlength=len(words))
        key = word * len(words) + context
        del word, context
        order = np.argsort(key, kind="stable")
        ranked, doc, learn = key[order], doc[order], learn[order]
        del key, order
        first = np.flatnonzero(np.diff(ranked, prepend=-1))
        seen = np.diff(np.append(first, len(ranked)))
        learnt = np.add.reduceat(learn.astype(np.int64), first)
        pair_word, pair_context = np.divmod(ranked[first], len(words))
        per_word = np.bincount(pair_word, minlength=len(words))
        kept = (number, _PAIRS, len(words), len(first), _pack(per_word, _steps(pair_context, per_word), learnt), None, None)
        rows = [(number, _DOCUMENTS, len(words), len(first), _pack(seen, doc), ids, n.tolist()), kept]
        bounds = np.searchsorted(part, np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            here = slice(*bounds[p : p + 2])
            rows.append((number, p, here.stop - here.start, 0, _pack(np.diff(words[here], prepend=np.uint64(0)), came[here]), None, None))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        names = [x.split()[0] for x in _CHUNK_SCHEMA.split(", ")]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, trained, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, learn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc_id)
                trained.append(learn)
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield chunk_rows(number, ids, trained, texts)
                    number += 1
                    ids, trained, texts, size = [], [], [], 0
        if ids:
            yield chunk_rows(number, ids, trained, texts)

    return run


def log_stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) of a discount, for 1 <= t <= c <= most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(most):
            t = np.arange(most + 1)
            grow = out[c] + np.log(np.maximum(c - discount * t, 1e-300))
            out[c + 1] = np.logaddexp(grow, np.append(-np.inf, out[c, :-1]))
    return out


class _Seating:
    """Draws numbers of tables of dishes under one discount and strength."""

    def __init__(self, discount: float, strength: float, seed: np.random.Generator) -> None:
        self.d, self.strength, self.random = discount, strength, seed
        self.stirling = log_stirling(discount, EXACT)

    def draw(self, customers: np.ndarray, tables: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        """New numbers of tables, given the restaurants' other tables and the dishes' base probabilities.

        The law of t tables for c customers of a dish, all else seated, is S(c, t) times the product of
        (strength + discount * (others + j)) for j < t, times base ** t. A dish of more than EXACT customers is
        seated one doubling of its customers after another: how many of them open a table is binomial, by the
        chance of the doubling's first customer.
        """
        out = np.minimum(customers, 1)
        order = np.argsort(customers, kind="stable")
        ranked = customers[order]
        low = int(np.searchsorted(ranked, 2))
        high = int(np.searchsorted(ranked, EXACT, side="right"))
        at = low
        while at < high:
            c = int(ranked[at])
            end = min(int(np.searchsorted(ranked, c, side="right")), at + max(1, (1 << 20) // c))
            pick = order[at:end]
            steps = np.log(self.strength + self.d * (others[pick, None] + np.arange(c))) + np.log(base[pick, None])
            weight = self.stirling[c, 1 : c + 1] + np.cumsum(steps, axis=1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            out[pick] = 1 + (total < self.random.random((len(pick), 1)) * total[:, -1:]).sum(axis=1)
            at = end
        pick = order[high:]
        if len(pick):
            c, t = customers[pick], np.ones(len(pick), dtype=np.int64)
            seated = np.ones(len(pick), dtype=np.int64)
            while (more := np.minimum(np.maximum(seated // 4, 1), c - seated)).any():
                opened = (self.strength + self.d * (others[pick] + t)) * base[pick]
                chance = opened / (opened + np.maximum(seated - self.d * t, 1 - self.d))
                t += np.where(more > 0, self.random.binomial(more, np.clip(chance, 0, 1)), 0)
                seated += more
            out[pick] = t
        return out


_WORDS_SCHEMA = "part int, known int, learnt long, trained int, totals binary, chunk array<long>, n_words array<int>, places array<binary>"


def _numbered(blocks: pd.DataFrame) -> pd.DataFrame:
    """One part's words with their occurrences in the training texts, and for each chunk the places of its words among them."""
    blocks = blocks.sort_values("chunk")
    found = [_unpack(b, ("<u8", n), ("<i8", n)) for n, b in zip(blocks["n_words"], blocks["block"], strict=True)]
    known, place = np.unique(np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found]), return_inverse=True)
    totals = np.zeros(len(known), dtype=np.int64)
    np.add.at(totals, place, np.concatenate([f[1] for f in found]))
    places = [_pack(_steps(x)) for x in np.split(place, np.cumsum(blocks["n_words"])[:-1])]
    return _frame([(int(blocks["part"].iloc[0]), len(known), int(totals.sum()), int((totals > 0).sum()), _pack(totals), blocks["chunk"].tolist(), blocks["n_words"].tolist(), places)], _WORDS_SCHEMA)


_NUMBERS_SCHEMA = "chunk long, part int, n_words int, block binary"


def _slices(totals: np.ndarray, hot: int, n_parts: int) -> np.ndarray:
    """How many parts share the pairs of words of so many occurrences."""
    return np.minimum(1 + totals // hot, n_parts)


def _told(hot: int, n_parts: int) -> Callable:
    """Tells each chunk the places of its words in their part, and how many parts share their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (totals,) = _unpack(row["totals"], ("<i8", row["known"]))
                slices, blocks = _slices(totals, hot, n_parts), []
                for n, places in zip(row["n_words"], row["places"], strict=True):
                    (steps,) = _unpack(places, ("<i8", n))
                    blocks.append(_pack(steps, slices[np.cumsum(steps)]))
                m = len(blocks)
                yield pa.record_batch([pa.array(row["chunk"], pa.int64()), pa.array([row["part"]] * m, pa.int32()), pa.array(row["n_words"], pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "part", "n_words", "block"])

    return run


def _homes(part: np.ndarray, slices: np.ndarray, word: np.ndarray, context: np.ndarray, n_parts: int) -> np.ndarray:
    """The parts of pairs: the word's own, or those after it by the context's own."""
    return (part[word] + part[context] % slices[word]) % n_parts


_BLOCK_SCHEMA = "chunk long, part int, n_words int, n_pairs int, block binary"


def _paired(offsets: np.ndarray) -> Callable:
    """A chunk's pairs as numbers of word and context, for each part."""
    n_parts = len(offsets)

    def run(kept: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        (own,) = kept.itertuples(index=False)
        told = told.sort_values("part")
        found = [_unpack(b, ("<i8", n), ("<i8", n)) for n, b in zip(told["n_words"], told["block"], strict=True)]
        part = np.repeat(told["part"].to_numpy(np.int64), told["n_words"])
        number = offsets[part] + np.concatenate([np.cumsum(f[0]) for f in found])
        per_word, steps, learnt = _unpack(own.block, ("<i8", own.n_words), ("<i8", own.n_pairs), ("<i8", own.n_pairs))
        word, context = np.repeat(np.arange(own.n_words), per_word), _from_steps(steps, per_word)
        home = _homes(part, np.concatenate([f[1] for f in found]), word, context, n_parts)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(n_parts + 1))
        w, c, learnt = number[word[order]], number[context[order]], learnt[order]
        rows = []
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            here = slice(*bounds[p : p + 2])
            names, each = np.unique(w[here], return_counts=True)
            rows.append((own.chunk, p, len(names), len(w[here]), _pack(_steps(names), each, _steps(c[here], each), learnt[here])))
        return _frame(rows, _BLOCK_SCHEMA)

    return run


#: What a part keeps for its answers, and the seats that its sweeps draw: dishes of two or more customers.
_MERGED_SCHEMA = "part int, known int, totals binary, chunk array<long>, n_words array<int>, places array<binary>, in_chunk array<long>, n_pairs array<int>, pair_places array<binary>, pairs int, customers binary, seats int, state binary"


def _merged(n_numbers: int) -> Callable:
    """One part's customers by word and context, and for each chunk the places of its pairs among them."""

    def run(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        blocks, keys, learnt = blocks.sort_values("chunk"), [], []
        for n, m, b in zip(blocks["n_words"], blocks["n_pairs"], blocks["block"], strict=True):
            names, each, steps, came = _unpack(b, ("<i8", n), ("<i8", n), ("<i8", m), ("<i8", m))
            keys.append(np.repeat(np.cumsum(names), each) * n_numbers + _from_steps(steps, each))
            learnt.append(came)
        none = [np.zeros(0, dtype=np.int64)]
        pairs, place = np.unique(np.concatenate(keys or none), return_inverse=True)
        customers = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(customers, place, np.concatenate(learnt or none))
        places = [_pack(_steps(x)) for x in np.split(place, np.cumsum(blocks["n_pairs"])[:-1])] if len(blocks) else []
        w, c = np.divmod(pairs[customers > 1], n_numbers)
        if len(words):
            part, known, totals = int(words["part"].iloc[0]), int(words["known"].iloc[0]), words["totals"].iloc[0]
            told = [list(words[x].iloc[0]) for x in ("chunk", "n_words", "places")]
        else:
            part, known, totals, told = int(blocks["part"].iloc[0]), 0, _pack(none[0]), [[], [], []]
        (total,) = _unpack(totals, ("<i8", known))
        state = _Seats(part, w, c, customers[customers > 1], np.ones(len(w), dtype=np.int64), total, np.minimum(total, 1)).packed()
        return _frame([(part, known, totals, *told, blocks["chunk"].tolist(), blocks["n_pairs"].tolist(), places, len(pairs), _pack(customers), len(w), state)], _MERGED_SCHEMA)

    return run


class _Seats:
    """The dishes of two or more customers in one part, and its own words."""

    def __init__(self, part: int, word: np.ndarray, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, total: np.ndarray, parent: np.ndarray) -> None:
        self.part, self.word, self.context, self.customers, self.tables, self.total, self.parent = part, word, context, customers, tables, total, parent

    def packed(self) -> bytes:
        return _pack(_steps(self.word), _steps(self.context, _runs(self.word)), self.customers, self.tables, self.total, self.parent)

    @classmethod
    def unpacked(cls, part: int, known: int, seats: int, state: bytes) -> _Seats:
        names, steps, *rest = _unpack(state, *[("<i8", seats)] * 4, *[("<i8", known)] * 2)
        word = np.cumsum(names)
        return cls(part, word, _from_steps(steps, _runs(word)), *rest)

    def sent(self, whole: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers of the parent by own word; which own words are hot, whose customers and tables the whole knows; and places of the seats' words."""
        own = self.word - whole["offsets"][self.part]
        inside = (own >= 0) & (own < len(self.total))
        lack = np.zeros(len(self.total), dtype=np.int64)
        np.add.at(lack, own[inside], (self.customers - self.tables)[inside])
        return self.total - lack, _slices(self.total, whole["hot"], len(whole["offsets"])) > 1, np.where(inside, own, -1)

    def swept(self, whole: dict, tables_of: np.ndarray, seed: list[int]) -> None:
        """Draws the tables anew, given the tables of the seats' contexts and the whole corpus' totals at the end of the sweep before."""
        random = np.random.default_rng([*seed, self.part])
        leaf, root = _Seating(DISCOUNT, STRENGTH, random), _Seating(ROOT_DISCOUNT, ROOT_STRENGTH, random)
        sent, hot, own = self.sent(whole)
        rate = lambda sent, parent: _base(sent, parent, whole)
        at = np.searchsorted(whole["hot_words"], self.word)
        at = np.where(at < len(whole["hot_words"]), at, 0)
        base = np.append(rate(sent, self.parent), 0.0)[own]
        if len(whole["hot_words"]):
            base = np.where(whole["hot_words"][at] == self.word, rate(whole["hot_sent"], whole["hot_parent"])[at], base)
        self.tables = leaf.draw(self.customers, self.tables, tables_of - self.tables, base)
        sent, hot, _ = self.sent(whole)
        drawn = root.draw(sent, self.parent, whole["parents"] - self.parent, np.full(len(sent), 1 / (whole["known"] + 1)))
        self.parent = np.where(hot, 0, drawn)  # those of hot words are drawn once all parts' customers are summed


def _base(sent: np.ndarray, parent: np.ndarray, whole: dict) -> np.ndarray:
    """The parent's probabilities of words."""
    return (np.maximum(sent - ROOT_DISCOUNT * parent, 0) + (ROOT_STRENGTH + ROOT_DISCOUNT * whole["parents"]) / (whole["known"] + 1)) / (ROOT_STRENGTH + whole["tables"])


#: of: the part that sent a row; below 0 the part's own state, the tables of a sample, its totals, or what its words' contexts lack.
_STATE, _SAMPLE, _TOTAL, _LACK = -1, -2, -3, -4
_SWEEP_SCHEMA = "part int, of int, n int, known int, block binary, words array<long>, sums array<long>"


def _outcome(seats: _Seats, whole: dict) -> list[tuple]:
    """A part's state, its sample, its totals, and what its dishes lack of tables for the owners of its contexts."""
    n, known, offsets = len(seats.word), len(seats.total), whole["offsets"]
    sent, hot, _ = seats.sent(whole)
    lack = seats.customers - seats.tables
    shared = np.flatnonzero(np.isin(seats.word, whole["hot_words"]))
    words, place = np.unique(seats.word[shared], return_inverse=True)
    lacking = np.bincount(place, weights=lack[shared], minlength=len(words)).astype(np.int64)
    sums = [int(sent[~hot].sum()), int(seats.parent[~hot].sum()), *lacking.tolist()]
    rows = [
        (seats.part, _STATE, n, known, seats.packed(), None, None),
        (seats.part, _SAMPLE, n, known, _pack(seats.tables, sent, seats.parent), None, None),
        (seats.part, _TOTAL, 0, 0, None, words.tolist(), sums),
    ]
    contexts, place = np.unique(seats.context, return_inverse=True)
    lacks = np.bincount(place, weights=lack, minlength=len(contexts)).astype(np.int64)
    owners = offsets[::OWNERS]
    bounds = np.searchsorted(contexts, np.append(owners, np.iinfo(np.int64).max))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        here = slice(*bounds[p : p + 2])
        rows.append((p, seats.part, here.stop - here.start, 0, _pack(_steps(contexts[here] - owners[p]), lacks[here]), None, None))
    return rows


def _begun(whole: dict) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _frame(_outcome(_Seats.unpacked(row.part, row.known, row.seats, row.state), whole), _SWEEP_SCHEMA)

    return run


def _swept(whole: dict, seed: list[int]) -> Callable:
    """One sweep of a part, from its state and what the owners of its contexts told."""

    def run(state: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        (own,) = state.itertuples(index=False)
        seats = _Seats.unpacked(own.part, own.known, own.n, own.block)
        told = told.sort_values("of")
        tables = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(b, ("<i8", n))[0] for n, b in zip(told["n"], told["block"], strict=True))])
        seats.swept(whole, tables[np.unique(seats.context, return_inverse=True)[1]], seed)
        return _frame(_outcome(seats, whole), _SWEEP_SCHEMA)

    return run


_TOLD_SCHEMA = "part int, of int, n int, block binary"


def _owned(words: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    """Sums what the contexts of some parts' words lack, and tells each part the tables of its contexts."""
    words = words.sort_values("part")
    total = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(t, ("<i8", n))[0] for n, t in zip(words["known"], words["totals"], strict=True))])
    lack, asked = np.zeros(len(total), dtype=np.int64), []
    for of, n, b in zip(sent["of"], sent["n"], sent["block"], strict=True):
        steps, lacks = _unpack(b, ("<i8", n), ("<i8", n))
        at = np.cumsum(steps)
        asked.append((of, at))
        lack[at] += lacks
    rows = [(of, int(words["part"].iloc[0]) // OWNERS, len(at), _pack((total - lack)[at])) for of, at in asked]
    own = np.split(lack, np.cumsum(words["known"])[:-1])
    return _frame(rows + [(p, _LACK, len(x), _pack(x)) for p, x in zip(words["part"], own, strict=True)], _TOLD_SCHEMA)


_ANSWER_SCHEMA = "chunk long, part int, n_words int, n_pairs int, n_seats int, block binary"


def _sampled(samples: list[dict]) -> Callable:
    """Answers every chunk of a part by the samples: for words, for their contexts, and for pairs."""

    def run(merged: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        (own,) = merged.itertuples(index=False)
        (total,), (customers,) = _unpack(own.totals, ("<i8", own.known)), _unpack(own.customers, ("<i8", own.pairs))
        number = samples[0]["offsets"][own.part] + np.arange(own.known)
        seat = np.cumsum(customers > 1) - 1
        by_word, tables = [total], []
        for s, whole in enumerate(samples):
            (here,) = drawn[(drawn["sample"] == s) & (drawn["of"] == _SAMPLE)]["block"]
            seated, sent, parent = _unpack(here, ("<i8", own.seats), ("<i8", own.known), ("<i8", own.known))
            at = np.flatnonzero(np.isin(number, whole["hot_words"]))
            if len(at):
                place = np.searchsorted(whole["hot_words"], number[at])
                sent[at], parent[at] = whole["hot_sent"][place], whole["hot_parent"][place]
            lack = [_unpack(b, ("<i8", own.known))[0] for b in drawn[(drawn["sample"] == s) & (drawn["of"] == _LACK)]["block"]]
            by_word += [sent, parent, *(lack or [np.zeros(own.known, dtype=np.int64)])]
            tables.append(seated)
        answers = {chunk: [0, 0, 0, [], []] for chunk in [*own.chunk, *own.in_chunk]}
        for chunk, n, places in zip(own.chunk, own.n_words, own.places, strict=True):
            w = np.cumsum(_unpack(places, ("<i8", n))[0])
            answers[chunk][0], answers[chunk][3] = n, [x[w] for x in by_word]
        for chunk, n, places in zip(own.in_chunk, own.n_pairs, own.pair_places, strict=True):
            p = np.cumsum(_unpack(places, ("<i8", n))[0])
            more = seat[p[customers[p] > 1]]
            answers[chunk][1:3], answers[chunk][4] = (n, len(more)), [customers[p], *(t[more] for t in tables)]
        none = np.zeros(0, dtype=np.int64)
        return _frame([(k, own.part, n, m, more, _pack(*(w or [none] * len(by_word)), *(p or [none] * (1 + SAMPLES)))) for k, (n, m, more, w, p) in answers.items()], _ANSWER_SCHEMA)

    return run


_SCORE_SCHEMA = "doc_id string, n_tokens long, n_known long, base_score double, score double"


def _scored(samples: list[dict], n_train: int) -> Callable:
    """Scores of a chunk's documents from its tokens and the parts' answers."""
    hot, known, n_parts = samples[0]["hot"], samples[0]["known"], len(samples[0]["offsets"])

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _frame([], _SCORE_SCHEMA)
        rows = {r.part: r for r in own.itertuples(index=False)}
        tokens, kept = rows[_DOCUMENTS], rows[_PAIRS]
        n_docs, n_pairs = len(tokens.doc_ids), kept.n_pairs
        by_word, part, by_pair = [], [], []
        for r in answers.sort_values("by").itertuples(index=False):
            found = _unpack(r.answer, *[("<i8", r.words)] * (1 + 3 * SAMPLES), ("<i8", r.pairs), *[("<i8", r.seats)] * SAMPLES)
            by_word.append(found[: 1 + 3 * SAMPLES])
            by_pair.append(found[1 + 3 * SAMPLES :])
            part.append(np.full(r.words, r.by))
        total, *of_word = (np.concatenate(x) for x in zip(*by_word, strict=True))
        came, *drawn = (np.concatenate(x) for x in zip(*by_pair, strict=True))  # in the order of the parts
        part = np.concatenate(part)
        del by_word, by_pair, found
        per_word, steps = _unpack(kept.block, ("<i8", kept.n_words), ("<i8", n_pairs))
        word, context = np.repeat(np.arange(kept.n_words, dtype=np.int32), per_word), _from_steps(steps, per_word).astype(np.int32)
        order = np.argsort(_homes(part, _slices(total, hot, n_parts), word, context, n_parts), kind="stable")
        p, seats, more = np.empty(n_pairs), np.empty(n_pairs), order[came > 1]
        p[order] = SAMPLES * came
        seats[order] = np.minimum(came, 1)
        del steps, order, came
        for s, whole in enumerate(samples):
            sent, parent, lack = of_word[3 * s : 3 * s + 3]
            seats[more] = drawn[s]
            p -= DISCOUNT * seats
            p += (STRENGTH + DISCOUNT * (total - lack))[context] * _base(sent, parent, whole)[word]
        p /= SAMPLES * (STRENGTH + total)[context]
        del seats, more, drawn, context
        seen, doc = _unpack(tokens.block, ("<i8", n_pairs), ("<u2", int(sum(tokens.n_tokens))))
        add = lambda x: np.bincount(doc, weights=np.repeat(x, seen), minlength=n_docs)
        n, log_base = np.array(tokens.n_tokens), np.log10(total + 0.1)
        return pd.DataFrame(
            {"doc_id": list(tokens.doc_ids), "n_tokens": n, "n_known": add((total > 0)[word].astype(float)).astype(np.int64), "base_score": add(log_base[word]) - n * math.log10(n_train + 0.1 * (known + 1)), "score": add(np.log10(p))}
        )

    return run


def _summed(rows: DataFrame, whole: dict, random: np.random.Generator | None) -> dict:
    """The whole corpus' totals after a sweep: the parts' sums, and the tables of hot words, drawn here since they are few."""
    pairs = rows.select("words", F.slice("sums", F.lit(3), F.size("words")).alias("lacks")).select(F.explode(F.arrays_zip("words", "lacks")).alias("x"))
    lack = pairs.groupBy("x.words").agg(F.sum("x.lacks").alias("lack"))
    lacks = {r["words"]: r["lack"] for r in lack.collect()}  # at most a word for every HOT tokens
    sums = rows.agg(F.sum(F.element_at("sums", 1)).alias("tables"), F.sum(F.element_at("sums", 2)).alias("parents")).first()
    sent = whole["hot_total"] - np.array([lacks.get(w, 0) for w in whole["hot_words"].tolist()], dtype=np.int64)
    parent = np.minimum(sent, 1)
    if random is not None:
        parent = _Seating(ROOT_DISCOUNT, ROOT_STRENGTH, random).draw(sent, parent, whole["parents"] - whole["hot_parent"], np.full(len(sent), 1 / (whole["known"] + 1)))
    return whole | {"hot_sent": sent, "hot_parent": parent, "tables": (sums["tables"] or 0) + int(sent.sum()), "parents": (sums["parents"] or 0) + int(parent.sum())}


def _hot_words(hot: int, n_parts: int) -> Callable:
    """The words of a part whose pairs several parts share, by place, with their occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                (total,) = _unpack(r.totals, ("<i8", r.known))
                at = np.flatnonzero(_slices(total, hot, n_parts) > 1)
                yield pd.DataFrame({"part": np.full(len(at), r.part), "place": at, "total": total[at]})

    return run


def scored(docs: DataFrame, trained: Column, text: str = "text", doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every document.

    trained says which rows the model learns from (null: not). A null text is empty and has the end token alone;
    repeated rows are learnt and scored each; a null id stays null. Without rows there is no result; where
    nothing is learnt every token is unknown and has the base measure's probability. Extra columns are not read.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_parts, hot = max(4, -(-size // PART_CHARS)), HOT
    chunks = written(rows.select("doc_id", "trained", "text").mapInArrow(_chunked(n_parts), _CHUNK_SCHEMA), "chunks")
    blocks = chunks.where("part >= 0").select("chunk", "part", "n_words", "block")
    words = written(blocks.groupBy("part").applyInPandas(_numbered, _WORDS_SCHEMA), "words")
    sizes = words.select("part", "known", "learnt", "trained").collect()  # a row for each part
    each = np.zeros(n_parts + 1, dtype=np.int64)
    for r in sizes:
        each[r["part"] + 1] = r["known"]
    offsets, n_numbers = np.cumsum(each)[:-1], int(each.sum())
    hottest = sorted((int(offsets[r["part"]]) + r["place"], r["total"]) for r in words.select("part", "known", "totals").mapInPandas(_hot_words(hot, n_parts), "part int, place long, total long").collect())
    n_train, none = sum(r["learnt"] for r in sizes), np.zeros(0, dtype=np.int64)
    whole = {"offsets": offsets, "hot": hot, "known": sum(r["trained"] for r in sizes), "hot_words": np.array([w for w, _ in hottest], dtype=np.int64), "hot_total": np.array([n for _, n in hottest], dtype=np.int64)}
    told = words.select("part", "known", "totals", "chunk", "n_words", "places").mapInArrow(_told(hot, n_parts), _NUMBERS_SCHEMA)
    pairs = chunks.where(F.col("part") == _PAIRS).select("chunk", "n_words", "n_pairs", "block").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_paired(offsets), _BLOCK_SCHEMA)
    merged = written(pairs.groupBy("part").cogroup(words.groupBy("part")).applyInPandas(_merged(n_numbers), _MERGED_SCHEMA), "customers")
    swept = written(merged.select("part", "known", "seats", "state").mapInPandas(_begun(whole), _SWEEP_SCHEMA), "seating")
    whole = _summed(swept.where(F.col("of") == _TOTAL), whole, None)
    samples, drawn, read = [], [], [words, merged]
    for sweep in range(BURN_IN + SAMPLES + 1):
        sent = swept.where("of >= 0").select("part", "of", "n", "block")
        answered = words.select("part", "known", "totals").groupBy(F.floor(F.col("part") / OWNERS).cast("int")).cogroup(sent.groupBy("part")).applyInPandas(_owned, _TOLD_SCHEMA)
        if sweep > BURN_IN:
            answered = written(answered, "told")
            samples.append(whole)
            read += [swept, answered]
            drawn += [x.where(F.col("of") == k).select("part", F.lit(sweep - BURN_IN - 1).alias("sample"), "of", "block") for x, k in ((swept, _SAMPLE), (answered, _LACK))]
        if sweep == BURN_IN + SAMPLES:
            break
        state = swept.where(F.col("of") == _STATE).select("part", "known", "n", "block")
        before = swept
        swept = written(state.groupBy("part").cogroup(answered.where("of >= 0").groupBy("part")).applyInPandas(_swept(whole, [seed, sweep]), _SWEEP_SCHEMA), "seating")
        whole = _summed(swept.where(F.col("of") == _TOTAL), whole, np.random.default_rng([seed, sweep, n_parts]))
        if sweep <= BURN_IN:
            removed(before)
    drawn = functools.reduce(DataFrame.unionByName, drawn)
    answers = written(merged.drop("state").groupBy("part").cogroup(drawn.groupBy("part")).applyInPandas(_sampled(samples), _ANSWER_SCHEMA), "answers")
    for table in read:
        removed(table)
    answers = answers.select(F.col("chunk").alias("of"), F.col("part").alias("by"), F.col("n_words").alias("words"), F.col("n_pairs").alias("pairs"), F.col("n_seats").alias("seats"), F.col("block").alias("answer"))
    own = chunks.where("part < 0")
    result = own.groupBy("chunk").cogroup(answers.groupBy("of")).applyInPandas(_scored(samples, n_train), _SCORE_SCHEMA)
    return result.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 10) == 0


def op1_pitman_yor(docs: DataFrame) -> DataFrame:
    result = scored(docs.select("doc_id", "text"), ~held_out(F.col("doc_id")))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"))
