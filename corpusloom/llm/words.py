"""Words of many texts at once as 64-bit hashes, in numpy.

A text's hash values come from its UTF-8 bytes by prefix sums of byte * BASE**position modulo 2**64;
dividing by BASE**start makes the value independent of where the word stands. A finishing mix spreads
the bits. Equal words always have equal hashes; unequal ones differ but for chances near 2**-64.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_UNIT = 1 << 18

#: Byte tables: A-Z lowered. SPACED keeps words between \x20 and \x09-\x0D; ALNUM keeps words of 0-9, a-z and all beyond ASCII.
SPACED = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _powers(base: int) -> np.ndarray:
    out = np.full(_UNIT, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE)
_INVERSES = _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(texts: list, kind: bytes) -> list[bytes]:
    """UTF-8 of the texts under a byte table; a null text has no bytes."""
    return [b"" if t is None else t.encode("utf-8", "replace").translate(kind) for t in texts]


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block of at most _UNIT bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = raw != 32
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _INVERSES[starts])


def _hash_long(data: bytes) -> np.ndarray:
    """As _hash_block for one text of any length: cut at spaces, words longer than a block one by one."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _UNIT)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            if cut <= at:
                stop = data.find(b" ", at)
                stop = len(data) if stop < 0 else stop
                if stop - at > _UNIT:  # a word of more than a block: chain its blocks
                    h = np.zeros(1, dtype=np.uint64)
                    for k in range(at, stop, _UNIT):
                        h = mix(h + _hash_block(data[k : min(stop, k + _UNIT)])[2] * np.uint64(3))
                    out.append(h)
                    at = stop
                    continue
                end = stop
            else:
                end = cut
        if end == at:
            at += 1
            continue
        out.append(_hash_block(data[at:end])[2])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the encoded texts, one after another, and the number of words of each text."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(encoded), dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            starts, _, h = _hash_block(b" ".join(encoded[i] for i in group))
            bounds = np.cumsum([0] + [len(encoded[i]) + 1 for i in group])
            counts[group] = np.diff(np.searchsorted(starts, bounds))
            parts.append(h)
        group, size = [], 0

    for i, data in enumerate(encoded):
        if len(data) > _UNIT // 2:
            flush()
            h = _hash_long(data)
            counts[i] = len(h)
            parts.append(h)
            continue
        if size + len(data) + 1 > _UNIT:
            flush()
        group.append(i)
        size += len(data) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), counts


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all n-word windows of one sequence of word hashes."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(_BASE) + h[j : len(h) - n + 1 + j]
    return mix(out)
