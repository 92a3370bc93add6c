"""Quality rules by repetition coverage.

Rolling hashes of n-word windows (n = 5 to 10) mark every window that repeats an earlier one of the same
text; the share of a text's word characters under marked windows, and the shares of repeated lines and of
the characters in them, are held against limits. The widths and limits are those published for the
MassiveText corpus (Rae et al. 2021, table A1).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import with_struct
from corpusloom.llm.words import mix

#: Window width -> most percent of word characters inside windows that repeat an earlier one.
COVERAGE_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of repeated lines, and of characters in them.
LINE_LIMIT, LINE_CHARS_LIMIT = 30, 20
MIN_WORDS, REPEAT_LIMIT = 50, 50

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, "n_lines", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE_LIMITS]]
_TYPE = "struct<" + ",".join(f"{c}: bigint" for c in MEASURES) + ">"


def _repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value: whether it stands elsewhere too, and whether it stands further left too."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    again, earlier = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    earlier[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, earlier


def _under(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """The words under the windows of n words that begin where starts is true."""
    edge = np.zeros(length + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> dict[str, int]:
    """All measures of one text; a null text has zeros."""
    out = dict.fromkeys(MEASURES, 0)
    if not text:
        return out
    words = text.encode("utf-8", "replace").split()
    out["n_words"] = n = len(words)
    out["n_symbols"] = sum(map(text.count, _SYMBOLS))
    out["word_chars"] = len(text) - sum(map(text.count, _SPACES))
    lines = Counter(line for line in text.split("\n") if line.strip(_SPACES))
    out["n_lines"] = sum(lines.values())
    out["n_dup_lines"] = out["n_lines"] - len(lines)
    out["dup_line_chars"] = sum((k - 1) * (len(line) - sum(map(line.count, _SPACES))) for line, k in lines.items() if k > 1)
    if n < 3:
        return out
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) < 1 << 20:
        triples = (seq[:-2] * len(ids) + seq[1:-1]) * len(ids) + seq[2:]
    else:  # ranks of pairs keep the key within 64 bits
        pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(ids) + seq[2:]
    again, _ = _repeats(triples)
    out["n_repeat_words"] = int(_under(again, 3, n).sum()) if again.any() else 0
    if not out["n_repeat_words"]:
        return out  # no longer window can repeat either
    chars = np.fromiter((len(w) - sum(128 <= b < 192 for b in w) if not w.isascii() else len(w) for w in ids), dtype=np.int64, count=len(ids))[seq]
    rolled = hashed = mix(seq.astype(np.uint64) + np.uint64(1))
    for width in range(2, max(COVERAGE_LIMITS) + 1):
        if n < width:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[width - 1 :]
        if width in COVERAGE_LIMITS:
            _, earlier = _repeats(rolled)
            if not earlier.any():
                break
            out[f"dup_chars_{width}"] = int(chars[_under(earlier, width, n)].sum())
    return out


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed, covered_failed (the method's verdict) and kept.

    A null or empty text has no words and fails the base rule. Every row is judged by itself, so repeated
    rows get equal verdicts and an empty table stays empty. Columns of docs with the names of results are
    replaced.
    """
    out = with_struct(docs, F.pandas_udf(_measures, _TYPE)(F.col(f"`{text}`")), MEASURES)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_LIMIT)
    covered = (F.col("n_dup_lines") * 100 > F.col("n_lines") * LINE_LIMIT) | (F.col("dup_line_chars") * 100 > F.col("word_chars") * LINE_CHARS_LIMIT)
    for n, most in COVERAGE_LIMITS.items():
        covered = covered | (F.col(f"dup_chars_{n}") * 100 > F.col("word_chars") * most)
    return out.withColumns({"base_failed": base, "covered_failed": covered, "kept": ~base & ~covered})


def op9_repetition(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept", "n_lines", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE_LIMITS])


_SPACE = "[\\x20\\x09-\\x0D]"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, [x for x in regexp_split_to_array(t, '{_SPACE}+') if x <> ''] AS ws FROM d),
b AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
l AS (SELECT r, x, length(regexp_replace(x, '{_SPACE}', '', 'g')) AS c, count(*) AS k
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_replace(x, '{_SPACE}', '', 'g') <> '' GROUP BY r, x),
lines AS (SELECT r, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * c)::BIGINT AS dup_line_chars FROM l GROUP BY r),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
n AS (SELECT unnest([3, {', '.join(map(str, COVERAGE_LIMITS))}]) AS n),
g AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM p, n WHERE i + n - 1 <= len(ws)),
o AS (SELECT r, i, n, count(*) OVER (PARTITION BY r, n, gram) AS k, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS nth FROM g),
u AS (SELECT DISTINCT r, n, i + j AS i FROM o, (SELECT unnest(range(0, 10)) AS j) WHERE j < n AND k > 1 AND (n = 3 OR nth > 1)),
c AS (SELECT r, count(*) FILTER (n = 3) AS n_repeat_words, {', '.join(f'coalesce(sum(length(ws[i])) FILTER (n = {n}), 0)::BIGINT AS dup_chars_{n}' for n in COVERAGE_LIMITS)} FROM u JOIN w USING (r) GROUP BY r),
a AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {', '.join(f'coalesce(dup_chars_{n}, 0) AS dup_chars_{n}' for n in COVERAGE_LIMITS)}
      FROM b LEFT JOIN lines USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_LIMIT} AS base_failed,
        n_dup_lines * 100 > n_lines * {LINE_LIMIT} OR dup_line_chars * 100 > word_chars * {LINE_CHARS_LIMIT}
        OR {' OR '.join(f'dup_chars_{n} * 100 > word_chars * {m}' for n, m in COVERAGE_LIMITS.items())} AS covered_failed FROM a)
SELECT * EXCLUDE (covered_failed), NOT base_failed AND NOT covered_failed AS kept FROM f
"""
