"""Secret scans by DataFrame functions only.

Three fixed patterns give the base spans. Candidate strings (runs of a character class) add spans where a
sliding window's Shannon entropy reaches the class's limit. A window moves by one character: one count goes
up, one goes down, and the sum of count * log2(count) follows, in whole millionths, so that it never drifts.
The allow-list suppresses what it finds in a candidate and what stands within REACH characters of it, so that a
long run is still searched elsewhere (from left to right: what one match suppresses is not searched for another);
base spans are never suppressed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import with_struct

#: The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> pattern, group whose length counts (0: all), least length; and a pattern that finds its long matches only.
BASE_KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}


@dataclass(frozen=True)
class EntropyClass:
    """Runs of at least window characters of chars, holding a digit and a letter, are candidates."""

    kind: str
    chars: str
    window: int
    bits: float


ENTROPY_CLASSES = (
    EntropyClass("hex_entropy", "0123456789abcdefABCDEF", 16, 3.0),
    EntropyClass("base64_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.8),
)
#: What is no secret inside a candidate: UUIDs, placeholders, counting rows; and candidates that are paths of words.
ALLOW_LIST = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|placeholder|your[_-]|xxxx|0123456789|1234567890|abcdefgh",
)
ALLOW_WHOLE = (r"^[/_-]?([A-Za-z]+[0-9]{0,2}[/_-])+[A-Za-z]+[0-9]{0,4}$",)
#: Characters on either side of an allowed part that are suppressed with it.
REACH = 64
ALLOWED = rf"(?s).{{0,{REACH}}}(?:{'|'.join(ALLOW_LIST)}).{{0,{REACH}}}"

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_BLOCK = 256
_MARK, _OTHER = "\x01", "\x02"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body uses it inside a function of elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _sums_before(lengths: Column) -> Column:
    """For each length the sum of those before it, over blocks, so that even very many in one text stay cheap."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))

    def of_sums(sums: Column) -> Column:
        before = F.transform(blocks, lambda b: _total(F.slice(sums, 1, b)))
        at = lambda i: F.floor(i / _BLOCK).cast("int")
        return _let(before, lambda bs: F.transform(lengths, lambda _, i: F.element_at(bs, at(i) + 1) + _total(F.slice(lengths, at(i) * _BLOCK + 1, i % _BLOCK))))

    return _let(F.transform(blocks, lambda b: _total(F.slice(lengths, b * _BLOCK + 1, _BLOCK))), of_sums)


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs of start, hit and value, in code points; null without any.

    One replacement puts marks around every match, and one split at the marks gives gaps, hits and values in turn.
    """
    unmarked = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(unmarked, pattern, f"{_MARK}$0{_MARK}${group}{_MARK}"), _MARK, -1)

    def of_parts(ps: Column) -> Column:
        part = lambda i, k: F.element_at(ps, 3 * i + k + 1)
        numbers = F.sequence(F.lit(0), ((F.size(ps) - 1) / 3).cast("int") - 1)
        lengths = F.transform(numbers, lambda i: F.length(part(i, 0)) + F.length(part(i, 1)))
        of_lengths = lambda ls: F.zip_with(
            numbers, _sums_before(ls), lambda i, n: F.struct((n + F.length(part(i, 0))).alias("start"), part(i, 1).alias("hit"), part(i, 2).alias("value"))
        )
        return F.when(F.size(ps) > 1, _let(lengths, of_lengths))

    return _let(parts, of_parts)


def _base(text: Column, number: int, kind: str) -> Column:
    pattern, group, least = BASE_KINDS[kind]
    pattern = LONG.get(kind, pattern)
    found = F.filter(_located(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end")))
    return F.coalesce(F.when(text.rlike(pattern), spans), _none())


def _open_parts(hit: Column) -> Column:
    """What the allow-list leaves of a candidate, as structs of start and part."""

    def cut(ps: Column) -> Column:
        of_lengths = lambda ls: F.zip_with(ps, _sums_before(ls), lambda p, n: F.struct(n.alias("start"), p.alias("part")))
        return F.filter(_let(F.transform(ps, F.length), of_lengths), lambda _, i: i % 2 == 0)

    whole = F.array(F.struct(F.lit(0).alias("start"), hit.alias("part")))
    return F.when(_any([hit.rlike(p) for p in ALLOW_LIST]), _let(F.split(F.regexp_replace(hit, ALLOWED, f"{_MARK}$0{_MARK}"), _MARK, -1), cut)).otherwise(whole)


def _windows(hit: Column, c: EntropyClass) -> Column:
    """The merged stretches of a candidate whose windows reach the limit: structs of start and end."""
    weigh = F.array(*[F.lit(round(n * math.log2(n) * 1e6) if n else 0) for n in range(c.window + 1)])
    most = math.floor((math.log2(c.window) - c.bits) * c.window * 1e6)  # of the sum of count * log2(count)
    stretch = "struct<start:int,end:int>"

    def scan(codes: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), len(c.chars)).alias("counts"),
            F.lit(0).cast("long").alias("weight"),
            F.expr("cast(array() as array<" + stretch + ">)").alias("done"),
            F.expr(f"cast(null as {stretch})").alias("last"),
        )

        def step(s: Column, p: Column) -> Column:
            entering, leaving = F.element_at(codes, p), F.when(p > c.window, F.element_at(codes, F.greatest(p - c.window, F.lit(1)))).otherwise(F.lit(0))
            same = entering == leaving
            up, down = F.element_at(s["counts"], entering), F.element_at(s["counts"], F.greatest(leaving, F.lit(1)))
            at = lambda n: F.element_at(weigh, n + 1)
            weight = s["weight"] + F.when(same, F.lit(0)).otherwise(at(up + 1) - at(up) + F.when(leaving > 0, at(down - 1) - at(down)).otherwise(F.lit(0)))
            counts = F.transform(s["counts"], lambda n, i: n + F.when(i + 1 == entering, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0))
            high = (p >= c.window) & (weight <= most)
            begin, end = (p - c.window).cast("int"), p.cast("int")
            joins = high & s["last"].isNotNull() & (s["last"]["end"] >= begin)
            return F.struct(
                counts.alias("counts"),
                weight.cast("long").alias("weight"),
                F.when(high & s["last"].isNotNull() & ~joins, F.array_append(s["done"], s["last"])).otherwise(s["done"]).alias("done"),
                F.when(joins, F.struct(s["last"]["start"].alias("start"), end.alias("end"))).when(high, F.struct(begin.alias("start"), end.alias("end"))).otherwise(s["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["last"])))

    codes = F.transform(F.split(hit, "(?<=.)(?=.)"), lambda ch: F.instr(F.lit(c.chars), ch))
    return _let(codes, scan)


def _entropy(text: Column, number: int, c: EntropyClass) -> Column:
    inside = "[" + c.chars.replace("-", "\\-") + "]"
    # a run that is long enough and, looking ahead, holds a digit and a letter
    run = rf"(?<!{inside})(?={inside}*?[0-9])(?={inside}*?[A-Za-z]){inside}{{{c.window},}}+"
    found = F.filter(_located(text, run), lambda x: ~_any([x["hit"].rlike(p) for p in ALLOW_WHOLE]))
    found = F.flatten(F.transform(found, lambda x: F.transform(_open_parts(x["hit"]), lambda p: F.struct((x["start"] + p["start"]).alias("start"), p["part"].alias("part")))))
    scanned_parts = F.transform(
        F.filter(found, lambda x: F.length(x["part"]) >= c.window),
        lambda x: F.transform(_windows(x["part"], c), lambda w: F.struct((x["start"] + w["start"]).alias("start"), F.lit(number).alias("kind"), (x["start"] + w["end"]).alias("end"))),
    )
    return F.coalesce(F.when(text.rlike(run), F.flatten(scanned_parts)), _none())


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


KINDS = [*BASE_KINDS, *(c.kind for c in ENTROPY_CLASSES)]


def _scan(text: Column) -> Column:
    """Struct of base and added: arrays of (start, number of the kind, end), sorted."""
    text = F.coalesce(text, F.lit(""))
    base = F.array_sort(F.concat(*[_base(text, n, k) for n, k in enumerate(BASE_KINDS)]))
    more = F.array_sort(F.concat(*[_entropy(text, len(BASE_KINDS) + n, c) for n, c in enumerate(ENTROPY_CLASSES)]))
    return _let(
        F.struct(base.alias("base"), more.alias("more")),
        lambda x: F.struct(x["base"].alias("base"), F.filter(x["more"], lambda m: ~F.exists(x["base"], lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))).alias("added")),
    )


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and added_spans: arrays of (start, kind, end), code points, end exclusive.

    kind counts KINDS from 0. A null text is empty and has no spans; added spans inside a base span are
    left out. Rows are scanned one by one, whole: repeated rows get equal spans, an empty table stays
    empty. Columns of docs with the names of results are replaced.
    """
    found = _scan(F.col(f"`{text}`"))
    return with_struct(docs, _let(found, lambda x: F.struct(x["base"].alias("base_spans"), x["added"].alias("added_spans"))), ["base_spans", "added_spans"])


def all_spans() -> Column:
    return F.array_sort(F.concat("base_spans", "added_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(scans: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The result of scanned with every span of the text replaced by mark; overlapping spans become one."""
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, x: Column, t: Column) -> Column:
        piece = F.when(x["start"] > s["at"], F.substring(t, s["at"] + 1, x["start"] - s["at"])).otherwise(F.lit(""))
        fresh = (x["start"] > s["at"]) | (F.size(s["kept"]) == 0)
        return F.struct(F.when(fresh, F.array_append(s["kept"], piece)).otherwise(s["kept"]).alias("kept"), F.greatest(s["at"], x["end"]).alias("at"))

    t = F.col(f"`{text}`")
    clean = F.aggregate(all_spans(), zero, lambda s, x: step(s, x, t), lambda s: F.array_join(F.array_append(s["kept"], F.substring(t, s["at"] + 1, F.length(t))), mark))
    return scans.withColumn(text, F.when(F.size(all_spans()) > 0, clean).otherwise(t))


def op10_secrets(docs: DataFrame) -> DataFrame:
    count = lambda n: F.size(F.filter("base_spans", lambda s: s["kind"] == n)).cast("long")
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)],
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
    )


def _sql_base(n: int, kind: str) -> str:
    pattern, group, least = BASE_KINDS[kind]
    quoted = ("(?s)(.*?)(" + pattern + ")").replace("'", "''")
    return f"""
b{n} AS (SELECT r, unnest(list_zip(regexp_extract_all(t, '{quoted}', 1), regexp_extract_all(t, '{quoted}', 2), regexp_extract_all(t, '{quoted}', {2 + group}))) AS x,
  unnest(range(1, len(regexp_extract_all(t, '{quoted}', 1)) + 1)) AS i FROM d),
s{n} AS (SELECT r, {n} AS kind, (sum(length(x[1]) + length(x[2])) OVER (PARTITION BY r ORDER BY i) - length(x[2]))::BIGINT AS s, x[2] AS hit, x[3] AS v FROM b{n}),
k{n} AS (SELECT r, kind, s, s + length(hit) AS e FROM s{n} WHERE length(v) >= {least})"""


def _sql_entropy(n: int, c: EntropyClass) -> str:
    run = "[" + c.chars.replace("-", "\\-") + "]+"
    bar = " OR ".join(f"regexp_matches(hit, '{p}')" for p in ALLOW_WHOLE)
    cut = f"string_split(regexp_replace(hit, '{ALLOWED}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    limit = math.floor((math.log2(c.window) - c.bits) * c.window * 1e6)
    return f"""
c{n} AS (SELECT r, unnest(list_zip(regexp_extract_all(t, '(?s)(.*?)({run})', 1), regexp_extract_all(t, '(?s)(.*?)({run})', 2))) AS x,
  unnest(range(1, len(regexp_extract_all(t, '(?s)(.*?)({run})', 1)) + 1)) AS i FROM d),
h{n} AS (SELECT r, i, (sum(length(x[1]) + length(x[2])) OVER (PARTITION BY r ORDER BY i) - length(x[2]))::BIGINT AS s, x[2] AS hit FROM c{n}),
q{n} AS (SELECT * FROM h{n} WHERE length(hit) >= {c.window} AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({bar})),
o{n} AS (SELECT r, i, s, unnest({cut}) AS part, unnest(range(0, len({cut}))) AS j FROM q{n}),
v{n} AS (SELECT r, i * 1000000 + j AS i, j, (s + sum(length(part)) OVER (PARTITION BY r, i ORDER BY j) - length(part))::BIGINT AS s, part AS hit FROM o{n}),
w{n} AS (SELECT r, i, s + p AS a, hit[p + 1:p + {c.window}] AS y FROM (SELECT *, unnest(range(0, length(hit) - {c.window} + 1)) AS p FROM v{n} WHERE j % 2 = 0 AND length(hit) >= {c.window})),
y{n} AS (SELECT r, i, a, ch, count(*) AS k FROM (SELECT r, i, a, unnest(string_split(y, '')) AS ch FROM w{n}) GROUP BY ALL),
z{n} AS (SELECT r, i, a FROM y{n} GROUP BY r, i, a HAVING sum(round(k * log2(k) * 1e6)) <= {limit}),
g{n} AS (SELECT r, i, a, sum(new) OVER (PARTITION BY r, i ORDER BY a) AS g FROM (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY r, i ORDER BY a) <= {c.window} THEN 0 ELSE 1 END AS new FROM z{n})),
k{n} AS (SELECT r, {n} AS kind, min(a) AS s, max(a) + {c.window} AS e FROM g{n} GROUP BY r, i, g)"""


_N = len(BASE_KINDS)
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{','.join(_sql_base(n, k) for n, k in enumerate(BASE_KINDS))},
{','.join(_sql_entropy(_N + n, c) for n, c in enumerate(ENTROPY_CLASSES))},
base AS ({' UNION ALL '.join(f'SELECT * FROM k{n}' for n in range(_N))}),
more AS ({' UNION ALL '.join(f'SELECT * FROM k{n}' for n in range(_N, len(KINDS)))}),
spans AS (SELECT *, true AS own FROM base UNION ALL
  SELECT *, false FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s <= m.s AND m.e <= b.e)),
named AS (SELECT *, {str(KINDS)}[kind + 1] || ':' || s || ':' || e AS x FROM spans),
a AS (SELECT r, {', '.join(f'count(*) FILTER (kind = {n}) AS n_{k}' for n, k in enumerate(BASE_KINDS))},
  string_agg(x, ',' ORDER BY s, kind, e) FILTER (own) AS own, string_agg(x, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
