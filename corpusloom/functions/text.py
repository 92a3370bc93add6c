"""Text functions as Spark columns: cleaning, validity, keys, hashes, dates.

White space is Unicode's: patterns carry (?U), since Java's \\s is ASCII only. Only Unicode normal forms, which
Spark lacks, are pandas UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the cleaning rules.
IMAGE_MARKDOWN = r"!\[[^\]]*\]\([^\)]+\)"
URL = r"https?://\S+"
SEQUENCE_PREFIX = r"(?U)^\s*\d{1,3}[.)）]\s*"
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[A-Za-z]?\d{15,18})(?![A-Za-z0-9])"
DOT_LEADER = r"(?U)^\s*[^\n]{1,80}\.{4,}\s*\d+\s*$"
BARE_NUMBER = r"^\d+(?:\.\d+)?$"
NUMBER_WITH_UNIT = r"(?i)^\d+(?:\.\d+)?\s*(?:%|cm|mm|m|km|kg|t)$"
DATE_FRAGMENT = r"^\d{4}\D\d{1,2}\D(?:\d{1,2}\D)?$"
REDACTED = "[REDACTED]"
#: Names that hold one of these are no entities.
INVALID_KEYWORDS = ("实体类型", "关系类型", "分类", "章节", "标题", "1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.")
#: A cited standard is a title in marks with an optional code.
CITATION_CODE = r"(?:Q[ /]?[A-Z]{1,5}|SY[ /]?[Tt]|GB|JGJ|NB[ /]?[Tt]|SH[ /]?[Tt]|DL[ /]?[Tt]|AQ)[ \t]*[A-Z]?[ \t]*[0-9][0-9A-Za-z./ \t-]{1,30}[0-9]"
CITATION = r"《[^》]{2,80}》(?:[ \t]*[（(]?[ \t]*(?:" + CITATION_CODE + r")[ \t]*[）)]?)?"
#: Placeholders in table cells.
PLACEHOLDER = r"^(?:—|-|/|无|暂无|待填|待补|示例|\s*)$"
DATE = r"(20\d{2})[年\-/.](\d{1,2})[月\-/.](\d{1,2})"
#: Fixed value: what a match key leaves out.
KEY_PUNCTUATION = r"[\s\u3000，,。；;：:（）()【】\[\]《》<>‘’'\"、·—-]+"
#: Arrows between steps, labels before a chain of steps, and what no step is.
STEP_ARROWS = r"\s*(?:→|->|—>|⇒|＞)\s*"
STEP_LABEL = r"^(?:施工顺序安排|施工顺序|施工步骤|作业步骤)\s*[：:]\s*"
STEP_EXCLUDED = ("风险作业目录", "目录编号", "作业编号", "不涉及风险作业")
STEP_CODE = r"(?i)\bCN-[A-Z0-9-]+\b"
STEP_TITLE = r"(?:施工顺序|施工步骤|作业步骤)[：:]*$"
MOST_STEP = 120
#: Characters of a sheet's cell, and what ends a cut one.
MOST_CELL, CUT_NOTICE = 32_767, "[导出内容已截断，请在页面查看完整证据]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def remove_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE_MARKDOWN, "")


def count_images(text: Column) -> Column:
    return F.regexp_count(text, F.lit(IMAGE_MARKDOWN))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def clean_document(text: Column) -> Column:
    """Struct of clean_text, removed (line, reason), image_count, sequence_count and identifier_count.

    Images and URLs go first; directory lines with dot leaders are dropped, sequence prefixes cut, identifiers of
    15 to 18 digits redacted, blank lines dropped. A null text gives nulls.
    """
    lines = F.transform(
        F.split(remove_urls(remove_images(text)), r"\R"),
        lambda line, i: F.struct(
            (i + 1).alias("line"),
            line.rlike(DOT_LEADER).alias("leader"),
            line.rlike(SEQUENCE_PREFIX).alias("numbered"),
            F.regexp_replace(line, SEQUENCE_PREFIX, "").alias("rest"),
        ),
    )
    marked = F.transform(
        lines,
        lambda x: F.struct(
            x["line"].alias("line"), x["leader"].alias("leader"), (x["numbered"] & ~x["leader"]).alias("numbered"),
            F.when(x["leader"], 0).otherwise(F.regexp_count(x["rest"], F.lit(IDENTIFIER))).alias("identifiers"),
            F.regexp_replace(x["rest"], IDENTIFIER, F.lit(r"\[REDACTED\]")).alias("text"),
        ),
    )

    def result(xs: Column) -> Column:
        reasons = lambda x: F.filter(
            F.array(
                F.when(x["leader"], F.lit("directory_leader")), F.when(x["numbered"], F.lit("sequence_prefix")), F.when(x["identifiers"] > 0, F.lit("identifier")),
            ),
            lambda r: r.isNotNull(),
        )
        kept = F.filter(xs, lambda x: ~x["leader"] & x["text"].rlike(r"(?U)\S"))
        total = lambda f: F.aggregate(xs, F.lit(0), lambda n, x: n + f(x))
        return F.struct(
            F.array_join(F.transform(kept, lambda x: rstrip(x["text"])), "\n").alias("clean_text"),
            F.flatten(F.transform(xs, lambda x: F.transform(reasons(x), lambda r: F.struct(x["line"].alias("line"), r.alias("reason"))))).alias("removed"),
            count_images(text).alias("image_count"),
            total(lambda x: x["numbered"].cast("int")).alias("sequence_count"),
            total(lambda x: x["identifiers"]).alias("identifier_count"),
        )

    return F.element_at(F.transform(F.array(marked), result), 1)


def is_valid_candidate(name: Column) -> Column:
    """No blank, bare number, number with unit, date fragment, URL or identifier; null is invalid."""
    value = strip(F.coalesce(name, F.lit("")))
    bad = (value == "") | value.rlike(BARE_NUMBER) | value.rlike(NUMBER_WITH_UNIT) | value.rlike(DATE_FRAGMENT) | value.rlike(f"^(?:{URL})$") | value.rlike(f"^(?:{IDENTIFIER})$")
    return ~bad


def has_invalid_keyword(name: Column, keywords: tuple[str, ...] = INVALID_KEYWORDS) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(name, k))


def citations(text: Column) -> Column:
    """Distinct cited standards of at least four characters, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), lambda x: F.regexp_replace(strip(x), "[；;，,。.]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 4))


def _normal_form(form: str):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return F.pandas_udf(run, "string")


def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).casefold().split()))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    """The compatibility form; plain ASCII, which has no other, is not sent to Python."""
    return F.coalesce(_normal_form("NFKC")(F.when(~is_ascii(text), text)), text)


def lookup_key(text: Column) -> Column:
    """NFKC, case folded, without white space."""
    return F.pandas_udf(_fold, "string")(text)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def entity_name(text: Column, normalise: bool = True) -> Column:
    """Graph identity of a name: NFKC, one space between words, A-Z in lower case. Plain ASCII needs no NFKC."""
    value = F.coalesce(text, F.lit(""))
    value = nfkc(value) if normalise else value
    return F.translate(collapsed(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def match_key(text: Column, normalise: bool = True) -> Column:
    """NFKC, without white space and punctuation, in lower case."""
    value = nfkc(text) if normalise else text
    return F.lower(F.regexp_replace(value, f"(?U){KEY_PUNCTUATION}", ""))


def alignment_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"(?U)[\s\-_（）()\[\]【】《》“”\"']", "")


def stable_hash(*columns: Column | str) -> Column:
    """sha-256 of compact JSON of the columns, in the order given (callers sort by name); nulls are written."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hash_number(code: Column) -> Column:
    """The first 60 bits of a hexadecimal hash as a positive number."""
    return F.conv(F.substring(code, 1, 15), 16, 10).cast("long")


def redact(text: Column, secrets: list[str]) -> Column:
    """Listed secrets, then bearer tokens, replaced by a mark."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", F.lit(r"$1\[REDACTED\]"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[\\/:*?\"<>|\s]+", "_")


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def version_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(20\d{2})年", 1).try_cast("int")


def dates(text: Column) -> Column:
    """All dates 20xx-m-d in three notations; those that no calendar has are skipped."""
    parts = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    made = F.transform(parts, lambda p: F.try_to_date(F.regexp_replace(p, r"^(\d+)\D(\d+)\D(\d+)$", "$1-$2-$3"), "yyyy-M-d"))
    return F.filter(made, lambda d: d.isNotNull())


def is_chronological(start: Column, end: Column) -> Column:
    return start <= end


def steps(text: Column) -> Column:
    """A chain of steps cut at arrows, without its label; what is blank, too long, a title, a code or an excluded term goes."""
    parts = F.transform(F.split(F.regexp_replace(collapsed(text), STEP_LABEL, ""), STEP_ARROWS), collapsed)
    excluded = lambda p: F.exists(F.array(*[F.lit(t) for t in STEP_EXCLUDED]), lambda t: F.contains(p, t))
    return F.filter(parts, lambda p: (p != "") & (F.length(p) <= MOST_STEP) & ~excluded(p) & ~p.rlike(STEP_CODE) & ~p.rlike(STEP_TITLE))


def is_meaningful(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False)) & ~strip(value).rlike(PLACEHOLDER)


def short_cell(text: Column, most: int = MOST_CELL, notice: str = CUT_NOTICE) -> Column:
    """A text that a sheet's cell can hold: a longer one is cut so that it and the notice fill the cell."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(notice))), F.lit(notice))).otherwise(text)


def cell(value: Column, kind: str) -> Column:
    """An export cell: null is empty, nested values are JSON, times are YYYY-MM-DD HH:MM:SS."""
    if kind.startswith(("array", "struct", "map")):
        value = F.to_json(value)
    elif kind == "timestamp":
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(value.cast("string"), F.lit(""))


def source_type(requested: str, name: Column) -> Column:
    """case or spec; auto decides by the name."""
    if requested not in ("auto", "case", "spec"):
        raise ValueError(f"unknown source type: {requested}")
    spec = F.contains(name, F.lit("规范")) | F.contains(name, F.lit("标准"))
    return F.when(spec, F.lit("spec")).otherwise(F.lit("case")) if requested == "auto" else F.lit(requested)
