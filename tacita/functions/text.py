"""Text expressions: normal forms, dates, sub-tokens and context."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONTEXT_CHARS

#: What the reference's pattern language counts as white space, for Java, whose \s is ASCII.
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: A word boundary between ASCII word characters and others; Java's \b takes accented letters as word characters.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Months as written, and their numbers.
MONTHS = {"enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07", "agosto": "08", "septiembre": "09", "setiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12"}
TEXT_DATE = rf"(?i)(\d{{1,2}})(?:{WS}++|{WS}*+[°º]{WS}++)de{WS}++({'|'.join(MONTHS)}){WS}++del?{WS}++(\d{{4}})"


def _bases() -> dict[str, str]:
    """Every letter that Unicode builds from one letter and marks U+0300 to U+036F, with that letter."""
    out = {}
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all("\u0300" <= m <= "\u036f" for m in parts[1:]):
            out[chr(code)] = parts[0]
    return out


BASES = _bases()


def fold(value: str) -> str:
    """Lower case without marks, blanks collapsed."""
    lowered = unicodedata.normalize("NFC", value).lower()
    bare = "".join(c for c in unicodedata.normalize("NFD", lowered) if not "̀" <= c <= "ͯ")
    return " ".join(bare.split())


@F.pandas_udf(T.StringType())
def comparable_exact(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold() itself, for scripts whose letters decompose otherwise."""
    for v in values:
        yield v.map(fold, na_action="ignore")


def comparable(value: Column) -> Column:
    """F1 in the JVM: lower case, marks removed, blanks collapsed."""
    bare = F.regexp_replace(F.translate(F.lower(value), "".join(BASES), "".join(BASES.values())), r"[\x{0300}-\x{036F}]+", "")
    return F.trim(F.regexp_replace(bare, f"{WS}+", " "))


def entity_key(value: Column) -> Column:
    """the grouping key, comparable() without edges that are no letter or digit."""
    return F.regexp_replace(comparable(value), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def without(value: Column, *parts: str) -> Column:
    for p in parts:
        value = F.replace(value, F.lit(p), F.lit(""))
    return value


def upper_packed(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), f"{WS}+", "")


def pad2(value: Column) -> Column:
    """Two digits at least; lpad alone would cut longer numbers."""
    text = value.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def numeric_date(value: Column) -> Column:
    """d/m/y or d-m-y as DD/MM/YYYY; two-digit years to 49 are of this century."""
    p = F.split(value, "[/-]")
    year = F.try_element_at(p, F.lit(3))
    full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") <= 49, F.lit("20")).otherwise(F.lit("19")), year)).otherwise(year)
    return F.when(F.size(p) >= 3, F.concat_ws("/", pad2(F.element_at(p, 1)), pad2(F.try_element_at(p, F.lit(2))), full)).otherwise(value)


def textual_date(value: Column) -> Column:
    """"7 de julio de 2026" as DD/MM/YYYY."""
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.try_element_at(months, F.lower(F.regexp_extract(value, TEXT_DATE, 2)))
    made = F.concat_ws("/", pad2(F.regexp_extract(value, TEXT_DATE, 1)), month, F.regexp_extract(value, TEXT_DATE, 3))
    return F.when(month.isNotNull(), made).otherwise(value)


def caption_flip(value: Column) -> Column:
    """"Surname, Given" as "given surname"."""
    at = F.locate(",", value)
    return comparable(F.when(at > 0, F.concat(F.substr(value, at + 1), F.lit(" "), F.substring(value, F.lit(1), at - 1))).otherwise(value))


def sub_tokens(value: Column) -> Column:
    """runs of letters and digits of the comparable form."""
    return F.regexp_extract_all(comparable(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def context(text: Column, start: Column, end: Column) -> Column:
    """Up to CONTEXT_CHARS before and after [start, end), cut at blanks; null where nothing is left. Places are
    code points from 0."""
    size = F.length(text)
    raw_from, raw_to = F.greatest(F.lit(0), start - CONTEXT_CHARS), F.least(size, end + CONTEXT_CHARS)
    # the first blank at or after raw_from, and the last at or before raw_to
    next_blank = F.locate(" ", F.substr(text, raw_from + 1))
    cut_from = F.when(raw_from <= 0, F.lit(0)).when(next_blank == 0, raw_from).otherwise(raw_from + next_blank)
    back = F.locate(" ", F.reverse(F.substring(text, F.lit(1), raw_to + 1)))
    cut_to = F.when(raw_to >= size, size).when(back == 0, raw_to).otherwise(raw_to + 1 - back)
    before = F.ltrim(F.when(cut_from < start, F.substring(text, cut_from + 1, start - cut_from)).otherwise(F.lit("")))
    after = F.rtrim(F.when(cut_to > end, F.substring(text, end + 1, cut_to - end)).otherwise(F.lit("")))
    valid = (start >= 0) & (end <= size) & (start < end) & ((before != "") | (after != ""))
    return F.when(valid, F.struct(before.alias("before"), after.alias("after")))
