"""Placeholders, masks and legend texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENTITY_TYPES, GENDERED_LABELS, LABELS, MASKS
from .geometry import fits_all
from .text import pad2


def _by_type(values: dict[str, str], kind: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kind)


def type_rank(kind: Column) -> Column:
    """A type's place in the fixed order."""
    return F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), kind).cast("int")


def mask_of(kind: Column) -> Column:
    """F25."""
    return _by_type(MASKS, kind)


def label(kind: Column, gender: Column, level: int) -> Column:
    """F22."""
    plain = _by_type({k: v[level] for k, v in LABELS.items()}, kind)
    known = _by_type({k: v[level] for k, v in GENDERED_LABELS.items()}, gender)
    return F.when((kind == "PERSON") & gender.isNotNull(), known).otherwise(plain)


def token(kind: Column, gender: Column, index: Column, level: int) -> Column:
    return F.concat(F.lit("["), label(kind, gender, level), F.lit("-" if level == 2 else " "), pad2(index), F.lit("]"))


def ladder(kind: Column, gender: Column, index: Column) -> Column:
    """The distinct tokens from the longest to the shortest."""
    return F.array_distinct(F.array(*(token(kind, gender, index, k) for k in range(3))))


def placeholder(kind: Column, gender: Column, index: Column, boxes: Column) -> Column:
    """the longest token that fits every box, else the shortest."""
    t = [token(kind, gender, index, k) for k in range(3)]
    return F.when(fits_all(t[0], boxes), t[0]).when(fits_all(t[1], boxes), t[1]).otherwise(t[2])


def prefix(value: Column) -> Column:
    """K6: the label in a token."""
    return F.regexp_extract(value, r"^\[(.+)[\s-]\d+\]$", 1)


def clean_metadata(value: Column) -> Column:
    """K7."""
    return F.substring(F.regexp_replace(value, r"[\x00-\x1F\x7F]", ""), 1, 500)


def counted(n: Column, one: str, many: str) -> Column:
    """F46."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))
