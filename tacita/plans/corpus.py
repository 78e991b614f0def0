"""The whole way of a text corpus: pages, detections, entities, replacements, redacted texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, grouping, replace
from ..operators.patterns import CUSTOM_PATTERNS, Pattern, default_patterns, with_custom
from ..sources import views
from ..sources.staging import staged

#: Rules of a corpus: (scope, type, mode, priority).
DEFAULT_MODES: tuple[tuple[str, str | None, str, int], ...] = ()


@lru_cache(maxsize=16)
def corpus_patterns(names: tuple[str, ...] = ()) -> tuple[Pattern, ...]:
    """All patterns. R14 (caratula-ar) matches only values that begin with one of names; without names it matches nothing."""
    return with_custom(default_patterns(names), CUSTOM_PATTERNS)


@dataclass
class Anonymised:
    """Lazy tables; what isn't read isn't computed."""

    pages: DataFrame
    occurrences: DataFrame
    groups: DataFrame
    members: DataFrame
    replacements: DataFrame
    texts: DataFrame


def occurrences(docs: DataFrame, patterns: tuple[Pattern, ...] | None = None, fresh: bool = False) -> DataFrame:
    """Detections of a corpus, numbered per document, without repeats. They are written once for a session, an input and
    a table of patterns, and read from there by all that asks again; fresh=True reads an input that has changed."""
    kept = docs.sparkSession.__dict__.setdefault("_tacita_occurrences", {})
    asked = (docs.semanticHash(), tuple(docs.columns), patterns)
    if fresh or asked not in kept:
        kept[asked] = _occurrences(docs, patterns)
    return kept[asked]


def _occurrences(docs: DataFrame, patterns: tuple[Pattern, ...] | None) -> DataFrame:
    page = views.pages(docs)
    found = detect.detect(page, patterns or corpus_patterns(), F.col("doc_id") % 5 == 0)
    found = found.withColumn("fragments", F.lit(None).cast("array<struct<x:double,y:double,width:double,height:double,rotation:int>>"))
    # Entities read the detections several times; the corpus is scanned for them once.
    return staged(grouping.distinct_occurrences(grouping.numbered(found)), "occurrences")


def anonymise(docs: DataFrame, patterns: tuple[Pattern, ...] | None = None, mode: str = "placeholder", seed: str = "0") -> Anonymised:
    """Detections are narrow; entities need shuffles on (document, type, form) of the detections only; the texts are read
    again and joined with their replacements at the end."""
    page = views.pages(docs)
    found = occurrences(docs, patterns)
    groups = grouping.exact_groups(found).withColumn("enabled", F.lit(True)).withColumn("mode", F.lit(mode))
    members = grouping.members(found, groups)
    valued = replace.replacement_values(groups, members, seed)
    replacements = replace.page_replacements(valued, members)
    texts = replace.assembled(replace.redacted_pages(page, replacements))
    return Anonymised(page, found, valued, members, replacements, texts)
