"""Quality rules: repetition found by suffix arrays over a text's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Words that a repeated substring has at least to count, the fraction of the words that repeats may cover, and the
#: longest repeat in words.
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 1 << 17


def suffix_order(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of several texts' words, sorted within each text by prefix doubling, and the common prefix in words
    of each with the one before it in its text. doc rises from text to text; code names the words."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1, np.diff(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])))
    key = doc.astype(np.int64) * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int32)
    starts = np.flatnonzero(fresh)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    levels, h = [rank], 1
    while True:
        alone = fresh & np.r_[fresh[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = at + h
        inside = after < end[at]
        second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        fresh = fresh.copy()
        fresh[slots] = new
        first = slots[np.flatnonzero(new)]
        rank = rank.copy()
        rank[at] = np.repeat(first, np.diff(np.r_[np.flatnonzero(new), len(at)]))
        levels.append(rank)
        h *= 2
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, far = a[same], b[same], np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + far, b + far
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        far[ok] += 1 << k
    common[same] = far
    return order, np.r_[0, common]


def longest_repeats(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word, the longest string from it on that its text holds again: the deepest interval of common prefixes
    that its suffix lies in, which is the larger of the two at its sides."""
    order, common = suffix_order(doc, code)
    out = np.zeros(len(code), np.int64)
    if len(code):
        out[order] = np.maximum(common, np.r_[common[1:], 0])
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the union of the repeats of at least `least` words."""
    n = len(repeats)
    at = np.flatnonzero(repeats >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeats[at], -1)
    return np.cumsum(edge[:n]) > 0


def text_features(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            again += line in seen
            seen.add(line)
    return len(text.translate(None, WHITE + CONTINUED)), len(text) - len(text.translate(None, SYMBOLS)), again


def _features(texts: list[bytes], min_repeat: int) -> Iterator[tuple[int, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_longest of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    at = 0
    while at < len(split):
        to, total = at + 1, sizes[at]
        while to < len(split) and total + sizes[to] <= BATCH_WORDS:
            total += sizes[to]
            to += 1
        code, _ = pd.factorize(np.array([w for words in split[at:to] for w in words] or [b""], dtype=object))
        code = code[:total]
        doc = np.repeat(np.arange(to - at), sizes[at:to])
        repeats = longest_repeats(doc, code)
        three, many = covered(repeats, 3), covered(repeats, min_repeat)
        ends = np.cumsum(sizes[at:to])
        for k, (lo, hi) in enumerate(zip(ends - sizes[at:to], ends, strict=True)):
            longest = int(repeats[lo:hi].max(initial=0))
            yield int(hi - lo), *text_features(texts[at + k]), int(three[lo:hi].sum()), int(many[lo:hi].sum()), longest if longest >= min_repeat else 0
        at = to


def quality_features(docs: DataFrame, min_repeat: int = MIN_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_longest), a row per row of docs."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "n_longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
                found = np.array(list(_features(texts, min_repeat)), np.int64).reshape(-1, 7)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(7))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return made.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """quality_features with base_failed and kept.

    base_failed: under 50 words, or over half the words in 3-word windows that the text holds twice. kept: not
    base_failed, repeats of at least min_repeat words cover at most max_covered of the words, and none has over
    max_longest words (an occurrence may overlap the other). A null or empty text has no words and fails; rows with equal
    ids or texts each come back; an empty table gives an empty result; other columns are not read."""
    out = quality_features(docs, min_repeat, id_col, text_col)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("n_longest") <= max_longest))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns, without a shuffle: each row carries its verdict.
    Limits as for quality_rules."""
    inner = docs.schema
    min_repeat = limits.get("min_repeat", MIN_REPEAT)
    max_covered = limits.get("max_covered", MAX_COVERED)
    max_longest = limits.get("max_longest", MAX_LONGEST)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [t or b"" for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
                f = np.array(list(_features(texts, min_repeat)), np.int64).reshape(-1, 7)
                n, again, cover, longest = f[:, 0], f[:, 4], f[:, 5], f[:, 6]
                good = (n >= 50) & (100 * again <= 50 * n) & (cover <= max_covered * n) & (longest <= max_longest)
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, inner)
