"""Cross-entropy difference: how much better a target model than a background model predicts each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if, written

#: What a word pair has in advance in either model, in pairs.
ALPHA = 0.1
#: Text gathered before its pairs are dealt out, and text for each part that they are dealt to, at least.
GATHER = 8 << 20
PART_BYTES = 12 << 20
#: A word with more than 1 / (HOT * parts) of all pairs is divided by the word that follows; there are at most HOT * parts.
HOT = 4
#: Ids of target documents that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
START, END = np.uint64(1), np.uint64(2)
#: Parts of a nat in which a part's share of a loss travels.
UNIT = float(1 << 34)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys, target flags and texts, some GATHER bytes at a time."""
    keys, flags, texts, size = [], [], [], 0
    for batch in batches:
        column = batch.column(2).cast(pa.large_binary())
        for key, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column, strict=True):
            keys.append(key)
            flags.append(flag)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= GATHER:
                yield np.array(keys, np.int64), np.array(flags, bool), texts
                keys, flags, texts, size = [], [], [], 0
    if keys:
        yield np.array(keys, np.int64), np.array(flags, bool), texts


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words, the words as places among them, and the number of words of each text."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    code, words = pd.factorize(np.array([*flat, b""], dtype=object)[: len(flat)])
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    return hashes, code.astype(np.int64), sizes


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, first, second, doc: every word with the one before it, a text's first after START, its last before END."""
    hashes, code, sizes = _encoded(texts)
    start, end = len(hashes), len(hashes) + 1
    hashes = np.r_[hashes, START, END]
    n = len(code) + len(sizes)
    first, second = np.full(n, start), np.full(n, end)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    head = np.cumsum(sizes + 1) - (sizes + 1)
    inner = np.ones(n, bool)
    inner[head] = False
    first[inner] = code
    inner = np.ones(n, bool)
    inner[head + sizes] = False
    second[inner] = code
    return hashes, first, second, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, flags, texts in _gathered(batches):
        hashes, first, _, doc = _pairs(texts)
        all_of = np.bincount(first, minlength=len(hashes))
        own = np.bincount(first[flags[doc]], minlength=len(hashes))
        keep = all_of > 0
        yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(own[keep]), pa.array(all_of[keep])], names=["word", "n_target", "n_all"])


def _deal(parts: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for keys, flags, texts in _gathered(batches):
            hashes, first, second, doc = _pairs(texts)
            part = hashes[first] % np.uint64(parts)
            split = np.isin(hashes, hot)[first]
            both = (hashes[first[split]] ^ (hashes[second[split]] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            part[split] = (both >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.int32), kind="stable")
            part, first, second, doc = part[order], first[order], second[order], doc[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                used, places = np.unique(first[a:b], return_inverse=True)
                docs, per = np.unique(doc[a:b], return_counts=True)
                # The follower goes as 48 bits of its hash, which need to differ within one word's followers only.
                follower = hashes[second[a:b]].view(np.uint8).reshape(-1, 8)[:, :6]
                arrays = (keys[docs], flags[docs].astype(np.uint8), per.astype(np.uint32), hashes[used], places.astype(np.uint32), follower)
                head = np.array([len(docs), len(used), b - a], np.int64)
                rows.append((int(part[a]), pack.compress(b"".join(x.tobytes() for x in (head, *arrays)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "packed"])

    return run


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    """Of each pair the text's key and flag, the first word, the follower."""
    data = zstandard.ZstdDecompressor().decompress(packed)
    n_docs, n_words, n = np.frombuffer(data, np.int64, 3)
    at, out = 24, []
    for kind, size in ((np.int64, n_docs), (np.uint8, n_docs), (np.uint32, n_docs), (np.uint64, n_words), (np.uint32, n), (np.uint8, 6 * n)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    keys, flags, per, words, places, follower = out
    second = np.zeros((n, 8), np.uint8)
    second[:, :6] = follower.reshape(-1, 6)
    return np.repeat(keys, per), np.repeat(flags, per).astype(bool), words[places], second.view("<u8").ravel()


def _score(hot: dict[int, tuple[int, int]], n_target: int, n_all: int, vocabulary: int, alpha: float, parts: int):
    """(part, packed): a part's share of the losses of each text, packed for the part that the text's key names. All pairs of a word are in its part,
    or, for hot words, all pairs with one follower, the word's own numbers being known."""
    scale = n_target / n_all if n_all else 0.0

    def settle(rows: list[bytes]) -> pa.RecordBatch:
        held = [_unpack(r) for r in rows]
        key, flag, first, second = (np.concatenate([p[k] for p in held]) for k in range(4))
        order = np.lexsort((second, first))
        key, flag, first, second = key[order], flag[order], first[order], second[order]
        word = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        pair = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        n = len(key)
        in_word, in_pair = np.diff(np.r_[word, n]), np.diff(np.r_[pair, n])
        target = flag.astype(np.int64)
        word_target, word_all = np.add.reduceat(target, word).astype(float), in_word.astype(float)
        for k in np.flatnonzero(np.isin(first[word], np.array(list(hot), np.uint64))) if hot else []:
            word_target[k], word_all[k] = hot[int(first[word[k]])]
        pair_target, pair_all = np.add.reduceat(target, pair).astype(float), in_pair.astype(float)
        own = np.repeat(np.arange(len(word)), in_word)[pair]
        loss_target = -np.log((pair_target + alpha) / (word_target[own] + alpha * vocabulary))
        loss_all = -np.log((pair_all * scale + alpha) / (word_all[own] * scale + alpha * vocabulary))
        texts, code = np.unique(key, return_inverse=True)
        sums = [np.rint(np.bincount(code, np.repeat(x, in_pair), len(texts)) * UNIT).astype(np.int64) for x in (loss_target, loss_all)]
        share = np.stack([texts, sums[0] - sums[1], sums[1], np.bincount(code, minlength=len(texts))])
        to = (texts.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        to, share = to[by], share[:, by]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
        pack = zstandard.ZstdCompressor(level=1)
        packed = [pack.compress(_by_bytes(share[:, a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and part != now:
                    yield settle(rows)
                    rows = []
                now = part
                rows.append(packed)
        if rows:
            yield settle(rows)

    return run


def _by_bytes(rows: np.ndarray) -> bytes:
    """Longs byte by byte, the first bytes of all, then the second: high bytes that agree pack well."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(rows.shape[0], -1, 8).transpose(0, 2, 1)).tobytes()


def _gather_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, b, n): the shares of each text, added up. The rows of a part come one after the other."""

    def settle(rows: list[bytes]) -> pa.RecordBatch:
        parts = []
        for r in rows:
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r), np.uint8)
            parts.append(np.ascontiguousarray(data.reshape(4, 8, -1).transpose(0, 2, 1)).view("<i8").reshape(4, -1))
        key, apart, background, n = np.concatenate(parts, axis=1)
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        total = [np.add.reduceat(x[order], at) for x in (apart, background, n)]
        columns = [pa.array(key[order][at]), pa.array((total[0] + total[1]) / UNIT), pa.array(total[1] / UNIT), pa.array(total[2])]
        return pa.RecordBatch.from_arrays(columns, names=["key", "t", "b", "n"])

    now, rows = None, []
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rows and part != now:
                yield settle(rows)
                rows = []
            now = part
            rows.append(packed)
    if rows:
        yield settle(rows)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score), a row per row of docs.

    Two models of word pairs, one of the rows whose id is among target_ids, one of all rows, share the vocabulary of all
    rows' words (A-Z lower-cased, between ASCII white space) and the end of a text. A pair's probability in either is
    (its number + alpha) / (its first word's number + alpha * words in the vocabulary); the background's numbers are
    scaled to the target's size, so that both are smoothed alike. The losses are means per token in nats, the end counting
    as a token; score is loss_target - loss_background, the lower the closer to the target.

    A null or empty text has no words and is scored by its end alone. Rows with equal ids and texts count each and score
    alike; null ids are never targets. Without target rows every score is what the empty model gives. An empty table
    gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    targets = broadcast_if(target_ids.select(F.col(target_ids.columns[0]).alias("target_id")).filter("target_id IS NOT NULL").distinct(), BROADCAST_IDS)
    marked = base.join(targets, F.col("doc_id") == F.col("target_id"), "left").select(F.xxhash64("doc_id", "text").alias("key"), F.col("target_id").isNotNull().alias("target"), "text")
    words = written(marked.mapInArrow(_count, "word long, n_target long, n_all long").groupBy("word").agg(F.sum("n_target").alias("n_target"), F.sum("n_all").alias("n_all")), "words")
    vocabulary, n_target, n_all = words.agg(F.count("*"), F.sum("n_target"), F.sum("n_all")).first()
    n_target, n_all = int(n_target or 0), int(n_all or 0)
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    # At most HOT * parts rows can pass this filter.
    hot = {r.word & ((1 << 64) - 1): (r.n_target, r.n_all) for r in words.filter(F.col("n_all") > n_all / (HOT * parts)).collect()}
    dealt = marked.mapInArrow(_deal(parts, np.array(sorted(hot), np.uint64)), "part int, packed binary")
    shares = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_score(hot, n_target, n_all, vocabulary, alpha, parts), "part int, packed binary")
    sums = shares.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_gather_shares, "key long, t double, b double, n long")
    rows = base.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    per = rows.groupBy("key").agg(F.count("*").alias("same"))
    scored = rows.join(sums.join(per, "key"), "key")
    return scored.select("doc_id", (F.col("n") / F.col("same")).cast("long").alias("n_tokens"), (F.col("t") / F.col("n")).alias("loss_target"), (F.col("b") / F.col("n")).alias("loss_background"), ((F.col("t") - F.col("b")) / F.col("n")).alias("score"))
