"""Exact substring dedup by prefix-free parsing: phrases cut by rolling-hash triggers, and sorted suffixes of a dictionary
of phrases joined with their places in the parse."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, written

U = np.uint64
#: Bytes of the strings that count, and of the rolling hash's window.
LENGTH = 50
GRAM = 16
#: Starts of a text that are parsed at once, and bytes of texts whose phrases are gathered before they are dealt out.
CHUNK = 1 << 20
GATHER = 8 << 20
#: Bytes of text for each part that phrases are dealt to, at least.
PART_BYTES = 16 << 20
#: Phrases with one trigger beyond which each of their strings goes by its own hash.
HOT_PHRASES = 4096
#: Low bits of a trigger that say where it stands while the least is sought, and what the bytes beside it are hashed to.
PLACE = U(22)
SIDES = U((1 << 24) - 2)
NO_SIDE, MANY = 0, (1 << 24) - 1
#: Bytes of a dictionary whose suffixes are sorted at once.
DICTIONARY = 2 << 20

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
COVERED, FRAGMENT, SINGLE = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for prefix sums of a chunk."""
    if not _powers:
        n = CHUNK + 4 * LENGTH
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def phrases(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for base, first, last, trigger, own, *_ in parsed(text, length):
        yield base, first, last, trigger, own


def parsed(text: bytes, length: int = LENGTH, sides: bool = False) -> Iterator[tuple]:
    """For each chunk of a text: its offset, and of its phrases the first starts, the ends of their starts, the triggers
    and the hashes of their bytes.

    The trigger of a string of `length` bytes is the least rolling hash of its GRAM-byte windows, so equal strings have
    equal triggers wherever they stand. A phrase is a maximal run of starts with one trigger, extended by length - 1
    bytes: the phrases cut all starts into runs, and each string lies in the phrase that its start is in.

    With `sides`, also the hashes of the bytes to the left and to the right of a phrase's trigger, half as many as a
    string has beside it: a string holds all of those of one side at least, so phrases with a string in common have one
    side in common. NO_SIDE if the phrase has fewer there; MANY if the trigger stands in it at several places."""
    gram = min(GRAM, length)
    half = (length - gram + 1) // 2
    for base in range(0, max(len(text) - length + 1, 0), CHUNK):
        piece = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - base), base)
        starts = len(piece) - length + 1
        value = VALUES[piece]
        h, span, factor = value, 1, BASE
        while span * 2 <= gram:
            h = h[:-span] * U(factor) + h[span:]
            span, factor = span * 2, factor * factor & MASK
        if span < gram:
            h = h[: len(h) - (gram - span)] * U(3) + h[gram - span :]
        h = mixed(h) >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64)
        wide, size = length - gram + 1, 1
        while size * 2 <= wide:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        least = np.minimum(h[:starts], h[wide - size : wide - size + starts])
        at, least = (least & ((U(1) << PLACE) - U(1))).astype(np.int64), least >> PLACE
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], starts]
        up, down = powers()
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(value * up[: len(piece)], out=sums[1:])
        own = mixed((sums[last + length - 1] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        found = base, first, last, mixed(least[first]), own
        if not sides:
            yield found
            continue
        place = at[first]
        many = at[last - 1] != place
        beside = []
        for lo, fits in ((place - half, place - half >= first), (place + gram, place + gram + half <= last + length - 1)):
            lo = np.where(fits, lo, 0)
            said = mixed((sums[lo + half] - sums[lo]) * down[lo]) % SIDES + U(1)
            beside.append(np.where(many, MANY, np.where(fits, said, NO_SIDE)).astype(np.uint64))
        yield *found, *beside


def record_keys(trigger: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4 and 6 bytes by which a phrase is dealt out. A clash of triggers costs a look, not a result."""
    return trigger.astype(np.uint32), own & U((1 << 48) - 1)


def answer_key(low: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mixed(low.astype(np.uint64) * U(BASE) ^ own).view(np.int64)


def _pack(values: np.ndarray, width: int = 6) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Their least, and in as few bytes as hold them how far each is beyond it."""
    beyond = ids.view(np.uint64) - ids.min().view(np.uint64)
    width = max(1, (int(beyond.max()).bit_length() + 7) // 8)
    return ids.min().tobytes() + bytes([width]) + _pack(beyond, width)


def _unpack_ids(data: bytes) -> np.ndarray:
    return (_unpack(data[9:], data[8]) + np.frombuffer(data[:8], np.uint64)).view(np.int64)


def _deal(parts: int, length: int):
    """Rows (part, ids, lows, owns, sides): phrases of many texts, packed for the part that their trigger names. Of equal
    phrases only the one in the smallest id travels; the others are covered by it already and go to `part` -1."""

    def flush(ids: list, found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        trigger = np.concatenate([f[0] for f in found])
        own = np.concatenate([f[1] for f in found])
        sides = np.concatenate([f[2] | f[3] << U(24) for f in found])
        doc = np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found])
        low, own = record_keys(trigger, own)
        part = ((trigger >> U(32)) % U(parts)).astype(np.int32)
        order = np.lexsort((doc, own, low, part))
        part, low, own, doc = part[order], low[order], own[order], doc[order]
        sides = sides[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (own[1:] != own[:-1])]
        starts = np.flatnonzero(new)
        least = np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
        later = ~new & (doc > least)
        later &= np.r_[False, (doc[1:] != doc[:-1]) | new[1:]]
        part, low, own, doc = np.r_[part[starts], np.full(later.sum(), -1, np.int32)], np.r_[low[starts], low[later]], np.r_[own[starts], own[later]], np.r_[doc[starts], doc[later]]
        sides = sides[starts]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        rows = [(int(part[a]), _pack_ids(doc[a:b]), low[a:b].tobytes(), _pack(own[a:b]), _pack(sides[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "ids", "lows", "owns", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size = [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, t in zip(batch.column(0), texts, strict=True):
                text = t.as_py()
                for _, _, _, *found_here in parsed(text, length, True):
                    ids.append(i.as_py())
                    found.append(found_here)
                size += len(text)
                if size >= GATHER:
                    yield from flush(ids, found)
                    ids, found, size = [], [], 0
        yield from flush(ids, found)

    return run


def _answer(hot: int):
    """(id, key, kind) for the phrases that another text shares: covered, if an equal phrase stands in a smaller id; else
    wanted as a fragment, if other phrases with the trigger and the bytes at one side of it stand in other ids."""

    def asked(least: np.ndarray, sides: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each of the phrases, in groups of one trigger, may have a string in common with one of another id."""
        group = np.repeat(np.arange(len(heads)), sizes)
        left, right = sides & U(MANY), sides >> U(24)
        out = np.zeros(len(least), bool)
        for side in (left, right):
            order = np.lexsort((side, group))
            at = np.flatnonzero(np.r_[True, (group[order][1:] != group[order][:-1]) | (side[order][1:] != side[order][:-1])])
            apart = np.minimum.reduceat(least[order], at) < np.maximum.reduceat(least[order], at)
            out[order] |= np.repeat(apart, np.diff(np.r_[at, len(order)])) & (side[order] != NO_SIDE)
        apart = np.minimum.reduceat(least, heads) < np.maximum.reduceat(least, heads)
        return np.where(np.logical_or.reduceat(left == MANY, heads)[group], apart[group], out)

    def settle(part: int, rows: list) -> pa.RecordBatch:
        doc = np.concatenate([_unpack_ids(r[0]) for r in rows])
        low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        own = np.concatenate([_unpack(r[2]) for r in rows])
        if part < 0:
            return _rows(doc, answer_key(low, own), np.zeros(len(doc), np.int8))
        sides = np.concatenate([_unpack(r[3]) for r in rows])
        order = np.lexsort((doc, own, low))
        doc, low, own, sides = doc[order], low[order], own[order], sides[order]
        group = np.r_[True, low[1:] != low[:-1]]
        phrase = group | np.r_[True, own[1:] != own[:-1]]
        at = np.flatnonzero(phrase)
        sizes = np.diff(np.r_[at, len(doc)])
        least = doc[at]
        kind = np.full(len(doc), -1, np.int8)
        kind[doc > np.repeat(least, sizes)] = COVERED
        heads = np.flatnonzero(group[at])
        many = np.diff(np.r_[heads, len(at)])
        if len(at):
            wanted = asked(least, sides[at], heads, many)
            hot_group = np.add.reduceat(wanted.astype(np.int64), heads) > hot
            kind[at] = np.where(wanted, np.where(np.repeat(hot_group, many), SINGLE, FRAGMENT), -1)
        keep = kind >= 0
        return _rows(doc[keep], answer_key(low, own)[keep], kind[keep])

    def _rows(doc: np.ndarray, key: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(kind)], names=["id", "key", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (part != now or part < 0 and len(rows) >= 64):
                    yield settle(now, rows)
                    rows = []
                now = part
                rows.append(row)
        if rows:
            yield settle(now, rows)

    return run


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    at = np.flatnonzero(new)
    return starts[at], ends[np.r_[at[1:], len(starts)] - 1]


def _look(length: int):
    """(kind, id, text_hash, start, stop, trigger, bytes): the covered spans of each text, and the fragments that are
    wanted of it."""
    names = ["kind", "id", "text_hash", "start", "stop", "trigger", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for k in range(batch.num_rows):
                doc, text_hash, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), texts[k].as_py()
                sets = [np.array(batch.column(3 + kind)[k].values.to_numpy()) for kind in range(3)]
                spans = [[], []]
                for base, first, last, trigger, own in phrases(text, length):
                    key = answer_key(*record_keys(trigger, own))
                    in_set = [np.isin(key, s) if len(s) else np.zeros(len(key), bool) for s in sets]
                    spans[0].append(base + first[in_set[COVERED]])
                    spans[1].append(base + last[in_set[COVERED]] + length - 1)
                    for j in np.flatnonzero(in_set[FRAGMENT] | in_set[SINGLE]):
                        a, b = base + int(first[j]), base + int(last[j])
                        if not in_set[SINGLE][j]:
                            cuts = [(a, b, int(trigger[j].astype(np.int64)))]
                        else:
                            cuts = [(s, s + 1, int.from_bytes(hashlib.blake2b(text[s : s + length], digest_size=8).digest(), "little", signed=True)) for s in range(a, b)]
                        for s, e, t in cuts:
                            out.append((FRAGMENT, doc, text_hash, s, e, t, text[s : e + length - 1]))
                            size += e - s + length
                for s, e in zip(*union(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in spans)), strict=True):
                    out.append((COVERED, doc, text_hash, int(s), int(e), 0, b""))
                    size += 8
                if size > 4 << 20:
                    yield _table(out)
                    out, size = [], 0
        yield _table(out)

    def _table(rows: list) -> pa.RecordBatch:
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def dictionary_order(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a dictionary at the given places, sorted by their first `length` bytes, and for each whether it
    differs there from the one before. Eight bytes at a time; only ties are looked at again."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    order = np.arange(len(places))
    fresh = np.zeros(len(places), bool)
    fresh[:1] = True
    at = np.arange(len(places))
    for depth in range(0, length, 8):
        width = min(8, length - depth)
        word = np.zeros(len(at), np.uint64)
        here = places[order[at]] + depth
        for k in range(width):
            word = (word << U(8)) | padded[here + k]
        run = np.cumsum(fresh[at])
        by = np.lexsort((word, run))
        order[at] = order[at][by]
        word, run = word[by], run[by]
        fresh[at] |= np.r_[True, (word[1:] != word[:-1]) | (run[1:] != run[:-1])]
        tied = ~fresh | ~np.r_[fresh[1:], True]
        at = np.flatnonzero(tied)
        if not len(at):
            break
    return order, fresh


def _settle(length: int):
    """(id, text_hash, start, stop): the spans of fragments that a smaller id holds too. All fragments with a trigger are
    together; the strings of the dictionary stand in suffix order, those of one run are equal, and the parse says in
    which texts they start."""
    names = ["id", "text_hash", "start", "stop"]

    def settle(rows: pd.DataFrame) -> pa.RecordBatch:
        sizes = (rows["stop"] - rows["start"]).to_numpy()
        data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
        wide = sizes + length - 1
        offsets = np.cumsum(wide) - wide
        fragment = np.repeat(np.arange(len(rows)), sizes)
        inside = np.arange(len(fragment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, fresh = dictionary_order(data, offsets[fragment] + inside, length)
        doc = rows["id"].to_numpy()[fragment]
        at = np.flatnonzero(fresh)
        least = np.empty(len(fragment), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.r_[at, len(order)])) if len(at) else 0
        lost = doc > least
        # runs of lost starts within a fragment
        edge = np.r_[True, (fragment[1:] != fragment[:-1]) | (lost[1:] != lost[:-1])] if len(lost) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        last = np.r_[first[1:], len(lost)]
        own = lost[first]
        first, last = first[own], last[own]
        f = fragment[first]
        start = rows["start"].to_numpy()[f] + inside[first]
        stop = rows["start"].to_numpy()[f] + inside[last - 1] + length
        return pa.RecordBatch.from_arrays([pa.array(rows["id"].to_numpy()[f]), pa.array(rows["text_hash"].to_numpy()[f]), pa.array(start), pa.array(stop)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096).to_pandas()
                held.append(part)
                size += int((part["stop"] - part["start"]).sum()) + len(part) * length
                if size >= DICTIONARY:
                    rows = pd.concat(held, ignore_index=True)
                    ready = rows["trigger"].to_numpy() != rows["trigger"].iloc[-1]
                    if ready.any():
                        yield settle(rows[ready].reset_index(drop=True))
                        rows = rows[~ready]
                        size = int((rows["stop"] - rows["start"]).sum()) + len(rows) * length
                    held = [rows]
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts = batch.column(1).cast(pa.large_binary())
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            spans = batch.column(2)[k]
            kept, removed, n = text, 0, 0
            if spans.is_valid:
                flat = spans.values
                starts, ends = union(flat.field("start").to_numpy(), flat.field("stop").to_numpy())
                n, removed = len(starts), int((ends - starts).sum())
                bounds = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def covered_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(id, text_hash, start, stop): spans of UTF-8 bytes that strings of `length` bytes cover which also start in a row
    with a smaller id. Spans of one text may overlap. Rows with a null id or a text under `length` bytes have none and
    cover nothing.

    First round: each text's phrases go, as hashes, to the part that their trigger names, where equal phrases are
    covered by the smallest id. Second round: phrases whose trigger, with the bytes at one side of it, other phrases have
    as well give their bytes, all of a trigger meet, and their suffixes are sorted."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    dealt = base.mapInArrow(_deal(parts, length), "part int, ids binary, lows binary, owns binary, sides binary")
    # Phrases that are settled in their own task have no part to go to; they are spread.
    to = F.when(F.col("part") < 0, F.pmod(F.hash("ids"), F.lit(parts))).otherwise(F.col("part"))
    dealt = dealt.withColumn("to", to).repartitionById(parts, F.col("to")).sortWithinPartitions("part").select("part", "ids", "lows", "owns", "sides")
    answers = written(dealt.mapInArrow(_answer(hot_phrases), "id long, key long, kind tinyint"), "answers")
    del dealt
    release(spark)
    sets = answers.groupBy("id").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("key"))).alias(f"k{k}") for k in range(3)))
    asked = base.select("id", F.xxhash64("text").alias("text_hash"), "text").join(sets, "id")
    seen = written(asked.mapInArrow(_look(length), "kind tinyint, id long, text_hash long, start long, stop long, trigger long, bytes binary"), "looked")
    del asked, sets
    discard(answers)
    release(spark)
    wanted = seen.filter(F.col("kind") == FRAGMENT).select("trigger", "id", "text_hash", "start", "stop", "bytes")
    settled = wanted.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_settle(length), "id long, text_hash long, start long, stop long")
    both = seen.filter(F.col("kind") == COVERED).select("id", "text_hash", "start", "stop").unionByName(settled)
    spans = written(both, "spans")
    discard(seen)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): a row per row of docs, kept being the bytes of its text
    that no string of `length` bytes covers which also starts in a row with a smaller id. Strings are judged on the
    input; matches don't cross rows.

    A null text is empty. A row with a null id loses nothing and covers nothing; rows with one id don't cover each
    other, equal or not. An empty table gives an empty result; other columns are not read."""
    spans = covered_spans(docs, length, id_col, text_col, hot_phrases)
    release(docs.sparkSession)
    by = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    joined = base.join(by, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("text_hash")), "left").select("doc_id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
