"""SimHash near-duplicates: 64-bit fingerprints, compared as bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, written

#: Rows of a bucket that one task compares at once; larger buckets are refined.
BUCKET_ROWS = 8192
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint_bytes(text: bytes | None, shingle_words: int = 3) -> bytes:
    """The 8 big-endian bytes of a text's fingerprint."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
        n = len(words) - shingle_words + 1
    return majority(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(n, 8))


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, given as rows of 8 bytes; none for no hashes."""
    n = len(hashes)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        set_bits += np.unpackbits(hashes[at : at + CHUNK], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * set_bits > n).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs. Lower-cases A-Z, takes words between ASCII white space, and hashes their
    shingles (fewer words: the whole sequence) with XXH64, seed 42. Null, empty and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = b"".join(fingerprint_bytes(t.as_py(), shingle_words) for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of 64-bit words: bit i of word w of plane p is bit p of fingerprint 64 * w + i. One spare word at the end."""
    n = len(fps)
    width = (n + 63) // 64 + 1
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by key: the positions (i, j), i < j, of rows of one key whose fingerprints differ in at most
    `radius` bits. Row i meets row i + d by shifting the planes by d; 64 distances at a time run through a bitwise
    counter that overflows beyond the radius, and words in which all have overflowed are abandoned."""
    n = len(keys)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    reach = ends - np.arange(n) - 1
    planes = bit_planes(fps)
    planes = np.concatenate([planes, np.zeros((64, 1), planes.dtype)], axis=1)
    last = planes.shape[1] - 1
    digits = max(1, radius.bit_length())
    start = (1 << digits) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    active, d = np.flatnonzero(reach >= 1), 1
    while len(active):
        flags = np.zeros((last + 1) * 64, bool)
        flags[active] = True
        words = np.unique(active >> 6)
        live = np.packbits(flags, bitorder="little").view("<u8")[words]
        q, r = divmod(d, 64)
        counters = [np.full(len(words), full if start >> k & 1 else 0, np.uint64) for k in range(digits)]
        for p in range(64):
            plane = planes[p]
            other = plane[np.minimum(words + q, last)]
            if r:
                other = (other >> np.uint64(r)) | (plane[np.minimum(words + q + 1, last)] << np.uint64(64 - r))
            carry = plane[words] ^ other
            for k in range(digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            live = live & ~carry
            if p % 8 == 7:
                keep = live != 0
                if not keep.all():
                    words, live, counters = words[keep], live[keep], [c[keep] for c in counters]
                    if not len(words):
                        break
        if len(words):
            at, bit = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = words[at] * 64 + bit
            yield i, i + d
        d += 1
        active = active[reach[active] >= d]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position each of n positions reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(radius: int):
    def flush(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        label, held, size = np.arange(len(keys)), [], 0
        for pair in [*close_pairs(keys, fps, radius), None]:
            if pair is not None:
                held.append(pair)
                size += len(pair[0])
            if held and (pair is None or size > 1 << 19):
                own = np.flatnonzero(label != np.arange(len(keys)))
                label = forest(len(keys), np.concatenate([own, *(x[0] for x in held)]), np.concatenate([label[own], *(x[1] for x in held)]))
                held, size = [], 0
        own = np.flatnonzero(label != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            kept = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            if len(kept[0]) >= 1 << 16:
                cut = int(np.searchsorted(kept[0], kept[0][-1]))
                if cut:
                    yield flush(*(k[:cut] for k in kept))
                    kept = [k[cut:] for k in kept]
        yield flush(*kept)

    return run


def _blocks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Each row once for each of `parts` blocks of its `width` remaining bits: key extended by the block, rest without it."""
    cuts = [width * k // parts for k in range(parts + 1)]
    made = []
    for k in range(parts):
        lo, hi = cuts[k], cuts[k + 1]
        block = F.shiftrightunsigned("rest", lo).bitwiseAND((1 << (hi - lo)) - 1)
        low = F.col("rest").bitwiseAND((1 << lo) - 1)
        high = F.shiftleft(F.shiftrightunsigned("rest", hi), lo) if hi < 64 else F.lit(0).cast("long")
        made.append(F.struct(F.xxhash64("key", F.lit(k), block).alias("key"), high.bitwiseOR(low).alias("rest")))
    return rows.select("fp", "node", F.explode(F.array(*made)).alias("x")).select("x.key", "x.rest", "fp", "node")


def near_links(nodes: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """nodes(fp, node), fingerprints distinct -> links (a, b) that connect every two nodes within `radius` bits.

    Fingerprints within the radius agree in one of radius + 1 blocks. Buckets of over bucket_rows rows are refined by
    the same rule on the bits left, twice, and then cut into tiles that meet each other, so that no pair is lost and
    no task holds more than two tiles. A bucket returns a spanning forest of its close pairs, not all of them."""
    parts, width = radius + 1, 64
    rows = nodes.filter("node IS NOT NULL").select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp", "node")
    ready = []
    for level in range(3):
        cut = width // parts
        rows = _blocks(rows, width, parts)
        width -= cut
        hot = rows.groupBy("key").count().filter(F.col("count") > bucket_rows)
        if not level:
            # 16-bit blocks: a table of at most parts * 2 ** 16 keys, whatever the input.
            hot = written(hot, "hot")
            if not hot.take(1):
                discard(hot)
                ready.append(rows.select("key", "fp", "node"))
                break
            rows_hot = rows.join(F.broadcast(hot.select("key")), "key", "left_semi")
            ready.append(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").select("key", "fp", "node"))
        else:
            hot = written(hot, "hot")
            ready.append(rows.join(hot.select("key"), "key", "left_anti").select("key", "fp", "node"))
            if not hot.take(1):
                break
            rows_hot = rows.join(hot, "key") if level == 2 else rows.join(hot.select("key"), "key", "left_semi")
        rows = rows_hot
        if level == 2:
            tiles = F.ceil(F.col("count") / bucket_rows).cast("long")
            own = F.pmod(F.xxhash64("node"), tiles)
            spread = rows.select("key", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
            ready.append(spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "node"))
    union = ready[0]
    for more in ready[1:]:
        union = union.unionByName(more)
    return union.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of docs. component_id is the smallest id that links of at
    most `radius` differing bits reach, the row's own included.

    Nulls: a null text counts as empty (fingerprint 0, which links like any other); a row with a null id gets the
    component of its fingerprint, null if no row of the group has an id. Rows with equal ids or texts each come back.
    An empty table gives an empty result. Other columns are not read."""
    fps = written(fingerprints(docs, shingle_words, id_col, text_col).select(F.col("id").cast("long").alias("id"), "fp"), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    groups = connected_components(near_links(nodes, radius))
    classes = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group holds a smaller id. Rows that share an id are one document and stay or go
    together; rows without an id stay. All columns are kept."""
    lost = near_duplicates(docs, shingle_words, radius, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(lost, id_col, "left_anti")
