"""Range sharding by sampled, size-weighted splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Ranges per shard, keys sampled per range, and the sizes that a range may have over its mean before it is divided.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 64
OVERFULL = 4.0
#: Beyond shards * RANGES_PER_SHARD ranges of this size there are more ranges, up to a number that a constant array holds.
RANGE_BYTES = 8 << 30
MOST_RANGES = 16384
ROUNDS = 3


def _unit(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _splitters(keys: DataFrame, total: int, ranges: int, samples: int, salt: int) -> list[tuple[int, int]]:
    """Boundaries (k1, k2) that cut keys(k1, k2, size) into about `ranges` parts of equal size. A row is drawn with the
    probability samples * size / total, and a larger row counts as the samples it stands for; the draw is a hash of the
    key, so that a task run again draws the same rows. At most about ranges * samples rows come to the driver."""
    rate = F.col("size") * F.lit(float(ranges * samples)) / F.lit(float(max(total, 1)))
    drawn = keys.filter(_unit("k1", "k2", F.lit(salt)) < rate).select("k1", "k2", F.greatest(rate, F.lit(1.0)).alias("w"))
    rows = sorted((r.k1, r.k2, r.w) for r in drawn.collect())
    weight = sum(w for _, _, w in rows)
    out, seen, k = [], 0.0, 1
    for k1, k2, w in rows:
        seen += w
        if seen >= k * weight / ranges:
            out.append((k1, k2))
            while seen >= k * weight / ranges:
                k += 1
    return out


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below the key, by bisection in a constant array."""
    if not cuts:
        return F.lit(0)
    # Text literals that fold into constant arrays.
    k1, k2 = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in (0, 1))
    steps = [1 << s for s in range(len(cuts).bit_length() - 1, -1, -1)]
    n = len(cuts)

    def step(lo: Column, s: Column) -> Column:
        at = lo + s
        i = F.least(at, F.lit(n))
        below = (F.element_at(k1, i) < F.col("k1")) | ((F.element_at(k1, i) == F.col("k1")) & (F.element_at(k2, i) <= F.col("k2")))
        return F.when((at <= n) & below, at).otherwise(lo)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def range_shards(keys: DataFrame, shards: int = 24, ranges_per_shard: int = RANGES_PER_SHARD, samples: int = SAMPLES_PER_RANGE, rows: DataFrame | None = None) -> DataFrame:
    """keys(k1, k2, size, ...) of longs -> the same rows with shard (0 to shards - 1) and slot (gapless from 0).

    Sampled splitters range-partition the rows in the order of (k1, k2); a range over OVERFULL times its share is
    sampled again and divided. Exact sums of each range then place every row on the line of all bytes, and a row goes
    to the shard in whose equal part of that line it starts. So shards are ranges of the key whose sizes differ by one
    row at most, whatever the sample; the sample only decides how evenly the work is dealt out. Rows equal in both
    keys stay together in one range and get consecutive slots.

    rows, if given, are the same rows with more columns; they are read and moved once, and returned in place of keys."""
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    total = int(total or 0)
    want = max(1, min(max(shards * ranges_per_shard, min(total // RANGE_BYTES, MOST_RANGES)), n // 64))
    cuts = _splitters(keys, total, want, samples, 0)
    for salt in range(1, ROUNDS):
        if not cuts:
            break
        parts = keys.withColumn("range", _range_of(cuts))
        limit = OVERFULL * total / want
        over = [(r.range, int(r.bytes)) for r in parts.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).filter(F.col("bytes") > limit).filter("lo <> hi").collect()]
        if not over:
            break
        more = set()
        for r, size in over:
            more.update(_splitters(parts.filter(F.col("range") == r), size, int(size // (total / want)) + 1, samples, salt))
        if more <= set(cuts):
            break
        cuts = sorted({*cuts, *more})
    # One row per range: a bounded number, whatever the input.
    sums = keys.withColumn("range", _range_of(cuts)).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    before = written(before, "ranges")
    placed = _place(keys, cuts, before, total, shards)
    if rows is None:
        placed = rows = written(placed, "placed")
    else:
        rows = _place(rows, cuts, before, total, shards)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return rows.join(F.broadcast(first), "shard").withColumn("slot", (F.col("at") - F.col("first")).cast("long")).drop("at", "first")


def _place(rows: DataFrame, cuts: list[tuple[int, int]], before: DataFrame, total: int, shards: int) -> DataFrame:
    """rows with shard and at, the row's number in the order of all."""
    inside = Window.partitionBy("range").orderBy("k1", "k2", "size")
    up = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("bytes_before") + F.coalesce(F.sum("size").over(up), F.lit(0))).cast("decimal(38,0)")
    return (
        rows.withColumn("range", _range_of(cuts))
        .join(F.broadcast(before), "range")
        .withColumn("at", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.floor(start * shards / F.lit(max(total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int"))
        .drop("range", "bytes_before", "rows_before")
    )


def shard_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2): size is the UTF-8 bytes of the text plus 8, k1 a hash of the text and k2 the
    id, so that equal texts are neighbours and a group of copies, however large, can be divided."""
    text = _text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), *_key_columns(id_col, text_col))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _key_columns(id_col: str, text_col: str) -> list[Column]:
    text = _text(text_col)
    return [(F.octet_length(text) + 8).cast("long").alias("size"), F.xxhash64(text).alias("k1"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k2")]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of docs. The law is `bytes`: the sums of
    size differ by at most one row between shards. grown_shard is null, as it is for this law.

    A null text has no bytes and the size 8; a null id is kept and ordered as -1. Rows equal in id and text get
    neighbouring slots in an order that doesn't matter. An empty table gives an empty result; other columns of docs
    are not read."""
    keys = written(shard_keys(docs, id_col, text_col), "keys")
    out = range_shards(keys, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with shard and slot, as shard_documents deals them; docs is moved once. Columns of docs with
    these names are replaced."""
    plain = docs.drop("shard", "slot")
    wide = plain.select(F.struct(*(F.col(f"`{c}`") for c in plain.columns)).alias("row"), *_key_columns(id_col, text_col))
    keys = written(plain.select(*_key_columns(id_col, text_col)), "keys")
    return range_shards(keys, shards, rows=wide).select("row.*", "shard", "slot")
