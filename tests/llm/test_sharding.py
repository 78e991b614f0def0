import random
import zlib

import xxhash

from tacita.llm import sharding


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, k1 string")


def check(rows, out, shards):
    assert len(out) == len(rows)
    sizes = {r.doc_id: len((r.text or "").encode()) + 8 for r in rows}
    by = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, most = sum(r.size for r in out), max((r.size for r in out), default=0)
    for k in range(shards):
        assert abs(sum(r.size for r in by.get(k, [])) - total / shards) <= most
    return sizes


def test_sizes_slots_and_checksums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["é" * rng.randrange(50), "same text", "x" * rng.randrange(400), None, ""]), "q", "z") for i in range(3000)]
    docs = docs_of(spark, rows)
    out = sharding.shard_documents(docs, 7).collect()
    sizes = check(docs.collect(), out, 7)
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _, _ in rows}
    assert all(r.size == sizes[r.doc_id] and r.text_crc32 == crc[r.doc_id] for r in out)
    # the shards are ranges of the key: copies of a text lie in neighbouring shards
    same = sorted(r.shard for r in out if r.text_crc32 == zlib.crc32(b"same text"))
    assert same[-1] - same[0] <= 2


def test_the_sample_does_not_change_the_result(spark):
    rng = random.Random(2)
    docs = docs_of(spark, [(i, "a" * rng.randrange(99), None, None) for i in range(2000)])
    one = sharding.range_shards(sharding.shard_keys(docs), 5, ranges_per_shard=2, samples=2)
    two = sharding.range_shards(sharding.shard_keys(docs), 5, ranges_per_shard=30, samples=50)
    assert sorted(one.select("doc_id", "shard", "slot").collect()) == sorted(two.select("doc_id", "shard", "slot").collect())


def test_hot_group_empty_and_repeats(spark):
    rows = [(i, "copy" if i % 3 else f"t{i}", None, None) for i in range(1500)]
    check(docs_of(spark, rows).collect(), sharding.shard_documents(docs_of(spark, rows), 24).collect(), 24)
    assert sharding.shard_documents(docs_of(spark, [])).collect() == []
    out = sharding.shard_documents(docs_of(spark, [(1, "a", None, None)] * 9 + [(None, None, None, None)] * 3), 4).collect()
    assert len(out) == 12 and sum(r.size for r in out) == 9 * 9 + 3 * 8
    assert sharding.shard_documents(docs_of(spark, [(1, "v" * 10**6, None, None)]), 24).collect()[0].shard == 0


def test_whole_rows_are_dealt_alike(spark):
    rng = random.Random(3)
    docs = docs_of(spark, [(i % 700, "b" * rng.randrange(60), f"old{i}", str(i)) for i in range(1500)])
    out = sharding.sharded(docs, 6)
    assert out.columns == ["doc_id", "text", "k1", "shard", "slot"]
    rows = out.collect()
    assert sorted(r.k1 for r in rows) == sorted(map(str, range(1500)))
    lean = sharding.shard_documents(docs, 6).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in lean)


def brute(rows, shards):
    """Rows on one line in the order of their texts' hashes and ids; a row goes to the equal part in which it starts."""

    def key(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return (h - (1 << 64) if h >> 63 else h, -1 if row[0] is None else row[0])

    ordered = sorted(rows, key=key)
    total = sum(len((r[1] or "").encode()) + 8 for r in rows)
    out, at, slots = {}, 0, {}
    for r in ordered:
        shard = min(at * shards // total, shards - 1)
        out[r[0]] = (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        at += len((r[1] or "").encode()) + 8
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["ü" * rng.randrange(70), "copy", "", None, "w" * rng.randrange(3000)]), None, None) for i in range(2500)] + [(9999, "x" * 500_000, None, None)]
    out = sharding.shard_documents(docs_of(spark, rows), 24).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in out} == brute(rows, 24)
