import itertools
import random

import numpy as np
import pytest
import xxhash

from tacita.llm import simhash


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    fps = {i: brute_fp(t) for i, t in rows}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= radius and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def corpus(n=120):
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.5:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 80, 200]))]
            base.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n\t\x0b"), (n + 3, "A b c"), (n + 4, "wort " * 30000)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bucket_rows", [2, 5])
def test_refined_buckets_lose_no_link(spark, bucket_rows):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        f = rng.choice([centre, *fps])
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    links = [(r.a, r.b) for r in simhash.near_links(nodes, 3, bucket_rows).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 192 for a, b in links)
    full = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    n = len(fps)
    arr = lambda p: (np.array([x for x, _ in p]), np.array([x for _, x in p]))
    assert (simhash.forest(n, *arr(links)) == simhash.forest(n, *arr(full))).all()


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_close_pairs(radius):
    rng = np.random.default_rng(1)
    n = 700
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64(0xFFF)
    keys = np.sort(rng.integers(0, 5, n))
    got = sorted((int(i), int(j)) for a, b in simhash.close_pairs(keys, fps, radius) for i, j in zip(a, b, strict=True))
    assert got == [(i, j) for i, j in itertools.combinations(range(n), 2) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]


def test_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d"), (7, "A b c d"), (7, "A b c d"), (9, "zz yy xx"), (None, "alone here now")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 9)]
    docs = spark.createDataFrame([(1, "a b c d", "k"), (2, "a b c d", "l"), (3, "q r s t", None), (None, "a b c d", "m")], "doc_id long, text string, node string")
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(docs).collect()) == [-1, 1, 3]
