import itertools
import random

import numpy as np
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tacita.llm import jaccard, simhash  # noqa: E402


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({b" ".join(words)} if words else set())


def links(rows):
    sets = {i: shingles(t) for i, t in rows}
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def kept(rows):
    first = {i: i for i, _ in rows}
    pairs = links(rows)
    while True:
        new = dict(first)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == first:
            return sorted(i for i in first if first[i] == i)
        first = new


def corpus():
    rng = random.Random(8)
    vocab = [f"Wé{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, base = [], []
    for i in range(160):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base[:6] if rng.random() < 0.4 else base))
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 60, 120, 200]))]
            if i % 3 == 0:
                words += passage
            base.append(words)
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows + [(300, ""), (301, None), (302, " \n"), (303, rows[0][1].upper())]


@pytest.mark.parametrize("common", [2, 8, 10**6])
def test_finds_all_pairs_of_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_null_repeated_and_no_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d", "k"), (2, "a b c d", "l"), (3, "q r s t", None), (None, "a b c d", "m"), (2, "zz", "o")], "doc_id long, text string, id string")
    assert sorted((r.doc_id or -1) for r in jaccard.keep_one(docs).collect()) == [-1, 1, 3]
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both, x, y = (rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 600)) for _ in range(3))
        x, y = np.unique(np.r_[both, x]), np.unique(np.r_[both, y])
        bits = lambda words: np.unpackbits(words.astype(">i8").view(np.uint8))
        (wide_x, small_x), (wide_y, small_y) = jaccard.sketch(x), jaccard.sketch(y)
        apart = len(np.setxor1d(x, y))
        assert (bits(small_x) != bits(small_y)).sum() <= apart
        p, q = bits(wide_x), bits(wide_y)
        while len(p) > len(q):
            p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        assert (p != q).sum() <= apart


def test_long_texts_and_chains_about_the_limit(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(9000)]
    rows = []
    for length, step in ((30, 1), (150, 3), (1100, 22), (2500, 50), (1020, 20)):
        words = [rng.choice(vocab) for _ in range(length)]
        for _ in range(14):
            rows.append((len(rows), " ".join(words)))
            base = words if rng.random() < 0.5 else rows[-1][1].split()
            words = list(base)
            for _ in range(step):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            words += [rng.choice(vocab) for _ in range(rng.randrange(step))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == kept(rows)


def bits(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_verifies_the_links_of_simhashes(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus() if t and t.strip()]
    made, verified, near = [], [], simhash.near_links

    def links_of(nodes, radius):
        own = {r.node: r.fp for r in nodes.collect()}
        out = near(nodes, radius)
        made.extend((own[r.a], own[r.b]) for r in out.collect())
        return out

    check = jaccard._verified
    monkeypatch.setattr(simhash, "near_links", links_of)
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: verified.append(bool(made)) or check(pairs, *rest))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
    assert made and all(verified)
    prints = {bits(t) for _, t in rows}

    def classes(pairs):
        group = {p: p for p in prints}
        for a, b in pairs:
            x, y = group[a], group[b]
            group = {p: min(x, y) if g in (x, y) else g for p, g in group.items()} if x != y else group
        return group

    close = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 7]
    assert close and classes((a % (1 << 64), b % (1 << 64)) for a, b in made) == classes(close)
