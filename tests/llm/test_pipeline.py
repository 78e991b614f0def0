import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_contamination import brute as contaminated  # noqa: E402
from test_jaccard import kept as unique  # noqa: E402
from test_mixing import draw  # noqa: E402
from test_quality import brute as features  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"wort{i}" for i in range(4000)]
    item = " ".join(rng.choice(vocab) for _ in range(30))
    rows = []
    for i in range(90):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40, 160))]
        if i % 9 == 4:
            words = words[:10] + item.split() + words[10:]
        if i % 11 == 5:
            words = words[:60] * 2
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 4}", 1))
    for i in range(90, 130):
        at = rng.randrange(90)
        text = rows[at][1]
        rows.append((i, text if i % 2 else text + " end", "en", rows[at][3], 1))
    rows += [(200, None, None, None, None), (201, "", "en", "hot", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_each_stage_against_brute_force(spark, corpus):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    def step(k):
        nonlocal docs
        docs = spark.createDataFrame(corpus_pipeline.STAGES[k][1](spark, docs, path).collect(), "doc_id long, text string, lang string, source string, n_chars long" + ", shard int, slot long" * (k == 4))
        return docs.collect()

    kept = step(0)
    want = []
    for r in rows:
        n, _, _, _, again, cover, longest = features(r[1] or "", 10)
        if n >= 50 and 2 * again <= n and cover <= 0.3 * n and longest <= 100:
            want.append(r[0])
    assert sorted(r.doc_id for r in kept) == want and docs.columns == columns
    want = unique([(r.doc_id, r.text) for r in kept])
    assert len(want) < len(kept)
    kept = step(1)
    assert sorted(r.doc_id for r in kept) == want and docs.columns == columns
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in kept], [(1, item)]) if r[5]}
    assert bad
    before, kept = kept, step(2)
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in before if r.doc_id not in bad) and docs.columns == columns
    sizes = Counter(r.source for r in kept)
    roots = sum(n**0.5 for n in sizes.values())
    drawn = {r.doc_id: draw(r.doc_id, len(kept) * sizes[r.source] ** 0.5 / roots / sizes[r.source]) for r in kept}
    mixed = step(3)
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in drawn.items() if n}) and docs.columns == columns
    last = step(4)
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mixed)
    most = max(len(r.text.encode()) + 8 for r in last)
    total = sum(len(r.text.encode()) + 8 for r in last)
    for k in range(24):
        own = [r for r in last if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(len(r.text.encode()) + 8 for r in own) - total / 24) <= most


def test_run_applies_all(spark, corpus):
    path, _, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_empty_table_null_ids_and_clashing_columns(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(70))
    rows = [(None, words, "en", "a", 1, "x", 1, 2), (None, "v " + words[40:], "en", None, 1, "x", 1, 2), (7, words + " z", "en", "a", 1, "x", 1, 2), (8, "long " + " ".join(f"u{k}" for k in range(30000)), "en", "b", 1, "x", 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, copy int, n_copies int"
    for name, own in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert (len(out) > 0) == bool(own)
        assert all(0 <= r.shard < 24 for r in out)
