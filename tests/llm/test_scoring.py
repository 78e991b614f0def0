import math
import random
from collections import Counter

import pytest

from tacita.llm import scoring


def lowered(text):
    return (text or "").encode().lower().split()


def brute(rows, targets, alpha=0.1):
    pairs, firsts = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = lowered(t)
        for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True):
            for k in range(2):
                if k or i in targets:
                    pairs[k][a, b] += 1
                    firsts[k][a] += 1
    v = len(firsts[1])
    n = [sum(c.values()) for c in firsts]
    scale = [1.0, n[0] / n[1]]
    out = []
    for i, t in rows:
        w = lowered(t)
        loss = [0.0, 0.0]
        for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True):
            for k in range(2):
                loss[k] -= math.log((pairs[k][a, b] * scale[k] + alpha) / (firsts[k][a] * scale[k] + alpha * v))
        m = len(w) + 1
        out.append((i, m, loss[0] / m, loss[1] / m, (loss[0] - loss[1]) / m))
    return out


def corpus():
    rng = random.Random(8)
    one, two = [f"a{i}" for i in range(60)], [f"b{i}é" for i in range(60)]
    rows = []
    for i in range(150):
        pool = one if i % 2 else two
        rows.append((i, " ".join(rng.choice([rng.choice(pool), "The"]) for _ in range(rng.randrange(60)))))
    return rows + [(200, None), (201, ""), (202, " \n"), (7, rows[7][1]), (7, "other the"), (None, "a1 a2"), (203, "the " * 5000)]


@pytest.mark.parametrize("hot", [4, 1000])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(scoring, "HOT", hot)
    rows = corpus()
    targets = {i for i, _ in rows if i is not None and i < 150 and i % 2}
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    ids = spark.createDataFrame([(i,) for i in targets] + [(None,)], "doc_id long")
    got = sorted((tuple(r) for r in scoring.cross_entropy_difference(docs, ids).collect()), key=str)
    want = sorted(brute(rows, targets), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == pytest.approx(w[2:], abs=1e-9)
    by = {g[0]: g[4] for g in got if g[0] is not None and g[0] < 150 and g[1] > 10}
    assert max(s for i, s in by.items() if i % 2) < min(s for i, s in by.items() if not i % 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ids = spark.createDataFrame([], "doc_id long")
    assert scoring.cross_entropy_difference(docs, ids).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert scoring.cross_entropy_difference(some, ids).first().n_tokens == 3
