import hashlib
import math
from collections import Counter

import pytest

from tacita.llm import mixing


def draw(doc_id, rate, seed=42):
    n = 0
    parts = max(1, math.ceil(rate / 500))
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        lam = rate / parts
        p = cdf = math.exp(-lam)
        k = 0
        while cdf <= u and k < lam + 12 * math.sqrt(lam) + 24:
            k += 1
            p = p * lam / k
            cdf += p
            if cdf > u:
                break
        n += k if cdf > u else k + 1
    return n


def test_counts_equal_inverted_poisson(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 5}", i) for i in range(900)] + [(None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long")
    weights = {"hot": 1.0, "s1": 2.0, "s2": 0.0, "": 0.5}
    out = mixing.mix_sources(docs, weights, total_rows=4000).collect()
    n_rows = Counter(s or "" for _, _, s, _ in rows)
    want = {}
    for i, _, s, _ in rows:
        want[i] = draw(i, 4000 * weights.get(s or "", 0.0) / 3.5 / n_rows[s or ""])
    got = Counter(r.doc_id for r in out)
    assert {i: n for i, n in want.items() if n} == dict(got)
    by = Counter(r.source for r in out)
    assert abs(by["s1"] / by["hot"] - 2) < 0.3 and "s2" not in by
    assert all(r.n_copies == got[r.doc_id] for r in out)
    assert sorted(r.copy for r in out if r.doc_id == 0) == list(range(got[0]))


def test_high_rates_and_order(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {"x": 1.0, "y": 1.0}, total_rows=6000)
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert Counter(r.doc_id for r in rows) == {1: draw(1, 3000.0), 2: draw(2, 3000.0)}
    assert 2600 < draw(1, 3000.0) < 3400


def test_defaults_empty_and_bad_weights(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.source_rates(empty, {"a": -1.0})
    docs = spark.createDataFrame([(i, "t", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    rates = {r.mix_source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates["b"] / rates["a"] == pytest.approx(math.sqrt(3))
