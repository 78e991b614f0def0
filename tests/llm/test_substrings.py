import hashlib
import random

import numpy as np
import pytest

from tacita.llm import shared
from tacita.llm import substrings as s


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                g = b[p : p + length]
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    alphabet = "abcdé \n"
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.5:
                p = rng.choice(pieces)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randrange(120)])
            else:
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(90))))
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 300), (101, "a" * 49), (102, "a" * 50), (103, "ab" * 200), (104, None), (105, ""), (106, rows[3][1]), (106, rows[3][1]), (106, "a" * 80), (None, "a" * 90), (2, "a" * 70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [4096, 2])
def test_equals_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, spans string").repartition(3)
    got = sorted((tuple(r[:5]) + (bytes(r.kept),) for r in s.remove_repeats(docs, hot_phrases=hot).collect()), key=str)
    assert got == brute(rows, 50)


@pytest.mark.parametrize("length", [20, 50, 64])
def test_other_lengths(spark, length):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[:5]) + (bytes(r.kept),) for r in s.remove_repeats(docs, length).collect()), key=str)
    assert got == brute(rows, length)


def test_phrases_tile_the_starts(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 101) for _ in range(5000))
    monkeypatch.setattr(s, "CHUNK", 700)
    starts = []
    for base, first, last, _, _ in s.phrases(text):
        assert (first[1:] == last[:-1]).all()
        starts += [base + int(first[0]), base + int(last[-1])]
    assert starts[0] == 0 and starts[-1] == len(text) - 49 and starts[1:-1:2] == starts[2::2]


def test_dictionary_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    places = np.arange(2900)
    order, fresh = s.dictionary_order(data, places, 50)
    strings = [data[p : p + 50].tobytes() for p in order]
    assert strings == sorted(strings)
    assert fresh.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:], strict=False)]


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_asks_only_for_phrases_with_a_side_in_common(spark, monkeypatch):
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, long = made(30), made(60)
    rows = [(i, made(80) + shared + made(80)) for i in range(20)] + [(30 + i, made(40) + long + made(40)) for i in range(2)]
    asked, write = [], s.written

    def seen(df, label):
        out = write(df, label)
        if label == "looked":
            asked.extend(r.id for r in out.filter(f"kind = {s.FRAGMENT}").collect())
        return out

    monkeypatch.setattr(s, "written", seen)
    got = sorted((tuple(r[:5]) + (bytes(r.kept),) for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows, 50)
    assert set(asked) <= {30, 31}


def test_leaves_nothing_but_the_spans(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    s.covered_spans(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["spans"]


def test_ids_are_packed():
    for ids in ([5], [-(2**63), 2**63 - 1, 0], [7, 300, 70000, 7]):
        ids = np.array(ids, np.int64)
        assert (s._unpack_ids(s._pack_ids(ids)) == ids).all()
