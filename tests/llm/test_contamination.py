import hashlib
import random
import re

import pytest

from tacita.llm import contamination as c

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[at : at + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for win, ids in wins.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    own |= ids
        own = sorted(str(i) for i in own if i is not None)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables(n=60):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(25)] + ["É", "ß1", "THE"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 5, 13, 14, 30])))) for i in range(20)]
    items += [(90, None), (91, "a"), (92, "same words here"), (93, "same words here"), (None, "nobody owns this item"), (94, items[5][1])]
    docs = []
    for i in range(n):
        parts = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            parts += [t.upper() if rng.random() < 0.3 else t.replace(" ", rng.choice([" ", ", ", "\n"]))]
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "same, WORDS -- here"), (502, "other text"), (502, "other text"), (None, "a a a"), (503, "w1 " * 20000), (504, "nobody owns this item")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("few", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(c, "SET_TERMS", few)
    monkeypatch.setattr(c, "BROADCAST_ROWS", few)
    docs, items = tables()
    got = c.contamination(*frames(spark, docs, items)).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(4)
    assert c.contamination(*frames(spark, [], items)).collect() == []
    assert not any(r.contaminated for r in c.contamination(*frames(spark, docs, [])).collect())


def test_dropped_rows_keep_their_columns(spark):
    docs, items = tables()
    frame, bench = frames(spark, docs, items)
    out = c.drop_contaminated(frame, bench)
    assert out.columns == frame.columns
    clean = [(i, t) for i, t in docs if not brute([(i, t)], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(clean, key=str)


def test_proximity(spark):
    items = [(1, "alpha beta gamma delta epsilon")]
    docs = [(1, "x alpha beta gamma delta epsilon y"), (2, "alpha beta and gamma delta epsilon"), (3, "alpha " + "x " * 30 + "beta gamma"), (4, "alpha only"), (5, "beta x x epsilon gamma alpha delta")]
    frame, bench = frames(spark, docs, items)
    windows = c.item_windows(bench)
    plan = c.plan_windows(windows, c.term_counts(frame, windows.selectExpr("explode(words) AS term").distinct()))
    index = c.build_index(frame, plan)
    exact = {r.doc_id for r in c.phrase_matches(index, plan).collect()}
    near = {r.doc_id: r.spread for r in c.proximity_matches(index, plan, 1).collect()}
    assert exact == {1}
    assert near[1] == 0 and set(near) <= {1, 2}
    assert {r.doc_id for r in c.proximity_matches(index, plan, 2).collect()} >= {1, 2}
