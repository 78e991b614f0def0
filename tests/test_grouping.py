import random

import pytest
from pyspark.sql import functions as F

from tacita.functions import similarity
from tacita.operators import edits, grouping, replace
from tacita.operators.grouping import Hit, Resolver


def hit(seq, kind="PERSON", value="Juan Pérez", key=None, source="regex", conf=1.0, box=(0.0, 0.0, 10.0, 10.0), page=0):
    return Hit(seq, kind, page, value, key or value.lower(), source, conf, box)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def strings(n, seed=1):
    out = []
    for _ in range(n):
        text = ""
        for _ in range(seed % 23):
            seed = (seed * 1664525 + 1013904223) % 2**32
            text += "abcé日🙂 n"[seed >> 16 & 7]
        seed = (seed * 1664525 + 1013904223) % 2**32
        out.append(text)
    return out


def test_bounded_distance_equals_plain():
    s = strings(120)
    for a, b in zip(s, s[1:] + [s[0]], strict=True):
        d = plain(a, b)
        for limit in (0, 1, 3, 8, 40):
            assert grouping.bounded_distance(a, b, limit) == min(d, limit + 1)
        for t in (0.0, 0.5, 0.88, 1.0):
            longest = max(len(a), len(b))
            want = t <= 1 if not longest else (1 - d / longest if a and b else 0.0) >= t
            assert grouping.alike(a, b, t) == want


def test_similarity_join_loses_nothing(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 5, 9, 18, 30]))) for _ in range(120)]
    for n in list(names[:60]):
        k = rng.randrange(len(n))
        names.append(n[:k] + rng.choice("abcdef") + n[k + 1 :])
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in names], "value string")
    got = {(r.a, r.b) for r in grouping.similar_pairs(df, threshold=0.8).collect()}
    want = {(a, b) for a in names for b in names if a < b and 1 - plain(a, b) / max(len(a), len(b)) >= 0.8}
    assert got == want


def test_max_distance(spark):
    rows = spark.range(0, 300).select(F.col("id").alias("n"), *(similarity.max_distance(F.col("id"), t).alias(f"t{k}") for k, t in enumerate((0.88, 0.5, 1.0)))).collect()
    for r in rows:
        for k, t in enumerate((0.88, 0.5, 1.0)):
            want = max((d for d in range(r.n + 1) if not r.n or 1 - d / r.n >= t), default=0)
            assert r[f"t{k}"] == want


def test_fold_rules():
    s = Resolver(frozenset({"juan"}))
    assert s.add(hit(1)) == "grouped"
    assert s.add(hit(2)) == "duplicate"
    assert s.add(hit(3, value="Juan Pérezz", box=(0.0, 50.0, 9.0, 9.0))) == "grouped" and len(s.groups) == 1
    assert s.add(hit(4, value="Juan", box=(1.0, 1.0, 2.0, 2.0))) == "contained"
    assert s.add(hit(5, "DNI", "1", source="regex", box=(0.0, 0.0, 9.0, 9.0), conf=1.0)) == "lost" and s.conflicts[-1]["reason"] == "overlap"
    assert s.add(hit(6, "ORGANIZATION", "Juan Pérez SA", source="ner", conf=0.9, box=(0.0, 0.0, 30.0, 10.0))) == "grouped" and s.conflicts[-1]["reason"] == "disagree"
    assert s.add(hit(7, value="Juan Gil", source="ner", conf=0.6, box=(0.0, 90.0, 9.0, 9.0))) == "suggested" and not s.groups[-1].enabled
    assert s.add(hit(8, value="Juan Gil", box=(40.0, 90.0, 9.0, 9.0))) == "grouped" and s.groups[-1].enabled
    assert s.add(hit(9, value="Zoe X", source="ner", conf=0.6, box=(0.0, 99.0, 9.0, 9.0), page=3)) == "dropped"
    assert s.add(hit(10, "EMAIL", "m", source="manual", box=(0.0, 50.0, 9.0, 9.0))) == "held"
    s.remove(0)
    assert s.add(hit(11, box=(70.0, 0.0, 9.0, 9.0))) == "suppressed" and all("juan pérez" not in g.keys for g in s.groups)
    s.lift("juan pérez")
    assert any("juan pérez" in g.keys for g in s.groups)
    s.drop(source="ner")
    assert all(h.source != "ner" for rows in s.records.values() for h, _ in rows)
    with pytest.raises(ValueError):
        s.drop()


def test_numbers_by_place():
    s = Resolver()
    for k, (v, y) in enumerate((("b", 50.0), ("a", 10.0), ("c", 90.0))):
        s.add(hit(k, "DNI", v, box=(0.0, y, 5.0, 5.0)))
    assert [(n, g.canonical) for n, g in s.finished()] == [(1, "a"), (2, "b"), (3, "c")]


def test_edits(spark):
    g = spark.createDataFrame([(1, "1:DNI:1", "DNI", "a", 1, 2, True, "placeholder", "[DNI 01]"), (1, "1:DNI:2", "DNI", "b", 2, 3, True, "placeholder", "[DNI 02]"), (1, "1:EMAIL:1", "EMAIL", "c", 1, 1, True, "mask", "x")], "doc_id long, group_id string, entity_type string, canonical_value string, index_in_type int, n_members long, enabled boolean, mode string, replacement_value string")
    out = {r.group_id: r for r in edits.apply_edits(g, [("1:DNI:1", {"replacement_value": "hand"}), ("1:DNI:1", {"mode": "mask"}), ("1:EMAIL:1", {"entity_type": "DNI"})]).collect()}
    assert not out["1:DNI:1"].value_user_set and out["1:DNI:1"].mode == "mask" and out["1:EMAIL:1"].index_in_type == 3
    with pytest.raises(ValueError):
        edits.update(g, "x", {"colour": 1})
    m = spark.createDataFrame([(k, "1:DNI:1" if k < 2 else "1:DNI:2") for k in range(5)], "seq long, group_id string")
    merged, moved = edits.merge(g, m, spark.createDataFrame([("1:DNI:1", "1:DNI:2"), ("1:DNI:1", "1:EMAIL:1"), ("1:DNI:1", "1:DNI:1")], "survivor string, absorbed string"))
    assert {r.group_id: r.n_members for r in merged.collect()} == {"1:DNI:1": 5, "1:EMAIL:1": 1}
    assert {r.group_id for r in moved.collect()} == {"1:DNI:1"}
    parted = edits.split(m, "1:DNI:2", spark.createDataFrame([(3,)], "seq long"), "new")
    assert sorted(r.seq for r in parted.filter("group_id = 'new'").collect()) == [3]
    with pytest.raises(ValueError):
        edits.split(m, "1:DNI:2", m.select("seq"), "new")
    d = {r.group_id: (r.op, r.changed) for r in edits.diff(g, g.filter("group_id <> '1:DNI:2'").withColumn("mode", F.when(F.col("group_id") == "1:EMAIL:1", "redact").otherwise(F.col("mode")))).collect()}
    assert d == {"1:DNI:2": ("removed", None), "1:EMAIL:1": ("updated", ["mode"])}


def test_rules_and_redaction(spark):
    g = spark.createDataFrame([(1, "a", "DNI"), (1, "b", "EMAIL"), (2, "c", "DNI")], "doc_id long, group_id string, entity_type string")
    rules = spark.createDataFrame([("r1", 1, "group", "a", None, "mask", 1, True), ("r2", 1, "type", None, "EMAIL", "redact", 1, True), ("r3", 1, "type", None, "EMAIL", "mask", 0, True), ("r4", 1, "global", None, None, "synthetic", 9, False)], "rule_id string, doc_id long, scope string, target_group_id string, target_type string, mode string, priority int, enabled boolean")
    assert {r.group_id: r.mode for r in replace.resolve_modes(g, rules).collect()} == {"a": "mask", "b": "redact", "c": "placeholder"}
    page = spark.createDataFrame([(1, 0, "é uno dos tres"), (1, 1, "x"), (2, 0, "y")], "doc_id long, page_index int, text string")
    spans = spark.createDataFrame([(1, 0, 6, 9, "[D]"), (1, 0, 2, 5, "")], "doc_id long, page_index int, start int, end int, replacement_value string")
    cover = spark.createDataFrame([(2, 0)], "doc_id long, page_index int")
    assert {r.doc_id: r.text for r in replace.assembled(replace.redacted_pages(page, spans, cover)).collect()} == {1: "é  [D] tres\nx", 2: ""}
