import random
from collections import Counter

from tacita.llm import quality


def brute(text, least):
    words = text.split()
    n = len(words)
    seen = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    three = {k for i in range(n - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    far = [0] * n
    for i in range(n):
        for j in range(n):
            size = 0
            while i != j and max(i, j) + size < n and words[i + size] == words[j + size]:
                size += 1
            far[i] = max(far[i], size)
    cover = {k for i in range(n) if far[i] >= least for k in range(i, i + far[i])}
    longest = max(far, default=0)
    lines, dup = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in lines
            lines.append(line)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(three), len(cover), longest if longest >= least else 0)


def texts():
    rng = random.Random(2)
    out = [rng.choice([" ", "\n"]).join(rng.choice(["é", "b#", "cc", "d|d"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    return out + ["", "a\n \na\na", "x " * 120, "one " * 5 + "two", "ü\n" * 60]


def test_features_equal_brute_force():
    found = list(quality._features([t.encode() for t in texts()], 5))
    assert found == [brute(t, 5) for t in texts()]


def test_a_long_repeat_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(4)
    vocab = [f"wort{i}" for i in range(5000)]
    clean = " ".join(rng.choice(vocab) for _ in range(400))
    part = " ".join(rng.choice(vocab) for _ in range(120))
    twice = " ".join([clean, part, "mid", " ".join(rng.choice(vocab) for _ in range(300)), part])
    rows = [(1, clean, "p"), (2, twice, "q"), (3, None, None), (4, "", "r"), (5, "few words", "s"), (None, clean, "t"), (1, clean, "p"), (6, "zz " * 40000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or -1, r.base_failed, r.kept) for r in quality.quality_rules(docs).collect())
    assert got == [(-1, False, True), (1, False, True), (1, False, True), (2, False, False), (3, True, False), (4, True, False), (5, True, False), (6, True, False)]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.kept) for r in kept.collect()) == [(-1, "t"), (1, "p"), (1, "p")]
    assert quality.quality_rules(docs.limit(0)).collect() == []
