import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tacita.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    odd = ["<|endoftext|>", "  ", "\n\n ", "it's we'll 'tis", "é x", "日本語 テキスト", "Ωmega ٣٤", "\x1c\x1d", "a" * 5000, "　  ", "🙂🙂 ok", "''s", " <|endoftext|>x", "<|endoftext", "½²", "\x85\r\n\t"]
    words = ["the", " and", "Antion", "123", "...", " ", "\n"]
    return odd + ["", "".join(rng.choice(odd + words) for _ in range(400))] + ["".join(rng.choice(odd[1:] + words) for _ in range(30)) for _ in range(200)]


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, PATH).collect()}
    want = set()
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want
    assert tokens.token_counts(docs.limit(0), PATH).collect() == []


def test_whole_tokens_are_proved():
    with open(PATH, encoding="utf-8") as f:
        counter = tokens.Counter(f.read())
    library = Tokenizer.from_file(PATH)
    assert len(counter.whole) > 40000
    for piece in random.Random(2).sample(sorted(counter.whole), 3000):
        assert len(library.encode(piece, add_special_tokens=False).ids) == 1
    assert counter[" zzxqk"] == len(library.encode(" zzxqk", add_special_tokens=False).ids)


def test_other_kinds_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        tokens.Counter(f.read())
