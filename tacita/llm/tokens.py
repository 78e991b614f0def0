"""Token counts of a byte-level BPE, with a shortcut for pre-tokens that are whole tokens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The contractions, and the white space of Unicode, in the public pattern of byte-level BPE.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this code point letters, digits and white space are the same in every Unicode version in use.
PLAIN_BELOW = "\u0370"
CACHED_PIECES = 1 << 19
CACHED_BYTES = 64

PIECES = regex.compile(rf"{'|'.join(CONTRACTIONS)}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary: itself where it is printable,
    else the next character from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counter(dict):
    """Pre-token -> its number of tokens. Whole tokens are entered beforehand; others are merged when they are met and
    kept while there is room."""

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        said = json.loads(definition)
        pre = said["pre_tokenizer"] or {}
        if said["model"]["type"] != "BPE" or said["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser or prefix space is wanted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError("added tokens must be matched as they are")
        added = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.whole = whole_tokens(said["model"]["vocab"], self.merged)
        self.update(dict.fromkeys(self.whole, 1))

    def merged(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) > CACHED_PIECES + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        """The tokens of a text without added tokens."""
        if text.isascii() or max(text) < PLAIN_BELOW:
            return sum(map(self.__getitem__, PIECES.findall(text)))
        # The library's own split, whose Unicode tables may differ from regex's.
        return sum(self[text[a:b]] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return sum(self.plain(p) for p in parts if p) + len(parts) - 1


def whole_tokens(vocab: dict[str, int], merged) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and that the merges join into one token: where such a string is
    met as a pre-token, it counts 1. Proved for each string, before any text is read."""
    to_byte = {c: b for b, c in byte_letters().items()}
    out = set()
    for token in vocab:
        try:
            text = bytes(to_byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and (match := PIECES.match(text)) and match.end() == len(text) and merged(text) == 1:
            out.add(text)
    return frozenset(out)


_counters: dict[str, Counter] = {}


def counter_of(definition: str) -> Counter:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(definition)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of docs. The tokenizer's file is read on the driver and sent
    to the executors; its size is fixed. Strings of added tokens inside a text count as one token.

    A null or empty text has no bytes and no tokens. Null and equal ids stay as they are; an empty table gives an empty
    result; other columns are not read."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(sent.value)
        for batch in batches:
            n = np.fromiter((counter.count(t.as_py()) for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return made.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
