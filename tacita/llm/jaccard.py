"""Near copies by the Jaccard similarity of their word shingles: SimHash links, then a prefix filter for the pairs that
fingerprints can't show; parity sketches, exact verification, one text per group."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import broadcast_if, discard, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits in which the 64-bit SimHashes of two sets may differ to be verified in the first round. The result is the same for any number.
RADIUS = 7
#: Texts of which shingles are counted to learn which are common, the count from which one is, and how many are held.
#: They order the shingles; the result is the same for any order.
SAMPLE_ROWS = 20_000
COMMON = 3
COMMON_ROWS = 1 << 16
#: Words of 64 bits in a set's small parity sketch, and their columns. The wide sketch has a bit or two a shingle.
SKETCH_WORDS = 4
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
#: Shingles before the one at hand by which two nodes see that they have met there; any number gives the same result.
BEHIND = 4
#: Rows of tables of sets, without their shingles, that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_set(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles (fewer words: the whole sequence), ascending; none for a blank text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), ">i8").astype(np.int64))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a set's wide sketch and of its small one. Bit i is 1 if an odd number of the hashes end in i. Shingles
    of both sets cancel out, so sketches of two sets differ in no more bits than the sets differ in shingles; a sketch of
    half the width is the first half against the second."""
    small = 64 * SKETCH_WORDS
    width = max(small, 1 << max(len(shingles) - 1, 0).bit_length())
    odd = np.bincount(shingles & (width - 1), minlength=width) & 1
    folded = odd.reshape(-1, small).sum(axis=0) & 1
    return tuple(np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64) for bits in (odd, folded))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def common_shingles(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Shingles that many of a sample of texts hold, the most common last. Only the least third of a text's hashes is
    asked, as those are what its prefix would hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(t.as_py(), shingle_words) for t in batch.column(0).cast(pa.large_binary())]
            held = [s[: len(s) // 3 + 1] for s in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], names=["h"])

    share = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counted = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "h").limit(COMMON_ROWS).collect()
    return np.array([r.h for r in reversed(top)], np.int64)


def shingled(docs: DataFrame, shingle_words: int, common: np.ndarray, share: Fraction = Fraction(1)) -> DataFrame:
    """(id, text_hash, node, n, fp, small sketch, wide, shingles): node names the set of n shingles and fp is its SimHash; of them, common ones last, come the first
    1 - share and one more, which two sets that share `share` of theirs can't both have for themselves (all for 0)."""
    rank = np.argsort(common)
    common = common[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, wide, sets, fps = [], [], [], [], []
            marks = np.zeros((batch.num_rows, SKETCH_WORDS), np.int64)
            for t in batch.column(2).cast(pa.large_binary()):
                own = shingle_set(t.as_py(), shingle_words)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                bits, marks[len(sizes)] = sketch(own)
                wide.append(bits)
                fps.append(simhash.majority(own.astype(">i8").view(np.uint8).reshape(-1, 8)))
                sizes.append(len(own))
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    held = common[at] == own
                    own = np.concatenate([own[~held], own[held][np.argsort(rank[at[held]])]])
                sets.append(own[: len(own) + (len(own) * -share.numerator) // share.denominator + 1])
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).astype(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))]
            columns += [*(pa.array(marks[:, k].copy()) for k in range(SKETCH_WORDS)), _lists(wide), _lists(sets)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "n", "fp", *SKETCH, "wide", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"id {kind}, text_hash long, node long, n int, fp long, {', '.join(f'{c} long' for c in SKETCH)}, wide array<long>, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle_words: int, share: Fraction) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are as similar as asked. Only one text of each set in the pairs is read for
    it, and none is moved while the list of them is small."""
    asked = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    asked = written(asked.select(F.col("id").alias("asked"), F.col("text_hash").alias("asked_hash")), "asked")
    texts = docs.join(broadcast_if(asked, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("asked")) & (F.xxhash64("text") == F.col("asked_hash")), "left_semi")
    # Made anew for either end: written they would take more room than all else of the stage.
    own = shingled(texts, shingle_words, np.zeros(0, np.int64), Fraction(0)).select("node", "shingles")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = written(both.filter(share.denominator * shared >= share.numerator * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
    discard(asked)
    return out


def _apart(x: str, y: str) -> Column:
    """The bits in which the small sketches x.. and y.. differ."""
    bits = [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in SKETCH]
    return sum(bits[1:], bits[0])


def _wide_apart(x: str, y: str) -> Column:
    """The bits in which the wide sketches of x.. and y.. differ. Of sets whose sizes fit, one is at most twice as wide."""
    xor = lambda p, q: p.bitwiseXOR(q)
    k = F.least(F.size(f"{x}wide"), F.size(f"{y}wide"))
    p, q = (F.when(F.size(c) > k, F.zip_with(F.slice(c, 1, k), F.slice(c, k + 1, k), xor)).otherwise(F.col(c)) for c in (f"{x}wide", f"{y}wide"))
    return F.aggregate(F.zip_with(p, q, xor), F.lit(0), lambda s, v: s + F.bit_count(v))


def _fits(x: str, y: str, share: Fraction) -> Column:
    """Whether sizes (n) and places of one common shingle (at) of x.. and y.. leave room for the similarity."""
    p, q = share.numerator, share.denominator
    n, m, at, other = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}at", f"{y}at"))
    most = F.least(at, other) + F.least(n - at, m - other)
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * most >= p * (n + m))


def _first(x: str, y: str, share: Fraction) -> Column:
    """Whether x.. and y.. may be so similar if the shingle at hand is the first that they share: all others then stand
    behind it in both. That holds for one shingle of each similar pair, so a pair need not be made at those where it fails."""
    p, q = share.numerator, share.denominator
    n, m, at, other = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}at", f"{y}at"))
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * F.least(n - at, m - other) >= p * (n + m))


def _close(x: str, y: str, apart: Column, share: Fraction) -> Column:
    """Whether sketches of x.. and y.. that differ in so many bits leave room for the similarity: sets of that similarity
    differ in at most (1 - share) / (1 + share) of the sum of their sizes."""
    p, q = share.numerator, share.denominator
    return (p + q) * apart <= (q - p) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _settled(pairs: DataFrame, links: DataFrame | None, docs: DataFrame, reps: DataFrame, shingle_words: int, share: Fraction) -> DataFrame:
    """links(a, b) and those of pairs(a, b, apart) that connect all nodes which verified pairs connect. Each node's
    closest partner goes first, one set a node; then only pairs that are still in different components."""
    best = written(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("least")).select("least.a", "b"), "best")
    found = _verified(best, docs, reps, shingle_words, share)
    links = found if links is None else links.unionByName(found)
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    if not rest.take(1):
        return links
    groups = written(connected_components(links), "groups")
    rest = written(_across(rest, groups), "rest")
    links = links.unionByName(_verified(rest, docs, reps, shingle_words, share)) if rest.take(1) else links
    for done in (best, groups, rest):
        discard(done)
    return links


def fingerprint_pairs(reps: DataFrame, radius: int) -> DataFrame:
    """reps(node, fp) -> pairs (a, b), a < b, that connect every two nodes whose fingerprints differ in at most `radius`
    bits: blocks and bit planes between different fingerprints, the least node to all others of an equal one."""
    nodes = written(reps.groupBy("fp").agg(F.min("node").alias("node")), "fps")
    equal = reps.select("fp", F.col("node").alias("b")).join(nodes.select("fp", F.col("node").alias("a")), "fp").filter("a <> b").select("a", "b")
    pairs = simhash.near_links(nodes, radius).unionByName(equal)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sketched(pairs: DataFrame, reps: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, apart): those of pairs(a, b) whose sketches leave room for the similarity."""
    for columns, apart in ((("n", *SKETCH), _apart("a_", "b_")), (("n", "wide"), _wide_apart("a_", "b_"))):
        for end in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
        pairs = pairs.filter(_close("a_", "b_", apart, share)).select("a", "b", apart.alias("apart"))
        pairs = pairs if "wide" in columns else pairs.select("a", "b")
    return pairs


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose nodes are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def near_links(docs: DataFrame, prefixes: DataFrame, reps: DataFrame, shingle_words: int, share: Fraction, radius: int = RADIUS) -> DataFrame:
    """docs(id, text), prefixes as of shingled() of one text a node, reps(node, id, text_hash, n, fp, sketches) -> links
    (a, b) that connect every two nodes whose sets have a Jaccard similarity of `share` or more.

    The links of the SimHashes are verified in the first round. At a similarity of 0.8 fingerprints differ in ten bits or so,
    so what they can't show is found by an exact way: each of two such sets has that share of its shingles in the other, so
    their prefixes have one in common. Nodes that share one meet there twice: first with their neighbours, by size and in an
    order of the shingle's own, so that each node of a large group gets some partners at every shingle and few pairs join
    the group; then all that are not yet connected. Pairs whose sizes, places or sketches rule out the similarity go; all others are verified."""
    postings = prefixes.select("node", "n", F.posexplode("shingles").alias("at", "h"))
    postings = written(postings.withColumn("rows", F.count("*").over(Window.partitionBy("h"))).filter("rows > 1").drop("rows"), "postings")

    by_size = Window.partitionBy("h").orderBy("n", "node")
    # Sizes of a band differ by a ninth at most, so that neighbours in it mostly fit.
    by_chance = Window.partitionBy("h").orderBy(F.floor(F.log("n") * 9), F.xxhash64("node", "h"), "node")
    before = lambda by: F.struct(*(F.lag(c).over(by).alias(f"q_{c}") for c in ("node", "n", "at")))
    chain = postings.withColumns({"u": before(by_size), "v": before(by_chance)})
    chain = chain.select(F.col("node").alias("p_node"), F.col("n").alias("p_n"), F.col("at").alias("p_at"), F.explode(F.array("u", "v")).alias("q")).select("p_node", "p_n", "p_at", "q.*")
    chain = chain.filter((F.col("p_node") != F.col("q_node")) & _fits("p_", "q_", share))
    chain = chain.select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b"))
    chain = chain.unionByName(fingerprint_pairs(reps.select("node", "fp"), radius)).distinct()
    chain = written(_sketched(chain, reps, share), "chain")
    links = _settled(chain, None, docs, reps, shingle_words, share)

    groups = written(connected_components(links), "groups")
    named = postings.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
    # All shingles that two nodes of different components share are open, so a pair is made at the first of them at least.
    behind = F.collect_list("h").over(Window.partitionBy("node").orderBy("at").rowsBetween(-BEHIND, -1))
    left = named.join(several, "h", "left_semi").withColumn("behind", behind)
    left = written(left.join(reps.select("node", *SKETCH, "wide"), "node"), "open")
    one, two = (left.select("h", *(F.col(c).alias(f"{end}_{c}") for c in ("node", "n", "at", "component", "behind", *SKETCH, "wide"))) for end in "ab")
    room = _first("a_", "b_", share) & ~F.arrays_overlap("a_behind", "b_behind") & _close("a_", "b_", _apart("a_", "b_"), share) & _close("a_", "b_", _wide_apart("a_", "b_"), share)
    rest = one.join(two, (one.h == two.h) & (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & room)
    rest = rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), _wide_apart("a_", "b_").alias("apart")).distinct().join(chain.select("a", "b"), ["a", "b"], "left_anti")
    rest = written(rest, "across")
    links = _settled(rest, links, docs, reps, shingle_words, share) if rest.take(1) else links
    for done in (postings, left, groups, chain, rest):
        discard(done)
    return links


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose group holds a smaller id; texts whose shingles have at least that Jaccard similarity
    are linked, and links connect groups. No pair is missed.

    Lower-cases A-Z and takes words between ASCII white space. Null, empty and blank texts are equal. Rows that share an
    id are one document and stay or go together; rows without an id stay. An empty table gives an empty result. All
    columns are kept."""
    share = Fraction(str(similarity))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = written(shingled(plain, shingle_words, common_shingles(plain, shingle_words), share), "shingles")
    rep = F.min(F.struct("id", "text_hash", "n", "fp", *SKETCH, "wide")).alias("rep")
    reps = written(every.groupBy("node").agg(rep).select("node", "rep.*"), "reps")
    one = broadcast_if(reps.select(F.col("node").alias("__n"), F.col("id").alias("__id"), F.col("text_hash").alias("__hash")), BROADCAST_ROWS)
    prefixes = every.join(one, (F.col("node") == F.col("__n")) & F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left_semi")
    groups = connected_components(near_links(plain, prefixes, reps, shingle_words, share, radius))
    least = every.groupBy("node").agg(F.min("id").alias("least")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(least, "least")
    classes = least.join(least.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", "first")
    lost = written(every.select("id", "node").join(classes, "node").filter("id <> first").select(F.col("id").alias(id_col)).distinct(), "lost")
    for done in (every, reps, least):
        discard(done)
    return docs.join(lost, id_col, "left_anti")
