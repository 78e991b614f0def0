"""Pattern detection over pages: matches with places, guards, overlap resolution, words and boxes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import context, fold
from ..sources.views import span_box
from .patterns import Pattern

MATCH = "array<struct<start:int,end:int,pattern:int,value:string,normalized:string>>"

# Fixed value: R17, a lower-case address whose @ was read as Q, with up to two "name. " parts before it. A match begins
# where its first run of characters begins, or where the last match ended, so that a run is read once.
Q_EMAIL = r"(?:(?<![a-z0-9._%+-])|\G)(?:[a-z0-9._%+-]*[a-z0-9]\.\x20){0,2}[a-z0-9._%+-]*[a-z0-9]Q[a-z0-9][a-z0-9.-]*\.[a-z]{2,}(?![A-Za-z0-9_])"
#: Characters around a match in which its run is looked for first.
RUN_CHARS = 256


def matches(text: Column, pattern: Pattern, index: int) -> Column:
    """The pattern's matches, not overlapping, blanks trimmed, each with its place. One expression cuts the text into
    what stands between matches and the matches; running lengths give the places, so look-arounds see the whole text."""
    if not pattern.active:
        return F.array().cast(MATCH)
    # \G: after the last match no other start is tried.
    whole = F.lit(rf"(?s)\G(.*?)({pattern.regex})")
    pairs = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("value"))
    empty = F.array().cast(MATCH)

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        bare = F.trim(p["value"])
        lead = F.length(p["value"]) - F.length(F.ltrim(p["value"]))
        normal = pattern.normalize(bare)
        found = F.struct((start + lead).alias("start"), (start + lead + F.length(bare)).alias("end"), F.lit(index).alias("pattern"), bare.alias("value"), normal.alias("normalized"))
        # A match whose check fails is dropped; its place isn't tried again
        kept = (bare != "") & pattern.check(normal)
        return F.struct((start + F.length(p["value"])).alias("at"), F.when(kept, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    has = text.rlike(pattern.regex)
    if pattern.gate:
        has = text.rlike(pattern.gate) & has
    if pattern.hint:
        has = text.contains(pattern.hint) & has
    return F.when(has, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])).otherwise(empty)


def run_guard(text: Column, start: Column, end: Column, value: Column) -> Column:
    """A match without letters counts only if the run around it, letters and digits with single - . / between, has
    none either."""
    # A possessive group is matched in a loop, without recursion. Most runs end within RUN_CHARS; only longer ones are read
    # from the whole text.
    run = r"^(?:[-./]?+[\p{L}\p{N}]++)*+"

    def lettered(near: Column, whole: Column) -> Column:
        found = F.regexp_extract(near, run, 0)
        return F.when(F.length(found) < RUN_CHARS - 1, found).otherwise(F.regexp_extract(whole, run, 0)).rlike(r"\p{L}")

    first = F.greatest(start - RUN_CHARS, F.lit(0))
    before = lettered(F.reverse(F.substring(text, first + 1, start - first)), F.reverse(F.substring(text, F.lit(1), start)))
    after = lettered(F.substring(text, end + 1, F.lit(RUN_CHARS)), F.substr(text, end + 1))
    return value.rlike(r"\p{L}") | ~(before | after)


def longest_first(found: Column) -> Column:
    """Greedy by length, then place, then order of patterns; what overlaps an accepted match is dropped; the result
    is in the order of places."""
    keyed = F.array_sort(F.transform(found, lambda m: F.struct((m["start"] - m["end"]).alias("rank"), m["start"].alias("start"), m["pattern"].alias("pattern"), m["end"].alias("end"), m["value"].alias("value"), m["normalized"].alias("normalized"))))
    none = F.array().cast("array<struct<start:int,end:int,pattern:int,value:string,normalized:string>>")

    def step(acc: Column, m: Column) -> Column:
        clash = F.exists(acc, lambda a: (m["start"] < a["end"]) & (a["start"] < m["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["pattern"].alias("pattern"), m["value"].alias("value"), m["normalized"].alias("normalized")))))

    return F.array_sort(F.aggregate(keyed, none, step))


def q_emails(text: Column) -> Column:
    """R17's matches as (start, end, value)."""
    return matches(text, Pattern("email-q", "EMAIL", Q_EMAIL, "xxxx@xxxx.xx", lambda v: F.lower(F.replace(F.regexp_replace(v, r"\.\x20", "."), F.lit("Q"), F.lit("@"))), hint="Q", gate="[a-z0-9]Q[a-z0-9]"), -1)


def page_gate(patterns: tuple[Pattern, ...]) -> str:
    """What every page with a match holds at least: one quick expression; none if a pattern has nothing to go by."""
    each = [p.needs or p.gate or re.escape(p.hint) for p in patterns if p.active]
    return "" if not each or "" in each else "|".join(f"(?:{g})" for g in dict.fromkeys(each))


def _made(patterns: tuple[Pattern, ...]) -> list[Column]:
    """The columns of matches in text, built once for a session: they take seconds to build call by call."""
    spark = SparkSession.getActiveSession()
    kept = spark.__dict__.setdefault("_tacita_matches", {})
    if patterns not in kept:
        kept[patterns] = [matches(F.col("text"), p, k) for k, p in enumerate(patterns)]
    return kept[patterns]


def detect(page: DataFrame, patterns: tuple[Pattern, ...], ocr: Column | None = None) -> DataFrame:
    """Every pattern on every page that isn't blank (P4), without a join: the patterns are constants of one
    projection. ocr says whether all words of a page were read from an image (P3); only there R17 runs, and its matches
    give way to those of the e-mail pattern (W5).

    (doc_id, page_index, start, end, pattern_id, entity_type, value, normalized_value, mask_format, word_span, bbox,
    context, source, confidence)"""
    rows = page.filter(F.trim("text") != "")
    text = F.col("text")
    email = next((k for k, p in enumerate(patterns) if p.id == "email"), None)
    made = _made(patterns)
    gate = page_gate(patterns)
    if gate:
        read = F.coalesce(ocr, F.lit(False)) & text.contains("Q") if ocr is not None else F.lit(False)
        rows = rows.filter(text.rlike(gate) | read)
    # Rows of one element keep the optimizer from copying the long expressions into every later filter.
    rows = rows.select("doc_id", "page_index", "text", F.explode(F.array(F.struct(*(m.alias(f"m{k}") for k, m in enumerate(made))))).alias("m"))
    found = [F.col(f"m.m{k}") for k in range(len(patterns))]
    if ocr is not None and email is not None:
        winners = F.col(f"m.m{email}")
        read = F.filter(q_emails(text), lambda q: ~F.exists(winners, lambda w: (w["start"] < q["end"]) & (q["start"] < w["end"])))
        read = F.transform(read, lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"), F.lit(email).alias("pattern"), q["value"].alias("value"), q["normalized"].alias("normalized")))
        found.append(F.when(ocr, read).otherwise(F.array().cast(MATCH)))
    rows = rows.select("doc_id", "page_index", "text", F.explode(F.array(F.concat(*found))).alias("found")).filter(F.size("found") > 0)
    rows = rows.select("doc_id", "page_index", "text", F.explode(longest_first(F.filter("found", lambda m: run_guard(text, m["start"], m["end"], m["value"])))).alias("m"))
    const = lambda attr: F.element_at(F.array(*(F.lit(getattr(p, attr)) for p in patterns)), F.col("m.pattern") + 1)
    rows = rows.select("doc_id", "page_index", "text", "m.start", "m.end", const("id").alias("pattern_id"), const("entity_type").alias("entity_type"), F.col("m.value").alias("value"), F.col("m.normalized").alias("normalized_value"), const("mask_format").alias("mask_format"))
    rows = rows.withColumn("place", span_box(text, F.col("start"), F.col("end")))
    return rows.select(
        "doc_id", "page_index", "start", "end", "pattern_id", "entity_type", "value", "normalized_value", "mask_format",
        F.struct("place.start_index", "place.end_index_exclusive").alias("word_span"),
        F.col("place.bbox").alias("bbox"),
        context(text, F.col("start"), F.col("end")).alias("context"),
        F.lit("regex").alias("source"),
        F.lit(1.0).alias("confidence"),
    )


def words_of_spans(spans: DataFrame, word: DataFrame) -> DataFrame:
    """spans(doc_id, page_index, start, end) and word rows -> the touched words' index range, hull,
    rotation if all agree, and line boxes where the words stand on several lines and none is turned. The join is on the
    page; the interval is its second condition."""
    from pyspark.sql.window import Window

    s, w = spans.alias("s"), word.alias("w")
    keys = ["doc_id", "page_index", "start", "end"]
    met = s.join(w, (F.col("s.doc_id") == F.col("w.doc_id")) & (F.col("s.page_index") == F.col("w.page_index")) & (F.col("w.end") > F.col("s.start")) & (F.col("w.start") < F.col("s.end"))).select(*(F.col(f"s.{k}") for k in keys), "w.word_index", "w.bbox")
    order = Window.partitionBy(*keys).orderBy("word_index")
    before = F.lag("bbox").over(order)
    parted = met.withColumn("new", F.when(before.isNull() | ((before["y"] < F.col("bbox.y") + F.col("bbox.height")) & (F.col("bbox.y") < before["y"] + before["height"])), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    right, bottom = F.col("bbox.x") + F.col("bbox.width"), F.col("bbox.y") + F.col("bbox.height")
    turn = F.coalesce("bbox.rotation", F.lit(0))
    runs = parted.groupBy(*keys, "run").agg(F.min("word_index").alias("first"), F.max("word_index").alias("last"), F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), F.max(right).alias("r"), F.max(bottom).alias("b"), F.max(turn).alias("turned"), F.min(F.coalesce("bbox.rotation", F.lit(-1))).alias("t0"), F.max(F.coalesce("bbox.rotation", F.lit(-1))).alias("t1"))
    piece = F.struct(F.col("y"), F.col("x"), (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))
    hull = runs.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"), F.max("turned").alias("turned"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    parts = F.transform("pieces", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["width"].alias("width"), p["height"].alias("height")))
    return hull.select(
        *keys,
        F.struct(F.col("first").alias("start_index"), (F.col("last") + 1).alias("end_index_exclusive")).alias("word_span"),
        F.struct("x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"), F.when((F.col("t0") == F.col("t1")) & (F.col("t0") >= 0), F.col("t0")).alias("rotation")).alias("bbox"),
        F.when((F.size("pieces") > 1) & (F.col("turned") == 0), parts).alias("fragments"),
    )


def find_text(word: DataFrame, query: str, prefix: bool = True) -> DataFrame:
    """Places where the query's sub-tokens stand in a row, on one line, the last one possibly only begun
    (prefix) or whole. (doc_id, page_index, start_index, end_index_exclusive, text); matches don't overlap.

    The sub-tokens of a page are compared by following rows of one window; only pages that hold a first token are sorted."""
    import re as _re

    from pyspark.sql.window import Window

    tokens = _re.findall(r"[^\W_]+", fold(query))
    if not tokens:
        return word.limit(0).select("doc_id", "page_index", F.lit(0).alias("start_index"), F.lit(0).alias("end_index_exclusive"), "text")
    from ..functions.text import sub_tokens

    n = len(tokens)
    flat = word.select("doc_id", "page_index", "word_index", "text", "bbox", F.posexplode(sub_tokens(F.col("text"))).alias("part", "token"))
    order = Window.partitionBy("doc_id", "page_index").orderBy("word_index", "part")
    flat = flat.withColumn("at", F.row_number().over(order))
    hit = F.col("token") == tokens[0] if n > 1 or not prefix else F.col("token").startswith(tokens[0])
    last = F.col("word_index")
    box = F.col("bbox")
    for k in range(1, n):
        nxt = F.lead(F.struct("token", "word_index", "bbox"), k).over(order)
        same = nxt["token"].startswith(tokens[k]) if prefix and k == n - 1 else nxt["token"] == tokens[k]
        band = (box["y"] < nxt["bbox"]["y"] + nxt["bbox"]["height"]) & (nxt["bbox"]["y"] < box["y"] + box["height"])
        hit = hit & F.coalesce(same & ((nxt["word_index"] == last) | band), F.lit(False))
        last, box = nxt["word_index"], nxt["bbox"]
    found = flat.withColumn("hit", hit).withColumn("last", last).filter("hit").select("doc_id", "page_index", "at", F.col("word_index").alias("start_index"), (F.col("last") + 1).alias("end_index_exclusive"))
    if n > 1:
        rows = found.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("at", "start_index", "end_index_exclusive"))).alias("hits"))
        none = F.array().cast("array<struct<at:int,start_index:int,end_index_exclusive:int>>")
        apart = F.aggregate("hits", none, lambda acc, h: F.when((F.size(acc) == 0) | (h["at"] >= F.try_element_at(acc, F.lit(-1))["at"] + n), F.concat(acc, F.array(h))).otherwise(acc))
        found = rows.select("doc_id", "page_index", F.explode(apart).alias("h")).select("doc_id", "page_index", "h.*")
    w = word.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), "word_index", F.col("text").alias("t"))
    met = found.join(w, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & F.col("word_index").between(F.col("start_index"), F.col("end_index_exclusive") - 1))
    return met.groupBy("doc_id", "page_index", "start_index", "end_index_exclusive").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "t"))), lambda x: x["t"]), " ").alias("text"))
