"""Benchmark decontamination by a positional inverted index of the training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if, written

WINDOW = 13
#: Lists that are intersected for each window, from the rarest term on.
LISTS = 3
#: Terms that are looked up in a constant set; beyond it words are joined with the terms.
SET_TERMS = 20_000
#: Rows of tables made from the benchmark that may be broadcast; beyond it their joins shuffle.
BROADCAST_ROWS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and everything beyond ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase, words): every `window` consecutive words of an item, or all of a shorter one. No words, no window."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    cut = items.select("item_id", "all", F.explode(at).alias("at")).select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def _listed(terms: DataFrame) -> list[str] | None:
    """The terms, if they are few enough for a constant set."""
    rows = terms.limit(SET_TERMS + 1).collect()
    return [r.term for r in rows] if len(rows) <= SET_TERMS else None


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): the number of times each of the terms stands in docs; terms that never do are missing."""
    few = _listed(terms)
    words = words_of(F.col(text_col))
    if few is not None:
        words = F.filter(words, lambda w: w.isin(few)) if few else F.array().cast("array<string>")
        return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def plan_windows(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase, words, lists): lists are the (term, offset) of the window's rarest terms, rarest first. Windows with a
    term that the texts lack can't occur and are dropped."""
    phrases = windows.select("phrase", "words").dropDuplicates(["phrase"])
    terms = phrases.select("phrase", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    grouped = terms.groupBy("phrase").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("by"))
    found = grouped.filter(F.col("by")[0]["n"] > 0)
    # of several offsets of one term, the first list serves; an offset is chosen once
    return found.select("phrase", "words", F.slice("by", 1, lists).alias("lists"))


def build_index(docs: DataFrame, plan: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, postings): the stored index, a row per row of docs and dealt out as docs is.
    postings are the (term, pos, from, context) of the words that some window's lists begin with; context, the words up
    to `window` - 1 before and after from word `from` on, is kept for the rarest terms of windows only."""
    first = plan.select(F.col("lists")[0]["term"].alias("term")).distinct()
    chosen = plan.select(F.explode("lists.term").alias("term")).distinct()
    rare, few = _listed(first), _listed(chosen)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), words_of(F.col(text_col)).alias("words"))

    def context(words: Column, pos: Column, keep: Column) -> Column:
        start = F.greatest(pos - (window - 1), F.lit(0))
        return F.when(keep, F.slice(words, start + 1, pos + window - start))

    posting = "array<struct<term:string,pos:int,from:int,context:array<string>>>"
    if rare is not None and few is not None:
        placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: x["term"].isin(few)) if few else F.array()
        if few:
            listed = F.transform(placed, lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), F.greatest(x["pos"] - (window - 1), F.lit(0)).alias("from"), context(F.col("words"), x["pos"], x["term"].isin(rare)).alias("context")))
        else:
            listed = F.array()
        return written(base.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), listed.cast(posting).alias("postings")), "index")
    # More terms than a constant set holds: the words travel to the terms, and places of those that match come back.
    base = written(base, "words")
    marks = chosen.join(first.withColumn("rare", F.lit(True)), "term", "left")
    hits = base.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term")).join(marks, "term")
    places = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("term", "pos", F.coalesce("rare", F.lit(False)).alias("rare"))).alias("places"))
    both = base.alias("b").join(places.alias("g"), F.expr("b.doc_id <=> g.doc_id AND b.text_hash = g.text_hash"), "left")
    listed = F.transform("places", lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), F.greatest(x["pos"] - (window - 1), F.lit(0)).alias("from"), context(F.col("words"), x["pos"], x["rare"]).alias("context")))
    return written(both.select("b.doc_id", "b.text_hash", F.size("words").cast("long").alias("n_words"), F.coalesce(listed, F.array()).cast(posting).alias("postings")), "index")


def _postings(index: DataFrame) -> DataFrame:
    return index.select("doc_id", "text_hash", F.col("n_words").alias("size"), F.explode("postings").alias("p")).select("doc_id", "text_hash", "size", "p.*")


def _candidates(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Starts of windows by their rarest term: (doc_id, text_hash, phrase, words, lists, start, from, context)."""
    keyed = broadcast_if(plan.select("phrase", "words", "lists", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["offset"].alias("offset")), BROADCAST_ROWS)
    rows = _postings(index).filter("context IS NOT NULL").join(keyed, "term").withColumn("start", F.col("pos") - F.col("offset"))
    return rows.filter((F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("size"))).drop("pos", "offset", "term", "size")


def phrase_matches(index: DataFrame, plan: DataFrame, lists: int = LISTS) -> DataFrame:
    """(doc_id, text_hash, phrase, start, size): every place of a text where a window stands word for word.

    Starts come from the list of the rarest term; the next lists, moved by their offsets, are intersected with them, and
    the words around the rarest term settle what is left."""
    found = _candidates(index, plan)
    exact = F.slice("context", F.col("start") - F.col("from") + 1, F.size("words")) == F.col("words")
    for k in range(1, lists):
        # The second and third lists, moved to where the window would start.
        nth = F.try_element_at(F.col("lists"), F.lit(k + 1))
        left = found.withColumn("want", nth["term"]).withColumn("place", F.col("start") + nth["offset"])
        other = _postings(index).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("term").alias("t"), F.col("pos").alias("p"))
        near = left.filter("want IS NOT NULL").join(other, F.expr("doc_id <=> d AND text_hash = h AND want = t AND place = p"), "left_semi")
        found = near.unionByName(left.filter("want IS NULL")).drop("want", "place")
    return found.filter(exact).select("doc_id", "text_hash", "phrase", "start", F.size("words").alias("size")).distinct()


def proximity_matches(index: DataFrame, plan: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_hash, phrase, start, spread): places where the window's listed terms stand so that the starts they
    point to differ by at most `slop` words, with the least spread from the rarest term's start. Windows of fewer terms
    than lists match with those they have."""
    found = _candidates(index, plan).select("doc_id", "text_hash", "phrase", "lists", "start").distinct().withColumn("spread", F.lit(0))
    for k in range(1, LISTS):
        nth = F.try_element_at(F.col("lists"), F.lit(k + 1))
        left = found.withColumn("want", nth["term"]).withColumn("moved", nth["offset"])
        other = _postings(index).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("term").alias("t"), F.col("pos").alias("p")).distinct()
        met = left.filter("want IS NOT NULL").join(other, F.expr(f"doc_id <=> d AND text_hash = h AND want = t AND abs(p - moved - start) <= {int(slop)}"))
        least = met.groupBy("doc_id", "text_hash", "phrase", "lists", "start").agg(F.min(F.greatest("spread", F.abs(F.col("p") - F.col("moved") - F.col("start")))).alias("spread"))
        found = least.unionByName(left.filter("want IS NULL").select(least.columns))
    return found.drop("lists")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of docs.

    n_hit: words of the text inside any occurrence of a window; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    A null or empty text has no words, a null or wordless item no window; items with null ids are not listed. Rows with
    equal ids are told apart by their texts, rows equal in both get the same answer each. Empty tables give empty or
    clean results. Other columns are not read."""
    windows = written(item_windows(benchmark, window, text_col="text"), "windows")
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    # A row for each term of the benchmark.
    counts = broadcast_if(written(term_counts(docs, vocabulary, text_col), "counts"), BROADCAST_ROWS)
    plan = written(plan_windows(windows, counts), "plan")
    index = build_index(docs, plan, window, id_col, text_col)
    matches = written(phrase_matches(index, plan), "matches")
    key = ["doc_id", "text_hash"]
    hit = matches.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy(key).agg(F.count("*").alias("n_hit"))
    owners = broadcast_if(windows.filter("item_id IS NOT NULL").select("phrase", F.col("item_id").cast("string").alias("item")), BROADCAST_ROWS)
    items = matches.select(*key, "phrase").distinct().join(owners, "phrase").groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hit.alias("h").join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.text_hash = i.text_hash"), "left").select("h.doc_id", "h.text_hash", "n_hit", "items")
    both = index.select(*key, "n_words").alias("b").join(found.alias("f"), F.expr("b.doc_id <=> f.doc_id AND b.text_hash = f.text_hash"), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        "b.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("b.text_hash").alias("text_hash"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't contaminated, all columns."""
    bad = contamination(docs, benchmark, window, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash == F.col("__hash")), "left_anti")
