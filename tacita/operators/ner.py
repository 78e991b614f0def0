"""From a model's token labels to spans, with joins, windows and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The model's labels, and the words between a street and its number.
LABELS = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "ADDRESS", "DATE": "DATE"}
STREET_NUMBER = r"^(?i)\s{1,2}(?:(?:N[°º]|No\.|nro\.?|n[úu]mero|al)\s{0,2})?\d{1,5}(?!\d|/|[.,\-‐‑–—]\d)"

PAGE = ["doc_id", "page_index", "chunk"]


def chunks(word: DataFrame, size: int = 256) -> DataFrame:
    """Words with the chunk they are inferred in: chunks end where the rotation changes and after `size` words."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("word_index")
    turn = F.coalesce("bbox.rotation", F.lit(0))
    run = word.withColumn("__t", turn).withColumn("__new", F.when(F.lag("__t").over(w).eqNullSafe(F.col("__t")), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    at = F.row_number().over(Window.partitionBy("doc_id", "page_index", "__run").orderBy("word_index")) - 1
    part = run.withColumn("__part", F.floor(at / size))
    return part.withColumn("chunk", (F.dense_rank().over(Window.partitionBy("doc_id", "page_index").orderBy("__run", "__part")) - 1).cast("int")).drop("__t", "__new", "__run", "__part")


def upper_run(word: Column) -> Column:
    """Whether a word is all capitals, two letters or more, and has no dot before a letter."""
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"\p{Ll}") & ~word.rlike(r"\.\p{L}") & (F.length(F.regexp_replace(word, r"[^\p{L}]", "")) >= 2)


def title_runs(word: DataFrame) -> DataFrame:
    """Runs of two or more capitalised words in title case; no word changes its length."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("word_index")
    up = word.withColumn("__up", upper_run(F.col("text")))
    up = up.withColumn("__near", F.col("__up") & (F.coalesce(F.lag("__up").over(w), F.lit(False)) | F.coalesce(F.lead("__up").over(w), F.lit(False))))
    first = F.length(F.regexp_extract("text", r"^([^\p{L}]*)", 1)) + 1
    titled = F.concat(F.substring("text", F.lit(1), first), F.lower(F.substr("text", first + 1)))
    return up.withColumn("text", F.when(F.col("__near") & (F.length(titled) == F.length("text")), titled).otherwise(F.col("text"))).drop("__up", "__near")


def positioned(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """tokens(.., token_index, entity, score, word) with their places in the chunk's text, each searched after the one
    before; tokens that aren't found are left out. One pass over a chunk's tokens; a chunk has a bounded number."""
    listed = tokens.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("token_index", "entity", "score", "word"))).alias("t")).join(texts, PAGE)
    none = F.array().cast("array<struct<token_index:int,entity:string,score:double,inner:boolean,start:int,end:int>>")

    def step(s: Column, x: Column) -> Column:
        inner = x["word"].startswith("##")
        clean = F.when(inner, F.substr(x["word"], F.lit(3))).otherwise(x["word"])
        at = F.call_function("locate", clean, F.col("text"), s["at"] + 1)
        made = F.struct(x["token_index"].alias("token_index"), x["entity"].alias("entity"), x["score"].alias("score"), inner.alias("inner"), (at - 1).alias("start"), (at - 1 + F.length(clean)).alias("end"))
        ok = (F.length(clean) > 0) & (at > 0)
        return F.struct(F.when(ok, at - 1 + F.length(clean)).otherwise(s["at"]).alias("at"), F.when(ok, F.concat(s["out"], F.array(made))).otherwise(s["out"]).alias("out"))

    out = F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return listed.select(*PAGE, "text", F.explode(out).alias("x")).select(*PAGE, "text", "x.*")


def label_spans(tokens: DataFrame) -> DataFrame:
    """Positioned tokens -> spans (start, end, entity_type, confidence). A span opens at a B- label of a
    word's first piece, after a gap, or where the label changes between words; a piece inside a word never opens one while
    one is open."""
    w = Window.partitionBy(*PAGE).orderBy("token_index")
    tag = F.regexp_extract("entity", "^[BI]-(.+)$", 1)
    known = F.when(tag.isin(*LABELS), tag)
    rows = tokens.withColumn("tag", known).withColumn("gap", F.col("tag").isNull() | F.lag("tag").over(w).isNull())
    # an inner piece keeps the label of the word it is in, so the open label is that of the last piece that could open one
    rows = rows.withColumn("gap_run", F.sum(F.when(F.col("tag").isNull(), 1).otherwise(0)).over(w)).filter("tag IS NOT NULL")
    r = Window.partitionBy(*PAGE, "gap_run").orderBy("token_index")
    rows = rows.withColumn("first", F.row_number().over(r) == 1).withColumn("lead_tag", F.last(F.when(~F.col("inner") | F.col("first"), F.col("tag")), True).over(r.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.col("first") | (~F.col("inner") & (F.col("entity").startswith("B-") | (F.col("tag") != F.col("lead_tag"))))
    rows = rows.withColumn("span", F.sum(F.when(opens, 1).otherwise(0)).over(r))
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    out = rows.groupBy(*PAGE, "gap_run", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("tag", "token_index").alias("tag"), F.avg("score").alias("c"))
    return out.select(*PAGE, "start", "end", F.element_at(names, F.col("tag")).alias("entity_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c"))).alias("confidence"))


def repaired(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of one type within a word become one, with the longest one's confidence; then each grows to the
    edges of its words, as far as its neighbours; then a lone last letter before a slash is given up."""
    s = spans.join(texts, PAGE)
    w = Window.partitionBy(*PAGE).orderBy("start")
    between = F.substring("text", F.lag("end").over(w) + 1, F.col("start") - F.lag("end").over(w))
    same = (F.lag("entity_type").over(w) == F.col("entity_type")) & (F.col("start") >= F.lag("end").over(w)) & between.rlike(r"^[\p{L}\p{N}]*$")
    s = s.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    s = s.groupBy(*PAGE, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("entity_type").alias("entity_type"), F.max_by("confidence", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("confidence"), F.first("text").alias("text"))
    floor = F.coalesce(F.lag("end").over(w), F.lit(0))
    ceiling = F.coalesce(F.lead("start").over(w), F.length("text"))
    s = s.withColumn("floor", floor).withColumn("ceiling", ceiling)
    back = F.length(F.regexp_extract(F.substring("text", F.col("floor") + 1, F.col("start") - F.col("floor")), r"([\p{L}\p{N}]*)$", 1))
    on = F.length(F.regexp_extract(F.substring("text", F.col("end") + 1, F.col("ceiling") - F.col("end")), r"^([\p{L}\p{N}]*)", 1))
    s = s.withColumns({"start": (F.col("start") - back).cast("int"), "end": (F.col("end") + on).cast("int")})
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    lone = (F.substring("text", F.col("end") + 1, F.lit(1)) == "/") & value.rlike(r"(?:^|\s)\p{L}$")
    kept = F.when(lone, F.rtrim(F.substring(value, F.lit(1), F.length(value) - 1))).otherwise(value)
    s = s.withColumn("value", kept).filter(F.col("value").rlike(r"[\p{L}\p{N}]"))
    return s.select(*PAGE, "start", (F.col("start") + F.length("value")).alias("end"), "entity_type", "confidence", "value")


def extended_addresses(spans: DataFrame) -> DataFrame:
    """an address without a number at its end takes the street number that follows, unless that goes on as a
    date, an amount or a range. spans have the page's text; `limit`, if there, is where a word of another rotation begins."""
    rest = F.substr(F.col("text"), F.col("end") + 1)
    if "limit" in spans.columns:
        rest = F.substring(rest, F.lit(1), F.greatest(F.col("limit") - F.col("end"), F.lit(0)))
    more = F.length(F.regexp_extract(rest, f"({STREET_NUMBER})", 1))
    last = F.substring("text", F.col("end"), F.lit(1))
    end = F.when((F.col("entity_type") == "ADDRESS") & ~last.rlike("[0-9]"), F.col("end") + more).otherwise(F.col("end"))
    return spans.withColumn("end", end.cast("int")).withColumn("value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))


def token_windows(lengths: list[int], budget: int = 508) -> list[tuple[int, int]]:
    """Words of the given token counts, cut into windows as long as the budget allows."""
    out, start, used = [], 0, 0
    for k, n in enumerate(lengths):
        if k > start and used + n > budget:
            out.append((start, k))
            start, used = k, 0
        used += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out
