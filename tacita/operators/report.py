"""Lists, summaries, evaluation and invariants over resolved entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.labels import type_rank
from ..functions.text import comparable
from ..schema import OVERLAP


def group_filter(groups: DataFrame, query: str) -> DataFrame:
    """The query stands in the canonical value or an alias, in any case."""
    q = query.lower()
    return groups.filter(F.lower("canonical_value").contains(q) | F.exists("aliases", lambda a: F.lower(a).contains(q)))


def panel_order(groups: DataFrame, by: str = "appearance") -> DataFrame:
    """Rank within the document: types in their order, then by number, or by name under Spanish collation."""
    keys = [F.collate("canonical_value", "es_CI_AI")] if by == "name" else []
    w = Window.partitionBy("doc_id").orderBy(type_rank(F.col("entity_type")), *keys, "index_in_type", "group_id")
    return groups.withColumn("panel_rank", F.row_number().over(w))


def summary(groups: DataFrame) -> DataFrame:
    """Per document the groups, the enabled ones, and the types; per type whether all, none or some are on."""
    return groups.groupBy("doc_id").agg(F.count("*").alias("n_groups"), F.count_if("enabled").alias("n_enabled"), F.count_distinct("entity_type").alias("n_types"))


def cascade(groups: DataFrame) -> DataFrame:
    on = F.count_if("enabled")
    state = F.when(on == 0, "none").when(on == F.count("*"), "all").otherwise("indeterminate")
    return groups.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n_groups"), state.alias("state"))


def match_status(found: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Each found place with the state of the group that covers at least half of it: hidden by an enabled group,
    disabled by one that is off, else unmarked."""
    cover = members.join(groups.select("group_id", "enabled"), "group_id").select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), "enabled", F.explode(g.pieces(F.col("bbox"), F.col("fragments"))).alias("b"))
    share = g.intersection_area(F.col("bbox"), F.col("b")) / F.nullif(g.area(F.col("bbox")), F.lit(0.0))
    met = found.join(cover, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & (F.col("bbox.x") < F.col("b.x") + F.col("b.width")) & (F.col("b.x") < F.col("bbox.x") + F.col("bbox.width")) & (share >= 0.5), "left")
    keys = ["doc_id", "page_index", "start_index", "end_index_exclusive"]
    return met.groupBy(*keys).agg(F.when(F.coalesce(F.bool_or("enabled"), F.lit(False)), "hidden").when(F.count("enabled") > 0, "disabled").otherwise("unmarked").alias("status"))


def covered_truth(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Truth rows with covered (a detection on the page holds the value) and typed (one of its type does). The
    join is on the page; containment is its second condition."""
    t = truth.withColumn("tv", comparable(F.col("value")))
    d = detections.select(F.col("document_id").alias("d"), F.col("page_index").alias("p"), F.col("entity_type").alias("kind"), comparable(F.col("value")).alias("dv")).distinct()
    keys = [c for c in truth.columns]
    met = t.withColumn("__n", F.monotonically_increasing_id()).join(d, (F.col("document_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & F.col("dv").contains(F.col("tv")), "left")
    return met.groupBy("__n", *keys).agg(F.coalesce(F.bool_or(F.col("d").isNotNull()), F.lit(False)).alias("covered"), F.coalesce(F.bool_or(F.col("kind") == F.col("entity_type")), F.lit(False)).alias("typed")).drop("__n")


def false_positives(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections on whose page no truth value holds them or is held by them."""
    t = truth.select(F.col("document_id").alias("d"), F.col("page_index").alias("p"), comparable(F.col("value")).alias("tv")).distinct()
    dv = comparable(F.col("value"))
    return detections.withColumn("dv", dv).join(t, (F.col("document_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & (F.col("dv").contains(F.col("tv")) | F.col("tv").contains(F.col("dv"))), "left_anti").drop("dv")


def rate(part: Column, whole: Column) -> Column:
    """Nothing out of nothing is all."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def evaluation(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Per document the truth, what is covered and typed, the detections and the false ones."""
    a = covered_truth(truth, detections).groupBy("document_id").agg(F.count("*").alias("n_truth"), F.count_if("covered").alias("n_covered"), F.count_if("typed").alias("n_typed"))
    b = detections.groupBy("document_id").agg(F.count("*").alias("n_detected"))
    c = false_positives(truth, detections).groupBy("document_id").agg(F.count("*").alias("n_false"))
    out = a.join(b, "document_id", "full").join(c, "document_id", "left")
    return out.select("document_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_truth", "n_covered", "n_typed", "n_detected", "n_false")))


def totals(per_document: DataFrame) -> DataFrame:
    """Sums, recall, typed recall and precision over all documents."""
    names = ("n_truth", "n_covered", "n_typed", "n_detected", "n_false")
    s = per_document.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return s.select(*names, rate(F.col("n_covered"), F.col("n_truth")).alias("recall"), rate(F.col("n_typed"), F.col("n_truth")).alias("typed_recall"), rate(F.col("n_detected") - F.col("n_false"), F.col("n_detected")).alias("precision"))


def entity_ids(truth: DataFrame) -> DataFrame:
    """a stable id from document, page, type, normal form and the number among equals."""
    v = comparable(F.col("value"))
    n = F.row_number().over(Window.partitionBy("document_id", "page_index", "entity_type", v).orderBy("value"))
    return truth.withColumn("entity_id", F.concat_ws("|", "document_id", "page_index", "entity_type", v, n))


def baseline_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Entities by id whose coverage differs: lost, gained, new or gone."""
    j = before.select("entity_id", F.col("covered").alias("was")).join(now.select("entity_id", F.col("covered").alias("is")), "entity_id", "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") & ~F.col("is"), "lost").when(~F.col("was") & F.col("is"), "gained")
    return j.withColumn("change", kind).filter("change IS NOT NULL").select("entity_id", "change")


def violations(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Q12: (rule, n) of the four properties that any result has: boxes are the hull of their pieces, numbers of a type run
    from 1 without gaps, enabled groups don't cover each other, and a value starts where its first word starts."""
    pieces = F.col("fragments")
    hull = members.filter(pieces.isNotNull()).filter(~g.same_box(g.union_box(F.transform(pieces, lambda b: g.box(b["x"], b["y"], b["width"], b["height"]))), F.col("bbox"))).agg(F.count("*").alias("n"))
    gaps = groups.groupBy("doc_id", "entity_type").agg(F.count("*").alias("c"), F.max("index_in_type").alias("m"), F.count_distinct("index_in_type").alias("d")).filter("c <> m OR c <> d").agg(F.count("*").alias("n"))
    live = members.join(groups.filter("enabled").select("group_id"), "group_id")
    a, b = live.alias("a"), live.alias("b")
    over = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.group_id") < F.col("b.group_id")) & (F.col("a.bbox.x") < F.col("b.bbox.x") + F.col("b.bbox.width")) & (F.col("b.bbox.x") < F.col("a.bbox.x") + F.col("a.bbox.width")) & (g.intersection_ratio(F.col("a.bbox"), F.col("b.bbox")) > OVERLAP)).agg(F.count("*").alias("n"))
    start = members.filter(F.col("word_span.start_index") < 0).agg(F.count("*").alias("n"))
    out = hull.select(F.lit("hull").alias("rule"), "n")
    for name, rows in (("numbering", gaps), ("overlap", over), ("word_start", start)):
        out = out.unionByName(rows.select(F.lit(name).alias("rule"), "n"))
    return out


def context_words(page: DataFrame, found: DataFrame, n: int = 6) -> DataFrame:
    """The n words before and after each found place."""
    p = page.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), F.split("text", " ").alias("w"))
    j = found.join(p, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")))
    start, end = F.col("start_index"), F.col("end_index_exclusive")
    return j.select(*found.columns, F.array_join(F.slice("w", F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n))), " ").alias("words_before"), F.array_join(F.slice("w", end + 1, F.lit(n)), " ").alias("words_after"))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper of two."""
    return F.sort_array(values)[F.floor(F.size(values) / 2).cast("int")]


def cache_bytes(word: DataFrame) -> DataFrame:
    """What a document's words take in the reference's cache."""
    turned = F.when(F.col("bbox.rotation").isNotNull(), 8).otherwise(0)
    return word.groupBy("doc_id").agg(F.sum(32 + 2 * F.length("text") + 2 * F.length("source") + 48 + turned).alias("bytes"))


def page_slots(sizes: DataFrame, gap: float = 16.0) -> DataFrame:
    """sizes(doc_id, page_index, height) with each page's top when pages stand under each other."""
    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("top", F.coalesce(F.sum(F.col("height") + gap).over(w), F.lit(0.0)))


def progress(events: DataFrame, total: int) -> DataFrame:
    """Done out of total, never more than the total."""
    return events.groupBy("doc_id").agg(F.least(F.count("*"), F.lit(total)).alias("current")).withColumn("total", F.lit(total)).withColumn("share", F.col("current") / F.col("total"))


def newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")
