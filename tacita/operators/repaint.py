"""What moves on a line when a replacement is wider than what it replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g

# Gaps between neighbours in heights, and the share of the room that a run must fill.
MAX_GAP, MIN_GAP, DENSITY = 4.0, -0.5, 0.3

KEY = ["doc_id", "page_index", "replacement_id"]


def next_boundaries(replacements: DataFrame) -> DataFrame:
    """For each replacement the left edge of the nearest other one to its right in its band, null if none."""
    a, b = replacements.alias("a"), replacements.alias("b")
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.replacement_id") != F.col("b.replacement_id")) & g.shares_band(F.col("a.bbox"), F.col("b.bbox")) & (F.col("b.bbox.x") >= g.right(F.col("a.bbox"))), "left")
    return met.groupBy("a.doc_id", "a.page_index", "a.replacement_id").agg(F.min("b.bbox.x").alias("boundary"))


def plans(replacements: DataFrame, word: DataFrame, page_width: float) -> DataFrame:
    """(doc_id, page_index, replacement_id, shift, first, last): how far which words move to make room for the token of
    width token_width. No row where nothing stands to the right, a gap is too wide or too narrow, the line is too sparse, the
    page or another replacement leaves no room, or another replacement lies in the way."""
    r = replacements.join(next_boundaries(replacements), KEY).alias("r")
    w = word.alias("w")
    box = F.col("r.bbox")
    limit = F.coalesce("r.boundary", F.lit(float("inf")))
    met = r.join(w, (F.col("r.doc_id") == F.col("w.doc_id")) & (F.col("r.page_index") == F.col("w.page_index")) & g.shares_band(F.col("w.bbox"), box) & (F.col("w.bbox.x") >= g.right(box)) & (F.col("w.bbox.x") < limit)).select(*(F.col(f"r.{k}") for k in KEY), "w.word_index", F.col("w.bbox").alias("wb"), F.col("r.bbox").alias("rb"), "r.token_width", "r.boundary")
    others = replacements.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), F.col("replacement_id").alias("o"), F.col("bbox").alias("ob"))
    met = met.join(others, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & (F.col("replacement_id") != F.col("o")) & g.overlaps(F.col("wb"), F.col("ob")), "left_anti")
    order = Window.partitionBy(*KEY).orderBy("wb.x")
    previous = F.coalesce(F.lag("wb").over(order), F.col("rb"))
    met = met.withColumn("prev", previous)
    gap = F.col("wb.x") - g.right(F.col("prev"))
    height = F.greatest("prev.height", "wb.height")
    met = met.withColumn("bad", (gap > MAX_GAP * height) | (gap < MIN_GAP * height))
    end = g.right(F.col("wb"))
    runs = met.groupBy(*KEY).agg(F.bool_or("bad").alias("bad"), F.min("word_index").alias("first"), F.max("word_index").alias("last"), F.max_by(end, "wb.x").alias("run_end"), F.least(F.min("wb.y"), F.first("rb.y")).alias("top"), F.greatest(F.max(g.bottom(F.col("wb"))), F.first(g.bottom(F.col("rb")))).alias("low"), F.first("rb").alias("rb"), F.first("token_width").alias("token_width"), F.first("boundary").alias("boundary"))
    room = F.least(F.lit(page_width), F.coalesce("boundary", F.lit(float("inf"))))
    runs = runs.withColumn("room", room).withColumn("shift", F.ceil(F.col("token_width") - F.col("rb.width")).cast("double"))
    fits = ~F.col("bad") & (F.col("room") > F.col("rb.x")) & ((F.col("run_end") - F.col("rb.x")) / (F.col("room") - F.col("rb.x")) >= DENSITY) & (F.col("run_end") + F.col("shift") <= F.col("room"))
    zone = g.box(F.col("rb.x"), F.col("top"), F.col("run_end") + F.col("shift") - F.col("rb.x"), F.col("low") - F.col("top"))
    kept = runs.filter(fits).withColumn("zone", zone)
    kept = kept.join(others, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & (F.col("replacement_id") != F.col("o")) & g.overlaps(F.col("zone"), F.col("ob")), "left_anti")
    return kept.select(*KEY, "shift", "first", "last")


def projected(word: DataFrame, plan: DataFrame, replacements: DataFrame) -> DataFrame:
    """Words with shown_x, after what moves them, and the replacement that covers them, if any."""
    p = plan.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), "first", "last", "shift")
    moved = word.join(p, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & F.col("word_index").between(F.col("first"), F.col("last")), "left")
    moved = moved.groupBy("doc_id", "page_index", "word_index", "bbox").agg(F.coalesce(F.sum("shift"), F.lit(0.0)).alias("shift"))
    c = replacements.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), F.col("replacement_id").alias("covered_by"), F.col("bbox").alias("cb"))
    out = moved.join(c, (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & g.overlaps(F.col("bbox"), F.col("cb")), "left")
    return out.groupBy("doc_id", "page_index", "word_index", "bbox", "shift").agg(F.min("covered_by").alias("covered_by")).withColumn("shown_x", F.col("bbox.x") + F.col("shift"))
