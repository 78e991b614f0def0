"""Reading order, image regions and readings of images. A page is the unit: its words are few and depend on each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..sources import views

# Shares of a line's height and of a page, and sizes in points.
LINE_BAND = 0.5
COLUMN_GAP = 3.0
RUN_GAP = 2.0
SAME_LINE = 1.0
GRID = 64
IMAGE_SHARE = 0.01
DILATE_X, DILATE_Y = 0.5, 0.8
SPLIT_GAP = 0.102
RELIABLE = 0.6
INK = 0.002
#: Bytes of text whose words are ordered at once.
TEXT_BYTES = 4 << 20


def middle(values) -> float:
    """The upper of two middle values."""
    ordered = sorted(values)
    return ordered[len(ordered) // 2] if ordered else 0.0


class W:
    """A word's box while a page is ordered."""

    __slots__ = ("at", "x", "y", "w", "h", "turn")

    def __init__(self, at: int, x: float, y: float, w: float, h: float, turn: int = 0):
        self.at, self.x, self.y, self.w, self.h, self.turn = at, x, y, w, h, turn

    @property
    def centre(self) -> float:
        return self.y + self.h / 2


def visual_lines(words: list[W]) -> list[list[W]]:
    """Words by their centres; one joins the last line if its centre is within half that line's median height."""
    lines: list[list[W]] = []
    for word in sorted(words, key=lambda v: (v.centre, v.x)):
        if lines and abs(word.centre - middle(v.centre for v in lines[-1])) < LINE_BAND * middle(v.h for v in lines[-1]):
            lines[-1].append(word)
        else:
            lines.append([word])
    return lines


def column_pieces(line: list[W]) -> list[list[W]]:
    """A line cut where the next word starts further than three heights after all words before it."""
    height, pieces, edge = middle(v.h for v in line), [], float("-inf")
    for word in sorted(line, key=lambda v: v.x):
        if pieces and word.x - edge <= COLUMN_GAP * height:
            pieces[-1].append(word)
        else:
            pieces.append([word])
        edge = max(edge, word.x + word.w)
    return pieces


def joined_pieces(pieces: list[list[W]]) -> list[list[W]]:
    """A piece joins the first earlier one that it is close to, across and along."""
    out: list[list[W]] = []
    measure = lambda p: (middle(v.centre for v in p), middle(v.h for v in p), min(v.x for v in p), max(v.x + v.w for v in p))
    for piece in pieces:
        c, h, lo, hi = measure(piece)
        for other in out:
            oc, oh, olo, ohi = measure(other)
            near = min(h, oh)
            if max(lo - ohi, olo - hi, 0.0) < COLUMN_GAP * near and abs(c - oc) < LINE_BAND * near:
                other.extend(piece)
                break
        else:
            out.append(list(piece))
    return out


def turned_runs(words: list[W]) -> list[list[W]]:
    """Per rotation columns across the writing, cut where the writing pauses for over two ems."""
    runs: list[list[W]] = []
    for turn in dict.fromkeys(v.turn for v in words if v.turn):
        across = (lambda v: v.y) if turn == 180 else (lambda v: v.x)
        em = (lambda v: v.h) if turn == 180 else (lambda v: v.w)
        start = {90: lambda v: v.y + v.h, 270: lambda v: v.y}.get(turn, lambda v: v.x + v.w)
        stop = {90: lambda v: v.y, 270: lambda v: v.y + v.h}.get(turn, lambda v: v.x)
        along = {90: lambda v: -v.y, 270: lambda v: v.y}.get(turn, lambda v: -v.x)
        columns: list[list[W]] = []
        for word in sorted((v for v in words if v.turn == turn), key=across):
            if columns and abs(across(word) - across(columns[-1][-1])) <= SAME_LINE:
                columns[-1].append(word)
            else:
                columns.append([word])
        for column in columns:
            column.sort(key=along)
            run = [column[0]]
            for word in column[1:]:
                if abs(start(word) - stop(run[-1])) > RUN_GAP * em(run[-1]):
                    runs.append(run)
                    run = []
                run.append(word)
            runs.append(run)
    return runs


def _level(words: list[W]) -> list[W]:
    lines = joined_pieces([p for line in visual_lines(words) for p in column_pieces(line)])
    return [v for line in lines for v in sorted(line, key=lambda x: x.x)]


def _reframed(v: W, turn: int) -> W:
    if turn == 90:
        return W(v.at, -(v.y + v.h), v.x, v.h, v.w)
    if turn == 180:
        return W(v.at, -(v.x + v.w), -(v.y + v.h), v.w, v.h)
    return W(v.at, v.y, -(v.x + v.w), v.h, v.w)


def order_of(words: list[W], scanned: bool) -> list[int]:
    """Level lines first, then turned runs by their first words; a scanned sheet that is turned as a whole is
    ordered in the frame in which it is level."""
    turns = {v.turn for v in words}
    if scanned and len(turns) == 1 and 0 not in turns:
        return [v.at for v in _level([_reframed(v, v.turn) for v in words])]
    level = _level([v for v in words if not v.turn])
    runs = sorted(turned_runs(words), key=lambda r: (r[0].y, r[0].x))
    return [v.at for v in level] + [v.at for r in runs for v in r]


def page_orders(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, turn: np.ndarray, scanned: np.ndarray) -> np.ndarray:
    """W10 to W14 for the words of many pages, page after page: for each place in a page's reading order, which of its words
    stands there. Pages of one level line without a gap are ordered all at once, the others one by one by order_of."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    if not len(page):
        return page
    start = np.cumsum(sizes) - sizes
    new = np.r_[True, page[1:] != page[:-1]]
    order = np.arange(len(page)) if (new[1:] | (x[1:] >= x[:-1])).all() else np.lexsort((x, page))
    level = (turn == 0) & (h > 0) & (y == y[start[page]]) & (h == h[start[page]])
    level &= np.r_[True, x[order][1:] - (x + w)[order][:-1] <= COLUMN_GAP * h[order][1:]] | new
    out = order - start[page]
    for k in np.unique(page[~level]):
        at = slice(start[k], start[k] + sizes[k])
        words = [W(i, *box) for i, box in enumerate(zip(x[at].tolist(), y[at].tolist(), w[at].tolist(), h[at].tolist(), turn[at].tolist(), strict=True))]
        out[at] = order_of(words, bool(scanned[k]))
    return out


def _with_orders(batch: pa.RecordBatch, kept: list[str], sizes: np.ndarray, boxes: list[np.ndarray], scanned: np.ndarray) -> pa.RecordBatch:
    order = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(page_orders(sizes, *boxes, scanned), pa.int32()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), order], names=[*kept, "reading"])


def reading_order(word: DataFrame) -> DataFrame:
    """Word rows with reading_index, one shuffle by page."""
    columns = word.columns
    turned = "rotation" in word.schema["bbox"].dataType.fieldNames()
    each = F.sort_array(F.collect_list(F.struct("word_index", F.struct(*columns).alias("word"))))
    packed = word.groupBy("doc_id", "page_index").agg(each.alias("words")).select(F.transform("words", lambda v: v["word"]).alias("words"))
    side = lambda name: F.transform("words", lambda v: v["bbox"][name].cast("double")).alias(name)
    turn = F.transform("words", lambda v: F.coalesce(v["bbox"]["rotation"].cast("int"), F.lit(0)) if turned else F.lit(0)).alias("turn")
    asked = packed.select("words", *(side(n) for n in ("x", "y", "width", "height")), turn, F.forall("words", lambda v: v["source"].eqNullSafe("ocr")).alias("scanned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            boxes = [batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("x", "y", "width", "height", "turn")]
            yield _with_orders(batch, ["words"], sizes, boxes, batch.column("scanned").to_numpy(zero_copy_only=False))

    ordered = asked.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("reading", T.ArrayType(T.IntegerType()))]))
    rows = ordered.select(F.posexplode(F.transform("reading", lambda k: F.col("words")[k])).alias("reading_index", "word"))
    return rows.select(*(F.col("word")[c].alias(c) for c in columns), "reading_index")


def text_reading_order(page: DataFrame) -> DataFrame:
    """W10 to W14 for pages (doc_id, page_index, text) whose words stand where views.words puts them: (doc_id, page_index,
    reading), the numbers of a page's words as they are read. Boxes are made from the text at hand, so no word is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # long pages are few at once
            ends = np.cumsum(pc.binary_length(whole.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False)) // TEXT_BYTES
            cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True]) if whole.num_rows else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(a, b - a)
                sizes, x, width = views.text_boxes(batch.column("text"))
                turn = np.zeros(len(x), np.int64)
                boxes = [x, np.full(len(x), views.WORD_Y), width, np.full(len(x), views.WORD_HEIGHT), turn]
                yield _with_orders(batch, ["doc_id", "page_index"], sizes, boxes, np.zeros(len(sizes), bool))

    kind = page.schema["doc_id"].dataType.simpleString()
    return page.select("doc_id", "page_index", "text").filter("text IS NOT NULL").mapInArrow(run, f"doc_id {kind}, page_index int, reading array<int>")


def large_images(images: DataFrame) -> DataFrame:
    """Images that take a hundredth of their page."""
    return images.filter((F.col("page_width") * F.col("page_height") > 0) & (g.area(F.col("bbox")) / (F.col("page_width") * F.col("page_height")) >= IMAGE_SHARE))


def occupied_cells(word: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page_index, cell): the cells of a page's grid that its words, widened, touch."""
    b = F.col("bbox")
    wide = g.box(b["x"] - b["height"] * DILATE_X, b["y"] - b["height"] * DILATE_Y, b["width"] + 2 * DILATE_X * b["height"], b["height"] + 2 * DILATE_Y * b["height"])
    # a box beyond the page counts in the cells at its edge
    first = lambda lo, size: F.least(F.greatest(F.floor(lo / size * GRID), F.lit(0)), F.lit(GRID - 1)).cast("int")
    last = lambda hi, size: F.least(F.greatest(F.ceil(hi / size * GRID) - 1, F.lit(0)), F.lit(GRID - 1)).cast("int")
    w = word.withColumn("wide", wide)
    x, y = F.col("wide.x"), F.col("wide.y")
    c0, c1 = first(x, F.lit(width)), last(x + F.col("wide.width"), F.lit(width))
    r0, r1 = first(y, F.lit(height)), last(y + F.col("wide.height"), F.lit(height))
    cells = F.flatten(F.transform(F.sequence(r0, F.greatest(r0, r1)), lambda r: F.transform(F.sequence(c0, F.greatest(c0, c1)), lambda c: r * GRID + c)))
    return w.select("doc_id", "page_index", F.explode(cells).alias("cell")).distinct()


def largest_empty(taken: set[int], rows: tuple[int, int], cols: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """(row, column, rows, columns) of the largest rectangle of free cells; the first of equals from above."""
    heights = [0] * (cols[1] - cols[0] + 1)
    best, most = None, 0
    for r in range(rows[0], rows[1] + 1):
        for k in range(len(heights)):
            heights[k] = 0 if r * GRID + cols[0] + k in taken else heights[k] + 1
        stack: list[int] = []
        for k in range(len(heights) + 1):
            now = heights[k] if k < len(heights) else 0
            while stack and now < heights[stack[-1]]:
                top = heights[stack.pop()]
                left = stack[-1] + 1 if stack else 0
                if top * (k - left) > most:
                    most, best = top * (k - left), (r - top + 1, cols[0] + left, top, k - left)
            stack.append(k)
    return best


def ocr_regions(images: DataFrame, word: DataFrame, width: float, height: float) -> DataFrame:
    """Per page the largest region of an image without words. images(doc_id, page_index, bbox)."""
    taken = occupied_cells(word, width, height).groupBy("doc_id", "page_index").agg(F.collect_list("cell").alias("cells"))
    j = images.join(taken, ["doc_id", "page_index"], "left")

    def run(parts):
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                b = r.bbox
                clamp = lambda v: min(max(int(v), 0), GRID - 1)
                cols = clamp(b["x"] / width * GRID // 1), clamp(-(-(b["x"] + b["width"]) / width * GRID // 1) - 1)
                span = clamp(b["y"] / height * GRID // 1), clamp(-(-(b["y"] + b["height"]) / height * GRID // 1) - 1)
                found = largest_empty(set(r.cells) if r.cells is not None else set(), span, cols)
                if found:
                    y, x, h, w = found
                    x0, y0 = max(x * width / GRID, b["x"]), max(y * height / GRID, b["y"])
                    x1, y1 = min((x + w) * width / GRID, b["x"] + b["width"]), min((y + h) * height / GRID, b["y"] + b["height"])
                    out.append((r.doc_id, r.page_index, x0, y0, max(0.0, x1 - x0), max(0.0, y1 - y0)))
            yield pd.DataFrame(out, columns=["doc_id", "page_index", "x", "y", "width", "height"])

    free = j.select("doc_id", "page_index", "bbox", "cells").mapInPandas(run, "doc_id long, page_index int, x double, y double, width double, height double")
    w = Window.partitionBy("doc_id", "page_index").orderBy(F.desc(F.col("width") * F.col("height")), "y", "x")
    return free.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def split_words(items: DataFrame) -> DataFrame:
    """Neighbouring pieces of text on a line are one word where the gap is under a tenth of their height."""
    w = Window.partitionBy("doc_id", "page_index", "line").orderBy("x")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    run = items.withColumn("__new", F.when(gap < SPLIT_GAP * F.col("height"), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return run.groupBy("doc_id", "page_index", "line", "__run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda v: v["text"]), "").alias("text"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width")).drop("__run")


def dpi_caps(images: DataFrame) -> DataFrame:
    """A page that is one raster needs no more than the raster's own resolution."""
    one = images.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.max(F.greatest(F.col("pixels_x") / F.col("axis_x"), F.col("pixels_y") / F.col("axis_y"))).alias("r"), F.bool_or("other_paint").alias("p"))
    return one.filter("n = 1 AND NOT p").select("doc_id", "page_index", F.ceil(72 * F.col("r")).cast("int").alias("ocr_dpi_cap"))


def best_readings(readings: DataFrame) -> DataFrame:
    """readings(doc_id, page_index, attempt, words array<struct<confidence>>): the one with most reliable words,
    then the most confident, then the first."""
    reliable = F.size(F.filter("words", lambda w: w["confidence"] >= RELIABLE))
    mean = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"], lambda s: F.when(F.size("words") > 0, s / F.size("words")).otherwise(F.lit(0.0)))
    rank = F.struct(reliable.alias("r"), F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("c"), (-F.col("attempt")).alias("a"))
    return readings.groupBy("doc_id", "page_index").agg(F.max_by("attempt", rank).alias("attempt"), F.max(rank)["r"].alias("n_reliable"))


def fused(native: DataFrame, read: DataFrame, replaced: DataFrame) -> DataFrame:
    """Native words, less those of replaced(doc_id, page_index) pages, and the words read from images."""
    return native.join(replaced, ["doc_id", "page_index"], "left_anti").unionByName(read)


def without_margin_repeats(margin: DataFrame, level: DataFrame) -> DataFrame:
    """Turned margin words that meet no level word."""
    m, l = margin.alias("m"), level.alias("l")  # noqa: E741
    return m.join(l, (F.col("m.doc_id") == F.col("l.doc_id")) & (F.col("m.page_index") == F.col("l.page_index")) & g.overlaps(F.col("m.bbox"), F.col("l.bbox")), "left_anti")


def source_kinds(page: DataFrame) -> DataFrame:
    """pages(doc_id, textless)."""
    n = F.count_if("textless")
    return page.groupBy("doc_id").agg(F.when(n == 0, "text").when(n == F.count("*"), "scanned").otherwise("mixed").alias("source_kind"))


def has_ink(ratio: Column) -> Column:
    """P19."""
    return ratio >= INK


def words_in(word: DataFrame, rects: DataFrame) -> DataFrame:
    """Words that a rectangle of their page meets."""
    w, r = word.alias("w"), rects.alias("r")
    return w.join(r, (F.col("w.doc_id") == F.col("r.doc_id")) & (F.col("w.page_index") == F.col("r.page_index")) & g.overlaps(F.col("w.bbox"), F.col("r.bbox")), "left_semi")


def selection_line(selected: DataFrame) -> DataFrame:
    """Selected words cut into runs that share a band and advance; the run with the largest area, the first of
    equals. (doc_id, page_index, first, last)"""
    w = Window.partitionBy("doc_id", "page_index").orderBy("word_index")
    b, p = F.col("bbox"), F.lag("bbox").over(w)
    same = g.shares_band(p, b) & (b["x"] >= p["x"]) & F.coalesce(p["rotation"], F.lit(0)).eqNullSafe(F.coalesce(b["rotation"], F.lit(0)))
    runs = selected.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    sums = runs.groupBy("doc_id", "page_index", "__run").agg(F.min("word_index").alias("first"), F.max("word_index").alias("last"), F.sum(g.area(b)).alias("area"))
    return sums.groupBy("doc_id", "page_index").agg(F.max_by(F.struct("first", "last"), F.struct("area", (-F.col("__run")).alias("r"))).alias("v")).select("doc_id", "page_index", "v.*")


def line_words(word: DataFrame, overflowing: DataFrame) -> DataFrame:
    """Words on the line of an overflowing piece that start at or after its right edge."""
    w, o = word.alias("w"), overflowing.alias("o")
    return w.join(o, (F.col("w.doc_id") == F.col("o.doc_id")) & (F.col("w.page_index") == F.col("o.page_index")) & g.shares_band(F.col("w.bbox"), F.col("o.bbox")) & (F.col("w.bbox.x") >= F.col("o.bbox.x") + F.col("o.bbox.width")), "left_semi")
