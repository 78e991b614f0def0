"""Boxes: struct columns with x, y, width, height and a nullable rotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEGRADED_RATIO, FONT_HEIGHT_RATIO, GLYPH_RATIO


def box(x, y, width, height, rotation=None) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, width, height)]
    turn = rotation if isinstance(rotation, Column) else F.lit(rotation)
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(cols, ("x", "y", "width", "height"), strict=True)), turn.cast("int").alias("rotation"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def shares_band(a: Column, b: Column) -> Column:
    """The boxes overlap on the y axis."""
    return (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def overlaps(a: Column, b: Column) -> Column:
    """Strict overlap; a box without area overlaps nothing."""
    solid = (a["width"] > 0) & (a["height"] > 0) & (b["width"] > 0) & (b["height"] > 0)
    return solid & shares_band(a, b) & (a["x"] < right(b)) & (b["x"] < right(a))


def contains(outer: Column, inner: Column, slack: float = 0.01) -> Column:
    """P10."""
    return (inner["x"] >= outer["x"] - slack) & (inner["y"] >= outer["y"] - slack) & (right(inner) <= right(outer) + slack) & (bottom(inner) <= bottom(outer) + slack)


def pieces(bbox: Column, fragments: Column) -> Column:
    """The boxes of an occurrence: its fragments, or its one box."""
    return F.coalesce(fragments, F.array(bbox))


def all_contained(outer: Column, inner: Column) -> Column:
    """Each inner piece lies in some outer piece."""
    return F.forall(inner, lambda i: F.exists(outer, lambda o: contains(o, i)))


def same_box(a: Column, b: Column) -> Column:
    """Rotation doesn't count."""
    return reduce(lambda x, y: x & y, [a[n] == b[n] for n in ("x", "y", "width", "height")])


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def intersection_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]))
    return w * h


def intersection_ratio(a: Column, b: Column) -> Column:
    """shared area over the smaller area."""
    smaller = F.least(area(a), area(b))
    return F.when((smaller > 0) & (intersection_area(a, b) > 0), intersection_area(a, b) / F.nullif(smaller, F.lit(0.0))).otherwise(F.lit(0.0))


def max_fragment_ratio(a: Column, b: Column) -> Column:
    """F32: the largest ratio over pairs of pieces."""
    return F.aggregate(a, F.lit(0.0), lambda best, x: F.greatest(best, F.aggregate(b, F.lit(0.0), lambda most, y: F.greatest(most, intersection_ratio(x, y)))))


def union_box(boxes: Column) -> Column:
    """A7 over an array: the hull, with the rotation if all agree."""
    low = lambda n: F.array_min(F.transform(boxes, lambda b: b[n]))
    x, y = low("x"), low("y")
    turns = F.array_distinct(F.transform(boxes, lambda b: b["rotation"]))
    turn = F.when(F.size(turns) == 1, F.element_at(turns, 1))
    return box(x, y, F.array_max(F.transform(boxes, right)) - x, F.array_max(F.transform(boxes, bottom)) - y, turn)


def token_width(chars: Column, height: Column) -> Column:
    """what a token of so many characters takes in a box of this height."""
    return chars * (height * FONT_HEIGHT_RATIO) * GLYPH_RATIO


def fits_all(token: Column, boxes: Column) -> Column:
    return F.forall(boxes, lambda b: token_width(F.length(token), b["height"]) <= b["width"])


def font_fit(token: Column, b: Column, floor: float = 1.0) -> Column:
    """the font size that fits, by whole steps down to a floor, its ratio to the wanted one, and whether the
    result is illegible."""
    wanted = b["height"] * FONT_HEIGHT_RATIO
    need = F.length(token) * GLYPH_RATIO
    steps = F.greatest(F.lit(0.0), F.ceil(wanted - b["width"] / F.nullif(need, F.lit(0.0))))
    size = F.greatest(F.lit(floor), wanted - F.coalesce(steps, F.lit(0.0)))
    ratio = size / F.nullif(wanted, F.lit(0.0))
    return F.struct(size.alias("size"), ratio.alias("ratio"), (ratio < DEGRADED_RATIO).alias("degraded"))


def fit_label(token: Column, b: Column) -> Column:
    """F43."""
    width = token_width(F.length(token), b["height"])
    return F.when(b.isNull() | (b["width"] <= 0), F.lit("unknown")).when(width <= 0.9 * b["width"], F.lit("fits")).when(width <= b["width"], F.lit("tight")).otherwise(F.lit("overflows"))


def point_in(x: Column, y: Column, boxes: Column) -> Column:
    """P15."""
    return F.exists(boxes, lambda b: (x >= b["x"]) & (x <= right(b)) & (y >= b["y"]) & (y <= bottom(b)))


def compose(m: Column, n: Column) -> Column:
    """affine matrices as arrays a, b, c, d, e, f; n first, then m."""
    a, b, c, d, e, f = (m[k] for k in range(6))
    g, h, i, j, k, l = (n[q] for q in range(6))  # noqa: E741
    return F.array(a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def transformed(m: Column, b: Column) -> Column:
    """the box around a box's image under a matrix."""
    xs, ys = [], []
    for x in (b["x"], right(b)):
        for y in (b["y"], bottom(b)):
            xs.append(m[0] * x + m[2] * y + m[4])
            ys.append(m[1] * x + m[3] * y + m[5])
    x, y = F.least(*xs), F.least(*ys)
    return box(x, y, F.greatest(*xs) - x, F.greatest(*ys) - y)


def rotation_of(dx: Column, dy: Column) -> Column:
    """right angles only, by the direction of writing."""
    return F.when((dx > 0) & (dy == 0), F.lit(0)).when((dx == 0) & (dy > 0), F.lit(90)).when((dx < 0) & (dy == 0), F.lit(180)).when((dx == 0) & (dy < 0), F.lit(270))


def upright(b: Column, rotation: Column, width: Column, height: Column) -> Column:
    """a box of a turned sheet in the frame in which its writing is level."""
    made = {
        90: box(b["y"], width - right(b), b["height"], b["width"]),
        180: box(width - right(b), height - bottom(b), b["width"], b["height"]),
        270: box(height - bottom(b), b["x"], b["height"], b["width"]),
    }
    out = F.when(rotation == 90, made[90]).when(rotation == 180, made[180]).when(rotation == 270, made[270])
    return out.otherwise(box(b["x"], b["y"], b["width"], b["height"]))


def to_points(pixels: Column, dpi: Column) -> Column:
    """a box in pixels of a raster, in points."""
    k = F.lit(72.0) / dpi
    return box(pixels["x"] * k, pixels["y"] * k, pixels["width"] * k, pixels["height"] * k)


def effective_dpi(configured: Column, cap: Column) -> Column:
    """F41."""
    return F.when(cap.isNull(), configured).otherwise(F.least(configured, cap))


def raster_bytes(width: Column, height: Column, dpi: Column) -> Column:
    """four bytes a pixel."""
    return (F.ceil(width * dpi / 72.0) * F.ceil(height * dpi / 72.0) * 4).cast("long")


def cells(b: Column, region: Column, side: int = 64) -> Column:
    """The cells of a region's grid that a box touches, as row * side + column."""
    def span(lo: Column, size: Column, start: Column, length: Column) -> tuple[Column, Column]:
        first = F.floor((lo - start) / length * side)
        last = F.ceil((lo + size - start) / length * side) - 1
        return F.greatest(F.lit(0), first).cast("int"), F.least(F.lit(side - 1), last).cast("int")

    c0, c1 = span(b["x"], b["width"], region["x"], region["width"])
    r0, r1 = span(b["y"], b["height"], region["y"], region["height"])
    grid = F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.transform(F.sequence(c0, c1), lambda c: r * side + c)))
    return F.when((c0 <= c1) & (r0 <= r1), grid).otherwise(F.array().cast("array<int>"))
