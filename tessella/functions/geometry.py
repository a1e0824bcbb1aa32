"""Boxes as columns. A box is (xc, yc, w, h), centre and size; corners are x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(xc: Column, yc: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """PJ06: x1, y1, x2, y2."""
    return xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2


def area(w: Column, h: Column) -> Column:
    """PJ12."""
    return F.abs(w * h)


def to_absolute(box: tuple, width: Column, height: Column) -> tuple:
    """PJ07: normalised coordinates in pixels."""
    return box[0] * width, box[1] * height, box[2] * width, box[3] * height


def to_normalised(box: tuple, width: Column, height: Column) -> tuple:
    """PJ07: pixels as shares of the image."""
    return box[0] / width, box[1] / height, box[2] / width, box[3] / height


def whole_corners(box: tuple) -> tuple:
    """PJ08: corners cut toward zero."""
    return tuple(c.cast("int") for c in corners(*box))


def clipped(xyxy: tuple, width: Column, height: Column) -> tuple:
    """PJ09: corners moved into the image."""
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0)), most)
    return inside(xyxy[0], width), inside(xyxy[1], height), inside(xyxy[2], width), inside(xyxy[3], height)


def is_normalised(box: tuple) -> Column:
    """PJ11: the centre and size, and the corners at seven decimals, lie in [0, 1]."""
    every = F.lit(True)
    for c in (*box, *(F.round(x, 7) for x in corners(*box))):
        every = every & c.between(0, 1)
    return every


def iou(a: tuple, b: tuple, form: str = "safe") -> Column:
    """PJ17: overlap of two boxes given by corners.

    safe: 0 for an empty union; plus: 1e-12 is added to the union; floor: the
    union is 1e-9 at least; pixel: sides count a pixel more, as of whole pixels.
    Null if a box is null.
    """
    one = F.lit(1.0 if form == "pixel" else 0.0)
    side = lambda lo, hi: F.greatest(hi - lo + one, F.lit(0.0))
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    of = lambda x: (x[2] - x[0] + one) * (x[3] - x[1] + one)
    union = of(a) + of(b) - inter
    both = lambda c: F.when(F.isnotnull(union), c)  # noqa: E731  greatest and least pass over nulls
    if form == "plus":
        return both(inter / (union + F.lit(1e-12)))
    if form == "floor":
        return both(inter / F.greatest(union, F.lit(1e-9)))
    return both(F.coalesce(F.try_divide(inter, union), F.lit(0.0)))


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """PJ10: (xc, yc, w, h) around x1 y1 x2 y2 ..., each vertex cut to a whole pixel first.

    A plain box line read as a polygon gives a wrong box: its size counts as a vertex.
    """
    whole = F.slice(points, F.lit(1), F.size(points) - F.size(points) % 2)
    # each list is walked once: an access by index in a lambda would make the list anew for every element
    xs = F.transform(F.filter(whole, lambda _, i: i % 2 == 0), lambda v: (v * width).cast("int"))
    ys = F.transform(F.filter(whole, lambda _, i: i % 2 == 1), lambda v: (v * height).cast("int"))
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(
        ((lo_x + hi_x) / 2 / width).alias("xc"), ((lo_y + hi_y) / 2 / height).alias("yc"),
        ((hi_x - lo_x) / width).alias("w"), ((hi_y - lo_y) / height).alias("h"),
    )


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """PJ13: gain, left and top padding of an image that is fitted into a canvas. Halves round to even."""
    gain = F.least(F.lit(float(to_height)) / height, F.lit(float(to_width)) / width)
    pad = lambda size, to: F.bround((F.lit(float(to)) - F.bround(size * gain)) / 2 - F.lit(0.1))
    return F.struct(gain.alias("gain"), pad(width, to_width).alias("left"), pad(height, to_height).alias("top"))


def unletterbox(xyxy: tuple, fit: Column, width: Column, height: Column) -> tuple:
    """PJ14: corners on the canvas as corners in the image."""
    return clipped(((xyxy[0] - fit.left) / fit.gain, (xyxy[1] - fit.top) / fit.gain, (xyxy[2] - fit.left) / fit.gain, (xyxy[3] - fit.top) / fit.gain), width, height)


def crop_window(xyxy: tuple, width: Column, height: Column) -> tuple:
    """PJ16: whole pixels inside the image, one pixel wide and high at least."""
    x1, y1, x2, y2 = (c.cast("int") for c in clipped(xyxy, width, height))
    x1, y1 = F.least(x1, width.cast("int") - 1), F.least(y1, height.cast("int") - 1)
    return x1, y1, F.greatest(x2, x1 + 1), F.greatest(y2, y1 + 1)


def label_line(cls: Column, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """PJ15: a label file's line."""
    return F.concat_ws(" ", *(c.cast("string") for c in (cls, xc, yc, w, h)))


def f_score(tp: Column, fp: Column, fn: Column, eps: float = 1e-6) -> Column:
    """PJ18: the soft form, 1 for nothing at all."""
    return (2 * tp + eps) / (2 * tp + fp + fn + eps)


def f_score_of(precision: Column, recall: Column) -> Column:
    """PJ18: the plain form, null where both are zero."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
