"""Boxes as structs (x0, y0, x1, y1), page-normalised, origin at the top left. Pure column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def containment(a: Column, b: Column) -> Column:
    """The share of a that lies in b; 0 for a box without area."""
    return F.when(area(a) <= 0, 0.0).otherwise(F.try_divide(intersection(a, b), area(a)))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both + F.lit(1e-8))


def overlaps(a: Column, b: Column) -> Column:
    """Whether the boxes share an inner point; touching edges don't count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def weighted_area(b: Column, power: float = 1.0) -> Column:
    """Area times (width / height) ** power: wide boxes weigh more; 0 without height."""
    return F.when(height(b) == 0, 0.0).otherwise(area(b) * F.pow(F.try_divide(width(b), height(b)), F.lit(power)))


def from_ltwh(left: Column, top: Column, w: Column, h: Column) -> Column:
    return box(left, top, left + w, top + h)


def from_polygon(points: Column) -> Column:
    """The box of a four-point polygon (array of struct x, y): its first and third points."""
    return box(points[0]["x"], points[0]["y"], points[2]["x"], points[2]["y"])


def rotate_portrait(b: Column, landscape: Column) -> Column:
    """Boxes of a landscape page, turned to portrait."""
    return F.when(landscape, box(1 - b["y1"], b["x0"], 1 - b["y0"], b["x1"])).otherwise(b)


def clip(b: Column) -> Column:
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return box(inside(b["x0"]), inside(b["y0"]), inside(b["x1"]), inside(b["y1"]))


def to_pixels(b: Column, w: Column, h: Column) -> Column:
    """Whole pixels, cut off towards zero."""
    return F.struct(*((b[n] * side).cast("int").alias(n) for n, side in (("x0", w), ("y0", h), ("x1", w), ("y1", h))))


def from_pixels(b: Column, w: Column, h: Column) -> Column:
    """Shares of the page's sides."""
    return box(b["x0"] / w, b["y0"] / h, b["x1"] / w, b["y1"] / h)


def union(boxes: Column) -> Column:
    """The smallest box around all; the whole page for none."""
    at = lambda n, f: f(F.transform(boxes, lambda b: b[n]))
    found = box(at("x0", F.array_min), at("y0", F.array_min), at("x1", F.array_max), at("y1", F.array_max))
    return F.when(F.size(boxes) > 0, found).otherwise(box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))


def spatial_weight(a: Column, b: Column) -> Column:
    """1 / (1 + distance of the centres)."""
    dx = (a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2
    dy = (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
    return 1 / (1 + F.sqrt(dx * dx + dy * dy))
