"""Geometry on boxes, polygons and run lengths as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of boxes (x, y, w, h); 0 if either has no area."""
    wide = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    high = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    both = (wide * high).cast("double")
    union = aw * ah + bw * bh - both
    return F.when((aw > 0) & (ah > 0) & (bw > 0) & (bh > 0), both / union).otherwise(0.0)


def struct_iou(a: Column, b: Column) -> Column:
    """box_iou of two structs with x, y, w, h."""
    return box_iou(a["x"], a["y"], a["w"], a["h"], b["x"], b["y"], b["w"], b["h"])


def boxes_overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def points_of(flat: Column) -> Column:
    """[x0, y0, x1, y1, ..] -> array of struct(x, y)."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def polygon_area(flat: Column) -> Column:
    """Shoelace area of a flat polygon; 0 below three points."""
    n = F.floor(F.size(flat) / 2).cast("int")
    turn = lambda i: F.get(flat, 2 * i) * F.get(flat, 2 * ((i + 1) % n) + 1) - F.get(flat, 2 * ((i + 1) % n)) * F.get(flat, 2 * i + 1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + turn(i))
    return F.when(n >= 3, F.abs(total) / 2.0).otherwise(0.0)


def polygon_box(flat: Column) -> Column:
    """struct(x, y, w, h) around a flat polygon, null if it has no points."""
    p = points_of(flat)
    xs, ys = F.transform(p, lambda q: q.x), F.transform(p, lambda q: q.y)
    x, y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(p) > 0, F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h")))


def box_polygon(x, y, w, h) -> Column:
    return F.array(x, y, x + w, y, x + w, y + h, x, y + h)


def inside_box(px, py, x, y, w, h, tolerance: float = 0.0) -> Column:
    return px.between(x - tolerance, x + w + tolerance) & py.between(y - tolerance, y + h + tolerance)


def point_in_polygon(px: Column, py: Column, flat: Column) -> Column:
    """Even-odd rule."""
    n = F.floor(F.size(flat) / 2).cast("int")

    def crosses(i):
        x1, y1, x2, y2 = F.get(flat, 2 * i), F.get(flat, 2 * i + 1), F.get(flat, 2 * ((i + 1) % n)), F.get(flat, 2 * ((i + 1) % n) + 1)
        return ((y1 > py) != (y2 > py)) & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1)

    times = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.coalesce(crosses(i), F.lit(False)).cast("int"))
    return F.when(n >= 3, times % 2 == 1).otherwise(False)


def expand_box(x, y, w, h, margin: float, width, height) -> Column:
    """The box grown by a share of its size on each side and clamped to the image."""
    x0, y0 = F.greatest(x - w * margin, F.lit(0.0)), F.greatest(y - h * margin, F.lit(0.0))
    x1, y1 = F.least(x + w + w * margin, width), F.least(y + h + h * margin, height)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def rle_area(counts: Column) -> Column:
    """Pixels set in an uncompressed run-length mask: every second run."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(counts) - 1, F.lit(1)), F.lit(2)), F.lit(0).cast("long"), lambda acc, i: acc + F.coalesce(F.get(counts, i), F.lit(0)).cast("long"))


def yolo_line(class_index: Column, flat: Column, width: Column, height: Column) -> Column:
    """One line of label text: class and points as shares of the size, clipped to [0, 1]."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    parts = F.transform(flat, lambda v, i: F.format_string("%.6f", clip(v / F.when(i % 2 == 0, width).otherwise(height))))
    return F.concat_ws(" ", class_index.cast("string"), F.array_join(parts, " "))


def quantise(value: Column, step: float) -> Column:
    return F.bround(value / step, 0) * step


def largest_eigenvalue(a: Column, b: Column, c: Column) -> Column:
    """Of the symmetric matrix [[a, b], [b, c]]."""
    half = (a + c) / 2.0
    return half + F.sqrt((a - c) * (a - c) / 4.0 + b * b)


def back_project(u, v, depth, fx, fy, cx, cy) -> Column:
    """A pixel and its depth as a point in the camera's frame."""
    return F.struct(((u - cx) * depth / fx).alias("x"), ((v - cy) * depth / fy).alias("y"), depth.alias("z"))
