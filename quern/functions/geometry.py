"""Boxes (left, top, right, bottom; the last two exclusive) as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.left, b.left)) * F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    size = lambda x: F.greatest(F.lit(1), (x.right - x.left) * (x.bottom - x.top))
    return both / F.greatest(size(a) + size(b) - both, F.lit(1))


def intersects(a: Column, b: Column, padding: int = 0) -> Column:
    """Whether boxes come nearer than ``padding``."""
    return ~((a.right + padding <= b.left) | (b.right + padding <= a.left) | (a.bottom + padding <= b.top) | (b.bottom + padding <= a.top))


def yolo(b: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h): centre and size by the image's."""
    return F.struct(((b.left + b.right) / 2 / width).alias("x"), ((b.top + b.bottom) / 2 / height).alias("y"), ((b.right - b.left) / width).alias("w"), ((b.bottom - b.top) / height).alias("h"))


def yolo_line(class_id: Column, b: Column, width: Column, height: Column) -> Column:
    y = yolo(b, width, height)
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, y.x, y.y, y.w, y.h)


def conflicts(boxes: DataFrame, by: str, key: str, padding: int = 0, most_iou: float = 0.0) -> DataFrame:
    """Pairs of boxes of one image (``by``) that are too near; box columns left, top, right, bottom.  An equi-join on the image, so the work is that of boxes on one image."""
    b = F.struct("left", "top", "right", "bottom")
    left, right = boxes.select(by, F.col(key).alias("a"), b.alias("x")), boxes.select(by, F.col(key).alias("b"), b.alias("y"))
    return left.join(right, by).where((F.col("a") < F.col("b")) & (intersects(F.col("x"), F.col("y"), padding) | (iou(F.col("x"), F.col("y")) > most_iou))).select(by, "a", "b", F.round(iou(F.col("x"), F.col("y")), 6).alias("iou"))
