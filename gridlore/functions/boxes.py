"""Axis-aligned boxes as x0, y0, x1, y1 column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlore.functions.numeric import ratio


def overlap(a: str, b: str) -> Column:
    """Intersection area of the boxes whose columns carry these prefixes."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: str = "") -> Column:
    return (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}y1") - F.col(f"{a}y0"))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 without overlap or with an empty union."""
    inter = overlap(a, b)
    return ratio(inter, area(a) + area(b) - inter)


def meets(a: str, b: str) -> Column:
    """Positive overlap, as range predicates."""
    return (F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{b}x0") < F.col(f"{a}x1")) & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{b}y0") < F.col(f"{a}y1"))


def cells(a: str, size: int) -> Column:
    """All grid cells a box touches, for equi-joins in place of range joins."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return F.flatten(F.transform(span(f"{a}x0", f"{a}x1"), lambda i: F.transform(span(f"{a}y0", f"{a}y1"), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def turned(box: list[Column], quarters: int, size: int) -> list[Column]:
    """A box of a square tile turned left by quarter turns; 4 - quarters is the inverse."""
    x0, y0, x1, y1 = box
    for _ in range(quarters % 4):
        x0, y0, x1, y1 = y0, size - x1, y1, size - x0
    return [x0, y0, x1, y1]
