"""Polygon rings as arrays of struct<x, y>, and their expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a box."""
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def rolled(r: Column) -> Column:
    """The ring begun one vertex later."""
    return F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def area(r: Column) -> Column:
    """Shoelace area; 0 under three points."""
    cross = F.zip_with(r, rolled(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(r) < 3, 0.0).otherwise(F.abs(total(cross)) / 2)


def perimeter(r: Column) -> Column:
    sides = F.zip_with(r, rolled(r), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(F.size(r) < 3, 0.0).otherwise(total(sides))


def bounds(r: Column) -> list[Column]:
    side = lambda f, c, n: f(F.transform(r, lambda p: p[c])).alias(n)
    return [side(F.array_min, "x", "x0"), side(F.array_min, "y", "y0"), side(F.array_max, "x", "x1"), side(F.array_max, "y", "y1")]


def affine(r: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    return F.transform(r, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def rot90(r: Column, k: int, width: Column, height: Column) -> Column:
    """Quarter turns of pixel coordinates, (x, y) -> (y, W - 1 - x), the frame turning along."""
    turn = lambda w: lambda p: F.struct(p["y"].alias("x"), (w - 1 - p["x"]).alias("y"))
    for i in range(k % 4):
        r = F.transform(r, turn(width if i % 2 == 0 else height))
    return r


def cut(r: Column, axis: str, limit: float, low: bool) -> Column:
    """The part of a ring on one side of an axis-parallel line."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= limit if low else p[axis] <= limit

    def cross(p: Column, q: Column) -> Column:
        at = p[other] + (q[other] - p[other]) * F.try_divide(F.lit(float(limit)) - p[axis], q[axis] - p[axis])
        parts = {axis: F.lit(float(limit)), other: at}
        return F.struct(parts["x"].alias("x"), parts["y"].alias("y"))

    def edge(p: Column, q: Column) -> Column:
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(cross(p, q))).when(inside(q), F.array(cross(p, q), q)).otherwise(none)

    return F.when(F.size(r) > 0, F.flatten(F.zip_with(r, rolled(r), edge))).otherwise(r)


def clip(r: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A ring cut to a rectangle, side after side (Sutherland-Hodgman). Each side is let-bound, so that it
    is computed once."""
    side = lambda axis, limit, low: lambda v: cut(v, axis, limit, low)
    for axis, limit, low in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        r = F.transform(F.array(r), side(axis, limit, low))[0]
    return r
