"""Outlines of masks as rings: directed pixel edges that cancel between neighbours, chained into closed loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridlore.functions import chains, groups

POINTS = "array<struct<x: double, y: double>>"
#: Right, down, left, up with y down; a pixel's edges run clockwise, so the mask lies to the right of each.
WAYS = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])
#: From an edge's start to the pixel it belongs to, (column, row).
INSIDE = np.array([[0, 0], [-1, 0], [-1, -1], [0, -1]])


def edges(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, way: edges between a set pixel (r, c) and one that is not; shared edges run both ways and cancel."""
    r, c = F.col("r"), F.col("c")
    sides = [(False, c, r, 1), (True, c + 1, r, 1), (False, c, r + 1, -1), (True, c, r, -1)]
    four = F.array(*[F.struct(F.lit(up).alias("up"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(s).alias("s")) for up, x, y, s in sides])
    left = mask.select(*keys, F.inline(four)).groupBy(*keys, "up", "x", "y").agg(F.sum("s").alias("s")).where("s <> 0")
    back = F.col("s") < 0
    way = F.when(F.col("up"), F.when(back, 3).otherwise(1)).otherwise(F.when(back, 2).otherwise(0))
    return left.select(*keys, (F.col("x") + (back & ~F.col("up")).cast("int")).alias("x"), (F.col("y") + (back & F.col("up")).cast("int")).alias("y"), way.alias("way"))


def rings(mask: DataFrame, keys: list[str], part: str | None = None) -> DataFrame:
    """keys, part, ring, area, points, border, px, py: the loops around the set pixels (r, c) of each group, eight-connected.

    With `part` (a whole number, as a component's label) pixels of different parts of a group are no neighbours.

    points runs along pixel edges, corners only; area is signed, holes are negative. border runs through the centres
    of the pixels the loop goes by, as border following does, corners only; (px, py) is the centre of the first of them. The
    edges of many groups are chained in one call on whole arrays, a group's all at once, so a group should be a tile."""
    kinds = dict(mask.dtypes)
    arrow = pa.schema([(k, pa.int64() if kinds[k] == "bigint" else pa.int32() if kinds[k] == "int" else pa.string()) for k in keys])
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def each(table: pa.Table, first: np.ndarray) -> pa.Table:
        start, way = np.stack([np.asarray(table["x"]), np.asarray(table["y"])], axis=1).astype(np.int64), np.asarray(table["way"])
        own = np.asarray(table[part]) if part else np.zeros(len(way), np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(way)))
        by = np.lexsort((way, start[:, 0], start[:, 1], own, group))
        start, way, own = start[by], way[by], own[by]
        apart = np.cumsum((np.diff(own, prepend=own[:1]) != 0) | (np.diff(group, prepend=0) != 0))
        order, begins = chains.loops(start, start + WAYS[way], True, apart)
        start, way, own = start[order], way[order], own[order]
        cross = start[:, 0] * WAYS[way, 1] - start[:, 1] * WAYS[way, 0]
        pixel = start + INSIDE[way]

        def lists(points: np.ndarray) -> pa.Array:
            kept, at = chains.corners(points, begins)
            both = pa.StructArray.from_arrays([pa.array(kept[:, 0].astype(float)), pa.array(kept[:, 1].astype(float))], ["x", "y"])
            return pa.ListArray.from_arrays(pa.array(np.append(at, len(kept)), pa.int32()), both, type=point)

        of = group[order][begins]
        ring = np.arange(len(of)) - np.searchsorted(of, of)
        same = {k: table[k].take(first[of]).cast(arrow.field(k).type) for k in keys} | ({part: pa.array(own[begins], pa.int64())} if part else {})
        rest = {"ring": pa.array(ring, pa.int32()), "area": pa.array(np.add.reduceat(cross, begins) / 2), "points": lists(start), "border": lists(pixel), "px": pa.array(pixel[begins, 0] + 0.5), "py": pa.array(pixel[begins, 1] + 0.5)}
        return pa.table(same | rest)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (f", {part} long" if part else "") + f", ring int, area double, points {POINTS}, border {POINTS}, px double, py double"
    return groups.map_groups(edges(mask.repartition(*keys), [*keys, part] if part else keys), keys, each, schema)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, by the parity of the sides that cross to its right."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    hit = F.zip_with(ring, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(hit, lambda h: h)) % 2 == 1


def polygons(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, exterior, holes, area (holes taken off): each hole under the smallest outer ring that contains it.

    found has a point (px, py) beside each hole's edge, strictly inside its outer ring. Rings of a group meet by their keys."""
    outer = found.where("area > 0").select(*keys, "ring", F.col("points").alias("exterior"), F.col("area").alias("own"))
    hole = found.where("area < 0").select(*keys, F.col("ring").alias("hole"), "points", "px", "py", F.col("area").alias("less"))
    over = outer.join(hole, keys).where(inside(F.col("px"), F.col("py"), F.col("exterior")))
    first = Window.partitionBy(*keys, "hole").orderBy("own", "ring")
    nested = over.withColumn("k", F.row_number().over(first)).where("k = 1").groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(F.struct("hole", "points"))).alias("h"), F.sum("less").alias("less"))
    own = outer.join(nested, [*keys, "ring"], "left")
    none = F.array().cast(f"array<{POINTS}>")
    return own.select(*keys, "ring", "exterior", F.coalesce(F.transform("h", lambda h: h["points"]), none).alias("holes"), (F.col("own") + F.coalesce("less", F.lit(0.0))).alias("area"))


def simplified(ring, epsilon: float) -> Column:
    """Douglas-Peucker on a ring."""

    def each(rows):
        import pandas as pd

        out = []
        for r in rows:
            own = chains.simplify(np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2), epsilon)
            out.append([{"x": float(x), "y": float(y)} for x, y in own])
        return pd.Series(out)

    return F.pandas_udf(each, T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))(ring)


def refilled(found: DataFrame, keys: list[str], pixels: DataFrame) -> DataFrame:
    """pixels (keys, r, c, ...) with `filled`: whether an even-odd fill of the rings' sides sets them.

    Each upright side toggles the rows it passes from its column on; a running count along the row gives the parity."""
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    sides = found.select(*keys, F.inline(F.zip_with("points", after, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))))
    rows = F.sequence(F.least("y0", "y1").cast("int"), (F.greatest("y0", "y1") - 1).cast("int"))
    toggles = sides.where("x = x1").select(*keys, F.explode(rows).alias("r"), F.col("x").cast("int").alias("c"), F.lit(1).alias("toggle"))
    marks = pixels.withColumn("__pixel", F.lit(1)).unionByName(toggles, allowMissingColumns=True)
    run = Window.partitionBy(*keys, "r").orderBy("c", F.col("__pixel").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    parity = F.coalesce(F.sum("toggle").over(run), F.lit(0)) % 2 == 1
    return marks.withColumn("filled", parity).where("__pixel = 1").drop("toggle", "__pixel")


def contours(labels: DataFrame, least_points: int = 3, least_area: float = 4.0) -> DataFrame:
    """tile, component, points, area, dropped of labelled pixels (tile, r, c, component): the outer border of each component.

    points are pixel centres where the border turns; dropped names why a border is of no use, null where it is."""
    one = rings(labels, ["tile"], "component").where("area > 0")
    after = F.concat(F.slice("border", 2, F.size("border")), F.slice("border", 1, 1))
    twice = F.aggregate(F.zip_with("border", after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, t: s + t)
    own = one.select("tile", "component", F.col("border").alias("points"), (F.abs(twice) / 2).alias("area"))
    why = F.when(F.size("points") < least_points, f"under_{least_points}_points").when(F.col("area") < least_area, f"under_{least_area:g}px")
    return own.withColumn("dropped", why)
