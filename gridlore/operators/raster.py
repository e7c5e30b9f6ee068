"""Stencils and labels on rasters as long tables (tile, r, c, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions import groups

#: Cells of the grids that are labelled at once; a larger grid alone.
CELLS = 1 << 18


def spread3(df: DataFrame, value: str, out: str, erode: bool = False) -> DataFrame:
    """3 x 3 dilation (or erosion; outside counts as set) of a 0/1 column, by two running windows."""
    f = F.min if erode else F.max
    down = Window.partitionBy("tile", "c").orderBy("r").rowsBetween(-1, 1)
    along = Window.partitionBy("tile", "r").orderBy("c").rowsBetween(-1, 1)
    return df.withColumn("__v", f(value).over(down)).withColumn(out, f("__v").over(along)).drop("__v")


def label_components(mask: DataFrame, h: int, w: int) -> DataFrame:
    """tile, r, c, component of the set pixels: eight neighbours, named by the least r * w + c.

    Labels of many tiles settle at once in numpy, by taking the least of each pixel's neighbours."""

    def settled(tile: np.ndarray, r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        grid = np.full((n, h + 2, w + 2), h * w, np.int64)
        at = (tile, r + 1, c + 1)
        grid[at] = r.astype(np.int64) * w + c
        while True:
            low = grid.copy()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    np.minimum(low[:, 1:-1, 1:-1], grid[:, 1 + dr : h + 1 + dr, 1 + dc : w + 1 + dc], out=low[:, 1:-1, 1:-1])
            own = low[at]
            if (own == grid[at]).all():
                return own
            grid[at] = own

    def each(table: pa.Table, first: np.ndarray) -> pa.Table:
        r, c, ends = np.asarray(table["r"]), np.asarray(table["c"]), np.append(first, table.num_rows)
        tile, some, out = np.repeat(np.arange(len(first)), np.diff(ends)), max(1, CELLS // ((h + 2) * (w + 2))), []
        for i in range(0, len(first), some):
            n = min(some, len(first) - i)
            rows = slice(ends[i], ends[i + n])
            out.append(settled(tile[rows] - i, r[rows], c[rows], n))
        return table.append_column("component", pa.array(np.concatenate(out)))

    rows = mask.select(F.col("tile").cast("long"), F.col("r").cast("int"), F.col("c").cast("int"))
    return groups.map_groups(rows, ["tile"], each, "tile long, r int, c int, component long")


def horizon(dem: DataFrame, h: int, w: int, resolution: float, directions: int, radius: int) -> DataFrame:
    """Sky-view factor and positive openness: the greatest tangent along each direction, edges repeated.

    Offsets are few (directions * radius); every pixel meets its shifted partner by an equi-join."""
    steps = [(d, k, round(-np.cos(2 * np.pi * d / directions) * k), round(np.sin(2 * np.pi * d / directions) * k)) for d in range(directions) for k in range(1, radius + 1)]
    at = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(k)).alias("k"), F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j")) for d, k, i, j in steps])
    inside = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    a = dem.select("tile", "r", "c", "v", F.inline(at)).select("tile", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("v").alias("z"), "d", "k", inside(F.col("r") + F.col("i"), h).alias("r"), inside(F.col("c") + F.col("j"), w).alias("c"))
    rise = a.join(dem.select("tile", "r", "c", "v"), ["tile", "r", "c"]).groupBy("tile", "r0", "c0", "d").agg(F.max((F.col("v") - F.col("z")) / (F.col("k") * resolution)).alias("t"))
    angle = F.atan("t")
    return rise.groupBy("tile", F.col("r0").alias("r"), F.col("c0").alias("c")).agg((1 - F.avg(F.sin(F.greatest(angle, F.lit(0.0))))).alias("svf"), F.avg(90 - F.degrees(angle)).alias("openness"))


def slope(dem: DataFrame, resolution: float) -> DataFrame:
    """Degrees by central differences, one-sided at edges."""

    def gradient(by: str, over: str) -> Column:
        w = Window.partitionBy("tile", by).orderBy(over)
        v, before, after = F.col("v"), F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2) / resolution

    return dem.withColumns({"dy": gradient("c", "r"), "dx": gradient("r", "c")}).withColumn("slope", F.degrees(F.atan(F.hypot("dx", "dy"))))


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue in degrees, saturation and value of channels in 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(high == r, F.try_divide(g - b, span)).when(high == g, F.try_divide(b - r, span) + 2).otherwise(F.try_divide(r - g, span) + 4)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(turn * 60, F.lit(360.0)))
    return [hue.alias("hue"), F.coalesce(F.try_divide(span, high), F.lit(0.0)).alias("sat"), high.alias("val")]
