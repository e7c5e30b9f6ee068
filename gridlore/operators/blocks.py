"""Rasters as tables of blocks: windows that read only the blocks they meet, overviews, and weighted resampling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coarser(pixels: DataFrame) -> DataFrame:
    """The next overview: means of 2 x 2 pixels, of those that there are. pixels: band, r, c, v, n, where v is the sum over n base pixels."""
    return pixels.groupBy("band", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def write(pixels: DataFrame, path: str, block: int = 64, levels: int = 1) -> None:
    """pixels (band, r, c, v) as Parquet partitioned by level and block (by, bx), level 0 in full and each next one half as large.

    A block is written by one task, whatever the number of input files, so it is one file."""
    rows = level = pixels.select("band", "r", "c", F.col("v").cast("double").alias("v"), F.lit(1).cast("long").alias("n")).withColumn("level", F.lit(0))
    for k in range(1, levels):
        level = coarser(level).withColumn("level", F.lit(k))
        rows = rows.unionByName(level)
    spot = {"by": F.floor(F.col("r") / block).cast("int"), "bx": F.floor(F.col("c") / block).cast("int")}
    placed = rows.withColumns(spot).select("band", "r", "c", (F.col("v") / F.col("n")).alias("v"), "level", "by", "bx")
    placed.repartition("level", "by", "bx").write.partitionBy("level", "by", "bx").mode("overwrite").parquet(path)


def window(spark: SparkSession, path: str, row: int, col: int, height: int, width: int, block: int = 64, level: int = 0, fill: float | None = None) -> DataFrame:
    """band, r, c, v of a window, counted from its corner, at an overview level. The window may leave the raster.

    The blocks that it meets are known before the read, so only their partitions are listed and only their files opened. With
    `fill`, pixels of the window that the raster lacks have that value in every band that the window meets."""
    ends = lambda at, size: (at // block, (at + size - 1) // block)
    (y0, y1), (x0, x1) = ends(row, height), ends(col, width)
    found = spark.read.parquet(path).where((F.col("level") == level) & F.col("by").between(y0, y1) & F.col("bx").between(x0, x1))
    found = found.where(F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1))
    found = found.select("band", (F.col("r") - row).alias("r"), (F.col("c") - col).alias("c"), "v")
    if fill is None:
        return found
    spots = found.select("band").distinct().select("band", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).select("band", "r", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
    return spots.join(found, ["band", "r", "c"], "left").select("band", "r", "c", F.coalesce("v", F.lit(float(fill))).alias("v"))


def area_weights(size: int, to: int) -> list[list[tuple[int, float]]]:
    """For each source pixel, the target pixels that it overlaps and the share of each that it covers."""
    scale = Fraction(size, to)
    share = lambda s, t: min(Fraction(s + 1), (t + 1) * scale) - max(Fraction(s), t * scale)
    return [[(t, float(share(s, t) / scale)) for t in range(to) if share(s, t) > 0] for s in range(size)]


def linear_weights(size: int, to: int) -> list[list[tuple[int, float]]]:
    """For each source pixel, the target pixels whose centre lies between it and a neighbour, edges repeated."""
    out: list[dict[int, Fraction]] = [{} for _ in range(size)]
    for t in range(to):
        at = Fraction((2 * t + 1) * size, 2 * to) - Fraction(1, 2)
        low = at.numerator // at.denominator
        for s, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            s = min(max(s, 0), size - 1)
            if w:
                out[s][t] = out[s].get(t, Fraction(0)) + w
    return [[(t, float(w)) for t, w in sorted(own.items())] for own in out]


def spread(weights: list[list[tuple[int, float]]], at: Column) -> Column:
    """The (target, weight) pairs of a source place, from a table of constants."""
    table = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in own]) for own in weights])
    return F.get(table, at)


def resample(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], weights=area_weights) -> DataFrame:
    """tile, r, c, v of tiles (tile, r, c, v) of `size` rows and columns, made `to` rows and columns.

    Weights are separable: rows are spread and summed first, then columns. A source pixel reaches few targets, so
    partial sums before each shuffle keep it near the size of the larger raster."""
    for axis, other, n, m in (("r", "c", size[0], to[0]), ("c", "r", size[1], to[1])):
        each = pixels.select("tile", other, "v", F.inline(spread(weights(n, m), F.col(axis))))
        pixels = each.groupBy("tile", other, F.col("t").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return pixels.select("tile", "r", "c", "v")
