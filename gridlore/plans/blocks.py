"""Queries on rasters in blocks, in files, and resampled."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions.numeric import r6
from gridlore.operators import blocks as B
from gridlore.plans.cut import folder
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql
from gridlore.sources import geotiff

reg = Registry()
BLOCK = 32
MOSAIC = {"mosaic": "SELECT CAST(tile // 20 * 8 + r AS INTEGER) AS r, CAST(tile % 20 * 8 + c AS INTEGER) AS c, v FROM pixels"}


def mosaic(v):
    """The tiles on one raster, twenty to a row."""
    place = {"r": (F.floor(F.col("tile") / 20) * 8 + F.col("r")).cast("int"), "c": (F.col("tile") % 20 * 8 + F.col("c")).cast("int")}
    return v.pixels().withColumns(place).select(F.lit(0).alias("band"), "r", "c", "v")


def in_blocks(v, levels: int = 3) -> str:
    path = folder(v.spark, f"blocks-{v.dir.strip('/').replace('/', '-')}")
    B.write(mosaic(v), path, BLOCK, levels)
    return path


@reg("s5_boundless_window", sql("SELECT i AS r, j AS c, coalesce(round(v, 6), -1) AS v FROM (SELECT CAST(unnest(range(0, 70)) AS INTEGER) AS i), (SELECT CAST(unnest(range(0, 90)) AS INTEGER) AS j) LEFT JOIN mosaic ON r = i - 5 AND c = j + 100", "pixels", extra=MOSAIC))
def s5(v):
    """A window that begins above the raster and ends to its right: what lies outside is filled."""
    return B.window(v.spark, in_blocks(v), -5, 100, 70, 90, BLOCK, fill=-1.0).select("r", "c", r6(F.col("v")).alias("v"))


@reg("s5_overview_window", sql("SELECT CAST(r // 4 AS INTEGER) AS r, CAST(c // 4 - 3 AS INTEGER) AS c, round(avg(v), 6) AS v FROM mosaic WHERE c // 4 BETWEEN 3 AND 30 AND r // 4 < 12 GROUP BY ALL", "pixels", extra=MOSAIC))
def s5_overview(v):
    """The same raster at a quarter of its resolution."""
    return B.window(v.spark, in_blocks(v), 0, 3, 12, 28, BLOCK, level=2).select("r", "c", r6(F.col("v")).alias("v"))


def in_files(v, m: float = 0.5, most: int = 20) -> str:
    """A file for each row of tiles."""
    geotiff.register(v.spark)
    path = folder(v.spark, f"rasters-{v.dir.strip('/').replace('/', '-')}")
    p = v.pixels().withColumns({"row": F.floor(F.col("tile") / most), "x": F.col("tile") % most * 8 + F.col("c")})
    strip = p.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x", "v"))), lambda e: e["v"]).alias("values"), F.max("x").alias("last"))
    rows = strip.where(F.size("values") == 8 * (F.col("last") + 1)).select(
        F.format_string("row%08d.tif", "row").alias("name"), (F.col("last") + 1).cast("int").alias("width"), F.lit(8).alias("height"), F.lit(300000.0).alias("x"), (2000000.0 - F.col("row") * 8 * m).alias("y"), F.lit(m).alias("pixel"), F.lit(-9999.0).alias("nodata"), "values",
    )
    rows.write.format("geotiff").mode("append").save(path)
    return path


STRIPS = {"strips": "SELECT tile // 20 AS row, CAST(max(tile % 20 * 8 + c) + 1 AS INTEGER) AS width, count(*) AS n, sum(v) AS total FROM pixels GROUP BY ALL HAVING count(*) = 8 * (max(tile % 20 * 8 + c) + 1)"}
STRIP = "printf('row%08d.tif', row) AS name, width, 8 AS height"


@reg("s6_header_data_source", sql(f"SELECT {STRIP}, 0.5::DOUBLE AS pixel, 300000.0::DOUBLE AS l, 2000000.0::DOUBLE - row * 4 - 4 AS b, 300000.0::DOUBLE + width * 0.5 AS r, 2000000.0::DOUBLE - row * 4 AS t, '-9999' AS nodata FROM strips", "pixels", extra=STRIPS))
def s6(v):
    """Bounds, transform and nodata from the headers of written files, without their pixels."""
    f = v.spark.read.format("geotiff").load(in_files(v))
    return f.select("name", "width", "height", F.col("pixel_x").alias("pixel"), F.col("left").alias("l"), F.col("bottom").alias("b"), F.col("right").alias("r"), F.col("top").alias("t"), "nodata")


@reg("k7_raster_round_trip", sql(f"SELECT {STRIP}, n, round(total, 4) AS total FROM strips WHERE row < 10", "pixels", extra=STRIPS))
def k7(v):
    """Values of the files whose names the filter leaves."""
    f = v.spark.read.format("geotiff").option("pixels", "true").load(in_files(v)).where(F.col("name").startswith("row0000000"))
    return f.select("name", "width", "height", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def shares(n: int, m: int) -> str:
    return f"(SELECT s, t, (least(s + 1.0::DOUBLE, (t + 1) * {n} / {m}::DOUBLE) - greatest(s::DOUBLE, t * {n} / {m}::DOUBLE)) / ({n} / {m}::DOUBLE) AS w FROM (SELECT unnest(range(0, {n})) AS s), (SELECT unnest(range(0, {m})) AS t) WHERE (s + 1) * {m} > t * {n} AND s * {m} < (t + 1) * {n})"


def tents(n: int, m: int) -> str:
    at = f"((2 * t + 1) * {n} / {2 * m}::DOUBLE - 0.5)"
    return f"(SELECT least(greatest(CAST(floor({at}) AS BIGINT) + k, 0), {n - 1}) AS s, t, CASE k WHEN 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END AS w FROM (SELECT unnest(range(0, {m})) AS t), (SELECT unnest([0, 1]) AS k))"


def resampled(rows: str, cols: str) -> str:
    return sql(f"SELECT tile, CAST(y.t AS INTEGER) AS r, CAST(x.t AS INTEGER) AS c, round(sum(v * y.w * x.w), 6) AS v FROM pixels p JOIN {rows} y ON y.s = p.r JOIN {cols} x ON x.s = p.c GROUP BY ALL", "pixels")


def resample(v, to: tuple[int, int], weights):
    return B.resample(v.pixels(), (8, 8), to, weights).select("tile", "r", "c", r6(F.col("v")).alias("v"))


@reg("r13_resample_area", resampled(shares(8, 5), shares(8, 3)))
def r13_area(v):
    return resample(v, (5, 3), B.area_weights)


@reg("r13_resample_area_up", resampled(shares(8, 11), shares(8, 12)))
def r13_up(v):
    return resample(v, (11, 12), B.area_weights)


@reg("r13_resample_linear", resampled(tents(8, 13), tents(8, 5)))
def r13_linear(v):
    return resample(v, (13, 5), B.linear_weights)
