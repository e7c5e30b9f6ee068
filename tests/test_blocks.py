"""Raster blocks, files and resampling against plain arrays."""

import io
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import blocks
from gridlore.sources import geotiff


def pixels(spark, x):
    rows = [(b, int(r), int(c), float(v)) for b, band in enumerate(x) for (r, c), v in np.ndenumerate(band)]
    return spark.createDataFrame(rows, "band int, r int, c int, v double")


def test_windows_open_only_the_blocks_they_meet(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3, 50, 70))
    path = f"file://{tmp_path}/raster"
    blocks.write(pixels(spark, x), path, 16, 3)
    for row, col, h, w in ((0, 0, 50, 70), (17, 33, 5, 20), (-4, 60, 10, 20), (48, -3, 9, 5), (100, 100, 4, 4)):
        got = blocks.window(spark, path, row, col, h, w, 16, fill=-7.0)
        for b in range(3):
            want = np.full((h, w), -7.0)
            r, c = np.mgrid[row : row + h, col : col + w]
            ok = (r >= 0) & (r < 50) & (c >= 0) & (c < 70)
            want[ok] = x[b][r[ok], c[ok]]
            mine = {(g.r, g.c): g.v for g in got.where(F.col("band") == b).collect()}
            assert mine == ({(i, j): want[i, j] for i in range(h) for j in range(w)} if ok.any() else {})
    some = blocks.window(spark, path, 17, 33, 5, 20, 16)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "by#" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters: [IsNotNull(r)" in plan
    files = {f.split("level=")[1].rsplit("/", 1)[0] for f in (r.f for r in some.select(F.col("band")).withColumn("f", F.input_file_name()).select("f").distinct().collect())}
    assert files == {"0/by=1/bx=2", "0/by=1/bx=3"}
    half = {(g.band, g.r, g.c): g.v for g in blocks.window(spark, path, 0, 0, 13, 18, 16, level=2).collect()}
    assert len(half) == 3 * 13 * 18 and all(abs(v - x[b, 4 * r : 4 * r + 4, 4 * c : 4 * c + 4].mean()) < 1e-12 for (b, r, c), v in half.items())


@pytest.mark.parametrize(("n", "m"), [(8, 5), (8, 8), (5, 13), (7, 1), (1, 6), (8, 4)])
def test_weights_equal_a_loop(n, m):
    area, linear = np.zeros((n, m)), np.zeros((n, m))
    for s, own in enumerate(blocks.area_weights(n, m)):
        for t, w in own:
            area[s, t] = w
    for s, own in enumerate(blocks.linear_weights(n, m)):
        for t, w in own:
            linear[s, t] = w
    assert np.allclose(area.sum(axis=0), 1) and np.allclose(linear.sum(axis=0), 1)
    x = np.random.default_rng(n).normal(size=n)
    fine = np.repeat(x, m).reshape(m, n).mean(axis=1)  # every target covers n of the n * m parts
    assert np.allclose(x @ area, fine)
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    assert np.allclose(x @ linear, np.interp(at, np.arange(n), x))


def test_resample_equals_matrices(spark):
    x = np.random.default_rng(3).normal(size=(6, 4, 7))
    df = pixels(spark, x).withColumnRenamed("band", "tile")
    for to in ((3, 9), (11, 2)):
        got = {(g.tile, g.r, g.c): g.v for g in blocks.resample(df, (4, 7), to, blocks.linear_weights).collect()}
        lines = [np.stack([np.interp(np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1), np.arange(n), e) for e in np.eye(n)]) for n, m in zip((4, 7), to, strict=True)]
        for t in range(6):
            assert np.allclose(lines[0].T @ x[t] @ lines[1], [[got[t, i, j] for j in range(to[1])] for i in range(to[0])])


def test_files_round_trip_and_headers_only(spark, tmp_path):
    geotiff.register(spark)
    g = np.random.default_rng(2)
    rows = [(f"a{i}.tif", int(w), int(h), 100.0 + i, 50.5, 0.25, -9999.0 if i % 2 else None, [float(v) for v in g.normal(size=w * h)]) for i, (w, h) in enumerate(g.integers(1, 30, (12, 2)))]
    df = spark.createDataFrame(rows, "name string, width int, height int, x double, y double, pixel double, nodata double, values array<double>")
    path = f"file://{tmp_path}/tif"
    df.repartition(3).write.format("geotiff").mode("append").save(path)
    df.write.format("geotiff").mode("append").save(path)  # again: the same files
    read = spark.read.format("geotiff").option("files_per_partition", 5)
    got = {r.name: r for r in read.option("pixels", "true").load(path).collect()}
    assert len(got) == 12
    for name, w, h, x, y, p, nodata, values in rows:
        r = got[name]
        assert (r.width, r.height, r.bands, r.pixel_x, r.x, r.y, r.left, r.top, r.right, r.bottom, r["values"]) == (w, h, 1, p, x, y, x, y, x + w * p, y - h * p, values)
        assert (r.nodata and float(r.nodata)) == nodata and r.tags[257] == str(h)
    for name in got:  # headers are read without the pixels
        file = tmp_path / "tif" / name
        os.truncate(file, file.stat().st_size - 8 * got[name].width * got[name].height)
    heads = read.option("pixels", "false").load(path)
    assert {(r.name, r.width) for r in heads.collect()} == {(r[0], r[1]) for r in rows} and heads.rdd.getNumPartitions() == 3
    (tmp_path / "tif" / "broken.tif").write_bytes(b"no header")
    few = heads.where("name in ('a3.tif', 'a4.tif')")
    assert {r.name for r in few.collect()} == {"a3.tif", "a4.tif"}  # the broken file is not opened
    assert few.rdd.getNumPartitions() == 1 and {r.name for r in heads.where("name like 'a1%' and width > 0").collect()} == {"a1.tif", "a10.tif", "a11.tif"}


def test_headers_of_other_byte_order_and_place():
    # Big-endian, the directory beyond the first bytes read.
    entries = [(256, 4, 1, struct.pack(">I", 7)), (257, 3, 1, struct.pack(">HH", 9, 0)), (42113, 2, 3, b"-1\0\0")]
    body = b"MM" + struct.pack(">HI", 42, 6000) + b"\0" * 5992 + struct.pack(">H", 3) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in entries) + b"\0" * 4
    row = geotiff.row("x", geotiff.header(io.BytesIO(body)))
    assert row[:4] == ("x", 7, 9, 1) and row[12] == "-1"
