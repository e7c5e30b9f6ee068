"""Literal fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import rle
from gridlore.functions.tdist import T95, point, two_sided
from gridlore.operators import matching as M
from gridlore.sources import readers
from gridlore.streaming import metrics

GT = "tile_id long, gt_id long, cls int, x0 long, y0 long, x1 long, y1 long, area long"
PRED = "tile_id long, pred_id long, cls int, score double, x0 long, y0 long, x1 long, y1 long, area long"


def match(spark, gt, pred):
    g, p = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    m = M.greedy(M.candidates(g, p), ["tile_id"], F.lit(0.5))
    return M.records(p, m), g


def test_greedy_and_sweep(spark):
    gt = [(1, 1, 1, 0, 0, 10, 10, 100), (1, 2, 1, 50, 50, 60, 60, 100)]
    pred = [(1, 1, 1, 0.9, 0, 0, 10, 10, 100), (1, 2, 1, 0.8, 0, 0, 6, 10, 60), (1, 3, 1, 0.7, 50, 50, 60, 60, 100)]
    rec, g = match(spark, gt, pred)
    assert [r.is_tp for r in rec.orderBy("pred_id").collect()] == [1, 0, 1]
    best = M.best(M.sweep(rec, 2)).first()
    assert (best.best_threshold, best.f1) == (0.7, 0.8)


def test_no_overlap_and_no_truth(spark):
    rec, _ = match(spark, [(1, 1, 1, 0, 0, 10, 10, 100)], [(1, 1, 1, 0.9, 80, 80, 90, 90, 100)])
    assert rec.first().is_tp == 0
    assert M.best(M.sweep(rec, 0)).first().f1 == 0.0
    assert M.best(M.sweep(rec.limit(0), 3)).first().best_threshold == 1.0


def test_nms_chain(spark):
    d = spark.createDataFrame([(1, 0.9, 0, 0, 10, 10), (2, 0.8, 0, 2, 10, 12), (3, 0.7, 0, 4, 10, 14), (4, 0.6, 100, 100, 110, 110)], "det_id long, score double, x0 long, y0 long, x1 long, y1 long")
    assert sorted(r.det_id for r in M.nms(d).collect()) == [1, 3, 4]


def test_student_t():
    p = two_sided([2.776, -7.88, None, 0.0, 1.0, 12.0, 2.0], [4, 2.23, 4, 4, 0, 3, 1e6])
    assert p[[0, 1, 3]] == pytest.approx([0.05, 0.011, 1.0], abs=1e-3) and np.isnan(p[[2, 4]]).all()
    # Closed forms: one and two degrees of freedom, and the normal limit.
    t = np.array([0.1, 1.0, 3.0, 40.0])
    assert two_sided(t, np.full(4, 1.0)) == pytest.approx(1 - 2 * np.arctan(t) / np.pi, rel=1e-9)
    assert two_sided(t, np.full(4, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-9)
    assert p[6] == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-4)
    assert point(np.arange(1, 11)) == pytest.approx(T95, abs=6e-4) and point(np.array([30.0])) == pytest.approx([2.0423], abs=1e-4)


def test_rle():
    r = np.random.default_rng(0)
    for _ in range(50):
        m = r.random((7, 5)) < r.random()
        runs = rle.encode(m)
        assert (rle.decode(runs, 7, 5) == m).all() and rle.from_text(rle.to_text(runs)) == runs
    assert rle.iou(m, m) in (0.0, 1.0)
    assert rle.fill(np.array([1, 4, 4, 1]), np.array([1, 1, 3, 3]), 6, 6).sum() == 6


def test_via_map_and_list(spark):
    shape = '{"shape_attributes":{"all_points_x":[1,2],"all_points_y":[3,4]}}'
    lines = spark.createDataFrame([(f'{{"filename":"a","regions":{{"0":{shape}}}}}',), (f'{{"filename":"b","regions":[{shape}]}}',)], "value string")
    assert sorted((r.name, r.x[0]) for r in readers.via(lines).collect()) == [("a", 1.5), ("b", 1.5)]


def test_segmentation_forms(spark):
    df = spark.createDataFrame([("[[0,0,1,0,1,1]]",), ('{"size":[2,2],"counts":"04"}',), (None,)], "s string").select(*readers.segmentation(F.col("s")))
    rows = df.collect()
    assert len(rows[0].rings[0]) == 6 and rows[0].rle is None and rows[1].rle.size == [2, 2] and rows[2].rle is None


def test_logs_and_listing(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"iteration":1,"ap":2.0}\n{broken\n{"iteration":3,"ap":4.0}\n')
    assert readers.read_metric_log(spark, str(p), "iteration long, ap double").where("iteration is not null").count() == 2
    with pytest.raises(Exception):
        readers.read_metric_log(spark, str(p), "iteration long, ap double", strict=True).collect()
    (tmp_path / "x_img7.tif").write_text("a")
    assert readers.listing(spark, str(tmp_path), ".tif", r"(img\d+)").first().key == "img7"


def test_registry_order():
    assert readers.resolve("k", "a", {"k": "b"}, {}) == "a"
    assert readers.resolve("k", None, {"k": "b"}, {}) == "b"
    with pytest.raises(KeyError):
        readers.resolve("k", None, {}, {})


def test_drain_writes_once(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/out"
    rows = lambda ids: spark.createDataFrame([(i, None, i % 3, "a", float(i), None) for i in ids], metrics.EVENTS).coalesce(1)
    written = lambda: sorted(r.iteration for r in spark.read.parquet(f"{path}/events").select("iteration").collect())
    rows(range(10)).write.parquet(str(src))
    for state in ("state", "state", "again"):  # run again, then replayed without the state
        s = metrics.events(spark, str(src)).withColumn("iteration", F.col("event_id"))
        metrics.drain(s, path, state).awaitTermination()
        assert written() == list(range(10))
    rows([3, 9, 12, 15]).write.mode("append").parquet(str(src))
    metrics.drain(metrics.events(spark, str(src)).withColumn("iteration", F.col("event_id")), path, "again").awaitTermination()
    assert written() == [*range(10), 12, 15]


def test_ceiling():
    assert math.isclose(625 / (625 + 100), 0.862, abs_tol=1e-3)


def test_functions_of_columns_ship_in_any_order(spark):
    # Functions made for one query must not keep the session in the package that later ones ship to workers.
    from gridlore.plans import catalog

    q = catalog.queries()
    for name in ("g3_rle_area", "a20_t_two_sided_p", "g3_rle_round_trip", "g4_fill_rounded_truncated", "g3_rle_area"):
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0


def test_confidence_beyond_the_table(spark):
    from gridlore.functions.tdist import t_point_95

    got = [r.t for r in spark.range(1, 40).select("id", t_point_95(F.col("id")).alias("t")).orderBy("id").collect()]
    assert got[:10] == T95 and got[11] == pytest.approx(2.1788, abs=1e-4) and all(a > b for a, b in zip(got, got[1:]))


def test_run_iou():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rle.box_runs(*r.integers(-3, 9, 2), *r.integers(4, 24, 2), 16) for _ in range(2))
        full = []
        for runs in (a, b):
            flat = np.zeros(256, bool)
            for x, y in runs:
                flat[x:y] = True
            full.append(flat)
        assert rle.runs_iou(a, b) == pytest.approx(rle.iou(*full))
