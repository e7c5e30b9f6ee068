"""Outlines, polygons and run lists against pixels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlore.functions import chains, groups, runs
from gridlore.operators import outlines, polygons, raster

POINT = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def even_odd(points, w, h, scale=1):
    """Plain loop over pixel centres and sides."""
    px, py = np.meshgrid((np.arange(w * scale) + 0.5) / scale, (np.arange(h * scale) + 0.5) / scale)
    inside = np.zeros(px.shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if ay != by:
            inside ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return inside


def masks_table(spark, masks):
    rows = [(i, int(r), int(c)) for i, m in enumerate(masks) for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "tile long, r int, c int")


def flood(mask, steps):
    """Labels by plain flood fill."""
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n += 1
        todo = [start]
        label[start] = n
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                at = (r + dr, c + dc)
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not label[at]:
                    label[at] = n
                    todo.append(at)
    return label, n


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def test_rings_of_masks_with_nested_holes(spark):
    g = np.random.default_rng(4)
    masks = [g.random((15, 12)) < p for p in (0.2, 0.5, 0.6, 0.8, 0.95)]
    nest = np.zeros((15, 12), bool)
    nest[0:11, 0:11] = True
    nest[2:9, 2:9] = False
    nest[3:8, 3:8] = True
    nest[5, 5] = False
    masks += [nest, np.ones((15, 12), bool), np.eye(15, 12, dtype=bool)]
    found = outlines.rings(masks_table(spark, masks), ["tile"])
    whole = outlines.polygons(found, ["tile"]).collect()
    for i, m in enumerate(masks):
        own = [p for p in whole if p.tile == i]
        label, n = flood(m, EIGHT)
        back, holes = flood(np.pad(~m, 1, constant_values=True), FOUR)
        assert len(own) == n and sum(len(p.holes) for p in own) == holes - 1
        areas = []
        for p in own:
            inside = even_odd([(q.x, q.y) for q in p.exterior], 12, 15)
            for hole in p.holes:
                inside ^= even_odd([(q.x, q.y) for q in hole], 12, 15)
            k = label[inside].max()
            assert (inside == (label == k)).all() and p.area == inside.sum()  # each polygon is one component, holes left out
            areas.append(k)
        assert len(set(areas)) == n
    nested = [p for p in whole if p.tile == 5]
    assert sorted((len(p.holes), p.area) for p in nested) == [(1, 24.0), (1, 72.0)]


def test_contours_follow_borders(spark):
    g = np.random.default_rng(9)
    masks = [g.random((9, 9)) < p for p in (0.3, 0.6)] + [np.ones((9, 9), bool), np.pad(np.ones((1, 5), bool), 4)[:9, :9], np.pad(np.ones((2, 2), bool), ((3, 4), (3, 4)))]
    labels = [flood(m, EIGHT)[0] for m in masks]
    rows = [(i, int(r), int(c), int(m[r, c])) for i, m in enumerate(labels) for r, c in zip(*np.nonzero(m), strict=True)]
    found = outlines.contours(spark.createDataFrame(rows, "tile long, r int, c int, component long")).collect()
    assert len(found) == sum(m.max() for m in labels)
    for f in found:
        own = labels[f.tile] == f.component
        r, c = np.nonzero(own)
        points = [(int(p.x), int(p.y)) for p in f.points]
        assert (min(x for x, _ in points), max(x for x, _ in points), min(y for _, y in points), max(y for _, y in points)) == (c.min(), c.max(), r.min(), r.max())
        border = set()  # pixels on the way from corner to corner, by straight or diagonal steps
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            n = max(abs(bx - ax), abs(by - ay))
            assert n == 0 or {abs(bx - ax), abs(by - ay)} <= {0, n}
            border |= {(ax + (bx - ax) * k // max(n, 1), ay + (by - ay) * k // max(n, 1)) for k in range(n + 1)}
        outside, _ = flood(np.pad(~own, 1, constant_values=True), FOUR)
        touches = {(x, y) for y, x in zip(r, c, strict=True) if any(outside[y + 1 + dy, x + 1 + dx] == 1 for dy, dx in FOUR)}
        assert border == touches  # just the pixels with a side to the outside
        area = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True))) / 2
        assert f.area == area and f.dropped == ("under_3_points" if len(points) < 3 else "under_4px" if area < 4 else None)
    assert {f.dropped for f in found} == {None, "under_3_points", "under_4px"}


class Plain:
    """Stands in for a DataFrame: mapInArrow gives the function itself."""

    def repartition(self, *keys):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, schema):
        return run


def test_groups_come_whole_and_many_a_call():
    keys = [None] * 3 + [0] * 2 + [1] * 9 + [2, 3, 4, 5, 6, 7] + [8] * 4
    table, calls = pa.table({"k": pa.array(keys, pa.int64()), "i": range(len(keys))}), []

    def each(rows, first):
        calls.append([rows["k"][int(f)].as_py() for f in first])
        assert [len(set(p)) for p in np.split(np.array([-1 if k is None else k for k in rows["k"].to_pylist()]), first[1:])] == [1] * len(first)
        return rows

    for size in (1, 3, 4, 5, 100):
        calls.clear()
        parts = table.to_batches(max_chunksize=size)
        out = list(groups.map_groups(Plain(), ["k"], each, "")(iter([parts[0].slice(0, 0), *parts])))
        assert pa.Table.from_batches(out).equals(table)
        assert [k for c in calls for k in c] == [None, *range(9)]  # each group once
        assert size < 100 or len(calls) == 2  # one call for all but the last of a batch
    assert not list(groups.map_groups(Plain(), ["k"], each, "")(iter([])))


def test_many_tiles_are_chained_in_a_call(spark):
    g = np.random.default_rng(12)
    masks = [g.random((9, 11)) < p for p in g.uniform(0.1, 0.95, 60)]
    df = masks_table(spark, masks).withColumn("tile", F.when(F.col("tile") != 7, F.col("tile")))
    named = df.withColumn("tile", F.concat(F.lit("t"), "tile"))
    facts = ["ring", "area", "points", "border", "px", "py"]

    def found(of, name=lambda t: t):
        return {(name(r.tile), r.ring): tuple(r[f] for f in facts) for r in outlines.rings(of, ["tile"]).collect()}

    whole = found(df)
    alone = {i: outlines.rings(df.where(F.col("tile") == i), ["tile"]).collect() for i in (0, 59)}
    for i, own in alone.items():
        assert [whole[i, r.ring] for r in own] == [tuple(r[f] for f in facts) for r in own] and len(own) == sum(k[0] == i for k in whole)
    assert {k[0] for k in whole} == {None, *range(60)} - {7} and found(named, lambda t: t and int(t[1:])) == whole
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")  # tiles reach over batches
    try:
        assert found(df) == whole
    finally:
        spark.conf.set(key, before)
    text = outlines.rings(df, ["tile"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and text.count("REPARTITION_BY_COL") == 1 and text.count("ENSURE_REQUIREMENTS") == 0


def test_many_tiles_are_labelled_in_a_call(spark, monkeypatch):
    g = np.random.default_rng(13)
    masks = [g.random((9, 11)) < p for p in g.uniform(0.1, 0.95, 60)]
    df = masks_table(spark, masks)
    df = df.withColumn("tile", F.when(F.col("tile") != 7, F.col("tile")))
    labels = {(r.tile, r.r, r.c): r.component for r in raster.label_components(df, 9, 11).collect()}
    assert len(labels) == sum(m.sum() for m in masks)
    for i, m in enumerate(masks):
        flat = flood(m, EIGHT)[0]
        least = {k: min(r * 11 + c for r, c in zip(*np.nonzero(flat == k), strict=True)) for k in range(1, flat.max() + 1)}
        assert all(labels[None if i == 7 else i, r, c] == least[flat[r, c]] for r, c in zip(*np.nonzero(m), strict=True))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")  # tiles reach over batches
    monkeypatch.setattr(raster, "CELLS", 1)
    try:
        assert {(r.tile, r.r, r.c): r.component for r in raster.label_components(df, 9, 11).collect()} == labels
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroups" not in raster.label_components(df, 9, 11)._jdf.queryExecution().executedPlan().toString()


def test_simplified_rings_stay_near(spark):
    g = np.random.default_rng(1)
    angle = np.sort(g.random(300)) * 2 * np.pi
    ring = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (50 + g.normal(size=(300, 1)))
    for epsilon in (0, 0.5, 3, 20):
        own = chains.simplify(ring, epsilon)
        a, b = own, np.roll(own, -1, axis=0)
        way = b - a
        along = np.clip(((ring[:, None] - a) * way).sum(axis=2) / np.maximum((way * way).sum(axis=1), 1e-300), 0, 1)
        assert np.hypot(*np.moveaxis(ring[:, None] - a - along[..., None] * way, 2, 0)).min(axis=1).max() <= epsilon + 1e-9
    assert len(chains.simplify(ring, 3)) < 60
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], f"points {outlines.POINTS}")
    assert len(df.select(outlines.simplified(F.col("points"), 3.0).alias("p")).first().p) == len(chains.simplify(ring, 3))


@pytest.mark.parametrize("whole", [True, False])
def test_polygons_equal_pixels(spark, whole):
    """Rings that cross, touch, retrace and leave the frame; areas by counting pixels, finely where corners are no whole numbers."""
    g = np.random.default_rng(5)
    w, h, scale = 20, 16, 1 if whole else 40
    rings = []
    for _ in range(60):
        n = int(g.integers(3, 9))
        if whole:  # level and upright sides only
            x, y = g.integers(-4, 24, n), g.integers(-4, 20, n)
            points = [p for i in range(n) for p in ((x[i], y[i]), (x[(i + 1) % n], y[i]))]
        else:
            points = [tuple(p) for p in g.uniform(-4, 24, (n, 2))]
        rings.append([(float(a), float(b)) for a, b in points])
    rings += [[(0, 0), (w, 0), (w, h), (0, h)], [(-5, -5), (40, -5), (40, 40), (-5, 40)], [(2, 2), (8, 2), (8, 8), (2, 8), (2, 5), (-3, 5), (2, 5)], [(3, 3), (9, 3)], [(30, 30), (40, 30), (35, 40)], [(1, 1), (5, 1), (5, 5), (1, 5)] * 2]
    rows = [(i // 10, i, [[(float(a), float(b)) for a, b in r]]) for i, r in enumerate(rings)] + [(99, 1000, None), (99, 1001, [])]
    rows.append((98, 2000, [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(10.0, 10.0), (13.0, 10.0), (13.0, 14.0), (10.0, 14.0)]]))
    df = spark.createDataFrame(rows, f"image long, id long, rings array<{outlines.POINTS}>")
    fitted = polygons.fit_to_frame(df, w, h, 0.0)
    got = {f.id: f for f in fitted.collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rings):
        want, mine = even_odd([tuple(map(float, p)) for p in r], w, h, scale), np.zeros((h * scale, w * scale), bool)
        for p in got[i].pieces:
            mine ^= even_odd([(q.x, q.y) for q in p.exterior], w, h, scale)
            for hole in p.holes:
                mine ^= even_odd([(q.x, q.y) for q in hole], w, h, scale)
            assert all(-1e-9 <= q.x <= w + 1e-9 and -1e-9 <= q.y <= h + 1e-9 for q in p.exterior)
        assert (mine != want).sum() <= (0 if whole else 80), i  # snapping moves a side by less than a hundredth of a fine pixel, of which it passes a thousand
        assert abs(got[i].area - want.sum() / scale**2) < (1e-9 if whole else 1.5), i
    n = len(rings)
    assert not got[n - 6].repaired and got[n - 6].area == w * h == got[n - 5].area and got[n - 4].repaired and got[n - 4].area == 36
    assert got[n - 3].dropped and got[n - 2].outside and got[n - 1].repaired and got[n - 1].area == 0
    assert got[1000].null_geometry and got[1001].outside and got[2000].split and got[2000].area == 16
    reasons = {r.reason: r.n for r in polygons.reasons(fitted).collect()}
    assert reasons["null_geometry"] == 1 and reasons["dropped"] == sum(f.dropped for f in got.values())


def test_runs_equal_masks(spark):
    g = np.random.default_rng(6)
    w, h = 13, 11
    rows = []
    for i in range(120):
        rings = [[(float(x), float(y)) for x, y in g.integers(-3, 16, (int(g.integers(1, 7)), 2)) + g.choice([0, 0.25])] for _ in range(int(g.integers(0, 4)))]
        rows.append((i, rings if i % 17 else None))
    df = spark.createDataFrame(rows, f"id long, rings array<{outlines.POINTS}>").repartition(3)
    masks = {}
    for i, rings in rows:
        masks[i] = np.zeros((h, w), bool)
        for ring in rings or []:
            masks[i] |= even_odd(ring, w, h)
    one = df.select("id", runs.filled("rings", w, h).alias("runs"))
    got = {r.id: [(x.b, x.e) for x in r.runs] for r in one.collect()}
    for i, m in masks.items():
        flat = np.zeros(w * h, bool)
        for b, e in got[i]:
            assert not flat[b:e].any()
            flat[b:e] = True
        assert (flat == m.ravel()).all() and all(a[1] < b[0] for a, b in zip(got[i], got[i][1:], strict=False))
    other = one.select((F.col("id") + 1).alias("id"), F.col("runs").alias("before"))
    both = one.join(other, "id").select("id", runs.shared("runs", "before", w * h + 1).alias("n"), runs.united(F.concat("runs", "before"), w * h + 1).alias("u"), runs.size("runs").alias("size"))
    for r in both.collect():
        assert r.n == (masks[r.id] & masks[r.id - 1]).sum() and sum(x.e - x.b for x in r.u) == (masks[r.id] | masks[r.id - 1]).sum() and r.size == masks[r.id].sum()


def test_loops_refuse_what_is_no_loop():
    with pytest.raises(ValueError):
        chains.loops(np.array([[0, 0]]), np.array([[1, 0]]), True)
    order, begins = chains.loops(np.zeros((0, 2)), np.zeros((0, 2)), True)
    assert len(order) == len(begins) == 0


def test_rings_of_a_batch_are_cut_together(monkeypatch):
    g = np.random.default_rng(15)
    frame = [(0, 16, 0, 0), (20, 16, 0, 16), (20, 0, 20, 16), (0, 0, 20, 0)]
    rows = []
    for i in range(80):
        p = [tuple(map(float, q)) for q in (g.integers(-4, 24, (int(g.integers(3, 12)), 2)) if i % 2 else g.uniform(-4, 24, (int(g.integers(3, 12)), 2)))]
        rows.append([dict(zip(("ax", "ay", "bx", "by"), map(float, s), strict=True)) for s in [*frame, *((*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True))]])
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))
    n = pa.array(range(len(rows)), pa.int64())
    batch = pa.RecordBatch.from_pydict({"image": n, "id": n, "part": n.cast(pa.int32()), "all": pa.array(rows, kind)})
    for loops in (False, True):
        run = polygons.bounding(Plain(), 20, 16, loops)
        whole = list(run(iter([batch])))
        assert len(whole) == 1 and len(whole[0]) == len(rows)
        with monkeypatch.context() as m:  # few at once, and one longer than that
            m.setattr(polygons, "SIDES", 30)
            m.setattr(polygons, "PAIRS", 5)
            parts = list(run(iter([batch.slice(0, 0), batch.slice(0, 33), batch.slice(33)])))
        assert len(parts) > 20 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches(whole).to_pydict()


def test_clipping_shuffles_rings_and_features_only(spark):
    df = spark.createDataFrame([(1, 1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]])], f"image long, id long, rings array<{outlines.POINTS}>")
    plan = polygons.fit_to_frame(df, 9, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 1 and "Broadcast" not in plan  # no rows of pairs or sides, pieces never broadcast


def test_rings_within_the_frame_do_not_meet_it(monkeypatch):
    frame = [(0, 9, 0, 0), (9, 9, 0, 9), (9, 0, 9, 9), (0, 0, 9, 0)]
    boxes = [(1, 1, 8, 8), (0, 1, 8, 8), (1, 1, 8, 10), (20, 20, 21, 21)]
    rows = []
    for x0, y0, x1, y1 in boxes:
        p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        rows.append([dict(zip(("ax", "ay", "bx", "by"), map(float, s), strict=True)) for s in [*frame, *((*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True))]])
    n, met, plain = pa.array(range(4), pa.int64()), [], polygons.cuts
    batch = pa.RecordBatch.from_pydict({"image": n, "id": n, "part": n.cast(pa.int32()), "all": pa.array(rows, pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))})
    monkeypatch.setattr(polygons, "cuts", lambda row, *rest: met.append(np.bincount(row).tolist()) or plain(row, *rest))
    (out,) = polygons.bounding(Plain(), 9, 9, loops=True)(iter([batch]))
    assert met == [[4, 8, 8, 8]]
    assert [[x["area"] for x in r] for r in out["loops"].to_pylist()] == [[49.0], [56.0], [56.0], []]
