"""Files in pieces of bounded size, and joins that are shuffled whatever the estimates say."""

from pyspark.sql import functions as F

from gridlore.plans import catalog
from gridlore.plans.views import Views

SF = "/root/testdata/sf0.001"


def test_coco_documents_do_not_grow_with_their_group(spark):
    from gridlore.sources import readers, writers

    images = spark.range(10).select(F.lit("a").alias("aoi"), F.col("id").alias("image_id"), F.lit("x").alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    notes = images.where("image_id <> 4").select("aoi", (F.col("image_id") + 100).alias("id"), "image_id", F.lit(1).alias("cls"), *(F.lit(n).alias(c) for c, n in (("x0", 0), ("y0", 1), ("x1", 2), ("y1", 3))), F.lit(4).alias("area"))
    docs = writers.coco_documents(images, notes, "aoi", most=3)
    got = [(r.images, r.annotations) for r in docs.select(F.from_json("document", readers.COCO).alias("d")).select("d.*").collect()]
    assert sorted(len(i) for i, _ in got) == [1, 3, 3, 3] and sum(len(a) for _, a in got) == 9
    assert sorted(i.id for images, _ in got for i in images) == list(range(10))
    assert all({a.image_id for a in a_} <= {i.id for i in i_} for i_, a_ in got)


def test_areas_are_read_from_all_their_documents(spark, tmp_path):
    from gridlore.plans import files

    # Tiles 26 ids apart, over 75 stretches of ids.
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") * 1040).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    v = Views(spark, str(tmp_path))
    assert spark.read.text(files.documents(v)).count() > 50
    want = {r.aoi: (r.i, r.n, r.w) for r in v.tiles().join(v.gt(), "tile_id", "left").groupBy("aoi").agg(F.count_distinct("tile_id").alias("i"), F.count("gt_id").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).collect()}
    assert {r.aoi: (r.images, r.annotations, r.width) for r in files.k1(v).collect()} == want
    assert {r.id for r in files.s1(v).collect()} == {r.gt_id for r in v.gt().collect()}


def test_feature_collections_do_not_grow_with_the_table(spark):
    from gridlore.plans import files

    v = Views(spark, SF)
    lines = spark.read.text(files.collections(v, most=70))
    sizes = [r[0] for r in lines.select(F.size(F.from_json("value", "features array<struct<type:string>>")["features"])).collect()]
    assert sum(sizes) == v.gt().count() and max(sizes) <= 10
    assert {r.det_id for r in files.k4(v).collect()} == {r.det_id for r in v.map_gt().where("det_id % 10 <> 0").collect()}


def test_the_side_in_nine_cells_is_never_broadcast(spark):
    v = Views(spark, SF)
    for name in ("j8_distance_semi_join", "m19_concordance"):
        plan = catalog.queries()[name](spark, v.dir)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "cell" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_masks_that_cannot_match_are_not_compared(spark):
    import numpy as np

    from gridlore.functions import rings, runs
    from gridlore.operators import matching as M

    g = np.random.default_rng(4)
    x, y, w, h = g.integers(0, 20, 80), g.integers(0, 20, 80), g.integers(1, 12, 80), g.integers(1, 12, 80)
    rows = [(1, i, float(i), *map(int, b)) for i, b in enumerate(zip(x, y, x + w, y + h, strict=True))]
    df = spark.createDataFrame(rows, "tile_id long, key long, score double, x0 long, y0 long, x1 long, y1 long")
    df = df.withColumn("runs", runs.filled(F.array(rings.box_ring(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))), 40, 40)).withColumn("area", runs.size("runs"))
    got = {(r.pred_id, r.gt_id): r.iou for r in M.mask_candidates(df.drop("score"), df, 1601, 0.5).collect()}
    want = {}
    for _, i, _, *a in rows:
        for _, j, _, *b in rows:
            both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
            one = lambda q: (q[2] - q[0]) * (q[3] - q[1])
            want[i, j] = both / (one(a) + one(b) - both)
    assert {k: round(i, 9) for k, i in got.items() if i >= 0.5} == {k: round(i, 9) for k, i in want.items() if i >= 0.5}
    assert len(got) == sum(i >= 0.5 for i in want.values())  # of plain boxes the bound is exact


def test_rings_are_shuffled_once(spark):
    from gridlore.operators import outlines, polygons

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, 1, [ring]), (1, 2, [ring])], f"image long, id long, rings array<{outlines.POINTS}>")
    plan = polygons.bounding(polygons.sides(df, 9, 9), 9, 9)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1 and "Join" not in plan


def masks_follow_the_join(spark, name):
    """Masks are made once, after a join that shuffles numbers only."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line and "p_x0" in line]
    made = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    return len(joins) == 1 and "SortMergeJoin [tile_id" in plan[joins[0]] and len(made) == 1 and made[0] < joins[0]


def test_masks_of_boxes_are_never_broadcast(spark):
    assert masks_follow_the_join(spark, "j6_mask_greedy")


def test_masks_of_rings_equal_pixels(spark):
    import numpy as np

    from gridlore.functions import rings
    from gridlore.operators import matching as M

    g = np.random.default_rng(8)
    x, y, w, h = g.integers(0, 20, 60), g.integers(0, 20, 60), g.integers(0, 12, 60), g.integers(1, 12, 60)
    # Two rows a key with boxes of their own, so that a key does not stand for its rings.
    rows = [(i % 2, i // 4, float(i), *map(int, b)) for i, b in enumerate(zip(x, y, x + w, y + h, strict=True))]
    df = spark.createDataFrame(rows, "tile_id long, key long, score double, x0 long, y0 long, x1 long, y1 long")

    def drawn(n):
        x0, y0, x1, y1 = (F.col(n + c) for c in ("x0", "y0", "x1", "y1"))
        return F.array(rings.box_ring(x0, y0, x1, y1), rings.box_ring(x0, y0, x1, (y0 + y1) / 2))

    got = sorted((r.tile_id, r.score, r.gt_id, round(r.iou, 9)) for r in M.ring_candidates(df.drop("score"), df, drawn, 40).collect() if r.iou)  # empty masks share nothing
    want = []
    for t, _, score, *a in rows:
        for u, key, _, *b in rows:
            both = [max(min(a[i + 2], b[i + 2]) - max(a[i], b[i]), 0) for i in (0, 1)]
            if t == u and all(both):
                one = lambda q: (q[2] - q[0]) * (q[3] - q[1])
                n = both[0] * both[1]
                want.append((t, score, key, round(n / (one(a) + one(b) - n), 9)))
    assert got == sorted(want) and len(got) > 100


def test_masks_of_several_rings_are_never_broadcast(spark):
    assert masks_follow_the_join(spark, "j6_true_masks")


def test_rings_are_not_made_again_for_filters(spark):
    for name in ("g1_fit_to_frame", "g1_reasons"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [line for line in plan if ("Filter" in line or "FileScan" in line) and "struct(x" in line]
        assert sum("explode(" in line for line in plan) == 1
