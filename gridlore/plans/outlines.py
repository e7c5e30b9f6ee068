"""Queries on outlines of masks, repaired and clipped polygons, and masks of several rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import rings, runs
from gridlore.functions.numeric import r6
from gridlore.operators import matching as M
from gridlore.operators import outlines as O
from gridlore.operators import polygons
from gridlore.operators import raster as R
from gridlore.plans.cut import cut
from gridlore.plans.rasters import COMP, SIZES, components
from gridlore.plans.registry import Registry
from gridlore.plans.views import greedy_sql, sql

reg = Registry()

#: Of each 2 x 2 window over a tile and a frame around it: how many pixels are set, and whether they are a diagonal pair.
QUADS = """SELECT tile, a + b + c + d AS n, a + d = 2 AND b + c = 0 OR b + c = 2 AND a + d = 0 AS diagonal FROM (
    SELECT t.tile, coalesce(max(CASE WHEN m.r = i - 1 AND m.c = j - 1 THEN 1 END), 0) AS a, coalesce(max(CASE WHEN m.r = i - 1 AND m.c = j THEN 1 END), 0) AS b,
        coalesce(max(CASE WHEN m.r = i AND m.c = j - 1 THEN 1 END), 0) AS c, coalesce(max(CASE WHEN m.r = i AND m.c = j THEN 1 END), 0) AS d
    FROM (SELECT DISTINCT tile FROM pixels WHERE v > 0) t, (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 9)) AS j)
    LEFT JOIN (SELECT tile, r, c FROM pixels WHERE v > 0) m ON m.tile = t.tile AND m.r BETWEEN i - 1 AND i AND m.c BETWEEN j - 1 AND j GROUP BY t.tile, i, j)"""


def mask(v):
    return v.pixels().where("v > 0").select("tile", "r", "c")


@reg("g5_mask_rings", sql("""SELECT q.tile, outers, outers - euler AS holes, corners, area, length, 0::BIGINT AS differ FROM
    (SELECT tile, CAST((count(*) FILTER (n = 1) - count(*) FILTER (n = 3) - 2 * count(*) FILTER (diagonal)) / 4 AS BIGINT) AS euler,
        count(*) FILTER (n = 1 OR n = 3) + 2 * count(*) FILTER (diagonal) AS corners FROM quads GROUP BY tile) q
    JOIN (SELECT tile, count(DISTINCT component) AS outers, count(*)::DOUBLE AS area FROM lab GROUP BY tile) l ON l.tile = q.tile
    JOIN (SELECT a.tile, 4 * count(DISTINCT (a.r, a.c)) - count(b.tile) AS length FROM pixels a LEFT JOIN pixels b ON b.v > 0 AND a.tile = b.tile AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.v > 0 GROUP BY a.tile) p ON p.tile = q.tile""",
    "pixels", extra={k: q.replace("0.12", "0") for k, q in COMP.items()} | {"quads": QUADS}))
def g5(v):
    """Polygons of a mask a tile: their number, holes, corners, area and length, and pixels that filling them again gets wrong.

    SQL has them from 2 x 2 windows: Euler's number, convex and concave corners, and sides without a neighbour."""
    found = cut(O.rings(mask(v), ["tile"]).drop("border"))  # met four times below
    nested = O.polygons(found, ["tile"])
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    length = F.aggregate(F.zip_with("points", after, lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, x: s + x)
    sizes = found.groupBy("tile").agg(F.sum(F.size("points")).cast("long").alias("corners"), F.sum(length).cast("long").alias("length"))
    shape = nested.groupBy("tile").agg(F.count(F.lit(1)).alias("outers"), F.sum(F.size("holes")).cast("long").alias("holes"), F.sum("area").alias("area"))
    wrong = O.refilled(found, ["tile"], v.pixels().select("tile", "r", "c", (F.col("v") > 0).alias("m"))).groupBy("tile").agg(F.count_if(F.col("filled") != F.col("m")).alias("differ"))
    return shape.join(sizes, "tile").join(wrong, "tile").select("tile", "outers", "holes", "corners", "area", "length", "differ")


@reg("g6_external_contours", sql("SELECT tile, CAST(component AS BIGINT) AS component, min(id % 8)::DOUBLE AS x0, min(id // 8)::DOUBLE AS y0, max(id % 8)::DOUBLE AS x1, max(id // 8)::DOUBLE AS y1, 1::BIGINT AS n FROM lab GROUP BY ALL", "pixels", extra=COMP))
def g6(v):
    """One outer border a component, through pixel centres: its bounds are the component's."""
    one = O.contours(components(v))
    ends = lambda f, c: f(F.transform("points", lambda p: p[c]))
    rows = one.select("tile", "component", ends(F.array_min, "x").alias("x0"), ends(F.array_min, "y").alias("y0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"))
    return rows.groupBy("tile", "component", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))


@reg("g6_dropped_contours")
def g6_dropped(v):
    """How many borders are kept, and how many dropped for which reason."""
    return O.contours(R.label_components(mask(v), 8, 8)).groupBy(F.coalesce("dropped", F.lit("kept")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def odd_shapes(v):
    """Rings of every kind from the boxes: plain, crossing itself, open at the top, and traced out and back. Shifted, so that some leave the frame."""
    x0, y0, x1, y1 = (F.col(n) - 50 for n in ("x0", "y0", "x1", "y1"))
    xm, ym = x0 + F.floor(F.col("w") / 2), y0 + F.floor(F.col("h") / 2)
    shape = F.col("gt_id") % 4
    box = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    eight = [(x0, y0), (xm, y0), (xm, y1), (x1, y1), (x1, ym), (x0, ym)]
    open_ = [(x0, y0), (x0 + 4, y0), (x0 + 4, y1 - 4), (x1 - 4, y1 - 4), (x1 - 4, y0), (x1, y0), (x1, y1), (x0, y1)]
    spur = [*box, (x0, ym), (x0 - 5, ym), (x0, ym)]
    ring = lambda points: F.array(rings.ring(*points))
    of = F.when(F.col("gt_id") % 101 == 7, None).when(shape == 0, ring(box)).when(shape == 1, ring(eight)).when(shape == 2, ring(open_)).otherwise(ring(spur))
    return v.gt().select(F.col("tile_id").alias("image"), F.col("gt_id").alias("id"), of.alias("rings"))


CLIPPED = """SELECT gt_id, shape, a, ax0, ay0, ax1, ay1 FROM (
    SELECT gt_id, shape, greatest(ax1 - ax0, 0) * greatest(ay1 - ay0, 0) AS a, ax0, ay0, ax1, ay1 FROM (
    SELECT gt_id, shape, greatest(bx0 - 50, 0) AS ax0, greatest(by0 - 50, 0) AS ay0, least(bx1 - 50, 350) AS ax1, least(by1 - 50, 350) AS ay1 FROM (
        SELECT gt_id, gt_id % 4 AS shape, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM gt WHERE gt_id % 4 IN (0, 3)
        UNION ALL SELECT gt_id, 1, x0, y0, x0 + w // 2, y0 + h // 2 FROM gt WHERE gt_id % 4 = 1
        UNION ALL SELECT gt_id, 1, x0 + w // 2, y0 + h // 2, x1, y1 FROM gt WHERE gt_id % 4 = 1
        UNION ALL SELECT gt_id, 2, x0, y0, x0 + 4, y1 - 4 FROM gt WHERE gt_id % 4 = 2
        UNION ALL SELECT gt_id, 2, x1 - 4, y0, x1, y1 - 4 FROM gt WHERE gt_id % 4 = 2
        UNION ALL SELECT gt_id, 4, x0, y1 - 4, x1, y1 FROM gt WHERE gt_id % 4 = 2) WHERE gt_id % 101 <> 7)) WHERE a > 0"""
#: An open shape whose base shows is one piece, with its legs.
WHOLE = """SELECT gt_id, sum(a) AS a, min(ax0) AS x0, min(ay0) AS y0, max(ax1) AS x1, max(ay1) AS y1 FROM clipped WHERE gt_id IN (SELECT gt_id FROM clipped WHERE shape = 4) GROUP BY gt_id
    UNION ALL SELECT gt_id, a, ax0, ay0, ax1, ay1 FROM clipped WHERE gt_id NOT IN (SELECT gt_id FROM clipped WHERE shape = 4)"""
SHAPES = {"clipped": CLIPPED, "whole": WHOLE}


def fitted(v):
    return polygons.fit_to_frame(odd_shapes(v), 350, 350)


@reg("g1_fit_to_frame", sql("SELECT gt_id, count(a) AS pieces, coalesce(sum(a), 0)::DOUBLE AS area, min(w.x0)::DOUBLE AS x0, min(w.y0)::DOUBLE AS y0, max(w.x1)::DOUBLE AS x1, max(w.y1)::DOUBLE AS y1 FROM gt LEFT JOIN (SELECT gt_id AS id, a, x0, y0, x1, y1 FROM whole WHERE a > 1) w ON id = gt_id GROUP BY gt_id", "gt", extra=SHAPES))
def g1_fit(v):
    return fitted(v).select(F.col("id").alias("gt_id"), F.size("pieces").cast("long").alias("pieces"), "area", "x0", "y0", "x1", "y1")


@reg("g1_reasons", sql("""SELECT unnest(['null_geometry', 'repaired', 'outside', 'split', 'dropped', 'slivers']) AS reason, unnest([count(*) FILTER (gt_id % 101 = 7), count(*) FILTER (gt_id % 101 <> 7 AND gt_id % 4 IN (1, 3)),
        count(*) FILTER (gt_id % 101 <> 7 AND n IS NULL), count(*) FILTER (k > 1), count(*) FILTER (coalesce(k, 0) = 0), CAST(coalesce(sum(n - k), 0) AS BIGINT)]) AS n
    FROM gt LEFT JOIN (SELECT gt_id AS id, count(*) AS n, count(*) FILTER (a > 1) AS k FROM whole GROUP BY gt_id) ON id = gt_id""", "gt", extra=SHAPES))  # fmt: skip
def g1_why(v):
    return polygons.reasons(fitted(v))


def instances(df, key: str, shape):
    """tile_id, key, score if there is one, shape and bounds of masks of several rings from boxes."""
    bounds = [(F.col(n) + by).alias(n) for n, by in (("x0", 16), ("y0", 16), ("x1", 20), ("y1", 20))]
    return df.select("tile_id", F.col(key).alias("key"), *[c for c in ("score",) if c in df.columns], *bounds, shape.alias("shape"))


def drawn(side: str):
    """Rings of an instance: one box, a ring that crosses itself, or two boxes that overlap, which are one instance."""
    x0, y0, x1, y1 = (F.col(f"{side}{n}") - by for n, by in (("x0", 0), ("y0", 0), ("x1", 4), ("y1", 4)))
    xm, ym = x0 + F.floor((x1 - x0) / 2), y0 + F.floor((y1 - y0) / 2)
    box = rings.box_ring(x0, y0, x1, y1)
    eight = rings.ring((x0, y0), (xm, y0), (xm, y1), (x1, y1), (x1, ym), (x0, ym))
    two = F.array(box, rings.box_ring(x0 + 4, y0 + 4, x1 + 4, y1 + 4))
    return F.when(F.col(f"{side}shape") == 0, F.array(box)).when(F.col(f"{side}shape") == 1, F.array(eight)).otherwise(two)


SIZE = 512
PARTS = """SELECT tile_id, id, score, x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1 FROM {0} WHERE shape = 0
    UNION ALL SELECT tile_id, id, score, x0, y0, x0 + (x1 - x0) // 2, y0 + (y1 - y0) // 2 FROM {0} WHERE shape = 1
    UNION ALL SELECT tile_id, id, score, x0 + (x1 - x0) // 2, y0 + (y1 - y0) // 2, x1, y1 FROM {0} WHERE shape = 1
    UNION ALL SELECT tile_id, id, score, unnest([x0, x1, x0 + 4]), unnest([y0, y0 + 4, y1]), unnest([x1, x1 + 4, x1]), unnest([y1, y1 + 4, y1 + 4]) FROM {0} WHERE shape = 2"""
MASKS = {
    "gs": "SELECT tile_id, gt_id AS id, 1.0 AS score, x0, y0, x1, y1, gt_id % 3 AS shape FROM gt", "ps": "SELECT tile_id, pred_id AS id, score, x0, y0, x1, y1, pred_id // 8 % 3 AS shape FROM pred",
    "gb": PARTS.format("gs"), "pb": PARTS.format("ps"),
    "ga": "SELECT id, sum((a1 - a0) * (b1 - b0)) AS area FROM gb GROUP BY id", "pa": "SELECT id, sum((a1 - a0) * (b1 - b0)) AS area FROM pb GROUP BY id",
    "cand": """SELECT tile_id, pred_id, score, 0 AS pred_cls, gt_id, inter / (pa.area + ga.area - inter)::DOUBLE AS iou FROM (
        SELECT p.tile_id, p.id AS pred_id, any_value(p.score) AS score, g.id AS gt_id, sum(greatest(least(p.a1, g.a1) - greatest(p.a0, g.a0), 0) * greatest(least(p.b1, g.b1) - greatest(p.b0, g.b0), 0)) AS inter
        FROM pb p JOIN gb g ON p.tile_id = g.tile_id AND p.a0 < g.a1 AND g.a0 < p.a1 AND p.b0 < g.b1 AND g.b0 < p.b1 GROUP BY ALL) JOIN pa ON pa.id = pred_id JOIN ga ON ga.id = gt_id""",
}


@reg("j6_true_masks", sql("SELECT tile_id, pred_id, gt_id, round(iou, 6) AS iou FROM m", "gt", "pred", extra=MASKS | greedy_sql()[1]))
def j6(v):
    """Greedy matches by the IoU of masks that are no boxes: boxes only choose the pairs whose masks are made and compared."""
    g, p = instances(v.gt(), "gt_id", F.col("gt_id") % 3), instances(v.pred(), "pred_id", F.floor(F.col("pred_id") / 8) % 3)
    cand = M.ring_candidates(g, p, drawn, SIZE)
    return M.greedy(cand, ["tile_id"], 0.5).select("tile_id", "pred_id", "gt_id", r6(F.col("iou")).alias("iou"))


@reg("g4_polygon_fill", sql("SELECT gt_id, coalesce(CAST(sum(a) AS BIGINT), 0) AS pixels FROM gt LEFT JOIN (SELECT gt_id AS id, a FROM clipped) ON id = gt_id WHERE gt_id % 101 <> 7 GROUP BY gt_id", "gt", extra=SHAPES))
def g4(v):
    """Pixels of rings that cross, retrace or leave the frame, filled in one pass over each batch."""
    return odd_shapes(v).where("rings is not null").select(F.col("id").alias("gt_id"), runs.size(runs.filled("rings", 350, 350)).alias("pixels"))


class Annotations:
    """Annotations of a tile from its labelled pixels (tile, r, c, component): a table function over TABLE(...) PARTITION BY tile.

    A tile's rows come one after another; its annotations are yielded when they end."""

    def __init__(self):
        self.parts = {}

    def eval(self, row):
        self.parts.setdefault((row["tile"], row["component"]), []).append((row["r"], row["c"]))

    def terminate(self):
        import numpy as np

        from gridlore.functions import chains
        from gridlore.operators.outlines import WAYS

        for (tile, component), own in sorted(self.parts.items()):
            if len(own) < 2:
                continue
            r, c = np.array(own).T
            grid = np.zeros((r.max() - r.min() + 3, c.max() - c.min() + 3), bool)
            grid[r - r.min() + 1, c - c.min() + 1] = True
            sides = [(grid & ~np.roll(grid, d, axis), way) for way, (d, axis) in enumerate(((1, 0), (-1, 1), (-1, 0), (1, 1)))]
            corner = ((0, 0), (1, 0), (1, 1), (0, 1))
            start = np.concatenate([np.argwhere(m)[:, ::-1] + corner[way] for m, way in sides])
            way = np.concatenate([np.full(m.sum(), w) for m, w in sides])
            order, begins = chains.loops(start, start + WAYS[way], True)
            points, first = chains.corners(start[order], begins)
            shift = np.array([c.min() - 1, r.min() - 1])
            rings = [(p + shift).ravel().tolist() for p in np.split(points, first[1:])]
            yield tile, component, len(own), int(c.min()), int(r.min()), int(c.max() - c.min() + 1), int(r.max() - r.min() + 1), rings


@reg("e8_table_function", sql("SELECT cs.tile, CAST(cs.component AS BIGINT) AS component, cs.n AS area, CAST(c0 AS INTEGER) AS x, CAST(r0 AS INTEGER) AS y, CAST(c1 - c0 + 1 AS INTEGER) AS w, CAST(r1 - r0 + 1 AS INTEGER) AS h, cs.n::DOUBLE AS ring_area FROM cs WHERE n >= 2", "pixels", extra=SIZES))
def e8(v):
    """One tile to many annotations with their rings: areas by the rings equal the pixels'."""
    v.spark.udtf.register("annotations", F.udtf(Annotations, returnType="tile: bigint, component: bigint, area: bigint, x: int, y: int, w: int, h: int, rings: array<array<int>>"))
    found = v.spark.sql("SELECT * FROM annotations(TABLE({labels}) PARTITION BY tile)", labels=components(v))
    points = lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), lambda i: F.struct(F.get(r, 2 * i).cast("double").alias("x"), F.get(r, 2 * i + 1).cast("double").alias("y")))
    signed = lambda p: F.aggregate(F.zip_with(p, rings.rolled(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, t: s + t) / 2
    area = F.aggregate(F.transform("rings", lambda r: signed(points(r))), F.lit(0.0), lambda s, t: s + t)
    return found.select("tile", "component", "area", "x", "y", "w", "h", area.alias("ring_area"))
