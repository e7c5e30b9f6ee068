"""Queries on rasters, rings and masks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions import rings, rle
from gridlore.functions.numeric import clip, r6, ranked, ratio
from gridlore.operators import raster as R
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql

reg = Registry()
n_ = lambda name="n": F.count(F.lit(1)).alias(name)


@reg("c5_block_mean", sql("SELECT tile, r // 4 AS br, c // 4 AS bc, round(avg(v), 6) AS v FROM pixels GROUP BY ALL", "pixels"))
def c5(v, step: int = 4):
    return v.pixels().groupBy("tile", F.floor(F.col("r") / step).cast("int").alias("br"), F.floor(F.col("c") / step).cast("int").alias("bc")).agg(r6(F.avg("v")).alias("v"))


STRETCH = {"lim": "SELECT tile, quantile_cont(dn, 0.02) AS lo, quantile_cont(dn, 0.98) AS hi FROM dn WHERE dn > 0 GROUP BY tile",
           "byte": "SELECT tile, r, c, CAST(trunc(round(least(255, greatest(0, (dn - lo) * 255.0::DOUBLE / greatest(hi - lo, 1))), 6)) AS INTEGER) AS b FROM dn JOIN lim USING (tile)"}


def stretched(v):
    """Percentile stretch of each tile to a byte, truncated after six decimals; the span is one at least."""
    w = v.dn().where("dn > 0").groupBy("tile").agg(F.percentile("dn", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    b = r6(clip((F.col("dn") - lo) * 255.0 / F.greatest(hi - lo, F.lit(1.0)), 0.0, 255.0)).cast("int")
    return v.dn().join(w, "tile").select("tile", "r", "c", b.alias("b"))


@reg("r1_percentile_stretch", sql("SELECT * FROM byte", "dn", extra=STRETCH))
def r1(v):
    return stretched(v)


RGB = {"rgb": "SELECT tile, r, c // 3 AS k, max(dn) FILTER (c % 3 = 0) % 256 AS red, max(dn) FILTER (c % 3 = 1) % 256 AS green, max(dn) FILTER (c % 3 = 2) % 256 AS blue FROM dn WHERE c < 6 GROUP BY ALL"}


def rgb(v):
    band = lambda i, n: (F.max(F.when(F.col("c") % 3 == i, F.col("dn"))) % 256).alias(n)
    return v.dn().where("c < 6").groupBy("tile", "r", F.floor(F.col("c") / 3).cast("int").alias("k")).agg(band(0, "red"), band(1, "green"), band(2, "blue"))


@reg("r2_grey_half_even", sql("SELECT tile, r, k, CAST(round_even((red + green + blue) / 3.0::DOUBLE, 0) AS INTEGER) AS grey FROM rgb", "dn", extra=RGB))
def r2(v):
    return rgb(v).select("tile", "r", "k", F.rint((F.col("red") + F.col("green") + F.col("blue")) / 3).cast("int").alias("grey"))


@reg("r3_luma", sql("SELECT tile, r, k, round(0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue, 6) AS luma FROM rgb", "dn", extra=RGB))
def r3(v):
    return rgb(v).select("tile", "r", "k", r6(0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue")).alias("luma"))


HSV = RGB | {"hs": """SELECT tile, r, k, CASE WHEN hi = lo THEN 0 ELSE ((60 * CASE WHEN hi = red THEN (green - blue) / (hi - lo)::DOUBLE WHEN hi = green THEN (blue - red) / (hi - lo)::DOUBLE + 2 ELSE (red - green) / (hi - lo)::DOUBLE + 4 END) % 360 + 360) % 360 END AS hue,
    CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0 END AS sat, hi / 255.0::DOUBLE AS val FROM (SELECT *, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo FROM rgb)"""}


def in_hsv(v):
    return rgb(v).select("tile", "r", "k", *R.hsv(F.col("red"), F.col("green"), F.col("blue"))).withColumn("val", F.col("val") / 255.0)


@reg("r4_hsv", sql("SELECT tile, r, k, round(hue, 4) AS hue, round(sat, 6) AS sat, round(val, 6) AS val FROM hs", "dn", extra=HSV))
def r4(v):
    return in_hsv(v).select("tile", "r", "k", F.round("hue", 4).alias("hue"), r6(F.col("sat")).alias("sat"), r6(F.col("val")).alias("val"))


@reg("p7_saturation_gate", sql("SELECT tile, count(*) AS n, round(avg(val), 6) AS val FROM hs WHERE sat > 0.05 GROUP BY tile HAVING count(*) >= 14", "dn", extra=HSV))
def p7(v):
    return in_hsv(v).where("sat > 0.05").groupBy("tile").agg(n_(), r6(F.avg("val")).alias("val")).where("n >= 14")


@reg("p6_nodata_exclusion", sql("SELECT tile, count(*) AS n FROM rgb WHERE red > 0 AND green > 0 AND blue > 0 GROUP BY tile", "dn", extra=RGB))
def p6(v):
    return rgb(v).where("red > 0 and green > 0 and blue > 0").groupBy("tile").agg(n_())


MASK = {"mk": "SELECT tile, r, c, dn, CAST(v > 0.05 AS INTEGER) AS m FROM dn",
        "dil": "SELECT a.tile, a.r, a.c, any_value(a.dn) AS dn, any_value(a.m) AS m, max(b.m) AS d, min(b.m) AS e FROM mk a JOIN mk b ON a.tile = b.tile AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL"}


def masked(v):
    return v.dn().select("tile", "r", "c", "dn", (F.col("v") > 0.05).cast("int").alias("m"))


def morphed(v):
    return R.spread3(R.spread3(masked(v), "m", "d"), "m", "e", erode=True)


@reg("r5_dilate_erode", sql("SELECT tile, r, c, d AS dilated, e AS eroded FROM dil", "dn", extra=MASK))
def r5(v):
    return morphed(v).select("tile", "r", "c", F.col("d").alias("dilated"), F.col("e").alias("eroded"))


@reg("a11_boundary_contrast", sql("SELECT tile, round(coalesce(abs(avg(dn) FILTER (m = 1 AND e = 0) - avg(dn) FILTER (m = 0 AND d = 1)), 0), 6) AS contrast, round(avg(CAST(dn < lim AS INTEGER)) FILTER (m = 0 AND d = 1), 6) AS shadow FROM (SELECT *, avg(dn) OVER (PARTITION BY tile) - stddev_pop(dn) OVER (PARTITION BY tile) AS lim FROM dil) GROUP BY tile", "dn", extra=MASK))
def a11(v):
    w = Window.partitionBy("tile")
    p = morphed(v).withColumn("lim", F.avg("dn").over(w) - F.stddev_pop("dn").over(w))
    inner, outer = (F.col("m") == 1) & (F.col("e") == 0), (F.col("m") == 0) & (F.col("d") == 1)
    on = lambda c, x: F.avg(F.when(c, x))
    return p.groupBy("tile").agg(r6(F.coalesce(F.abs(on(inner, F.col("dn")) - on(outer, F.col("dn"))), F.lit(0.0))).alias("contrast"), r6(on(outer, (F.col("dn") < F.col("lim")).cast("int"))).alias("shadow"))


COMP = {"px": "SELECT tile, r, c, r * 8 + c AS id FROM pixels WHERE v > 0.12",
        "nb": "SELECT a.tile, a.id AS a, b.id AS b FROM px a JOIN px b ON a.tile = b.tile AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1",
        "reach": "SELECT tile, id AS a, id AS root FROM px UNION SELECT n.tile, n.b, s.root FROM reach s JOIN nb n ON n.tile = s.tile AND n.a = s.a WHERE s.root < n.b",
        "lab": "SELECT tile, a AS id, min(root) AS component FROM reach GROUP BY ALL"}


def components(v):
    return R.label_components(v.pixels().where("v > 0.12"), 8, 8)


@reg("r6_component_labels", sql("SELECT tile, CAST(id // 8 AS INTEGER) AS r, CAST(id % 8 AS INTEGER) AS c, CAST(component AS BIGINT) AS component FROM lab", "pixels", extra=COMP))
def r6_labels(v):
    return components(v)


SIZES = COMP | {"cs": "SELECT tile, component, count(*) AS n, min(id // 8) AS r0, max(id // 8) AS r1, min(id % 8) AS c0, max(id % 8) AS c1 FROM lab GROUP BY ALL"}


@reg("e8_tile_to_annotations", sql("SELECT tile, CAST(component AS BIGINT) AS component, n AS area, CAST(r0 AS INTEGER) AS r0, CAST(r1 AS INTEGER) AS r1, CAST(c0 AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1, r0 = 0 OR c0 = 0 OR r1 = 7 OR c1 = 7 AS edge_touching FROM cs WHERE n >= 2", "pixels", extra=SIZES))
def e8(v, min_area: int = 2):
    g = components(v).groupBy("tile", "component").agg(n_("area"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    edge = (F.col("r0") == 0) | (F.col("c0") == 0) | (F.col("r1") == 7) | (F.col("c1") == 7)
    return g.where(F.col("area") >= min_area).withColumn("edge_touching", edge)


@reg("p3_edge_touching", sql("SELECT gt_id, x0 = 0 OR y0 = 0 OR x1 >= 479 OR y1 >= 479 AS edge FROM gt", "gt"))
def p3(v):
    return v.gt().select("gt_id", F.expr("x0 = 0 or y0 = 0 or x1 >= 479 or y1 >= 479").alias("edge"))


@reg("p4_drop_edge_keep_tiles", sql("SELECT tile_id, count(gt_id) AS n FROM tiles LEFT JOIN (SELECT * FROM gt WHERE NOT (x0 = 0 OR y0 = 0 OR x1 >= 479 OR y1 >= 479)) USING (tile_id) GROUP BY tile_id", "tiles"))
def p4(v):
    g = v.gt().where("not (x0 = 0 or y0 = 0 or x1 >= 479 or y1 >= 479)").groupBy("tile_id").agg(n_())
    return v.tiles().join(g, "tile_id", "left").select("tile_id", F.coalesce("n", F.lit(0)).alias("n"))


@reg("a33_empty_tile_triage", sql("SELECT state, count(*) AS n FROM (SELECT t.tile, CASE WHEN any_value(t.tile) % 17 = 0 THEN 'missing' WHEN count(cs.tile) = 0 THEN 'empty' WHEN max(cs.n) < 6 THEN 'all_small' ELSE 'usable' END AS state FROM (SELECT DISTINCT tile FROM pixels) t LEFT JOIN cs ON cs.tile = t.tile GROUP BY t.tile) GROUP BY state", "pixels", extra=SIZES))
def a33(v):
    c = components(v).groupBy("tile", "component").agg(n_()).groupBy("tile").agg(F.max("n").alias("top"))
    state = F.when(F.col("tile") % 17 == 0, "missing").when(F.col("top").isNull(), "empty").when(F.col("top") < 6, "all_small").otherwise("usable")
    return v.pixels().select("tile").distinct().join(c, "tile", "left").groupBy(state.alias("state")).agg(n_())


DIRS = ", ".join(f"({d}, {k}, {i}, {j})" for d, k, i, j in [(0, 1, -1, 0), (0, 2, -2, 0), (1, 1, 0, 1), (1, 2, 0, 2), (2, 1, 1, 0), (2, 2, 2, 0), (3, 1, 0, -1), (3, 2, 0, -2)])


@reg("r8_sky_view", sql(f"""SELECT tile, r, c, round(1 - avg(sin(greatest(atan(t), 0))), 6) AS svf, round(avg(90 - degrees(atan(t))), 4) AS openness FROM (
    SELECT a.tile, a.r, a.c, d, max((b.v - a.v) / (k * 0.5::DOUBLE)) AS t FROM pixels a CROSS JOIN (VALUES {DIRS}) s(d, k, i, j) JOIN pixels b ON b.tile = a.tile AND b.r = least(greatest(a.r + i, 0), 7) AND b.c = least(greatest(a.c + j, 0), 7) GROUP BY ALL) GROUP BY ALL""", "pixels"))
def r8(v):
    return R.horizon(v.pixels(), 8, 8, 0.5, 4, 2).select("tile", "r", "c", r6(F.col("svf")).alias("svf"), F.round("openness", 4).alias("openness"))


GRAD = "CASE WHEN lag(v) OVER {0} IS NULL THEN lead(v) OVER {0} - v WHEN lead(v) OVER {0} IS NULL THEN v - lag(v) OVER {0} ELSE (lead(v) OVER {0} - lag(v) OVER {0}) / 2 END / 0.5"


@reg("r9_slope", sql(f"SELECT tile, r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS slope FROM (SELECT tile, r, c, {GRAD.format('y')} AS dy, {GRAD.format('x')} AS dx FROM pixels WINDOW y AS (PARTITION BY tile, c ORDER BY r), x AS (PARTITION BY tile, r ORDER BY c))", "pixels"))
def r9(v):
    return R.slope(v.pixels(), 0.5).select("tile", "r", "c", F.round("slope", 4).alias("slope"))


@reg("r10_fixed_stretch", sql("SELECT tile, r, c, CAST(trunc(least(255, greatest(0, (abs(v) * 100 - 0) / (50 - 0)::DOUBLE * 255))) AS INTEGER) AS plain, 255 - CAST(trunc(least(255, greatest(0, (abs(v) * 100 - 0) / (50 - 0)::DOUBLE * 255))) AS INTEGER) AS inverted FROM pixels", "pixels"))
def r10(v, low: float = 0.0, high: float = 50.0):
    b = clip((F.abs("v") * 100 - low) / (high - low) * 255, 0.0, 255.0).cast("int")
    return v.pixels().select("tile", "r", "c", b.alias("plain"), (255 - b).alias("inverted"))


#: What each band's bytes stand for: least and greatest value, and whether they run backwards.
SCALES = {"svf": (0.7, 1.0, False), "openness": (68.0, 93.0, False), "slope": (0.0, 50.0, True)}
IMPLIED = " UNION ALL ".join(f"SELECT tile, r, c, '{k}' AS band, round({f'{hi}::DOUBLE - dn % 256 / 255.0::DOUBLE * {hi - lo}' if inv else f'{lo}::DOUBLE + dn % 256 / 255.0::DOUBLE * {hi - lo}'}, 4) AS physical FROM dn" for k, (lo, hi, inv) in SCALES.items())


@reg("r10_implied_physical", sql(IMPLIED, "dn"))
def r10_inverse(v):
    """The values that the bytes of stretched bands imply."""
    part = lambda lo, hi: F.col("dn") % 256 / 255.0 * (hi - lo)
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.round(hi - part(lo, hi) if inv else lo + part(lo, hi), 4).alias("physical")) for k, (lo, hi, inv) in SCALES.items()])
    return v.dn().select("tile", "r", "c", F.inline(bands))


@reg("r11_mean_sd_match", sql("SELECT tile, r, c, round(CASE WHEN s > 1e-3 THEN (v - m) / s * 40 + 128 ELSE v END, 6) AS matched FROM (SELECT *, avg(v) OVER (PARTITION BY tile) AS m, stddev_pop(v) OVER (PARTITION BY tile) AS s FROM pixels)", "pixels"))
def r11(v, mean: float = 128.0, sd: float = 40.0):
    w = Window.partitionBy("tile")
    m, s = F.avg("v").over(w), F.stddev_pop("v").over(w)
    return v.pixels().select("tile", "r", "c", r6(F.when(s > 1e-3, F.try_divide(F.col("v") - m, s) * sd + mean).otherwise(F.col("v"))).alias("matched"))


WIN = {"tl": "SELECT unnest([0, 3, 6]) AS t0", "wn": "SELECT tile, a.t0 AS tr, b.t0 AS tc, count(*) AS n, count(*) FILTER (dn > 40) AS valid FROM dn JOIN tl a ON r >= a.t0 AND r < a.t0 + 4 JOIN tl b ON c >= b.t0 AND c < b.t0 + 4 GROUP BY ALL"}


def windows(v):
    """Windows of four pixels with an overlap of one; a pixel is dealt to those that hold it."""
    at = lambda x: F.filter(F.array(F.lit(0), F.lit(3), F.lit(6)), lambda t: (F.col(x) >= t) & (F.col(x) < t + 4))
    p = v.dn().withColumn("tr", F.explode(at("r"))).withColumn("tc", F.explode(at("c")))
    return p.groupBy("tile", "tr", "tc").agg(n_(), F.count_if(F.col("dn") > 40).alias("valid"))


@reg("r12_ground_tiling", sql("SELECT * FROM wn", "dn", extra=WIN))
def r12(v):
    return windows(v)


@reg("p8_validity_fraction", sql("SELECT tile, tr, tc FROM wn WHERE valid >= 0.15 * n AND n >= 8", "dn", extra=WIN))
def p8(v):
    return windows(v).where("valid >= 0.15 * n and n >= 8").select("tile", "tr", "tc")


@reg("p12_nodata_fraction", sql("SELECT tile, round(avg(CAST(dn < 10 AS INTEGER)), 6) AS fraction FROM dn GROUP BY tile HAVING avg(CAST(dn < 10 AS INTEGER)) < 0.02", "dn"))
def p12(v):
    f = v.dn().groupBy("tile").agg(F.avg((F.col("dn") < 10).cast("int")).alias("f")).where("f < 0.02")
    return f.select("tile", r6(F.col("f")).alias("fraction"))


@reg("r16_centroid_crop", sql("SELECT p.tile, p.r, p.c, p.dn FROM dn p JOIN (SELECT tile, CAST(trunc(avg(r)) AS INTEGER) AS cy, CAST(trunc(avg(c)) AS INTEGER) AS cx FROM dn WHERE v > 0.1 GROUP BY tile) q USING (tile) WHERE p.r BETWEEN greatest(0, cy - 2) AND least(7, cy + 1) AND p.c BETWEEN greatest(0, cx - 2) AND least(7, cx + 1)", "dn"))
def r16(v, half: int = 2):
    q = v.dn().where("v > 0.1").groupBy("tile").agg(F.avg("r").cast("int").alias("cy"), F.avg("c").cast("int").alias("cx"))
    near = lambda x, m: F.col(x).between(F.greatest(F.lit(0), F.col(m) - half), F.least(F.lit(7), F.col(m) + half - 1))
    return v.dn().join(q, "tile").where(near("r", "cy") & near("c", "cx")).select("tile", "r", "c", "dn")


@reg("j13_point_in_raster", sql("SELECT m.det_id FROM (SELECT det_id, (x0 + x1) // 2 % 8 AS c, (y0 + y1) // 2 % 8 AS r, det_id % (SELECT count(*) FROM ti) AS k FROM map_gt WHERE x0 >= 0) m JOIN ti USING (k) JOIN dn USING (tile, r, c) WHERE dn.v <= 0", "map_gt", "dn", extra={"ti": "SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS k FROM (SELECT DISTINCT tile FROM dn)"}))
def j13(v):
    """Detections fall on all rasters, by the rasters' gapless rank."""
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    t = ranked(v.dn().select("tile").distinct(), "tile")
    m = v.map_gt().where("x0 >= 0").crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("n"))))
    m = m.select("det_id", (mid("x0", "x1") % 8).cast("int").alias("c"), (mid("y0", "y1") % 8).cast("int").alias("r"), (F.col("det_id") % F.col("n")).alias("k"))
    return m.join(v.dn().where("v <= 0").join(t, "tile"), ["k", "r", "c"]).select("det_id")


IOU = {"cl": "SELECT unnest([1, 2, 3]) AS cls", "th": "SELECT unnest([0.05, 0.1])::DOUBLE AS t",
       "gp": "SELECT tile, cls, r, c FROM pixels, cl WHERE v > 0.04 * cls AND tile % 4 <> cls", "pp": "SELECT tile, cls, t, r, c FROM pixels, cl, th WHERE v > 0.04 * cls + t - 0.06 AND tile % 5 <> cls",
       "grid3": "SELECT DISTINCT tile, cls, t FROM pixels, cl, th",
       "iu": "SELECT g.tile, g.cls, g.t, coalesce(i, 0) AS i, coalesce(a, 0) + coalesce(b, 0) - coalesce(i, 0) AS u FROM grid3 g LEFT JOIN (SELECT tile, cls, count(*) AS a FROM gp GROUP BY ALL) x USING (tile, cls) LEFT JOIN (SELECT tile, cls, t, count(*) AS b FROM pp GROUP BY ALL) y USING (tile, cls, t) LEFT JOIN (SELECT tile, cls, t, count(*) AS i FROM pp JOIN gp USING (tile, cls, r, c) GROUP BY ALL) z USING (tile, cls, t)"}


@reg("m14_semantic_iou", sql("SELECT t, cls, round(CASE WHEN sum(u) > 0 THEN sum(i) / sum(u)::DOUBLE ELSE 0 END, 6) AS pooled, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u::DOUBLE END), 6) AS empty_is_hit, round(avg(CASE WHEN u > 0 THEN i / u::DOUBLE END), 6) AS without_empty FROM iu GROUP BY ALL", "pixels", extra=IOU))
def m14(v):
    """Intersection and union of every tile, class and threshold on a dense grid: one aggregate of a full join."""
    cls = v.spark.createDataFrame([(1,), (2,), (3,)], "cls int")
    thr = v.spark.createDataFrame([(0.05,), (0.1,)], "t double")
    p = v.pixels().select("tile", "r", "c", "v").crossJoin(F.broadcast(cls)).crossJoin(F.broadcast(thr))
    g = (F.col("v") > 0.04 * F.col("cls")) & (F.col("tile") % 4 != F.col("cls"))
    q = (F.col("v") > 0.04 * F.col("cls") + F.col("t") - 0.06) & (F.col("tile") % 5 != F.col("cls"))
    iu = p.groupBy("tile", "cls", "t").agg(F.count_if(g & q).alias("i"), F.count_if(g | q).alias("u"))
    each = F.try_divide("i", "u")
    return iu.groupBy("t", "cls").agg(r6(ratio(F.sum("i"), F.sum("u"))).alias("pooled"), r6(F.avg(F.coalesce(each, F.lit(1.0)))).alias("empty_is_hit"), r6(F.avg(each)).alias("without_empty"))


@reg("m14_overall", sql("SELECT t, round(avg(round(pooled, 6)), 6) AS overall FROM (SELECT t, cls, CASE WHEN sum(u) > 0 THEN sum(i) / sum(u)::DOUBLE ELSE 0 END AS pooled FROM iu GROUP BY ALL) GROUP BY t", "pixels", extra=IOU))
def m14_overall(v):
    return m14(v).groupBy("t").agg(r6(F.avg("pooled")).alias("overall"))


def outline(g):
    return rings.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


@reg("g2_shoelace", sql("SELECT gt_id, round(area::DOUBLE, 6) AS area, round(2.0::DOUBLE * (w + h), 6) AS perimeter FROM gt", "gt"))
def g2(v):
    return v.gt().select("gt_id", r6(rings.area(outline(v))).alias("area"), r6(rings.perimeter(outline(v))).alias("perimeter"))


@reg("s4_ring_bounds", sql("SELECT gt_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM gt", "gt"))
def s4(v):
    return v.gt().select("gt_id", outline(v).alias("ring")).select("gt_id", *rings.bounds(F.col("ring")))


@reg("g1_clip_to_frame", sql("SELECT gt_id, round(greatest(least(x1, 400) - greatest(x0, 50), 0) * greatest(least(y1, 400) - greatest(y0, 50), 0)::DOUBLE, 6) AS area FROM gt", "gt"))
def g1(v):
    return v.gt().select("gt_id", r6(rings.area(rings.clip(outline(v), 50, 50, 400, 400))).alias("area"))


@reg("p15_affine", sql("SELECT gt_id, round(0.5 * x0 + 300000, 6)::DOUBLE AS x, round(2000000 - 0.5 * y0, 6)::DOUBLE AS y FROM gt", "gt"))
def p15(v):
    ring = rings.affine(outline(v), 0.5, 0.0, 300000.0, 0.0, -0.5, 2000000.0)
    return v.gt().select("gt_id", ring[0].alias("p")).select("gt_id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@reg("g7_centroid", sql("SELECT gt_id, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, w * 0.5::DOUBLE AS w_m, h * 0.5::DOUBLE AS h_m, area * 0.25::DOUBLE AS area_m2 FROM gt", "gt"))
def g7(v, m: float = 0.5):
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    return v.gt().select("gt_id", mid("x0", "x1").alias("cx"), mid("y0", "y1").alias("cy"), (F.col("w") * m).alias("w_m"), (F.col("h") * m).alias("h_m"), (F.col("area") * m * m).alias("area_m2"))


@reg("g8_rot90", sql("SELECT gt_id, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 479 - x0 ELSE 479 - y0 END::DOUBLE AS x, CASE k WHEN 0 THEN y0 WHEN 1 THEN 479 - x0 WHEN 2 THEN 479 - y0 ELSE x0 END::DOUBLE AS y FROM gt, (SELECT unnest([0, 1, 2, 3]) AS k)", "gt"))
def g8(v):
    size = F.lit(480)
    turned = F.array(*[F.struct(F.lit(k).alias("k"), rings.rot90(outline(v), k, size, size)[0].alias("p")) for k in range(4)])
    return v.gt().select("gt_id", F.inline(turned)).select("gt_id", "k", "p.x", "p.y")


def masks(v):
    flat = F.transform(F.sort_array(F.collect_list(F.struct("r", "c", (F.col("v") > 0).alias("m")))), lambda x: x["m"])
    return v.pixels().groupBy("tile").agg(flat.alias("m"))


@reg("g3_rle_area", sql("SELECT tile, CAST(count(*) FILTER (v > 0) AS INTEGER) AS area FROM pixels GROUP BY tile", "pixels"))
def g3(v):
    """Area from the runs: every second one."""
    runs = masks(v).select("tile", rle.rle_encode_rows("m", F.lit(8), F.lit(8)).alias("k"))
    return runs.select("tile", F.aggregate(F.filter("k", lambda x, i: i % 2 == 1), F.lit(0), lambda s, x: s + x).alias("area"))


@reg("g3_rle_round_trip", sql("SELECT tile, TRUE AS same FROM pixels GROUP BY tile", "pixels"))
def g3_trip(v):
    k = masks(v).withColumn("k", rle.rle_encode_rows("m", F.lit(8), F.lit(8))).withColumn("t", rle.rle_text("k"))
    return k.select("tile", (rle.rle_decode_rows(rle.rle_from_text("t"), F.lit(8), F.lit(8)) == F.col("m")).alias("same"))


@reg("s7_inverted_mask", sql("SELECT tile, count(*) AS n FROM dn WHERE dn % 7 = 0 GROUP BY tile", "dn"))
def s7(v):
    """Object pixels of a mask in which the object is 0."""
    return v.dn().withColumn("mask", F.col("dn") % 7).where("mask = 0").groupBy("tile").agg(n_())


@reg("s8_dem_fill", sql("SELECT tile, r, c, round(CASE WHEN v > -0.1 THEN v ELSE m END, 6) AS v FROM dn JOIN (SELECT tile, median(v) AS m FROM dn WHERE v > -0.1 GROUP BY tile) USING (tile)", "dn"))
def s8(v, nodata: float = -0.1):
    m = v.dn().where(F.col("v") > nodata).groupBy("tile").agg(F.percentile("v", 0.5).alias("m"))
    return v.dn().join(m, "tile").select("tile", "r", "c", r6(F.when(F.col("v") > nodata, F.col("v")).otherwise(F.col("m"))).alias("v"))


@reg("a35_tile_features", sql("SELECT tile_id, n, round(ln(med), 6) AS log_median_area, round(n / 0.0576::DOUBLE, 6) AS density, round(hue, 4) AS hue FROM (SELECT tile_id, count(*) AS n, median(area)::DOUBLE AS med FROM gt GROUP BY tile_id) JOIN (SELECT tile AS tile_id, (degrees(atan2(avg(sin(radians(hue))), avg(cos(radians(hue))))) + 360) % 360 AS hue FROM hs WHERE sat > 0.05 GROUP BY tile) USING (tile_id)", "gt", "dn", extra=HSV))
def a35(v):
    g = v.gt().groupBy("tile_id").agg(n_(), F.percentile("area", 0.5).alias("med"))
    h = F.radians("hue")
    hue = in_hsv(v).where("sat > 0.05").groupBy(F.col("tile").alias("tile_id")).agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(h)), F.avg(F.cos(h)))), F.lit(360.0)).alias("hue"))
    return g.join(hue, "tile_id").select("tile_id", "n", r6(F.log("med")).alias("log_median_area"), r6(F.col("n") / 0.0576).alias("density"), F.round("hue", 4).alias("hue"))
