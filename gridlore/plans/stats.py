"""Queries on aggregates, significance and attribution, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions.numeric import prefix_sums, r6, ratio
from gridlore.functions.tdist import t_point_95, t_two_sided_p
from gridlore.operators.regression import Gram
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql

reg = Registry()
n_ = lambda name="n": F.count(F.lit(1)).alias(name)


@reg("a1_count_by_tile_class", sql("SELECT tile_id, cls, count(gt_id) AS n FROM tiles CROSS JOIN (SELECT unnest([1, 2, 3]) AS cls) LEFT JOIN gt USING (tile_id, cls) GROUP BY ALL", "tiles"))
def a1(v):
    dense = v.tiles().select("tile_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cls"))
    counts = v.gt().groupBy("tile_id", "cls").agg(n_())
    return dense.join(counts, ["tile_id", "cls"], "left").select("tile_id", "cls", F.coalesce("n", F.lit(0)).alias("n"))


@reg("a2_class_shares", sql("SELECT aoi, cls, n, round(n / sum(n) OVER (PARTITION BY cls)::DOUBLE, 6) AS share FROM (SELECT aoi, cls, count(*) AS n FROM gt JOIN tiles USING (tile_id) GROUP BY ALL)", "tiles"))
def a2(v):
    c = v.gt().join(v.tiles(), "tile_id").groupBy("aoi", "cls").agg(n_())
    total = c.groupBy("cls").agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(total), "cls").select("aoi", "cls", "n", r6(F.col("n") / F.col("t")).alias("share"))


@reg("a3_mean_sd_table", sql("SELECT arm, count(*) AS n, round(avg(metric), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_samp(metric), 6) END AS sd FROM runs GROUP BY arm", "runs"))
def a3(v):
    return v.runs().groupBy("arm").agg(n_(), r6(F.avg("metric")).alias("mean"), r6(F.when(F.count(F.lit(1)) > 1, F.stddev_samp("metric"))).alias("sd"))


@reg("a4_drop_reasons", sql("SELECT reason, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS pct FROM (SELECT CASE WHEN area < 200 THEN 'below_min_area' WHEN w <= 14 OR h <= 14 THEN 'sliver' WHEN x0 = 0 OR y0 = 0 THEN 'edge' ELSE 'kept' END AS reason FROM gt) GROUP BY reason", "gt"))
def a4(v):
    reason = F.when(F.col("area") < 200, "below_min_area").when((F.col("w") <= 14) | (F.col("h") <= 14), "sliver").when((F.col("x0") == 0) | (F.col("y0") == 0), "edge").otherwise("kept")
    c = v.gt().groupBy(reason.alias("reason")).agg(n_())
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("reason", "n", r6(100.0 * F.col("n") / F.col("t")).alias("pct"))


@reg("a5_exact_percentiles", sql("SELECT label, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.98), 6) AS p98 FROM pixels GROUP BY label", "pixels"))
def a5(v):
    p = v.pixels().groupBy("label").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("p"))
    return p.select("label", *[r6(F.col("p")[i]).alias(c) for i, c in enumerate(("p2", "p50", "p98"))])


HIST = "SELECT label, dn, count(*) AS n FROM dn WHERE dn > 0 GROUP BY ALL"


@reg("a6_histogram_percentile", sql(f"SELECT label, CAST(min(dn) FILTER (upto >= 0.02 * total) AS INTEGER) AS p2, CAST(min(dn) FILTER (upto >= 0.98 * total) AS INTEGER) AS p98, min(dn) AS low, max(dn) AS high, round(sum(dn * n) / sum(n)::DOUBLE, 6) AS mean FROM (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY dn) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM ({HIST})) GROUP BY label", "dn"))
def a6(v):
    """A histogram has a row a grey value, so the running sum is over a bounded table."""
    h = v.dn().where("dn > 0").groupBy("label", "dn").agg(n_())
    run = prefix_sums(h, ["label"], F.floor(F.col("dn") / 256), [F.col("dn")], {"upto": "n"})
    total = h.groupBy("label").agg(F.sum("n").alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("dn")))
    return run.join(F.broadcast(total), "label").groupBy("label").agg(at(0.02).alias("p2"), at(0.98).alias("p98"), F.min("dn").alias("low"), F.max("dn").alias("high"), r6(F.sum(F.col("dn") * F.col("n")) / F.sum("n")).alias("mean"))


@reg("w9_cdf_lookup", sql(f"SELECT label, dn, CAST(sum(n) OVER (PARTITION BY label ORDER BY dn) AS BIGINT) AS upto FROM ({HIST})", "dn"))
def w9(v):
    h = v.dn().where("dn > 0").groupBy("label", "dn").agg(n_())
    return prefix_sums(h, ["label"], F.floor(F.col("dn") / 256), [F.col("dn")], {"upto": "n"}).select("label", "dn", "upto")


@reg("a7_moments", sql("SELECT r AS band, count(*) AS n, round(avg(v), 6) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 6) AS sd, min(v) AS low, max(v) AS high FROM pixels GROUP BY r", "pixels"))
def a7(v):
    return v.pixels().groupBy(F.col("r").alias("band")).agg(n_(), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))


@reg("a8_tile_spread", sql("SELECT count(*) AS n, round(avg(lo), 6) AS mean_min, round(avg(hi), 6) AS mean_max, round(stddev_pop(m), 6) AS sd_mean, round(avg(CAST(lo < 20 AS INTEGER)), 6) AS pinned_low, CASE WHEN avg(CAST(lo < 20 AS INTEGER)) >= 0.9 THEN 'per_tile' WHEN avg(CAST(lo < 20 AS INTEGER)) >= 0.5 THEN 'mixed' ELSE 'global' END AS verdict FROM (SELECT tile, min(dn) AS lo, max(dn) AS hi, avg(dn) AS m FROM dn GROUP BY tile)", "dn"))
def a8(v):
    t = v.dn().groupBy("tile").agg(F.min("dn").alias("lo"), F.max("dn").alias("hi"), F.avg("dn").alias("m"))
    low = F.avg((F.col("lo") < 20).cast("int"))
    return t.agg(n_(), r6(F.avg("lo")).alias("mean_min"), r6(F.avg("hi")).alias("mean_max"), r6(F.stddev_pop("m")).alias("sd_mean"), r6(low).alias("pinned_low"), F.when(low >= 0.9, "per_tile").when(low >= 0.5, "mixed").otherwise("global").alias("verdict"))


CIRC = "SELECT tile, label, avg(sin(radians(d))) AS s, avg(cos(radians(d))) AS c FROM (SELECT tile, label, ((v * 360) % 360 + 360) % 360 AS d FROM pixels) GROUP BY ALL"
RBAR = "least(greatest(sqrt(s * s + c * c), 1e-9), 1 - 1e-12)"


def circular(v):
    d = F.radians(F.pmod(F.col("v") * 360, F.lit(360.0)))
    return v.pixels().groupBy("tile", "label").agg(F.avg(F.sin(d)).alias("s"), F.avg(F.cos(d)).alias("c"))


@reg("a9_circular_stats", sql(f"SELECT tile, round((degrees(atan2(s, c)) + 360) % 360, 6) AS mean, round(sqrt(s * s + c * c), 6) AS r, round(degrees(sqrt(-2 * ln({RBAR}))), 6) AS sd FROM ({CIRC})", "pixels"))
def a9(v):
    r = F.hypot("s", "c")
    held = F.least(F.greatest(r, F.lit(1e-9)), F.lit(1 - 1e-12))
    return circular(v).select("tile", r6(F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("mean"), r6(r).alias("r"), r6(F.degrees(F.sqrt(-2 * F.log(held)))).alias("sd"))


@reg("a9_circular_pooled", sql(f"SELECT label, round((degrees(atan2(avg(sin(a)), avg(cos(a)))) + 360) % 360, 6) AS hue FROM (SELECT label, atan2(s, c) AS a FROM ({CIRC})) GROUP BY label", "pixels"))
def a9_pooled(v):
    """The pooled hue is the circular mean of the tiles' means."""
    t = circular(v).withColumn("a", F.atan2("s", "c"))
    return t.groupBy("label").agg(r6(F.pmod(F.degrees(F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a")))), F.lit(360.0))).alias("hue"))


@reg("a10_cohen_d", sql("SELECT label, round((avg(mi) - avg(mo)) / sqrt((avg(vi) + avg(vo)) / 2), 6) AS d FROM (SELECT tile, label, avg(dn) FILTER (v > 0) AS mi, avg(dn) FILTER (v <= 0) AS mo, var_pop(dn) FILTER (v > 0) AS vi, var_pop(dn) FILTER (v <= 0) AS vo FROM dn GROUP BY ALL) GROUP BY label", "dn"))
def a10(v):
    inside = lambda f, yes: f(F.when(F.col("v") > 0 if yes else F.col("v") <= 0, F.col("dn")))
    t = v.dn().groupBy("tile", "label").agg(inside(F.avg, True).alias("mi"), inside(F.avg, False).alias("mo"), inside(F.var_pop, True).alias("vi"), inside(F.var_pop, False).alias("vo"))
    return t.groupBy("label").agg(r6((F.avg("mi") - F.avg("mo")) / F.sqrt((F.avg("vi") + F.avg("vo")) / 2)).alias("d"))


@reg("a12_size_mix", sql("SELECT aoi, round(100 * avg(CAST(area < 1024 AS INTEGER)), 6) AS small, round(100 * avg(CAST(area BETWEEN 1024 AND 9216 AS INTEGER)), 6) AS medium, round(100 * avg(CAST(area > 9216 AS INTEGER)), 6) AS large FROM gt JOIN tiles USING (tile_id) GROUP BY aoi", "tiles"))
def a12(v):
    pct = lambda c, n: r6(100 * F.avg(c.cast("int"))).alias(n)
    a = F.col("area")
    return v.gt().join(v.tiles(), "tile_id").groupBy("aoi").agg(pct(a < 1024, "small"), pct((a >= 1024) & (a <= 9216), "medium"), pct(a > 9216, "large"))


TILE = "SELECT tile_id, count(*) AS n, avg(area) AS a FROM gt GROUP BY 1"


@reg("a13_spearman", sql(f"SELECT round(corr(x, y), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY s, tile) AS x, row_number() OVER (ORDER BY t, tile) AS y FROM (SELECT tile, sum(dn) AS s, max(dn) AS t FROM dn GROUP BY 1))", "dn"))
def a13(v):
    """Ordinal ranks, ties by position; each rank is a running count over range buckets."""
    t = v.dn().groupBy("tile").agg(F.sum("dn").alias("s"), F.max("dn").alias("t"), F.lit(1).alias("one"))
    x = prefix_sums(t, [], F.floor(F.col("s") / 4096), [F.col("s"), F.col("tile")], {"x": "one"})
    y = prefix_sums(x, [], F.floor(F.col("t") / 64), [F.col("t"), F.col("tile")], {"y": "one"})
    return y.agg(r6(F.corr("x", "y")).alias("rho"))


@reg("w13_ordinal_rank", sql("SELECT tile, row_number() OVER (ORDER BY s, tile) AS k FROM (SELECT tile, sum(dn) AS s FROM dn GROUP BY 1)", "dn"))
def w13(v):
    t = v.dn().groupBy("tile").agg(F.sum("dn").alias("s"), F.lit(1).alias("one"))
    return prefix_sums(t, [], F.floor(F.col("s") / 4096), [F.col("s"), F.col("tile")], {"k": "one"}).select("tile", "k")


STRIPS = {"strip": "SELECT tile, CASE WHEN c = 0 THEN 'left' ELSE 'right' END AS side, r, v FROM pixels WHERE c IN (0, 7)"}


def strips(v):
    return v.pixels().where(F.col("c").isin(0, 7)).select("tile", F.when(F.col("c") == 0, "left").otherwise("right").alias("side"), "r", "v")


@reg("r14_edge_strips", sql("SELECT tile, side, r, v FROM strip", "pixels", extra=STRIPS))
def r14(v):
    return strips(v)


@reg("a14_strip_correlation", sql("SELECT a.tile, round(coalesce(corr(a.v, b.v), 0), 6) AS rho FROM strip a JOIN strip b ON b.tile = a.tile + 1 AND a.r = b.r AND a.side = 'right' AND b.side = 'left' GROUP BY a.tile", "pixels", extra=STRIPS))
def a14(v):
    s = strips(v)
    a = s.where("side = 'right'").select("tile", "r", F.col("v").alias("a"))
    b = s.where("side = 'left'").select((F.col("tile") - 1).alias("tile"), "r", F.col("v").alias("b"))
    return a.join(b, ["tile", "r"]).groupBy("tile").agg(r6(F.coalesce(F.corr("a", "b"), F.lit(0.0))).alias("rho"))


@reg("a15_weighted_z", sql(f"SELECT tile_id, round((a - m) / s, 6) AS z FROM ({TILE}) CROSS JOIN (SELECT sum(n * a) / sum(n) AS m FROM ({TILE})) CROSS JOIN (SELECT sqrt(sum(n * (a - (SELECT sum(n * a) / sum(n) FROM ({TILE}))) ** 2) / sum(n)) AS s FROM ({TILE}))", "gt"))
def a15(v):
    t = v.gt().groupBy("tile_id").agg(n_(), F.avg("area").alias("a"))
    m = t.agg((F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * F.col("a") * F.col("a")) / F.sum("n")).alias("q"))
    return t.crossJoin(F.broadcast(m)).select("tile_id", r6((F.col("a") - F.col("m")) / F.sqrt(F.col("q") - F.col("m") * F.col("m"))).alias("z"))


FEATURE = {"feat": "SELECT tile_id, count(*)::DOUBLE AS w, avg(area) AS y, avg(cls)::DOUBLE AS x1, avg(w)::DOUBLE AS x2 FROM gt GROUP BY tile_id",
           "mu": "SELECT sum(w) AS sw, sum(w * y) / sum(w) AS my, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2 FROM feat",
           "s": "SELECT sum(w * (x1 - m1) * (x1 - m1)) AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b, sum(w * (x2 - m2) * (x2 - m2)) AS c, sum(w * (x1 - m1) * (y - my)) AS p, sum(w * (x2 - m2) * (y - my)) AS q, sum(w * (y - my) * (y - my)) AS t FROM feat, mu",
           "k": "SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM s"}


def features(v):
    return v.gt().groupBy("tile_id").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.avg("area").alias("y"), F.avg("cls").alias("x1"), F.avg("w").alias("x2"))


@reg("a16_weighted_least_squares", sql("SELECT 'x1' AS factor, round(b1, 5) AS coefficient, round((b1 * p + b2 * q) / t, 6) AS r2 FROM k UNION ALL SELECT 'x2', round(b2, 5), round((b1 * p + b2 * q) / t, 6) FROM k", "gt", extra=FEATURE))
def a16(v):
    g = Gram(features(v), ["x1", "x2"], "y", "weight")
    coef, r2 = g.solve(3, [0, 1, 2])
    return v.spark.createDataFrame([("x1", round(float(coef[1]), 5), round(float(r2), 6)), ("x2", round(float(coef[2]), 5), round(float(r2), 6))], "factor string, coefficient double, r2 double")


@reg("a17_partial_r2", sql("SELECT 'x1' AS factor, round((b1 * p + b2 * q) / t - q * q / c / t, 6) AS partial_r2, round(1 / greatest(1e-9, 1 - b * b / (a * c)), 6) AS vif FROM k UNION ALL SELECT 'x2', round((b1 * p + b2 * q) / t - p * p / a / t, 6), round(1 / greatest(1e-9, 1 - b * b / (a * c)), 6) FROM k", "gt", extra=FEATURE))
def a17(v):
    rows = [(f, round(float(p), 6), round(float(i), 6)) for f, _, p, i in Gram(features(v), ["x1", "x2"], "y", "weight").report()]
    return v.spark.createDataFrame(rows, "factor string, partial_r2 double, vif double")


PAIR = {"fm": "SELECT arm, fold, avg(metric) AS m FROM runs GROUP BY ALL", "arms": "SELECT a.arm AS a, b.arm AS b, a.fold, a.m - b.m AS d FROM fm a JOIN fm b ON a.fold = b.fold AND a.arm < b.arm",
        "pt": "SELECT a, b, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM arms GROUP BY a, b HAVING count(*) >= 2"}
P4 = "2 * (1 - (0.5 + 0.375 * (abs(t) / sqrt(1 + t * t / 4)) * (1 - t * t / (1 + t * t / 4) / 12)))"


def pairs(v):
    m = v.runs().groupBy("arm", "fold").agg(F.avg("metric").alias("m"))
    a, b = m.select(F.col("arm").alias("a"), "fold", F.col("m").alias("ma")), m.select(F.col("arm").alias("b"), "fold", F.col("m").alias("mb"))
    return a.join(b, "fold").where("a < b").select("a", "b", "fold", (F.col("ma") - F.col("mb")).alias("d"))


def paired(v):
    p = pairs(v).groupBy("a", "b").agg(n_(), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("n >= 2")
    return p.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))


@reg("j12_paired_folds", sql("SELECT a, b, fold, round(d, 6) AS d FROM arms", "runs", extra=PAIR))
def j12(v):
    return pairs(v).select("a", "b", "fold", r6(F.col("d")).alias("d"))


@reg("a18_paired_t", sql(f"SELECT a, b, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, round({P4}, 6) AS p, CASE WHEN {P4} < 0.05 THEN 'significant' WHEN abs(mean) < 0.5 THEN 'below noise' ELSE '' END AS flag FROM pt", "runs", extra=PAIR))
def a18(v, noise: float = 0.5):
    p = paired(v).withColumn("p", t_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double")))
    flag = F.when(F.col("p") < 0.05, "significant").when(F.abs("mean") < noise, "below noise").otherwise("")
    return p.select("a", "b", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "t", "p")], flag.alias("flag"))


@reg("a19_confidence", sql("SELECT a, b, round(mean - 2.776 * sd / sqrt(n), 6) AS low, round(mean + 2.776 * sd / sqrt(n), 6) AS high, round(mean / sd, 6) AS dz FROM pt", "runs", extra=PAIR))
def a19(v):
    half = t_point_95(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return paired(v).select("a", "b", r6(F.col("mean") - half).alias("low"), r6(F.col("mean") + half).alias("high"), r6(F.try_divide("mean", "sd")).alias("dz"))


@reg("a20_t_two_sided_p", sql(f"SELECT a, b, round(t, 6) AS t, round({P4}, 6) AS p FROM pt", "runs", extra=PAIR))
def a20(v):
    """Probabilities of the paired t of every two arms."""
    return paired(v).select("a", "b", r6(F.col("t")).alias("t"), r6(t_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double"))).alias("p"))


@reg("a21_sign_flip", sql("SELECT a, b, round(avg(CAST(abs(s) >= abs(o) - 1e-12 AS INTEGER)), 6) AS p FROM (SELECT a, b, f, sum(CASE WHEN (f >> fold) & 1 = 1 THEN -d ELSE d END) AS s, sum(d) AS o FROM arms, (SELECT unnest(range(0, 32)) AS f) GROUP BY a, b, f) GROUP BY a, b", "runs", extra=PAIR))
def a21(v):
    """Every sign pattern over a pair's folds; the number of folds bounds them."""
    d = pairs(v).groupBy("a", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "d"))), lambda x: x["d"]).alias("d"))
    flips = d.select("a", "b", "d", F.explode(F.expr("sequence(0L, shiftleft(1L, size(d)) - 1)")).alias("f"))
    total = lambda sign: F.aggregate(F.transform("d", sign), F.lit(0.0), lambda s, x: s + x)
    s, o = total(lambda x, i: F.when(F.col("f").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, -x).otherwise(x)), total(lambda x, i: x)
    return flips.groupBy("a", "b").agg(r6(F.avg((F.abs(s) >= F.abs(o) - 1e-12).cast("int"))).alias("p"))


@reg("a22_bonferroni", sql(f"SELECT a, b, round({P4}, 6) AS p, {P4} < 0.05 / (SELECT count(*) FROM pt) AS holds FROM pt", "runs", extra=PAIR))
def a22(v):
    p = paired(v).withColumn("p", t_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double")))
    return p.crossJoin(F.broadcast(p.agg(n_("family")))).select("a", "b", r6(F.col("p")).alias("p"), (F.col("p") < 0.05 / F.col("family")).alias("holds"))


WELCH = {"g": "SELECT arm, count(*) AS n, avg(metric) AS m, var_samp(metric) AS s FROM runs GROUP BY arm"}


@reg("a23_welch", sql("SELECT a.arm AS a, b.arm AS b, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) AS t, round((a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)), 4) AS df FROM g a JOIN g b ON a.arm < b.arm", "runs", extra=WELCH))
def a23(v):
    return welch(v).select("a", "b", r6(F.col("t")).alias("t"), F.round("df", 4).alias("df"))


def welch(v):
    g = v.runs().groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("m"), F.var_samp("metric").alias("s"))
    a, b = (g.select(F.col("arm").alias(x), *[F.col(c).alias(f"{c}{x}") for c in "nms"]) for x in "ab")
    va, vb = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
    j = a.join(b, F.col("a") < F.col("b"))
    return j.select("a", "b", ((F.col("ma") - F.col("mb")) / F.sqrt(va + vb)).alias("t"), ((va + vb) ** 2 / (va**2 / (F.col("na") - 1) + vb**2 / (F.col("nb") - 1))).alias("df"))


@reg("a23_welch_p")
def a23_p(v):
    return welch(v).select("a", "b", r6(t_two_sided_p(F.col("t"), F.col("df"))).alias("p"))


@reg("a24_repeat_factor", sql("SELECT cls, n, round(n / t::DOUBLE, 6) AS f, round(greatest(1, sqrt(0.995 / (n / t::DOUBLE))), 6) AS repeat FROM (SELECT cls, count(DISTINCT tile_id) AS n FROM gt GROUP BY cls), (SELECT count(*) AS t FROM tiles)", "tiles"))
def a24(v, threshold: float = 0.995):
    c = v.gt().select("cls", "tile_id").distinct().groupBy("cls").agg(n_())
    f = c.crossJoin(F.broadcast(v.tiles().agg(n_("t")))).withColumn("f", F.col("n") / F.col("t"))
    return f.select("cls", "n", r6(F.col("f")).alias("f"), r6(F.greatest(F.lit(1.0), F.sqrt(threshold / F.col("f")))).alias("repeat"))


@reg("a25_iou_ceiling", sql("SELECT cls, d, round(avg(area / (area + d * 2.0::DOUBLE * (w + h))), 6) AS mean_ceiling, round(avg(hits) * 10, 6) AS ceiling_ap FROM (SELECT cls, area, w, h, d, (SELECT count(*) FROM (SELECT unnest(range(10, 20)) * 0.05::DOUBLE AS t) WHERE area / (area + d * 2.0::DOUBLE * (w + h)) >= t) AS hits FROM gt, (SELECT unnest([1, 2, 3]) AS d)) GROUP BY ALL", "gt"))
def a25(v):
    """Ceiling of a box whose outline is off by d pixels: A / (A + d * perimeter)."""
    g = v.gt().select("cls", "area", (2.0 * (F.col("w") + F.col("h"))).alias("per"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("d"))
    c = F.col("area") / (F.col("area") + F.col("d") * F.col("per"))
    hits = sum(((c >= F.lit(k) * F.lit(0.05)).cast("int") for k in range(10, 20)), F.lit(0))
    return g.groupBy("cls", "d").agg(r6(F.avg(c)).alias("mean_ceiling"), r6(F.avg(hits) * 10).alias("ceiling_ap"))


@reg("a26_unmeasurable_rollup", sql("SELECT coalesce(CAST(cls AS VARCHAR), 'ALL') AS cls, count(*) AS n, round(100 * avg(CAST(area / (area + 2.0::DOUBLE * (w + h)) < 0.75 AS INTEGER)), 6) AS pct FROM gt GROUP BY ROLLUP (cls)", "gt"))
def a26(v):
    c = F.col("area") / (F.col("area") + 2.0 * (F.col("w") + F.col("h")))
    return v.gt().rollup("cls").agg(n_(), r6(100 * F.avg((c < 0.75).cast("int"))).alias("pct")).select(F.coalesce(F.col("cls").cast("string"), F.lit("ALL")).alias("cls"), "n", "pct")


ANCHOR = {"an": "SELECT s / sqrt(ar) AS aw, s * sqrt(ar) AS ah FROM (SELECT unnest([16, 32, 64, 128, 256])::DOUBLE AS s), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS ar)",
          "bi": "SELECT gt_id, cls, max(least(w * 1.231::DOUBLE, aw) * least(h * 1.231::DOUBLE, ah) / (w * 1.231::DOUBLE * h * 1.231::DOUBLE + aw * ah - least(w * 1.231::DOUBLE, aw) * least(h * 1.231::DOUBLE, ah))) AS best, any_value(w) AS w, any_value(h) AS h FROM gt, an WHERE w > 1 AND h > 1 GROUP BY gt_id, cls"}


def best_anchor(v):
    sizes = [(float(s) / math.sqrt(a), float(s) * math.sqrt(a)) for s in (16, 32, 64, 128, 256) for a in (0.5, 1.0, 2.0)]
    w, h = F.col("w") * 1.231, F.col("h") * 1.231

    def one(aw: float, ah: float):
        inter = F.least(w, F.lit(aw)) * F.least(h, F.lit(ah))
        return inter / (w * h + aw * ah - inter)

    return v.gt().where("w > 1 and h > 1").select("gt_id", "cls", "w", "h", F.greatest(*(one(*s) for s in sizes)).alias("best"))


@reg("j15_best_anchor", sql("SELECT gt_id, round(best, 6) AS best FROM bi", "gt", extra=ANCHOR))
def j15(v):
    return best_anchor(v).select("gt_id", r6(F.col("best")).alias("best"))


@reg("a27_anchor_coverage", sql("SELECT cls, count(*) AS n, round(quantile_cont(sqrt(w * h), 0.5), 6) AS side, round(quantile_cont(h / w::DOUBLE, 0.5), 6) AS ar, round(avg(CAST(best < 0.3 AS INTEGER)), 6) AS under_3, round(avg(CAST(best < 0.5 AS INTEGER)), 6) AS under_5, round(avg(CAST(sqrt(w * h) < 32 AS INTEGER)), 6) AS under_32 FROM bi GROUP BY cls", "gt", extra=ANCHOR))
def a27(v):
    side = F.sqrt(F.col("w") * F.col("h"))
    part = lambda c, n: r6(F.avg(c.cast("int"))).alias(n)
    return best_anchor(v).groupBy("cls").agg(n_(), r6(F.percentile(side, 0.5)).alias("side"), r6(F.percentile(F.col("h") / F.col("w"), 0.5)).alias("ar"), part(F.col("best") < 0.3, "under_3"), part(F.col("best") < 0.5, "under_5"), part(side < 32, "under_32"))


@reg("a28_size_ladder", sql("SELECT cls, size, round(quantile_cont(sqrt(area) * size / 480, 0.5), 6) AS p50, round(100 * avg(CAST(sqrt(area) * size / 480 < 32 AS INTEGER)), 6) AS pct_small FROM gt, (SELECT unnest([480, 640, 800, 960])::DOUBLE AS size) GROUP BY ALL", "gt"))
def a28(v):
    s = F.sqrt("area") * F.col("size") / 480
    return v.gt().select("cls", "area", F.explode(F.array(*map(F.lit, (480.0, 640.0, 800.0, 960.0)))).alias("size")).groupBy("cls", "size").agg(r6(F.percentile(s, 0.5)).alias("p50"), r6(100 * F.avg((s < 32).cast("int"))).alias("pct_small"))


MASK = "SELECT tile, r, c, v > 0 AS a, v > 0.5 AS b, v < -0.3 AS d, dn FROM dn"


@reg("a29_pixel_frequency", sql(f"SELECT n, round(na / n::DOUBLE, 6) AS fa, round((n - na) / na::DOUBLE, 6) AS pos_weight_a, CASE WHEN nb > 0 THEN round((n - nb) / nb::DOUBLE, 6) ELSE 0 END AS pos_weight_b, round(100 * ab / n::DOUBLE, 6) AS overlap_pct, 100 * ab > n AS overlaps FROM (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS ab FROM ({MASK}))", "dn"))
def a29(v):
    a, b = F.col("v") > 0, F.col("v") > 0.5
    c = v.pixels().agg(n_(), F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.count_if(a & b).alias("ab"))
    n, na, nb, ab = (F.col(x) for x in ("n", "na", "nb", "ab"))
    return c.select("n", r6(na / n).alias("fa"), r6(ratio(n - na, na)).alias("pos_weight_a"), r6(ratio(n - nb, nb)).alias("pos_weight_b"), r6(100.0 * ab / n).alias("overlap_pct"), (100 * ab > n).alias("overlaps"))


@reg("j14_mask_cooccurrence", sql(f"SELECT count(*) FILTER (a AND b) AS ab, count(*) FILTER (a AND d) AS ad, count(*) FILTER (b AND d) AS bd, count(*) FILTER (a) AS aa FROM ({MASK})", "dn"))
def j14(v):
    a, b, d = F.col("v") > 0, F.col("v") > 0.5, F.col("v") < -0.3
    return v.pixels().agg(F.count_if(a & b).alias("ab"), F.count_if(a & d).alias("ad"), F.count_if(b & d).alias("bd"), F.count_if(a).alias("aa"))


@reg("a30_headroom", sql("SELECT arm, round(100 - avg(m), 6) AS headroom FROM (SELECT arm, fold, max(metric) AS m FROM runs GROUP BY ALL) GROUP BY arm", "runs"))
def a30(v):
    return v.runs().groupBy("arm", "fold").agg(F.max("metric").alias("m")).groupBy("arm").agg(r6(100 - F.avg("m")).alias("headroom"))


@reg("a31_trajectory", sql("SELECT arm, fold, peak, final, round(peak - final, 6) AS fall, round(first_at / (n - 1)::DOUBLE, 6) AS position FROM (SELECT arm, fold, max(metric) AS peak, arg_max(metric, iteration) AS final, count(*) AS n, min(k) FILTER (metric = top) - 1 AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY arm, fold ORDER BY iteration) AS k, max(metric) OVER (PARTITION BY arm, fold) AS top FROM runs) GROUP BY ALL) WHERE n > 1", "runs"))
def a31(v):
    w = Window.partitionBy("arm", "fold")
    k = v.runs().withColumns({"k": F.row_number().over(w.orderBy("iteration")), "top": F.max("metric").over(w)})
    g = k.groupBy("arm", "fold").agg(F.max("metric").alias("peak"), F.max_by("metric", "iteration").alias("final"), n_(), (F.min(F.when(F.col("metric") == F.col("top"), F.col("k"))) - 1).alias("at")).where("n > 1")
    return g.select("arm", "fold", "peak", "final", r6(F.col("peak") - F.col("final")).alias("fall"), r6(F.col("at") / (F.col("n") - 1)).alias("position"))


@reg("w6_last_value", sql("SELECT arm, fold, arg_max(metric, iteration) AS final FROM runs GROUP BY ALL", "runs"))
def w6(v):
    return v.runs().groupBy("arm", "fold").agg(F.max_by("metric", "iteration").alias("final"))


@reg("a32_roi_fraction", sql("SELECT arm, round(avg(fg / (fg + bg)::DOUBLE), 6) AS fraction, CASE WHEN sum(fg) = 0 THEN 'inf'::DOUBLE ELSE round(sum(bg) / sum(fg)::DOUBLE, 6) END AS ratio FROM (SELECT arm, iteration % 7 AS fg, iteration % 11 + 1 AS bg FROM runs) GROUP BY arm", "runs"))
def a32(v):
    r = v.runs().select("arm", (F.col("iteration") % 7).alias("fg"), (F.col("iteration") % 11 + 1).alias("bg"))
    return r.groupBy("arm").agg(r6(F.avg(F.try_divide("fg", F.col("fg") + F.col("bg")))).alias("fraction"), F.when(F.sum("fg") == 0, F.lit(float("inf"))).otherwise(r6(F.try_divide(F.sum("bg"), F.sum("fg")))).alias("ratio"))


@reg("a34_inside_outside", sql("SELECT tile, round(avg(dn) FILTER (v > 0.5), 6) AS inside, round(avg(dn) FILTER (v <= 0), 6) AS outside, round(100 * avg(CAST(dn < m AS INTEGER)), 6) AS percentile, CASE WHEN 100 * avg(CAST(dn < m AS INTEGER)) > 60 THEN 'bright' WHEN 100 * avg(CAST(dn < m AS INTEGER)) < 40 THEN 'dark' ELSE 'plain' END AS verdict FROM (SELECT *, avg(dn) FILTER (v > 0.5) OVER (PARTITION BY tile) AS m FROM dn) WHERE m IS NOT NULL GROUP BY tile", "dn"))
def a34(v):
    return inside(v).select("tile", r6(F.col("inside")).alias("inside"), r6(F.col("outside")).alias("outside"), r6(F.col("p")).alias("percentile"), F.when(F.col("p") > 60, "bright").when(F.col("p") < 40, "dark").otherwise("plain").alias("verdict"))


def inside(v):
    d = v.dn().withColumn("m", F.avg(F.when(F.col("v") > 0.5, F.col("dn"))).over(Window.partitionBy("tile"))).where("m is not null")
    return d.groupBy("tile").agg(F.avg(F.when(F.col("v") > 0.5, F.col("dn"))).alias("inside"), F.avg(F.when(F.col("v") <= 0, F.col("dn"))).alias("outside"), (100 * F.avg((F.col("dn") < F.col("m")).cast("int"))).alias("p"))


@reg("r15_percentile_in_tile", sql("SELECT tile, round(100 * avg(CAST(dn < m AS INTEGER)), 6) AS percentile FROM (SELECT *, avg(dn) FILTER (v > 0.5) OVER (PARTITION BY tile) AS m FROM dn) WHERE m IS NOT NULL GROUP BY tile", "dn"))
def r15(v):
    return inside(v).select("tile", r6(F.col("p")).alias("percentile"))


@reg("a36_collect_set", sql("SELECT aoi, count(*) AS n, array_to_string(list_sort(list(DISTINCT cls)), ',') AS classes FROM gt JOIN tiles USING (tile_id) GROUP BY aoi", "tiles"))
def a36(v):
    return v.gt().join(v.tiles(), "tile_id").groupBy("aoi").agg(n_(), F.array_join(F.transform(F.sort_array(F.collect_set("cls")), lambda x: x.cast("string")), ",").alias("classes"))


@reg("a37_scale_sensitivity", sql("SELECT s.arm, s.fold AS scale, round(s.m, 6) AS mean, round(s.sd, 6) AS sd, round(s.m - n.m, 6) AS delta FROM (SELECT arm, fold, avg(metric) AS m, stddev_samp(metric) AS sd FROM runs GROUP BY ALL) s JOIN (SELECT arm, avg(metric) AS m FROM runs WHERE fold = 0 GROUP BY arm) n USING (arm)", "runs"))
def a37(v):
    s = v.runs().groupBy("arm", F.col("fold").alias("scale")).agg(F.avg("metric").alias("m"), F.stddev_samp("metric").alias("sd"))
    native = s.where("scale = 0").select("arm", F.col("m").alias("n"))
    return s.join(native, "arm").select("arm", "scale", r6(F.col("m")).alias("mean"), r6(F.col("sd")).alias("sd"), r6(F.col("m") - F.col("n")).alias("delta"))


@reg("a38_hot_spots", sql("SELECT x0 // 300 AS gx, y0 // 300 AS gy, count(*) AS n FROM map_pred WHERE x0 >= 0 AND y0 >= 0 GROUP BY ALL ORDER BY n DESC, gx, gy LIMIT 20", "map_pred"))
def a38(v):
    g = v.map_pred().where("x0 >= 0 and y0 >= 0").groupBy(F.floor(F.col("x0") / 300).alias("gx"), F.floor(F.col("y0") / 300).alias("gy")).agg(n_())
    return g.orderBy(F.col("n").desc(), "gx", "gy").limit(20)
