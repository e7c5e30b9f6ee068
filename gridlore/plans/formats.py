"""Queries on formats, text, filters and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions.numeric import r6
from gridlore.plans.cut import folder
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql
from gridlore.streaming import metrics

reg = Registry()
n_ = lambda name="n": F.count(F.lit(1)).alias(name)


@reg("s2_key_listing", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS key FROM pages WHERE url LIKE '%/en/%'")
def s2(v):
    return v.table("pages").where("url like '%/en/%'").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("key"))


@reg("f1_string_keys", sql("SELECT gt_id, 'img' || tile_id AS stem, CAST(split_part('tile_' || tile_id || '_x', '_', 2) AS BIGINT) AS number FROM gt", "gt"))
def f1(v):
    name = F.concat(F.lit("/data/img"), F.col("tile_id"), F.lit(".tif"))
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.\w+$", "")
    return v.gt().select("gt_id", stem.alias("stem"), F.split_part(F.concat(F.lit("tile_"), F.col("tile_id"), F.lit("_x")), F.lit("_"), F.lit(2)).cast("long").alias("number"))


@reg("f2_formatting", sql("SELECT gt_id, printf('%06d', gt_id) AS code, printf('%.2f', area / 7.0::DOUBLE) AS size FROM gt", "gt"))
def f2(v):
    return v.gt().select("gt_id", F.format_string("%06d", "gt_id").alias("code"), F.format_string("%.2f", F.col("area") / 7.0).alias("size"))


@reg("f3_text_audit", "SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (regexp_matches(p, '(?i)(^| )(the|der|les|que)( |$)')) AS mentions, CAST(sum(len(regexp_extract_all(p, '[.!?]'))) AS BIGINT) AS stops FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id")
def f3(v):
    p = v.table("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("p"))
    return p.groupBy("doc_id").agg(n_("paragraphs"), F.count_if(F.col("p").rlike("(?i)(^| )(the|der|les|que)( |$)")).alias("mentions"), F.sum(F.regexp_count("p", F.lit("[.!?]"))).cast("long").alias("stops"))


@reg("f4_iso_stamp", sql("SELECT iteration, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM runs", "runs"))
def f4(v):
    return v.runs().select("iteration", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


@reg("f5_math", sql("SELECT iteration, round(sqrt(abs(metric)), 6) AS root, round(degrees(atan2(metric, 3)), 6) AS angle, round(ln(abs(metric) + 1), 6) AS log, round(least(1, greatest(-1, metric)), 6) AS clipped FROM runs", "runs"))
def f5(v):
    m = F.col("metric")
    return v.runs().select("iteration", r6(F.sqrt(F.abs(m))).alias("root"), r6(F.degrees(F.atan2(m, F.lit(3.0)))).alias("angle"), r6(F.log(F.abs(m) + 1)).alias("log"), r6(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), m))).alias("clipped"))


@reg("f5b_ground_distance", sql("SELECT tile_id, round(2.7e-6::DOUBLE * 111320 * cos(radians(tile_id % 60)), 6) AS gx, round(2.7e-6::DOUBLE * 110540, 6) AS gy FROM tiles", "tiles"))
def f5b(v):
    return v.tiles().select("tile_id", r6(F.lit(2.7e-6) * 111320 * F.cos(F.radians(F.col("tile_id") % 60))).alias("gx"), r6(F.lit(2.7e-6) * 110540).alias("gy"))


@reg("f6_rounding", sql("SELECT gt_id, CAST(round_even(area / 8.0::DOUBLE, 0) AS BIGINT) AS even, CAST(trunc(area / 8.0::DOUBLE) AS BIGINT) AS down FROM gt", "gt"))
def f6(v):
    x = F.col("area") / 8.0
    return v.gt().select("gt_id", F.rint(x).cast("long").alias("even"), x.cast("long").alias("down"))


@reg("f7_array_functions", "SELECT vec_id, round(list_aggregate(embedding[1:8], 'max')::DOUBLE, 5) AS top, len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS signs FROM embeddings")
def f7(v):
    e = v.table("embeddings")
    return e.select("vec_id", F.round(F.array_max(F.slice("embedding", 1, 8)).cast("double"), 5).alias("top"), F.size(F.array_distinct(F.transform("embedding", lambda x: x > 0))).cast("long").alias("signs"))


@reg("f8_counters", sql("SELECT tile_id, coalesce(count(*) FILTER (cls = 1), 0) AS c1, coalesce(count(*) FILTER (cls = 2), 0) AS c2, coalesce(count(*) FILTER (cls = 3), 0) AS c3 FROM gt GROUP BY tile_id", "gt"))
def f8(v):
    m = v.gt().groupBy("tile_id", "cls").agg(n_()).groupBy("tile_id").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("m"))
    return m.select("tile_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"c{k}") for k in (1, 2, 3)])


@reg("f9_json_props", sql("SELECT iteration, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM runs", "runs"))
def f9(v):
    return v.runs().select("iteration", F.from_json("props", "k long")["k"].alias("k"))


@reg("f10_nan_guards", sql("SELECT arm, round(avg(CASE WHEN iteration % 5 = 0 THEN NULL ELSE metric END), 6) AS mean FROM runs GROUP BY arm", "runs"))
def f10(v):
    x = F.when(F.col("iteration") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("metric"))
    return v.runs().withColumn("x", x).groupBy("arm").agg(r6(F.avg(F.when(~F.isnan("x"), F.col("x")))).alias("mean"))


@reg("p1_drop_crowd", sql("SELECT gt_id FROM gt WHERE gt_id % 50 <> 0", "gt"))
def p1(v):
    g = v.gt().withColumn("iscrowd", F.when(F.col("gt_id") % 50 == 0, 1))
    return g.where("coalesce(iscrowd, 0) = 0").select("gt_id")


@reg("p5_min_area_reasons", sql("SELECT CASE WHEN area <= 160 THEN 'sliver' WHEN area < 200 THEN 'small' ELSE 'kept' END AS reason, count(*) AS n FROM gt GROUP BY ALL", "gt"))
def p5(v):
    return v.gt().groupBy(F.when(F.col("area") <= 160, "sliver").when(F.col("area") < 200, "small").otherwise("kept").alias("reason")).agg(n_())


@reg("p9_equality_filter", "SELECT event_id FROM events WHERE event_type = 'click'")
def p9(v):
    return v.table("events").where("event_type = 'click'").select("event_id")


@reg("p10_class_subset", sql("SELECT gt_id FROM gt WHERE cls NOT IN (3)", "gt"))
def p10(v):
    return v.gt().where(~F.col("cls").isin(3)).select("gt_id")


@reg("p11_box_sanity", sql("SELECT count(*) FILTER (x1 - x0 > 13 AND y1 - y0 > 13) AS sane, count(*) AS n FROM pred", "pred"))
def p11(v):
    return v.pred().agg(F.count_if((F.col("x1") - F.col("x0") > 13) & (F.col("y1") - F.col("y0") > 13)).alias("sane"), n_())


@reg("p13_count_range", sql("SELECT tile_id, count(*) AS n FROM gt WHERE cls = 1 GROUP BY tile_id HAVING count(*) BETWEEN 13 AND 45", "gt"))
def p13(v):
    return v.gt().where("cls = 1").groupBy("tile_id").agg(n_()).where("n between 13 and 45")


@reg("p14_viewport", sql("SELECT det_id FROM map_pred WHERE x1 > 900 AND x0 < 1500 AND y1 > 400 AND y0 < 1000", "map_pred"))
def p14(v):
    return v.map_pred().where("x1 > 900 and x0 < 1500 and y1 > 400 and y0 < 1000").select("det_id")


@reg("p16_file_rewrite", sql("SELECT tile_id, aoi || '/img' || tile_id || '.tif' AS file_name FROM tiles", "tiles"))
def p16(v):
    return v.tiles().select("tile_id", F.concat_ws("/", "aoi", F.format_string("img%d.tif", "tile_id")).alias("file_name"))


@reg("p17_category_remap", sql("SELECT pred_id, CASE WHEN (SELECT min(cls - 1) FROM pred) = 0 THEN cls ELSE cls - 1 END AS category_id FROM pred", "pred"))
def p17(v):
    p = v.pred().withColumn("cls", F.col("cls") - 1)
    low = p.agg(F.min("cls").alias("low"))
    return p.crossJoin(F.broadcast(low)).select("pred_id", F.when(F.col("low") == 0, F.col("cls") + 1).otherwise(F.col("cls")).alias("category_id"))


@reg("p18_shape_mismatch", "SELECT vec_id FROM (SELECT vec_id, embedding[1:CASE WHEN vec_id % 7 = 3 THEN 56 ELSE 64 END] AS e FROM embeddings) WHERE len(e) = 64")
def p18(v, h: int = 8, w: int = 8):
    """Tiles of which a row of pixels is missing are skipped; every seventh lacks its last."""
    cut = F.slice("embedding", 1, F.when(F.col("vec_id") % 7 == 3, (h - 1) * w).otherwise(h * w))
    return v.table("embeddings").select("vec_id", cut.alias("e")).where(F.size("e") == h * w).select("vec_id")


@reg("p19_scale_boxes", sql("SELECT gt_id, round(w * 800 / 650.0::DOUBLE, 6) AS w, round(h * 800 / 650.0::DOUBLE, 6) AS h FROM gt", "gt"))
def p19(v):
    return v.gt().select("gt_id", r6(F.col("w") * 800 / 650.0).alias("w"), r6(F.col("h") * 800 / 650.0).alias("h"))


def stream(v):
    return metrics.events(v.spark, f"{v.dir}/events.parque[t]")


@reg("t2_first_seen_stream", "SELECT DISTINCT user_id FROM events")
def t2(v):
    """One event a user; state for ten years of event time, so that none is forgotten here."""
    return metrics.settled(metrics.first_seen(stream(v), "user_id", "3650 days"), folder(v.spark, "t2"), "append").select("user_id")


@reg("t2_running_counts", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def t2_counts(v):
    """What the last row of each user's running state says, after all events."""
    rows = metrics.running(stream(v), "user_id", folder(v.spark, "t2-state"))
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("n", "total"), "round").alias("s")).select("user_id", "s.n", F.round("s.total", 4).alias("total"))


@reg("t3_one_pass_stream", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def t3(v):
    return metrics.settled(metrics.moments(stream(v)), folder(v.spark, "t3")).withColumn("total", F.round("total", 4))


@reg("t4_best_so_far_stream", "SELECT event_type, arg_min(event_id, (-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY event_type")
def t4(v):
    return metrics.settled(metrics.best_so_far(stream(v)), folder(v.spark, "t4"))


@reg("t_windowed_stream", "SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t_windowed(v):
    w = metrics.settled(metrics.windowed(stream(v)), folder(v.spark, "tw"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
