"""Queries on the remaining formats, masks of rings, clustering and evaluators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import rings, runs
from gridlore.functions.numeric import r6
from gridlore.operators import clustering, evaluator
from gridlore.plans.cut import folder
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql

reg = Registry()
n_ = lambda name="n": F.count(F.lit(1)).alias(name)


@reg("s6_header_scan", sql("SELECT tile_id, tile_id % 20 * 480 * 0.5::DOUBLE AS left_m, -(tile_id // 20) * 480 * 0.5::DOUBLE AS top_m FROM tiles", "tiles"))
def s6(v, m: float = 0.5):
    """Bounds from a tile's place, without its pixels."""
    return v.grid().select("tile_id", (F.col("col") * 480 * m).alias("left_m"), (-F.col("row") * 480 * m).alias("top_m"))


@reg("k9_membership_record", sql("SELECT aoi, CASE WHEN tile_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, tile_id FROM tiles", "tiles"))
def k9(v):
    """Every member of each area's splits, a row each."""
    return v.tiles().select("aoi", F.when(F.col("tile_id") % 5 == 0, "val").otherwise("train").alias("split"), "tile_id")


def ring_area(snap, size: int = 64):
    """Pixels of the box from the origin to (w + 0.5, h + 0.5), its corners snapped first; a batch of rings is filled at once."""
    low, right, bottom = snap(F.lit(0.0)), snap(F.col("w") + 0.5), snap(F.col("h") + 0.5)
    return runs.size(runs.filled(F.array(rings.box_ring(low, low, right, bottom)), size, size)).cast("int")


@reg("g4_fill_rounded_truncated", sql("SELECT gt_id, CAST(round_even(w + 0.5::DOUBLE, 0) * round_even(h + 0.5::DOUBLE, 0) AS INTEGER) AS rounded, CAST(w * h AS INTEGER) AS cut FROM gt", "gt"))
def g4(v):
    return v.gt().select("gt_id", ring_area(F.rint).alias("rounded"), ring_area(lambda c: c.cast("long")).alias("cut"))


@reg("m3_merged_instance", sql("SELECT gt_id, round(2 * area::DOUBLE, 6) AS area FROM gt", "gt"))
def m3(v):
    """An instance of two separate rings is one instance; its areas add."""
    one = rings.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    two = rings.box_ring(F.col("x0") + 1000, F.col("y0"), F.col("x1") + 1000, F.col("y1"))
    return v.gt().select("gt_id", F.explode(F.array(one, two)).alias("ring")).groupBy("gt_id").agg(r6(F.sum(rings.area(F.col("ring")))).alias("area"))


def vectors(v):
    from pyspark.ml.functions import array_to_vector

    return v.table("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))


@reg("c6_principal_components")
def c6(v, k: int = 8):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    e = vectors(v)
    z = PCA(k=k, inputCol="x", outputCol="z").fit(e).transform(e)
    return z.select("vec_id", F.sqrt(F.aggregate(vector_to_array("z"), F.lit(0.0), lambda s, t: s + t * t)).alias("norm"))


@reg("c7_clusters")
def c7(v, k: int = 10, seed: int = 7):
    from pyspark.ml.clustering import KMeans

    e = vectors(v)
    return KMeans(k=k, seed=seed, featuresCol="x", maxIter=20).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@reg("e3_row_mapper", sql("SELECT gt_id, CAST(w * h AS BIGINT) AS area FROM gt WHERE cls <> 3", "gt"))
def e3(v):
    return evaluator.map_records(v.gt().select("gt_id", "cls", "w", "h"), lambda r: None if r["cls"] == 3 else {"gt_id": r["gt_id"], "area": r["w"] * r["h"]}, "gt_id long, area long")


@reg("e9_query_parameters", sql("SELECT gt_id FROM gt WHERE area > 700 AND cls = 2", "gt"))
def e9(v):
    return v.spark.sql("SELECT gt_id FROM {gt} WHERE area > :least AND cls = :cls", args={"least": 700, "cls": 2}, gt=v.gt())


def thumbnails(v):
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


@reg("c6_signed_components")
def c6_signed(v, k: int = 32):
    """All 32 components of each row, with fixed signs."""
    z = clustering.components(thumbnails(v), k)
    return z.select(F.col("id").alias("vec_id"), F.posexplode("z").alias("k", "value")).withColumn("value", r6(F.col("value")))


@reg("c7_seeded_clusters")
def c7_seeded(v, k: int = 10, seed: int = 7):
    """Clusters of the 32 components, seeded by squared distance."""
    z = clustering.components(thumbnails(v)).withColumnRenamed("z", "x")
    z.write.mode("overwrite").parquet(path := folder(v.spark, f"components-{v.dir.strip('/').replace('/', '-')}"))
    return clustering.clusters(v.spark.read.schema(z.schema).parquet(path), k, seed).withColumnRenamed("id", "vec_id")
