"""Readers of annotation and log formats, with explicit schemas, normalised to the detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = """images array<struct<id:bigint,file_name:string,width:int,height:int>>,
    annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,segmentation:string>>,
    categories array<struct<id:int,name:string>>"""
FEATURES = "crs string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
FLAT = "image_id long, category_id int, score double, bbox array<double>, segmentation string"
NESTED = "image_id long, instances array<struct<category_id:int,bbox:array<double>,score:double,segmentation:string>>"


def coco(document: DataFrame) -> dict[str, DataFrame]:
    """images, annotations and categories of documents parsed with COCO. Images without annotations stay.

    segmentation is text: a JSON array is rings, a JSON object is an RLE; see `segmentation`."""
    parts = {n: document.select(F.inline(n)) for n in ("images", "annotations", "categories")}
    a = parts["annotations"].where("coalesce(iscrowd, 0) = 0")
    box = [F.col("bbox")[i] for i in range(4)]
    parts["annotations"] = a.select("id", "image_id", "category_id", "area", "segmentation", box[0].alias("x0"), box[1].alias("y0"), (box[0] + box[2]).alias("x1"), (box[1] + box[3]).alias("y1"))
    return parts


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Files that are a document each, or have one a line, which tasks share."""
    return coco(spark.read.schema(COCO).option("multiLine", not lines).json(path))


def segmentation(text) -> list:
    """rings and rle columns of a polymorphic segmentation text; counts may be runs or compact text."""
    rings = F.when(text.startswith("["), F.from_json(text, "array<array<double>>"))
    rle = F.when(text.startswith("{"), F.from_json(text, "struct<size:array<int>,counts:string>"))
    return [rings.alias("rings"), rle.alias("rle")]


def features(document: DataFrame) -> DataFrame:
    """properties and geometry of GeoJSON features; null geometries stay, crs defaults to EPSG:4326."""
    return document.select(F.coalesce("crs", F.lit("EPSG:4326")).alias("crs"), F.explode_outer("features").alias("f")).select("crs", "f.properties", "f.geometry")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files that are a collection each, or have one a line, which tasks share."""
    return features(spark.read.schema(FEATURES).option("multiLine", not lines).json(path))


def read_flat_predictions(spark: SparkSession, paths: list[str], folds: int | None = None) -> DataFrame | None:
    """Predictions of all folds with the file they came from; None if `folds` are asked for and some lack."""
    df = spark.read.schema(FLAT).option("multiLine", True).json(paths).withColumn("path", F.input_file_name())
    if folds is not None and df.select("path").distinct().count() < folds:
        return None
    return df


def read_complete_folds(spark: SparkSession, path: str, arm: str, folds: int) -> DataFrame:
    """Predictions of every arm (a partition below path) that has `folds` files, with their path; the other arms have none.

    All arms are read at once, and files are counted by arm beside the read."""
    df = spark.read.schema(f"{FLAT}, {arm} string, fold int").option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    whole = df.groupBy(arm).agg(F.count_distinct("path").alias("__n")).where(F.col("__n") == folds).select(arm)
    return df.join(whole, arm, "left_semi")


def malformed(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """by (partitions below path), lines and malformed: JSON lines, and those that do not parse."""
    lines = spark.read.schema(f"value string, {', '.join(f'{k} string' for k in by)}").text(path)
    bad = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})["__bad"]
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), F.count(bad).alias("malformed"))


def read_nested_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NESTED).json(path).select("image_id", F.explode_outer("instances").alias("i")).select("image_id", "i.*")


def read_metric_log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or fail the whole file where strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def listing(spark: SparkSession, path: str, extension: str, key: str) -> DataFrame:
    """path and key of the files with an extension; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", key, 1).alias("key")).where("key <> ''")


def via(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and vertices of VIA regions, a map or a list of them, vertices moved to pixel centres."""
    shape = "struct<shape_attributes:struct<all_points_x:array<double>,all_points_y:array<double>>>"
    as_map, as_list = F.from_json(column, f"filename string, regions map<string,{shape}>"), F.from_json(column, f"filename string, regions array<{shape}>")
    regions = F.coalesce(F.map_values(as_map["regions"]), as_list["regions"])
    r = lines.select(as_map["filename"].alias("name"), F.explode_outer(regions).alias("r")).select("name", "r.shape_attributes.*")
    half = lambda c: F.transform(c, lambda x: x + 0.5)
    return r.select("name", half("all_points_x").alias("x"), half("all_points_y").alias("y"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """arm, fold, minutes and AP of the rows of a run table in plain text."""
    rows = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", r"^(\w)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)", i)
    return rows.where(part(1) != "").select(part(1).alias("arm"), part(2).cast("int").alias("fold"), part(3).cast("int").alias("seed"), part(4).cast("int").alias("minutes"), part(5).cast("double").alias("ap"))


class Catalog:
    """Names for tables that are read when asked for; registering again replaces, a missing path is skipped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register(self, name: str, path: str) -> bool:
        from pyspark.errors import AnalysisException

        try:
            self.spark.read.parquet(path).createOrReplaceTempView(name)
        except AnalysisException:
            return False
        return True


def resolve(key: str, explicit: str | None = None, registry: dict | None = None, environment: dict | None = None) -> str:
    """Explicit value, else the registry's, else the environment's, else an error."""
    import os

    for value in (explicit, (registry or {}).get(key), (os.environ if environment is None else environment).get("GRIDLORE_PROJECT")):
        if value:
            return value
    raise KeyError(f"no project for {key}")
