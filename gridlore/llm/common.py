"""Shared pieces: reading tables, scratch tables in the shared folder, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridlore-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the scratch tables of this process that are still there, in the order of their making.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/gridlore/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Have a written scratch table deleted when the driver ends, if nothing deletes it before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, name)[0]


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in MADE:
            MADE.remove(path)


def drop_since(spark: SparkSession, mark: int, *keep: str) -> None:
    """Delete what was made after MADE had `mark` paths, but for `keep`."""
    drop_scratch(spark, *[p for p in MADE[mark:] if p not in keep])


class Tables:
    """Scratch tables of one operator, deleted once its result is planned, but for those that the result reads."""

    def __init__(self):
        self.made: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(write_scratch(df, name))
        return self.made[-1][0]

    def drop_but(self, *keep: DataFrame) -> None:
        for df, path in self.made:
            if not any(df is k for k in keep):
                drop_scratch(df.sparkSession, path)


def give_back() -> None:
    """Return the memory that this worker has freed to the system; else it stays with the idle worker, beside the next stage's."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_columns(df: DataFrame, schema: StructType | str, start: Callable[[], Callable[..., list]], rows: int = 2000) -> DataFrame:
    """Arrow batches through a function of Python lists, one a column, that returns such lists for `schema`.

    start() runs once a task and gives the function. Slices of at most `rows` rows bound memory; integers
    and nulls stay exact."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                out = work(*(c.to_pylist() for c in batch.slice(i, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
        work = out = batch = None
        give_back()

    return df.mapInArrow(each, kind)


def map_groups(df: DataFrame, keys: list[str], schema: StructType | str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """Groups of rows that share `keys`, one after another in a task, through a function of Python lists.

    As map_columns; one shuffle on the keys and a sort that spills. A group is held whole, so callers bound
    its size."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow, at = to_arrow_schema(kind), [df.columns.index(k) for k in keys]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, key, held = start(), None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = work(*(list(c) for c in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                held.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True):
                    own = [row[k] for k in at]
                    if own != key:
                        yield from flush()
                        key = own
                    held.append(row)
        yield from flush()
        work = batch = None
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, kind)


def map_whole(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Arrow batches with all columns of df, in their order, through a function that returns such batches. Names may be any."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(each, plain.schema).toDF(*df.columns)


def replace_columns(df: DataFrame, names: list[str], start: Callable[[], Callable[..., list]], rows: int = 2000) -> DataFrame:
    """As map_columns, but only the named columns go through the function; the others stay as they are."""
    at = [df.columns.index(n) for n in names]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                arrays = list(part.columns)
                for k, column in zip(at, work(*(arrays[k].to_pylist() for k in at)), strict=True):
                    arrays[k] = pa.array(column, arrays[k].type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)
        work = batch = part = arrays = None
        give_back()

    return map_whole(df, each)


def stored_bytes(df: DataFrame) -> int:
    """What the files of a written table hold."""
    jvm, conf, total = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(name)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def look_up(left: DataFrame, right: DataFrame, key: str, other: str, spread: list[str], how: str = "inner", most: int = 16_000_000, salts: int = 64) -> DataFrame:
    """left joined with the written table `right`, one row a key, whichever share of left one key holds.

    A right of at most `most` bytes of files is broadcast; a larger one is copied `salts` times, and each key of
    left dealt over the copies by a hash of the columns `spread`."""
    if stored_bytes(right) <= most:
        return left.join(F.broadcast(right), F.col(key) == F.col(other), how)
    some = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return some.join(copies, (F.col(key) == F.col(other)) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], rank: str, part_rows: int = 200_000, most_parts: int = 4096) -> DataFrame:
    """Add `rank`, gapless from 0 within `keys`, without sorting any one key in one task.

    df is a written table. Each key is dealt into parts by a hash of the row's place in its file, so that equal
    rows part too, about `part_rows` rows a part at most; parts are numbered on their own and shifted by the number of
    rows in the parts before them. Few rows need one part, and are ranked by `order`.
    """
    splits = int(min(most_parts, 1 + df.count() // part_rows))
    spot = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(splits)) if splits > 1 else F.lit(0)
    part = df.select("*", spot.cast("int").alias("__part"))
    sizes = part.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("__shift", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    local = part.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    joined = local.alias("l").join(shift.alias("s"), [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__part"]])
    kept = [F.col(f"l.{c}").alias(c) for c in df.columns]
    return joined.select(*kept, (F.col("__shift") + F.col("__local") - 1).alias(rank))


#: Edges of a task that writes a round of components.
EDGES_A_TASK = 100_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of every node of `edges` (src, dst: long): columns id, component (smallest id reachable).

    Alternating large-star and small-star steps; each keeps the edge count within the input's and halves
    distances, so a few rounds suffice, none where the edges are stars. Rounds are cut by tables in the shared
    folder; only counts and whether they have settled reach the driver. Nulls and self loops are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null and u <> v").distinct()
    e, path = write_scratch(e, "edges")
    tasks = 8 + e.count() // EDGES_A_TASK  # later rounds have no more edges
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbour, edges up to smaller nodes, and whether there are edges down. Settled: all have one edge up or only some down.
        low, low_path = write_scratch(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum((F.col("v") < F.col("u")).cast("int")).alias("up"), F.max((F.col("v") > F.col("u")).cast("int")).alias("down")).coalesce(tasks), "low")
        if low.where("up + down > 1").isEmpty():
            drop_scratch(spark, low_path)
            break
        large = both.where("v > u").join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = write_scratch(small.coalesce(tasks), "edges")
        drop_scratch(spark, path, low_path)
        e, path = new, new_path
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def merge_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components as of connected_components (found, written) once the edges `more` (src, dst), few of them, are added."""
    old = found.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    for side in ("src", "dst"):
        more = more.join(old, F.col(side) == F.col("__id"), "left").withColumn(side, F.coalesce("__c", side)).drop("__id", "__c")
    new, path = write_scratch(connected_components(more).withColumnsRenamed({"id": "__id", "component": "__c"}), "merged")
    kept = found.join(new, F.col("component") == F.col("__id"), "left").select("id", F.coalesce("__c", "component").alias("component"))
    alone = new.join(found, F.col("__id") == F.col("id"), "left_anti").select(F.col("__id").alias("id"), F.col("__c").alias("component"))
    return kept.unionByName(alone)
