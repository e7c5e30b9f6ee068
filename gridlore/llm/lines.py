"""Line dedup by levelled sorted runs of line hashes.

A line's key is the MD5 of the line, stripped of white space at both ends and with A-Z in lower case. Runs holds
sorted runs of (key, documents with it), each a table bucketed and sorted by key, so runs meet batches and
one another bucket by bucket without moving. A batch of documents is counted by key, with partial counts before the
shuffle; keys that a run already holds as settled (in `least` documents or more) are merge-anti-joined away, and the
rest become a new run of level 0. Two runs of a level are compacted into one of the next, so there are at most
as many runs as the number of batches has bits; a later batch costs its own keys and its share of compactions.

drop_frequent feeds a whole table batch by batch, then drops every line whose key is settled. Documents are told
apart by their place (file and row), so repeated rows and ids count each and none is a hot key; lines meet
the settled keys through a table broadcast at a checked size, or dealt over salts beyond it, and documents meet
the positions to drop by place. Whole texts take part; a document's lines are one row's array.

Null and empty texts are one empty line. Lines without a key (nothing but white space) stay. Ties do not arise. Other
columns, of any names, pass through drop_frequent as they are, but for `lines_before` and `lines_dropped`, which it
sets. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """16 bytes, null for a line without a key."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare != "", F.unhex(F.md5(F.translate(bare, UPPER, LOWER))))


class Runs:
    """Sorted runs of (key binary, n long) in levels, two runs of a level merged into one of the next."""

    def __init__(self, spark: SparkSession, least: int):
        self.spark, self.least = spark, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def write(self, counts: DataFrame) -> str:
        """A run as a bucketed, sorted table in the shared folder. Its rows are dealt by key already, so each bucket is one file."""
        name = f"gridlore_run_{uuid.uuid4().hex}"
        path = common.new_path(self.spark, name)
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        common.forget(self.spark, path)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        common.drop_scratch(self.spark, *[p for p in common.MADE if f"/{name}-" in p])

    def new(self, counts: DataFrame) -> DataFrame:
        """What of a batch's counts (key, n) no run holds as settled."""
        settled = [self.spark.table(r).where(F.col("n") >= self.least) for r in self.levels if r]
        return reduce(lambda left, run: left.join(run.hint("merge"), "key", "left_anti"), settled, counts)

    def add(self, keys: DataFrame) -> None:
        """Count a batch (key: one row a document and key) and add it as a run; compact where a level has two."""
        run = self.write(self.new(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))))
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self.merge(run, other), None
        self.levels.append(run)

    def merge(self, a: str, b: str) -> str:
        left, right = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
        both = left.join(right.hint("merge"), "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        name = self.write(both)
        self.drop(a)
        self.drop(b)
        return name

    def settled(self) -> DataFrame:
        """key: those in `least` documents or more, over all batches."""
        while len(runs := [r for r in self.levels if r]) > 1:
            self.levels = [self.merge(runs[0], runs[1]), *runs[2:]]
        return self.spark.table(runs[0]).where(F.col("n") >= self.least).select("key")

    def close(self) -> None:
        for name in filter(None, self.levels):
            self.drop(name)


def placed(docs: DataFrame) -> DataFrame:
    """docs with a row's file and row number; what is read from no such files is written first."""
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return common.scratch(docs, "documents").select("*", *place)


def drop_frequent(docs: DataFrame, least: int = 10, batches: int = 4) -> DataFrame:
    """docs without the lines whose key is found in `least` documents or more; with lines_before and lines_dropped."""
    spark, docs = docs.sparkSession, placed(docs)
    batch = F.pmod(F.xxhash64("__file", "__row"), F.lit(batches)).cast("int").alias("__batch")
    path = common.new_path(spark, "lines")
    docs.select("__file", "__row", batch, F.transform(split(F.col("text")), key).alias("keys")).write.partitionBy("__batch").parquet(path)
    common.forget(spark, path)
    lines = spark.read.schema("__file string, __row long, keys array<binary>, __batch int").parquet(path)
    runs = Runs(spark, least)
    for k in range(batches):
        runs.add(lines.where(F.col("__batch") == k).select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null"))
    settled = common.scratch(runs.settled().withColumnRenamed("key", "settled"), "settled")
    runs.close()
    each = lines.select("__file", "__row", F.posexplode("keys").alias("__line", "key")).where("key is not null")
    hits = common.look_up(each, settled, "key", "settled", ["__file", "__row", "__line"])
    drops = hits.groupBy(F.col("__file").alias("file"), F.col("__row").alias("row")).agg(F.sort_array(F.collect_list("__line")).alias("__drop"))
    drops, own = common.write_scratch(drops, "drops")
    common.drop_scratch(spark, path)
    small = common.stored_bytes(drops) <= 16_000_000
    out = docs.join(F.broadcast(drops) if small else drops, (F.col("__file") == F.col("file")) & (F.col("__row") == F.col("row")), "left")
    out = out.withColumns({"lines_before": F.size(split(F.col("text"))).cast("long"), "lines_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")})
    return out.withColumn("text", kept(F.col("text"), F.col("__drop"))).drop("__file", "__row", "file", "row", "__drop")


def kept(text: Column, drop: Column) -> Column:
    """The text without the lines at the positions `drop` (ascending): the stretches between them, in time linear in the lines."""
    own = split(text)
    ends = F.concat(drop, F.array(F.size(own)))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
    rest = F.flatten(F.transform(ends, lambda end, i: F.slice(own, begin(i) + 1, end - begin(i))))
    return F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.concat_ws("\n", rest))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, r, len(l) AS n, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON f.key = k.key GROUP BY doc_id, r"""
