"""Tolerant as-of join: the latest order at or before each click, by ordinals over the union of both.

Orders of one key and time are collapsed into one group, which keeps its best order and its size. Groups and
clicks stand in one timeline, dealt over tasks by ranges of (key, time, kind, id), so a hot key or a hot instant
is many parts, none of them larger than the others. A running count of groups over the timeline, within a part
and carried over from the parts before it, numbers the groups of a key densely from 1 and gives each click
the ordinal of the group that precedes it. Click and group meet by an equi-join on key, part and ordinal; the group in
force where a part begins is carried into it, so all clicks after one order are no one task's work either.
What is carried is one row a key and part. The timeline is a written table: ranges are drawn once, and a lost
executor repeats its task on the same rows.

Nulls: a null key or time never matches. Among equal times larger preferences win, null ones lose. Clicks that
share an id are one click (of the earliest time, then the smallest key, nulls last); a null id is an id. Repeated orders
count each. Ties in all preferences leave rows that the carried columns do not tell apart. Empty tables give an
empty or an unmatched result. Other columns, of any names, are ignored. Texts take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm import common

HOUR = 3_600_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone as if in UTC, whatever the session's zone."""
    t = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(t.cast("timestamp"))
    seconds = F.hour(t).cast("long") * 3600 + F.minute(t) * 60
    return F.unix_date(t.cast("date")).cast("long") * (24 * HOUR) + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def latest_before(clicks: DataFrame, orders: DataFrame, within: int) -> DataFrame:
    """click, key, at, lag, order_at, n_tied, best for each distinct click of clicks (click, key, at: long).

    orders (key, at: long; best: a struct, the larger the better) holds what clicks match. Unmatched clicks have
    n_tied 0 and nulls."""
    order = F.struct(F.col("at").isNull().alias("a"), F.col("at").alias("b"), F.col("key").isNull().alias("c"), F.col("key").alias("d"))
    clicks = clicks.groupBy("click").agg(F.min(order).alias("o")).select("click", F.col("o.d").alias("key"), F.col("o.b").alias("at"))
    groups = orders.where("key is not null and at is not null").groupBy("key", "at").agg(F.struct(F.col("at"), F.count(F.lit(1)).alias("n"), F.max("best").alias("best")).alias("group"))
    marks = groups.select("key", "at", F.lit(0).alias("kind"), F.lit(None).cast(dict(clicks.dtypes)["click"]).alias("click"), "group")
    marks = marks.unionByName(clicks.select("key", "at", F.lit(1).alias("kind"), "click"), allowMissingColumns=True)
    place = [F.col(c) if c != "key" else F.coalesce(F.col("key"), F.xxhash64("click")) for c in ("key", "at", "kind", "click")]  # null keys match nothing: anywhere
    line = common.scratch(marks.repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "timeline")

    is_group = (F.col("kind") == 0).cast("long")
    ends = line.where("key is not null").groupBy("key", "part").agg(F.sum(is_group).alias("n"), F.max("group").alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = common.scratch(ends.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"), F.last("last", ignorenulls=True).over(before).alias("group")), "carried")
    running = Window.partitionBy("key", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = line.where("key is not null and at is not null").withColumn("own", F.sum(is_group).over(running))
    # Ordinals in a part count from the group carried into it, which is 0 there.
    numbered = known.where("kind = 0").select("key", "part", F.col("own").alias("ordinal"), "group")
    numbered = numbered.unionByName(carried.where("carry > 0").select("key", "part", F.lit(0).cast("long").alias("ordinal"), "group"))
    asked = known.where("kind = 1").select("click", "key", "at", "part", F.col("own").alias("ordinal"))
    met = asked.join(numbered, ["key", "part", "ordinal"], "left").select("click", "key", "at", "group")
    met = met.unionByName(line.where("kind = 1 and (key is null or at is null)").select("click", "key", "at", "group"))
    lag = F.col("at") - F.col("group.at")
    met = met.withColumn("group", F.when(lag <= within, F.col("group")))
    return met.select("click", "key", "at", lag.alias("lag"), F.col("group.at").alias("order_at"), F.coalesce("group.n", F.lit(0)).cast("long").alias("n_tied"), F.col("group.best").alias("best"))


def coarse(h: Column, at: Column) -> Column:
    """Times whose h is odd are floored to days."""
    day = F.lit(24 * HOUR)
    return F.when(h % 2 == 1, at - F.pmod(at, day)).otherwise(at)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales = common.table(spark, sf_dir, "clicks"), common.table(spark, sf_dir, "sales")
    digits = lambda c: F.crc32(F.col(c).cast("string"))
    asked = clicks.select(F.col("click_id").alias("click"), F.col("client_id").alias("key"), coarse(digits("click_id"), micros(clicks, "ts")).alias("at"))
    cents = F.when(F.abs("total") < float("inf"), F.floor(100 * F.col("total") + 0.5))
    h = digits("sale_id")
    own = F.struct(F.col("priority").cast("long").alias("priority"), F.bitwise_not("sale_id").alias("reverse"), cents.alias("cents"))
    # -1 - sale_id is the bitwise complement of sale_id.
    second = F.struct((6 - F.col("priority").cast("long")).alias("priority"), F.col("sale_id").alias("reverse"), cents.alias("cents"))
    both = F.when(h % 3 != 0, F.array(own, second)).otherwise(F.array(own))
    orders = sales.select(F.col("client_id").alias("key"), coarse(h, micros(sales, "sold_at")).alias("at"), F.explode(both).alias("best"))
    out = latest_before(asked, orders, 72 * HOUR)
    return out.select(
        F.col("click").alias("click_id"), F.col("key").alias("client_id"), F.col("at").alias("ts_us"),
        F.bitwise_not("best.reverse").alias("sale_id"), F.col("lag").alias("lag_us"), F.col("best.cents").alias("total_cents"), "n_tied",
    )


#: The remainders of the CRC-32 polynomial are worked out in SQL; then groups and an as-of join.
ORACLE = """
    WITH crc AS (SELECT list(list_reduce(list_concat([i::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
    hashed AS (SELECT id, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h
        FROM (SELECT click_id AS id FROM clicks UNION SELECT sale_id FROM sales), crc WHERE id IS NOT NULL),
    c AS (SELECT DISTINCT click_id, client_id, CASE WHEN h % 2 = 1 THEN epoch_us(ts) - ((epoch_us(ts) % 86400000000) + 86400000000) % 86400000000 ELSE epoch_us(ts) END AS ts_us FROM clicks LEFT JOIN hashed ON id = click_id),
    s AS (SELECT sale_id, client_id, h, priority, floor(100 * total + 0.5)::BIGINT AS cents, CASE WHEN h % 2 = 1 THEN epoch_us(sold_at) - ((epoch_us(sold_at) % 86400000000) + 86400000000) % 86400000000 ELSE epoch_us(sold_at) END AS o_at FROM sales LEFT JOIN hashed ON id = sale_id),
    o AS (SELECT sale_id, client_id, priority, cents, o_at FROM s UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, cents, o_at FROM s WHERE h % 3 <> 0),
    r AS (SELECT *, count(*) OVER (PARTITION BY client_id, o_at) AS n, row_number() OVER (PARTITION BY client_id, o_at ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST, cents DESC NULLS LAST) AS k FROM o WHERE client_id IS NOT NULL AND o_at IS NOT NULL),
    g AS (SELECT * FROM r WHERE k = 1)
    SELECT click_id, c.client_id, ts_us, CASE WHEN ts_us - o_at <= 259200000000 THEN sale_id END AS sale_id, CASE WHEN ts_us - o_at <= 259200000000 THEN ts_us - o_at END AS lag_us,
        CASE WHEN ts_us - o_at <= 259200000000 THEN cents END AS total_cents, CASE WHEN ts_us - o_at <= 259200000000 THEN n ELSE 0 END AS n_tied
    FROM c ASOF LEFT JOIN g ON c.client_id = g.client_id AND c.ts_us >= g.o_at"""
