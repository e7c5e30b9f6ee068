"""Streams of metric events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gridlore.sources.jobs import existing

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, path: str, state: str = "state") -> StreamingQuery:
    """Metric events to Parquet below path once each: only iterations over the last written, which then advances.

    A batch writes to a folder of its own name, and its mark beside it, so that a batch that is run again after a
    failure replaces what it wrote. Another `state` replays the stream: the marks of the earlier run hold it off."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = f"run={state}-{number}"
        marks = existing(spark, f"{path}/marks")
        last = marks.where(F.col("run") != own.removeprefix("run=")).agg(F.max("last")).first()[0] if marks is not None else None
        fresh = batch if last is None else batch.where(F.col("iteration") > last)
        fresh.write.mode("overwrite").parquet(f"{path}/events/{own}")
        top = spark.read.parquet(f"{path}/events/{own}").agg(F.max("iteration").alias("last")).where("last is not null")
        top.write.mode("overwrite").parquet(f"{path}/marks/{own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/{state}").trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """The first event of each key, state kept for `delay` of event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


class Seen(StatefulProcessor):
    """Of each key: how many of its events have been seen, their total, the least id of its first batch, and how many batches had it."""

    SCHEMA = "key long, n long, total double, first long, round int"

    def init(self, handle) -> None:
        self.state = handle.getValueState("seen", "n long, total double, first long, round int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, first, number = self.state.get() if self.state.exists() else (0, 0.0, None, 0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
            if number == 0:
                least = int(frame["event_id"].min())
                first = least if first is None else min(first, least)
        state = (n, total, first, number + 1)
        self.state.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["key", "n", "total", "first", "round"])

    def close(self) -> None:
        pass


def running(stream: DataFrame, key: str, path: str) -> DataFrame:
    """Running counts of each key over all that is there now, one row a key and batch that has it, in files below path.

    State is kept by key in the store that state with columns needs, so a batch costs its own keys; a batch that is run
    again after a failure replaces what it wrote."""
    spark, run, store = stream.sparkSession, uuid.uuid4().hex[:12], "spark.sql.streaming.stateStore.providerClass"
    rows = stream.select(F.col(key).alias("key"), "event_id", "value").groupBy("key").transformWithStateInPandas(Seen(), Seen.SCHEMA, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{run}/table/batch={number}")

    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/{run}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(f"{Seen.SCHEMA}, batch int").parquet(f"{path}/{run}/table")


def moments(stream: DataFrame, by: str = "event_type") -> DataFrame:
    """One-pass sums by group, for update or complete mode."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def best_so_far(stream: DataFrame, by: str = "event_type") -> DataFrame:
    return stream.groupBy(by).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


def windowed(stream: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def settled(frame: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """The result table of a stream over all that is there now, in files below path.

    In complete mode a batch replaces the table; in append mode it adds a folder of its own name."""
    run = uuid.uuid4().hex[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{run}/table" + (f"/batch={number}" if mode == "append" else ""))

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/{run}/state").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/{run}/table")
