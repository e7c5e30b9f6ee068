"""Cutting lineage where a plan iterates, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridlore-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A place for files of that name, one a session: writing again replaces what is there."""
    return f"{shared_dir(spark)}/gridlore/{spark.sparkContext.applicationId}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
