"""Evaluators over batches of predictions, and several metrics from one match table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.operators import matching as M
from gridlore.plans.cut import cut


class Evaluator:
    """reset, process, evaluate. Batches are unions of plans; the first batch that has an image counts for it."""

    def __init__(self, gt: DataFrame, least: float = 0.5):
        self.gt, self.least = gt, least
        self.reset()

    def reset(self) -> None:
        self.batches: list[DataFrame] = []

    def process(self, pred: DataFrame) -> None:
        self.batches.append(pred.withColumn("__batch", F.lit(len(self.batches))))

    def predictions(self) -> DataFrame | None:
        if not self.batches:
            return None
        rows = self.batches[0]
        for b in self.batches[1:]:
            rows = rows.unionByName(b)
        first = rows.groupBy("tile_id").agg(F.min("__batch").alias("__first"))
        return rows.join(first, "tile_id").where("__batch = __first").drop("__batch", "__first")

    def evaluate(self) -> DataFrame | None:
        """The best point of the threshold sweep."""
        pred = self.predictions()
        if pred is None:
            return None
        return M.best(M.curve(M.tally(pred, M.candidates(self.gt, pred), self.least, []), self.gt.count(), []))


class Partial:
    """States of an evaluator that merge: image, batch, score and, of that image's predictions of that score in that batch, tp and n.

    An image counts in the least batch that has it, and a batch's rows of an image count once, so merging is commutative,
    associative and idempotent: states may come in any order, twice, and from any tree of merges. A state has
    at most a row a prediction, and is all that a batch leaves; its plan is never run again."""

    SCHEMA = "image long, batch int, score double, tp long, n long"

    @staticmethod
    def of(gt: DataFrame, pred: DataFrame, batch: int, least: float = 0.5) -> DataFrame:
        at = M.tally(pred, M.candidates(gt, pred), least, ["tile_id"])
        return at.select(F.col("tile_id").alias("image"), F.lit(batch).alias("batch"), "score", F.col("tp1").alias("tp"), F.col("n1").alias("n"))

    @staticmethod
    def merge(*states: DataFrame) -> DataFrame:
        rows = states[0]
        for s in states[1:]:
            rows = rows.unionByName(s)
        once = rows.repartition("image").groupBy("image", "batch", "score").agg(F.max("tp").alias("tp"), F.max("n").alias("n"))
        first = F.min("batch").over(Window.partitionBy("image"))
        return once.withColumn("__first", first).where("batch = __first").drop("__first")

    @staticmethod
    def finalise(state: DataFrame, n_gt: int) -> DataFrame:
        """The best point of the threshold sweep."""
        return M.best(M.curve(state.groupBy("score").agg(F.sum("tp").alias("tp1"), F.sum("n").alias("n1")), n_gt, []))


class States:
    """An evaluator whose batches leave their states in files: process once each, in any process, then evaluate.

    A batch that is processed again replaces its state."""

    def __init__(self, gt: DataFrame, path: str, least: float = 0.5):
        self.gt, self.path, self.least = gt, path, least

    def process(self, pred: DataFrame, batch: int) -> None:
        Partial.of(self.gt, pred, batch, self.least).drop("batch").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def state(self) -> DataFrame:
        return Partial.merge(self.gt.sparkSession.read.schema(Partial.SCHEMA).parquet(self.path))

    def evaluate(self) -> DataFrame:
        return Partial.finalise(self.state(), self.gt.count())


def compose(rows: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Several metrics of one match table, written once in the shared folder."""
    held = cut(rows)
    return {name: f(held) for name, f in metrics.items()}


def map_records(df: DataFrame, f: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """A row mapper over Arrow batches; None drops the row."""

    def each(frames):
        import pandas as pd

        for frame in frames:
            out = [r for r in map(f, frame.to_dict("records")) if r is not None]
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(each, schema)
