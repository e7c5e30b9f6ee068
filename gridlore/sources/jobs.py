"""Registers, hooks, resumable jobs and cached tables around queries."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def digest(table: DataFrame) -> str:
    """A name for what a table is read from: its files, in any session alike."""
    return hashlib.md5("\n".join(sorted(table.inputFiles())).encode()).hexdigest()


def cached(spark: SparkSession, path: str, key: object, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept below path under a key such as the number of its ids; another key makes it anew."""
    place = f"{path}/key={key}"
    if existing(spark, place) is None:
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def resume(spark: SparkSession, names: Iterable[str], job: Callable[[str], DataFrame], path: str) -> list[tuple[str, str]]:
    """Run the jobs whose result is not below path yet; one that fails is logged with its error and the others go on.

    (name, status) of each: skipped, done or failed. A result counts once it is committed whole."""
    out = []
    for name in names:
        place = f"{path}/{name}"
        if existing(spark, place) is not None:
            out.append((name, "skipped"))
            continue
        try:
            job(name).write.mode("overwrite").parquet(place)
            out.append((name, "done"))
        except Exception:  # the loop's contract: whatever a job raises, go on with the next
            logging.getLogger(__name__).exception("job %s failed", name)
            out.append((name, "failed"))
    return out


class Hooks:
    """Functions called in the order they were added, but for the one that must come last."""

    def __init__(self):
        self.some: list[tuple[str, Callable[[], None]]] = []
        self.final: tuple[str, Callable[[], None]] | None = None

    def add(self, name: str, f: Callable[[], None], last: bool = False) -> None:
        if last:
            if self.final:
                raise ValueError(f"{self.final[0]} is last already")
            self.final = (name, f)
        else:
            self.some.append((name, f))

    def run(self) -> list[str]:
        called = [*self.some, *([self.final] if self.final else [])]
        for _, f in called:
            f()
        return [name for name, _ in called]
