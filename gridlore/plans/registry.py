"""Named queries beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlore.plans.views import Views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(make: Callable[[Views], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return make

        return add
