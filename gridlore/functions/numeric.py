"""Column expressions with the metric conventions used throughout: guarded ratios, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def rates(tp: Column, n_pred: Column, n_gt: Column) -> list[Column]:
    """precision, recall and f1 of counts."""
    p, r = ratio(tp, n_pred), ratio(tp, n_gt)
    return [r6(p).alias("precision"), r6(r).alias("recall"), r6(f1(p, r)).alias("f1")]


def prefix_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums in `order` within `keys`, inclusive, for sums = {new column: column}.

    `bucket` is an integer that never falls along `order` and has few values. Buckets are summed on their
    own, the few bucket totals are accumulated, and rows accumulate within their bucket: no key is sorted
    in one task however many rows it has."""
    rows = df.withColumn("__bucket", bucket)
    totals = rows.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums))
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__l_{n}": F.sum(c).over(within) for n, c in sums.items()})
    return local.join(shift, same).select(*df.columns, *((F.col(f"__l_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums))


def ranked(df: DataFrame, key: str, rank: str = "k") -> DataFrame:
    """Add `rank`, gapless from 0 over the integer `key`, counted over buckets of a thousand values."""
    rows = prefix_sums(df.withColumn("__one", F.lit(1)), [], F.floor(F.col(key) / 1000), [F.col(key)], {rank: "__one"})
    return rows.withColumn(rank, F.col(rank) - 1).drop("__one")
