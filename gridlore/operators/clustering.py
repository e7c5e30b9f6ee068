"""Principal components from one matrix of sums, and k-means with seeding by squared distance.

Rows are (id, x: array<double> of one length). What reaches the driver is bounded by the length and the number of
clusters: sums, a matrix of length x length, and centres. Every step is one scan with sums before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def summed(parts: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Element by element sums of arrays `s` by key, of a bounded number of keys."""
    each = parts.select(key, F.posexplode("s").alias("j", "v")).groupBy(key, "j").agg(F.sum("v").alias("v"))
    rows = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("s")).collect()
    return {r[key]: np.array([e.v for e in r.s]) for r in rows}


def gram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the sum of outer products of what is left without it: two scans, so that no large sums cancel."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            x = matrix(b["x"])
            total = total + np.append(x.sum(axis=0), len(x))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), lists(total[None])], names=["k", "s"])

    found = summed(rows.select("x").mapInArrow(totals, "k int, s array<double>"), "k")[0]
    mean = found[:-1] / found[-1]

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            x = matrix(b["x"]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean)), pa.int32()), lists(total)], names=["k", "s"])

    rows_of = summed(rows.select("x").mapInArrow(outer, "k int, s array<double>"), "k")
    return mean, np.stack([rows_of[i] for i in range(len(mean))])


def components(rows: DataFrame, k: int = 32) -> DataFrame:
    """id, z: the first k principal components; the largest loading of each is positive."""
    mean, g = gram(rows)
    _, v = np.linalg.eigh(g)
    v = v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], lists((matrix(b["x"]) - mean) @ v)], names=["id", "z"])

    return rows.select("id", "x").mapInArrow(each, "id long, z array<double>")


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (row, centre), each from its own differences."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def draw(seed: int, step: int):
    """A number in (0, 1) of each row and step, from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "id"), F.lit(2**53)) + 0.5) / float(2**53)


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows, each drawn with a chance in proportion to its squared distance from those before: the least of -ln(u) / d."""
    centres: list[np.ndarray] = []
    for step in range(k):
        known = np.array(centres)

        def least(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, u = matrix(b["x"]), np.asarray(b["u"])
                    d = apart(x, known).min(axis=1) if len(known) else np.ones(len(x))
                    cost = np.where(d > 0, -np.log(u) / np.where(d > 0, d, 1), np.inf)
                    i = np.lexsort((np.asarray(b["id"]), cost))[0]
                    yield pa.RecordBatch.from_arrays([pa.array([cost[i]]), b["id"].slice(i, 1), b["x"].slice(i, 1)], names=["cost", "id", "x"])

        best = rows.select("id", "x", draw(seed, step).alias("u")).mapInArrow(least, "cost double, id long, x array<double>")
        centres.append(np.array(best.agg(F.min_by("x", F.struct("cost", "id")).alias("x")).first().x))
    return np.array(centres)


def clusters(rows: DataFrame, k: int, seed: int = 0, rounds: int = 60) -> DataFrame:
    """id, cluster: k-means for at most `rounds` rounds, fewer once centres settle. A centre without rows stays where it is.

    rows should be a written table: every round scans it."""
    centres = seeds(rows, k, seed)

    def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, centres.shape[1] + 1))
        for b in batches:
            x = matrix(b["x"])
            np.add.at(total, apart(x, centres).argmin(axis=1), np.column_stack([x, np.ones(len(x))]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), lists(total)], names=["k", "s"])

    for _ in range(rounds):
        found = summed(rows.select("x").mapInArrow(lambda b, c=centres: sums(b, c), "k int, s array<double>"), "k")
        new = np.stack([found[j][:-1] / found[j][-1] if found[j][-1] else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(apart(matrix(b["x"]), centres).argmin(axis=1).astype(np.int32))], names=["id", "cluster"])

    return rows.select("id", "x").mapInArrow(label, "id long, cluster int")
