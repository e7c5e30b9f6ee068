"""Groups of rows through functions on whole Arrow columns, many groups a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def begins(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where each run of rows with equal keys begins; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table[k].combine_chunks() if isinstance(table[k], pa.ChunkedArray) else table[k]
        new[1:] |= np.diff(np.asarray(column.dictionary_encode(null_encoding="encode").indices)) != 0
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], each: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """each(rows, begins) for rows of df in whole groups, one after another, and where each group begins; it returns rows of `schema`.

    One shuffle on the keys, none if df is dealt by them already, and a sort that spills. A call has the groups that end in one Arrow batch; only a group
    longer than that is put together from several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                yield from each(table, begins(table, keys)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(begins(batch, keys)[-1])
            if last:
                held.append(batch.slice(0, last))
            if last or held and any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys):
                yield from done()
            held.append(batch.slice(last))
        yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
