"""Whole groups of rows in Arrow, many at a time: no Python call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group of a table that is sorted by ``keys``; null is a key as any other."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for c in keys if table.num_rows > 1 else []:
        column = table.column(c).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = compute.or_(compute.fill_null(compute.not_equal(a, b), False), compute.not_equal(compute.is_null(a), compute.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def over_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, least: int = 100_000) -> DataFrame:
    """``work`` on the rows in order, in tables of whole groups with about ``least`` rows (one group at least), and where each group begins.

    One exchange by the keys; a task holds one such table at a time. The exchange has its number of parts named, as adaptive
    execution would put few rows of much work into one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= least:
                table = pa.Table.from_batches(held).combine_chunks()
                first = begins(table, keys)
                if first[-1]:
                    yield from work(table.slice(0, int(first[-1])), first[:-1])
                held = table.slice(int(first[-1])).to_batches()
                size = sum(b.num_rows for b in held)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, begins(table, keys))

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)
