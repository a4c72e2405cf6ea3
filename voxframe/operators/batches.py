"""Bounded groups in Arrow batches.

Rows are hash-partitioned and sorted by the group key, and each task walks its
sorted stream. Only the group in progress is held back, so callers must use
keys whose groups have a size bound (a cube, an image plane).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each run of equal keys."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def task_count(df: DataFrame) -> int:
    """Tasks for array work: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_sorted_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str,
                      fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], sized_by: DataFrame | None = None) -> DataFrame:
    """``fn(table, starts)`` gets whole groups, many at a time, in key order.

    ``sized_by`` is a stored table that tells the amount of work where ``rows``
    itself has only a rough size estimate.
    """
    # a fixed partition count keeps heavy work on few bytes parallel where AQE would merge it
    parts = task_count(rows if sized_by is None else sized_by)
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            starts = group_starts(table, keys)
            last = int(starts[-1])
            if last:
                yield from fn(table.slice(0, last).combine_chunks(), starts[:-1])
            held = table.slice(last)
        if held is not None:
            yield from fn(held.combine_chunks(), np.zeros(1, dtype=np.int64))

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
