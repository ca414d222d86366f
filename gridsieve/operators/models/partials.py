"""Sums of arrays over all rows, added up inside tasks first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..similarity import matrix_as_rows, rows_as_matrix

# Tasks that add up the tasks' results; so many rows reach the driver at most.
MERGERS = 16


def merged(
    rows: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add,
    few: bool = False,
) -> np.ndarray | None:
    """One vector: ``partial`` makes it of a task's batches, ``merge`` joins two of them.

    Its length must be fixed by the model, not by the data.  None without rows.  With ``few``
    the caller knows that the tasks are few, and their results need no further tasks.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(b for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([matrix_as_rows(found.reshape(1, -1))], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in rows_as_matrix(batch.column(0)) if batch.num_rows else ():
                held = row if held is None else merge(held, row)
        if held is not None:
            yield pa.RecordBatch.from_arrays([matrix_as_rows(held.reshape(1, -1))], ["v"])

    parts = rows.mapInArrow(first, "v array<double>")
    if not few:
        parts = parts.repartition(MERGERS).mapInArrow(again, "v array<double>")
    table = parts.toArrow()
    out = None
    for row in rows_as_matrix(table.column("v")) if table.num_rows else ():
        out = row if out is None else merge(out, row)
    return out
