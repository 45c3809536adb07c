"""Helpers for tables of vectors: usable rows, Arrow lists as matrices, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import ship_module

ship_module(__name__)

#: Tasks that add up what the tasks of a pass have found, before the driver adds their sums.
FAN_IN = 32


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and holds finite numbers alone."""
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; all must have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries in one table")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def reduce_tasks(
    rows: DataFrame, part: Callable[[Iterable[np.ndarray]], np.ndarray | None], merge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    kind: str = "double",
) -> np.ndarray | None:
    """Reduce a table whose first column holds vectors to one array.

    ``part`` makes one flat array of ``kind`` of a task's matrices, ``merge`` joins two. The tasks' arrays meet in
    ``FAN_IN`` tasks and only these reach the driver; an array's size depends on the vectors' length alone.
    """
    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(matrix(b.column(0)) for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.from_numpy_dtype(found.dtype)))], names=["values"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in matrix(batch.column(0)):
                total = row if total is None else merge(total, row)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.from_numpy_dtype(total.dtype)))], names=["values"])

    out = f"values array<{kind}>"
    found = rows.mapInArrow(reduce_rows, out).repartition(FAN_IN).mapInArrow(join, out).toArrow()
    total = None
    for row in matrix(found["values"].combine_chunks()) if found.num_rows else []:
        total = row if total is None else merge(total, row)
    return total
