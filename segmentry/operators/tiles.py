"""All pairs of rows as pairs of packed blocks.

A block is one row of a table: the keys of a few thousand rows and their numbers as bytes. A task
meets every block of a part of one table with every block of a part of another, reading the blocks
again for each part they meet. So pairs are never shuffled or written, and a task holds two blocks
and what it adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

#: Rows of a block, and bytes of its vectors, at most (one row at least).
ROWS, BYTES = 2048, 1 << 20


def dense(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows; a null number is not a number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def numbers(raw: pa.Scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), dtype=kind)


def parts(batches: Iterator[pa.RecordBatch], vector: str, rows: int = ROWS) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in blocks, with numbers that no other task gives."""
    no = TaskContext.get().partitionId() << 32
    for batch in batches:
        width = len(batch.column(vector)[0]) if batch.num_rows else 1
        step = max(1, min(rows, BYTES // (8 * max(1, width))))
        for at in range(0, batch.num_rows, step):
            yield no, batch.slice(at, step)
            no += 1


def crossed(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of both tables that go together, a task for each two parts of them, without a shuffle or a broadcast."""
    return left.hint("shuffle_replicate_nl").join(right, on)


def equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all pairs of equal keys."""
    order = np.argsort(b, kind="stable")
    held = b[order]
    low, high = (np.searchsorted(held, a, side) for side in ("left", "right"))
    n = high - low
    at = np.repeat(np.arange(len(a)), n)
    return at, order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - low, n)]
