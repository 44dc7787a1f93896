"""Principal components over all rows by randomised subspace iteration.

A pass sketches the standardised rows A in blocks: Y = A W for a few directions W, the
triangular factor of Y by a tree of QR factorisations (a task factors its own rows; factors
are stacked and factored again), and Y'A. From these follow A on the range of Y, its singular
values and its right vectors, which are the directions of the next pass. With as many
directions as columns one pass is exact; else passes go on until the values settle.

Rows never leave their tasks. What tasks hand on, and at last the driver holds, is one
triangular factor and one sketch: as many rows as there are directions.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges as R

#: Directions beyond those asked for; relative change of the values at which passes end; seed of the first directions.
MORE, SETTLED, SEED = 10, 1e-13, 20260408
#: Rows of a block in a task; parts that one task of the tree puts together.
ROWS, FAN = 512, 16

Dense = Callable[[pa.RecordBatch], np.ndarray]


@dataclass(frozen=True)
class Components:
    """Rows, means and deviations of the columns; singular values and vectors (rows) of the standardised table, the sum of its squares, and passes."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float
    passes: int

    def shares(self) -> np.ndarray:
        """Of the variance of all columns, what each component explains."""
        return self.values**2 / self.total if self.total else self.values


def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpacked(raw: bytes | pa.Buffer) -> list[np.ndarray]:
    held = np.load(io.BytesIO(raw), allow_pickle=False)
    return [held[k] for k in held.files]


def blocks(batches: Iterator[pa.RecordBatch], dense: Dense, step: int = ROWS) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            x = dense(batch.slice(at, step))
            # A matrix over a batch's own memory cannot be written to.
            yield x if x.flags.writeable else x.copy()


def together(parts: DataFrame, merge: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """What all parts (one packed row a task) make, merged FAN at a time in a tree; None without parts."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": rows["id"].iloc[:1] // FAN, "part": [packed(*merge([unpacked(bytes(p)) for p in rows["part"]]))]})

    parts = R.stored(parts.select(F.spark_partition_id().cast("long").alias("id"), "part"), "parts")
    while parts.count() > 1:
        parts = R.stored(parts.groupBy(F.floor(F.col("id") / FAN).alias("up")).applyInPandas(merged, "id long, part binary"), "parts")
    row = parts.first()
    return unpacked(bytes(row["part"])) if row else None


def add_moments(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts, means and sums of squared deviations of several parts as those of all."""
    n, mean, m2 = parts[0]
    for k, other, more in parts[1:]:
        gap, every = other - mean, n + k
        mean, m2 = mean + gap * (k / every), m2 + more + gap**2 * (n * k / every)
        n = every
    return [n, mean, m2]


def moments(rows: DataFrame, dense: Dense, step: int = ROWS) -> list[np.ndarray] | None:
    def run(batches):
        held = None
        for x in blocks(batches, dense, step):
            mean = x.mean(axis=0)
            x -= mean
            part = [np.array(float(len(x))), mean, np.einsum("ij,ij->j", x, x)]
            held = add_moments([held, part]) if held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([packed(*held)], pa.binary())], ["part"])

    return together(rows.mapInArrow(run, "part binary"), add_moments)


def add_sketches(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    factor = np.linalg.qr(np.concatenate([p[0] for p in parts]), mode="r")
    return [factor, sum(p[1] for p in parts)]


def sketched(rows: DataFrame, dense: Dense, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, step: int = ROWS) -> list[np.ndarray]:
    """The triangular factor of Y = A W, and Y'A; the deviations divide W and Y'A, not each row."""
    told = rows.sparkSession.sparkContext.broadcast((mean, scale, w))

    def run(batches):
        mean, scale, w = told.value
        held, scaled = None, w / scale[:, None]
        for x in blocks(batches, dense, step):
            x -= mean
            y = x @ scaled
            factor, product = np.linalg.qr(y, mode="r"), y.T @ x
            if held:
                held[0] = np.linalg.qr(np.concatenate([held[0], factor]), mode="r")
                held[1] += product
            else:
                held = [factor, product]
        if held:
            held[1] /= scale
            yield pa.RecordBatch.from_arrays([pa.array([packed(*held)], pa.binary())], ["part"])

    return together(rows.mapInArrow(run, "part binary"), add_sketches)


def fit(rows: DataFrame, dense: Dense, components: int, passes: int, ddof: int = 1, least: float = 0.0, settled: float = SETTLED, step: int = ROWS) -> Components | None:
    """Leading components of all rows, `dense` giving the rows of a batch as a matrix; None without rows.

    Columns are centred and divided by their deviation (plus `least`; constant ones by 1). At
    most `passes` passes are made; those beyond the first end when no value changes by more
    than `settled` of it. `dense` gets `step` rows at a time, and its matrix is written to. The largest entry of a vector is positive. There are no more components than
    columns, or than rows; those of a value of zero are left out.
    """
    found = moments(rows, dense, step)
    if found is None:
        return None
    n, mean, m2 = int(found[0]), found[1], found[2]
    scale = np.sqrt(m2 / max(1, n - ddof)) + least
    scale = np.where(scale > 0, scale, 1.0)
    columns = len(mean)
    wide = min(columns, components + MORE)
    w = np.eye(columns) if wide == columns else np.linalg.qr(np.random.default_rng(SEED).normal(size=(columns, wide)))[0]
    values = vectors = None
    for made in range(1, passes + 1):
        factor, product = sketched(rows, dense, mean, scale, w, step)
        _, s, v = np.linalg.svd(factor, full_matrices=False)
        on = s > s.max(initial=0) * 1e-13
        _, new, right = np.linalg.svd((v[on] @ product) / s[on, None], full_matrices=False)
        done = values is not None and len(values) == len(new) and np.all(np.abs(new - values)[:components] <= settled * np.maximum(new[:components], 1e-300))
        values, vectors, w = new, right, right.T
        if done or wide == columns or not len(new):
            break
    real = values > values.max(initial=0) * 1e-12
    values, vectors = values[real][:components], vectors[real][:components]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return Components(n, mean, scale, values, vectors * signs[:, None], float((m2 / scale**2).sum()), made)
