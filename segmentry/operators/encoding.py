"""Shares of four letters at each place of a sequence, as long rows and as sums of each channel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L

#: Sequences whose shares are held at once.
ROWS = 256


def letters(column: pa.Array, length: int) -> np.ndarray:
    """(n, length): of the first letters, upper-cased, the number of a known one, and 4 for another and for padding."""
    code, at = L.codes(column)
    place = at[:-1, None] + np.arange(length)[None]
    on = place < at[1:, None]
    out = np.full(on.shape, 4, dtype=np.int8)
    out[on] = np.where(code < L.OTHER, code & 3, 4)[place[on]]
    return out


def encoded(column: pa.Array, length: int, other: float = 0.25) -> np.ndarray:
    """(n, length, 4) of the upper-cased first letters; unknown letters and padding are a quarter each."""
    return np.append(np.eye(4), np.full((1, 4), other), axis=0)[letters(column, length)]


def worked(rows: DataFrame, key: str, text: str, kind: T.StructType, make) -> DataFrame:
    """(key, *make(shares)): make gives, of ROWS sequences, the numbers of rows and the other columns."""
    held = rows.select(key, F.col(text).alias("__text"))
    whole = T.StructType([held.schema[key], *kind.fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, *columns = make(part.column("__text"))
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), *map(pa.array, columns)], whole.fieldNames())

    return held.mapInArrow(run, whole)


def long_rows(rows: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(key, pos, channel, v) of every place and letter; a null sequence gives one row of nulls.

    Python gives a byte a place; the rows, many to a byte, are made where they go.
    """

    def run(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), ROWS):
            part = column.slice(at, ROWS)
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * length, mask=np.append(part.is_null().to_numpy(zero_copy_only=False), False))
            out.append(pa.ListArray.from_arrays(ends, pa.array(letters(part, length).ravel())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int8()))

    each = rows.select(key, F.posexplode_outer(F.arrow_udf(run, T.ArrayType(T.ByteType()))(F.col(text))).alias("pos", "__letter"))
    letter, none = F.col("__letter"), F.lit(None).cast("int")
    channels = F.when(letter.isNull(), F.array(none)).otherwise(F.array(*map(F.lit, range(4))))
    v = F.when(letter == F.col("channel"), 1.0).when(letter == 4, 0.25).when(letter.isNotNull(), 0.0)
    return each.select(key, "pos", "__letter", F.explode(channels).alias("channel")).select(key, "pos", "channel", v.alias("v"))


def channel_sums(rows: DataFrame, key: str, text: str, length: int, reverse: bool = False) -> DataFrame:
    """(key, channel, total, placed): of each channel the sum of shares and that of shares times places from 1; reversed,
    places and channels run backwards, as those of the reverse complement. A null sequence has null sums."""
    kind = T.StructType().add("channel", T.IntegerType()).add("total", T.DoubleType()).add("placed", T.DoubleType())

    def make(column):
        x = encoded(column, length)
        x = x[:, ::-1, ::-1] if reverse else x
        gone = np.repeat(column.is_null().to_numpy(zero_copy_only=False), 4)
        total, placed = x.sum(axis=1).ravel(), np.einsum("npc,p->nc", x, np.arange(1.0, length + 1)).ravel()
        n = len(column)
        return np.repeat(np.arange(n), 4), np.tile(np.arange(4, dtype=np.int32), n), pa.array(total, mask=gone), pa.array(placed, mask=gone)

    return worked(rows, key, text, kind, make)
