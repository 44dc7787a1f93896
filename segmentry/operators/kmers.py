"""Words of k letters as long, sparse tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L

#: Rows of a batch that a task hands on.
OUT = 1 << 18


def vocabulary(spark: SparkSession, k: int) -> DataFrame:
    """(idx, kmer) of all 4 ** k words in order; the index spells the word in base four."""
    digit = lambda i: F.substr(F.lit("ACGT"), (F.floor(F.col("id") / (4 ** (k - 1 - i))) % 4 + 1).cast("int"), F.lit(1))
    return spark.range(4**k).select(F.col("id").alias("idx"), F.concat(*(digit(i) for i in range(k))).alias("kmer"))


def tallied(rows: DataFrame, key: list[str], text: str, k: int, n_bins: int | None = None, summed: bool = False) -> DataFrame:
    """(key, kmer, n, freq), with the slice after the key if there are n_bins: words are counted where the row is, nothing is shuffled.

    Summed, a batch gives one row (key, kmer, n) for each key and word.
    """
    held = rows.select(*key, F.col(text).alias("__text"))
    kind = T.StructType([held.schema[c] for c in key] + ([T.StructField("slice", T.IntegerType())] if n_bins else []))
    kind = kind.add("kmer", T.StringType()).add("n", T.LongType())
    kind = kind if summed else kind.add("freq", T.DoubleType())
    names = kind.fieldNames()

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for first, last in L.pieces(column):
                code, at = L.codes(column.slice(first, last - first))
                part, word, n, total = L.counted(code, L.slices(at, n_bins) if n_bins else at, k)
                for i in range(0, len(part), OUT):
                    p, w, c, t = (v[i : i + OUT] for v in (part, word, n, total))
                    row = pa.array(first + (p // n_bins if n_bins else p))
                    keys = [batch.column(x).take(row) for x in key] + ([pa.array((p % n_bins).astype(np.int32))] if n_bins else [])
                    if summed:
                        table = pa.table([*keys, pa.array(w), pa.array(c)], names).group_by(names[:-1]).aggregate([("n", "sum")]).combine_chunks()
                        *keys, w, c = (table.column(x).combine_chunks() for x in [*names[:-1], "n_sum"])
                        yield pa.RecordBatch.from_arrays([*keys, L.spelled(w.to_numpy(), k), c], names)
                    else:
                        yield pa.RecordBatch.from_arrays([*keys, L.spelled(w, k), pa.array(c), pa.array(c / t)], names)

    return held.mapInArrow(run, kind)


def frequencies(rows: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """(key, kmer, n, freq): known words over the words counted. A row without any gives none."""
    return tallied(rows, key, text, k)


def positional(rows: DataFrame, key: list[str], text: str, k: int, n_bins: int) -> DataFrame:
    """Frequencies in each of n_bins slices; words do not cross slices."""
    return tallied(rows, key, text, k, n_bins)


def totals(rows: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """(key, kmer, n): words of all rows of a key; a task sends one row for each key and word of a batch."""
    return tallied(rows, key, text, k, summed=True).groupBy(*key, "kmer").agg(F.sum("n").alias("n"))


def entropies(rows: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """(key, h): bits of the shares of words of each row that has any."""
    held = rows.select(*key, F.col(text).alias("__text"))
    kind = T.StructType([held.schema[c] for c in key]).add("h", T.DoubleType())

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for first, last in L.pieces(column):
                where, _, n, total = L.counted(*L.codes(column.slice(first, last - first)), k)
                h = np.bincount(where, -n / total * np.log2(n / total), minlength=last - first)
                row = np.unique(where)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(pa.array(first + row)) for x in key), pa.array(h[row])], kind.fieldNames())

    return held.mapInArrow(run, kind)
