"""Parquet tables of the corpus, of features and of selections, aligned line files, and small JSON manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranges as R
from .text import placed, read_splits


def write_corpus(rows: DataFrame, path: str) -> None:
    """One table, a folder for each split, so that readers of one split read nothing else."""
    rows.write.partitionBy("split").parquet(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.where(rows.split == split) if split else rows
    return rows.select(*columns) if columns else rows


#: Features of a block: a reader of a few features reads their blocks only.
BLOCK = 256


def write_features(rows: DataFrame, names: DataFrame, path: str, key: str, block: int = BLOCK) -> None:
    """Sparse rows (key, x: array of (i, v)) with their vocabulary (i, name).

    `rows` holds the keys, `vectors` a row for each key and block of the vocabulary with entries there,
    compressed to arrays of places and values, a folder a block; `vocabulary` has, for each feature, its
    block and its number of entries, sum, sum of squares, least and greatest value. Entries are to have
    places of the vocabulary, each once a row; null rows are as empty ones.
    """
    rows.select(key).write.parquet(f"{path}/rows")
    kind = T.StructType([rows.schema[key]]).add("block", T.IntegerType()).add("places", T.ArrayType(T.IntegerType())).add("numbers", T.ArrayType(T.DoubleType()))

    def parted(batches):
        for batch in batches:
            for row, i, v in entries(batch):
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (i[1:] // block != i[:-1] // block)]))
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i, v)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row[first])), pa.array(i[first] // block), *lists], kind.fieldNames())

    rows.select(key, "x").mapInArrow(parted, kind).write.partitionBy("block").parquet(f"{path}/vectors")

    vectors = rows.sparkSession.read.schema(kind).parquet(f"{path}/vectors")
    each = vectors.select(F.explode(F.arrays_zip("places", "numbers")).alias("e")).select(F.col("e.places").alias("i"), F.col("e.numbers").alias("v"))
    sums = each.groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.min("v").alias("least"), F.max("v").alias("most"))
    told = names.select("i", "name", F.floor(F.col("i") / block).cast("int").alias("block")).join(sums, "i", "left").fillna(0, ["n", "total", "squares"])
    told.write.parquet(f"{path}/vocabulary")


#: Rows whose entries are sorted at once.
ROWS = 4096


def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, i, v) of the entries of ROWS rows of a batch, by row and place; rows without any are left out."""
    for at in range(0, batch.num_rows, ROWS):
        column = batch.column("x").slice(at, ROWS)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        held = column.flatten()
        row = at + np.repeat(np.arange(len(sizes)), sizes)
        i, v = (held.field(c).to_numpy(zero_copy_only=False) for c in "iv")
        if np.any((row[1:] == row[:-1]) & (i[1:] < i[:-1])):
            order = np.lexsort((i, row))
            row, i, v = row[order], i[order], v[order]
        if len(row):
            yield row, i, v


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocabulary")


def read_features(spark: SparkSession, path: str, key: str, chosen: Column | str | None = None) -> DataFrame:
    """(key, x) of every row, with the entries of the features whose vocabulary row is `chosen`.

    Only folders of blocks with such a feature are read; rows without entries have an empty x.
    """
    keys, names = spark.read.parquet(f"{path}/rows"), read_vocabulary(spark, path)
    names = names if chosen is None else names.where(chosen)
    # One array of places a block, of at most so many as a block has.
    wanted = names.groupBy("block").agg(F.collect_set("i").alias("wanted"))
    # Of the vocabulary, folders of blocks that have entries.
    blocks = [r["block"] for r in names.where("n > 0").select("block").distinct().collect()]
    kind = "array<struct<i: int, v: double>>"
    if not blocks:
        return keys.select(key, F.expr(f"cast(array() as {kind})").alias("x"))
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("block").isin(blocks))
    x = F.zip_with("places", "numbers", lambda i, v: F.struct(i.cast("int").alias("i"), v.alias("v")))
    met = vectors.join(wanted, "block").select(key, F.filter(x, lambda e: F.array_contains("wanted", e["i"])).alias("x"))
    rows = met.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
    return keys.join(rows, key, "left").select(key, F.coalesce("x", F.expr(f"cast(array() as {kind})")).alias("x"))


#: Rows of a range of aligned files, at most, if no number of ranges is told.
RANGE = 1 << 19


def write_aligned(rows: DataFrame, path: str, order: str, columns: dict[str, Column], parts: int | None = None) -> None:
    """Line files, one folder a column, of which row n of each is the same row, in the order of the unique `order`.

    Rows are dealt once into sorted ranges of the order, in a table that all files are written from, a file for each
    range in each folder (one for each split, if readers split the table's file); so a task that runs again writes the
    same lines. The manifest, a row for each range, comes last: without it nothing was written. Values are to be single
    lines; null is an empty one.
    """
    values = rows.select(F.col(order).alias("__order"), *(c.cast("string").alias(n) for n, c in columns.items()))
    if parts is None:
        # So that a range is sorted in memory; few rows are dealt as the session deals them.
        least = -(-rows.count() // RANGE)
        parts = least if least > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    dealt = values.repartitionByRange(parts, "__order") if parts else values.repartitionByRange("__order")
    numbered = dealt.sortWithinPartitions("__order").withColumn(R.PART, F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    staged = R.stored(numbered.drop("__order"), "ranges", "zstd")
    split = F.col("_metadata.file_block_start")
    name = F.concat(F.lpad(F.col(R.PART).cast("string"), 6, "0"), F.when(split > 0, F.concat(F.lit("_"), F.lpad(split.cast("string"), 15, "0"))).otherwise(""))
    for n in columns:
        lines = staged.select(name.alias("part"), "__at", F.coalesce(n, F.lit("")).alias("value")).sortWithinPartitions("part", "__at")
        lines.select("part", "value").write.partitionBy("part").text(f"{path}/{n}")
    staged.groupBy(name.alias("part")).agg(F.count("*").alias("rows")).coalesce(1).write.json(f"{path}/manifest")


def read_aligned(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(row_id, the columns) of files by write_aligned; files that do not have the manifest's rows are an error."""
    told = spark.read.schema("part string, rows long").json(f"{path}/manifest")
    want = told.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = None
    for n in names:
        lines = spark.createDataFrame([], "row_id long, value string")
        if want:
            at, splits = read_splits(spark, f"{path}/{n}")
            splits = R.stored(splits, "splits")
            # Files of so many lines have each number once, so the columns can be joined without looking for gaps.
            if splits.agg(F.sum("n")).first()[0] != want:
                raise ValueError(f"{path}: line files do not have the {want} rows of the manifest")
            lines = placed(at, splits)
        lines = lines.withColumnRenamed("value", n)
        out = lines if out is None else out.join(lines, "row_id")
    return out


def write_selection(keys: DataFrame, path: str) -> None:
    """The keys of chosen rows; a semi join picks them."""
    keys.write.parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """A small result table as JSON lines."""
    rows.coalesce(1).write.json(path)
