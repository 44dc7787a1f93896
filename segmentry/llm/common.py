"""Helpers that the training-data operators share: tables, shared scratch tables, graph components.

Batches for Python workers are bounded in bytes by Spark itself
(spark.sql.execution.arrow.maxBytesPerBatch), so no operator changes a session's settings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of the size, shingle and mixing contracts.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="segmentry-")
        context.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it again: lineage ends there. Returns it and its path."""
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bitmaps of 4 KB that are broadcast at most.
MOST_BITMAPS = 8192


def chosen(spark: SparkSession, rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows whose `key` is among the whole numbers `key` of keys, and paths that they need.

    Keys are gathered in bitmaps of 32 768 neighbouring numbers, a bit a key, so wide rows stay
    where they are. Keys that lie too far apart for MOST_BITMAPS meet the rows by a join.
    """
    bits = keys.select(F.bitmap_bucket_number("key").alias("__bucket"), F.bitmap_bit_position("key").alias("bit")).repartition("__bucket")
    maps, path = stored(spark, bits.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits")), "bitmaps")
    if maps.limit(MOST_BITMAPS + 1).count() > MOST_BITMAPS:
        drop(spark, path)
        return rows.join(keys, "key", "left_semi"), []
    met = rows.withColumn("__bucket", F.bitmap_bucket_number("key")).join(F.broadcast(maps), "__bucket")
    at = F.bitmap_bit_position("key")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns), [path]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of `edges` (a, b), as (v, label).

    Vertices hook to the smallest label among their neighbours and labels are then
    short-cut, so the number of rounds is logarithmic in the longest path. Every round is
    joins and partial aggregates only, and ends in a table in the shared folder.
    Null ends are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both, kept = stored(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels, path = stored(spark, both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("v", "b"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        told = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("near"))
        # A vertex keeps the label it had, so that a scan of the table tells whether any changed.
        hooked = (
            told.select("v", F.col("near").alias("label"), F.col("label").alias("old"))
            .union(told.where("near < label").select("label", "near", F.lit(None)))
            .groupBy("v")
            .agg(F.min("label").alias("label"), F.min("old").alias("old"))
        )
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label").select("v", F.col("up").alias("label"), "old")
        new, new_path = stored(spark, jumped, "labels")
        changed = not new.where("label <> old").isEmpty()
        drop(spark, path)
        labels, path = new.drop("old"), new_path
        if not changed:
            drop(spark, kept)
            return labels
