"""Normalisation counts kept current as files of segments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..fixtures import VIEWS, spelled
from ..operators import intervals as I
from ..scratch import path as scratch


def counts(segments: DataFrame, states: DataFrame) -> DataFrame:
    """By source and reason (null reasons are kept rows): the same operator over a batch or a stream."""
    return I.normalised(segments, states).groupBy("eid", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def run_available(spark: SparkSession, folder: str, glob: str, schema: StructType, states: DataFrame, view: str = "segments") -> DataFrame:
    """Read what the folder holds now as a stream, keep the counts up to date, and return them as a table.

    Every trigger writes the whole state under its own number, so a trigger that runs again
    replaces its own table and the last one holds all counts.
    """
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 4).parquet(folder)
    text = spelled(VIEWS[view], True).replace("from lineitem", "from {lineitem}").replace("join states", "join {states}")
    stream = counts(spark.sql(text, lineitem=rows, states=states), states)
    out = scratch(spark, "stream")
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last[:] = [number]

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[0]}")
