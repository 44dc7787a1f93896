"""Work along an order without a task for each group: range partitions, and what one hands on to the next.

Rows are sorted into range partitions by group and order, so a group that holds most rows is
many tasks. Inside a partition windows see only its own rows; a summary of each (partition,
group), as small as partitions and groups together, is composed along the order, and what
comes out of the partitions before is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import path as scratch

PART = "__part"
#: Letters of the hash whose values are the buckets of a rank: 16 ** DIGITS buckets a group.
DIGITS = 4


#: Bytes of a row group of a table whose rows are large, as readers hold all of a group's rows at once.
GROUP = 1 << 23


def stored(rows: DataFrame, name: str, codec: str | None = None, large: bool = False) -> DataFrame:
    """The rows from a table in the shared folder, so that work before it is done once."""
    at = scratch(rows.sparkSession, name)
    out = rows.write
    if large:
        out = out.option("parquet.block.size", GROUP).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1)
    out.parquet(at, compression=codec)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def in_ranges(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Rows with the number of their range of (group, order), from a table: numbers follow the order and do not change."""
    keys = [*group, *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return stored(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def inside(group: tuple[str, ...], order: tuple[str, ...]):
    """Window of a group's rows in one range."""
    return W.partitionBy(PART, *group).orderBy(*order)


def along(group: tuple[str, ...]):
    """Window of a group's summaries in the order of ranges: as many rows as the group has ranges."""
    return W.partitionBy(*group).orderBy(PART)


def same(group: tuple[str, ...], one: str, two: str) -> Column:
    """Rows of two frames that are of one range and group, nulls being equal."""
    match = F.col(f"{one}.{PART}") == F.col(f"{two}.{PART}")
    for g in group:
        match &= F.col(f"{one}.{g}").eqNullSafe(F.col(f"{two}.{g}"))
    return match


def with_summary(rows: DataFrame, summary: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of the summary of their range and group."""
    held = [F.col(f"s.{c}") for c in summary.columns if c not in (PART, *group)]
    return rows.alias("r").join(summary.alias("s"), same(group, "r", "s")).select("r.*", *held)


def before(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Rows with `name`: the value of the row before in the group's order, null for the first."""
    rows = in_ranges(rows.withColumn("__value", value), group, order, parts)
    last = rows.groupBy(PART, *group).agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(along(group))).drop("__last")
    out = with_summary(rows, carried, group)
    window = inside(group, order)
    first = F.row_number().over(window) == 1
    return out.withColumn(name, F.when(first, F.col("__carried")).otherwise(F.lag("__value").over(window))).drop("__value", "__carried", PART)


def odd_islands(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """The last row of each island of an odd number of rows, an island being rows that each start before the end of the row before.

    A range hands on how many rows the island has that is open at its end. It opens a new one
    unless all of its rows go on with the island before.
    """
    rows = in_ranges(rows, group, order, parts)
    window, bare = inside(group, order), W.partitionBy(PART, *group)
    rows = rows.withColumn("__n", F.row_number().over(window)).withColumn("__over", F.coalesce(F.col(start) < F.lag(end).over(window), F.lit(False)))
    # Row number at which the island of a row begins in this range.
    rows = rows.withColumn("__from", F.max(F.when(~F.col("__over"), F.col("__n"))).over(window))
    rows = rows.withColumn("__next", F.lead("__over").over(window))
    summary = rows.groupBy(PART, *group).agg(
        F.count("*").alias("__size"), F.max("__from").alias("__tail"), F.min_by(start, "__n").alias("__start"), F.max_by(end, "__n").alias("__end")
    )
    order_ = along(group)
    # Whether the first row goes on with the island before, and the last row's island goes on.
    summary = summary.withColumn("__goes", F.coalesce(F.col("__start") < F.lag("__end").over(order_), F.lit(False)))
    summary = summary.withColumn("__on", F.coalesce(F.lead("__goes").over(order_), F.lit(False)))
    opens = ~(F.col("__goes") & (F.col("__tail") == 1))
    summary = summary.withColumn("__run", F.sum(opens.cast("int")).over(order_)).withColumn("__adds", F.col("__size") - F.col("__tail") + 1)
    along_run = W.partitionBy(*group, "__run").orderBy(PART)
    summary = summary.withColumn("__open", F.sum("__adds").over(along_run))
    carry = F.when(F.col("__goes"), F.lag("__open").over(order_)).otherwise(0)
    summary = summary.select(PART, *group, carry.alias("__carry"), "__on", "__size")
    out = with_summary(rows, summary, group)
    last = F.when(F.col("__n") == F.col("__size"), ~F.col("__on")).otherwise(~F.col("__next"))
    size = F.col("__n") - F.col("__from") + 1 + F.when(F.col("__from") == 1, F.col("__carry")).otherwise(0)
    return out.where(last & (size % 2 == 1)).drop("__n", "__over", "__from", "__next", "__carry", "__on", "__size", PART)


def bucket(draw: Column) -> Column:
    """Buckets of a hexadecimal hash, in its order."""
    return F.conv(F.substring(draw, 1, DIGITS), 16, 10).cast("int")


def ranked(rows: DataFrame, group: tuple[str, ...], draw: Column, key: str, name: str) -> DataFrame:
    """Rows with their place from 1 in the group by (draw, key), draw being a hexadecimal hash; `rows` is read twice.

    Rows of one bucket of the hash are numbered by themselves, after what a histogram counts in the
    buckets before. So a group is 16 ** DIGITS keys.
    """
    rows = rows.withColumn("__draw", draw).withColumn("__bucket", bucket(F.col("__draw")))
    counts = rows.groupBy(*group, "__bucket").agg(F.count("*").alias("__count"))
    base = F.coalesce(F.sum("__count").over(W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(*group, "__bucket", base.alias("__base"))
    match = F.col("r.__bucket") == F.col("s.__bucket")
    for g in group:
        match &= F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    out = rows.alias("r").join(bases.alias("s"), match).select("r.*", "s.__base")
    place = F.row_number().over(W.partitionBy(*group, "__bucket").orderBy("__draw", key))
    return out.withColumn(name, F.col("__base") + place).drop("__draw", "__bucket", "__base")


def first_by_draw(rows: DataFrame, group: tuple[str, ...], draw: Column, key: str, k: int) -> DataFrame:
    """The k rows of each group that come first by (draw, key); `rows` is read twice.

    A histogram of the hash tells the bucket in which the k-th row of a group lies. Rows of the
    buckets before stay as they are, those of buckets after go, and only that bucket is sorted.
    """
    rows = rows.withColumn("__draw", draw).withColumn("__bucket", bucket(F.col("__draw")))
    counts = rows.groupBy(*group, "__bucket").agg(F.count("*").alias("__count"))
    up_to = F.sum("__count").over(W.partitionBy(*group).orderBy("__bucket"))
    # Where the k-th row lies; a group of fewer rows has no such bucket and stays whole.
    cuts = counts.withColumn("__up", up_to).where((F.col("__up") >= k) & (F.col("__up") - F.col("__count") < k))
    cuts = cuts.select(*group, F.col("__bucket").alias("__cut"), (k - F.col("__up") + F.col("__count")).alias("__left"))
    match = F.lit(True)
    for g in group:
        match &= F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    met = rows.alias("r").join(cuts.alias("s"), match, "left").select("r.*", "s.__cut", "s.__left")
    whole = met.where(F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut")))
    place = F.row_number().over(W.partitionBy(*group).orderBy("__draw", key))
    part = met.where(F.col("__bucket") == F.col("__cut")).withColumn("__place", place).where(F.col("__place") <= F.col("__left")).drop("__place")
    return whole.union(part).drop("__draw", "__bucket", "__cut", "__left")
