"""Samples that do not depend on partitioning: rows are ordered by md5 of seed and key, ties by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SEED
from . import ranges as R


def draw(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def per_group(rows: DataFrame, group: list[str], key: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows of each group; Spark keeps k in each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(draw(key, seed), key))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def overall(rows: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    return rows.orderBy(draw(key, seed), key).limit(k)


def first_in_order(rows: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """The first k rows of each group in input order."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def capped(rows: DataFrame, cap: int, sources: int, key: str, seed: int = SEED) -> DataFrame:
    """Rows (eid, state_int, split): of train, max(1, cap // sources) for each source and state; all others stay.

    The rows are stored, as they are read to count the hash, and again to choose by it.
    """
    each = max(1, cap // max(sources, 1))
    rows = R.stored(rows, "capped")
    train = F.col("split") == "train"
    kept = R.first_by_draw(rows.where(train), ("eid", "state_int"), draw(key, seed), key, each)
    return kept.union(rows.where(~train | F.col("split").isNull()))


def capped_with_fill(rows: DataFrame, cap: int, sources: int, key: str, seed: int = SEED) -> DataFrame:
    """As `capped` by state, and what a state lacks to its cap is filled from the sources with most rows.

    The place of a row in its state follows from its rank in its source and from the numbers of
    rows of the sources: first the shares of all sources, by id, then what is beyond them, by size.
    """
    each = max(1, cap // max(sources, 1))
    rows = R.ranked(R.stored(rows, "filled"), ("eid", "state_int"), draw(key, seed), key, "__rank")
    sizes = rows.groupBy("eid", "state_int").agg(F.count("*").alias("__n"))
    share, ahead = F.least(F.col("__n"), F.lit(each)), lambda *o: W.partitionBy("state_int").orderBy(*o).rowsBetween(W.unboundedPreceding, -1)
    by_size = (F.col("__n").desc(), "eid")
    sizes = sizes.withColumn("__before", F.coalesce(F.sum(share).over(ahead("eid")), F.lit(0)))
    beyond = F.sum(share).over(W.partitionBy("state_int")) + F.coalesce(F.sum(F.col("__n") - share).over(ahead(*by_size)), F.lit(0)) - each
    sizes = sizes.withColumn("__beyond", beyond)
    match = F.col("r.eid").eqNullSafe(F.col("s.eid")) & F.col("r.state_int").eqNullSafe(F.col("s.state_int"))
    met = rows.alias("r").join(sizes.alias("s"), match).select("r.*", "s.__before", "s.__beyond")
    fill = F.col("__rank") + F.when(F.col("__rank") <= each, F.col("__before")).otherwise(F.col("__beyond"))
    return met.where(fill <= cap).drop("__rank", "__before", "__beyond")


def folds(rows: DataFrame, label: str, key: str, n: int = 5, seed: int = SEED) -> DataFrame:
    """Stratified folds 1..n: exact ranks, with no label in one task."""
    return R.ranked(rows, (label,), draw(key, seed), key, "__rank").withColumn("fold", (F.col("__rank") - 1) % n + 1).drop("__rank")


def split_of(chrom: Column) -> Column:
    """train, val or test by chromosome; an unknown one is an error."""
    from ..schema import CHROMOSOMES, TEST, VALIDATION

    train = [c for c in CHROMOSOMES if c not in VALIDATION + TEST]
    unknown = F.raise_error(F.concat(F.lit("unknown chromosome "), chrom)).cast("string")
    return F.when(chrom.isin(*VALIDATION), "val").when(chrom.isin(*TEST), "test").when(chrom.isin(*train), "train").otherwise(unknown)


def holdout(key: str, share: float = 0.2, seed: int = SEED) -> Column:
    """Whether the key's hash falls into the held-out share."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") < int(share * 4294967296)
