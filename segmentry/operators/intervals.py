"""Segments to clean fixed-width bins: reasons to drop, binning, lift, overlap removal, reference letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BIN, CHROMOSOMES, MIN_ENTROPY, MIN_MATCH
from ..functions import sequence as S
from . import ranges as R

BUCKET = 65536


def canonical(chrom: Column) -> Column:
    """Names without their prefix get it."""
    return F.when(~chrom.startswith("chr"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


def normalised(segments: DataFrame, states: DataFrame) -> DataFrame:
    """segments with canonical names, their state's columns and drop_reason."""
    named = segments.withColumn("chrom", canonical(F.col("chrom"))).join(F.broadcast(states), "state_name", "left")
    length = F.col("end_pos") - F.col("start_pos")
    reason = (
        F.when(F.col("start_pos").isNull() | F.col("end_pos").isNull() | F.col("chrom").isNull(), "malformed")
        .when(F.col("state_int").isNull(), "invalid_state")
        .when(~F.col("chrom").isin(*CHROMOSOMES), "non_canonical")
        .when((length <= 0) | (length % BIN != 0), "bad_length")
    )
    return named.withColumn("drop_reason", reason)


def bins(clean: DataFrame) -> DataFrame:
    """A row for each bin of each segment, with its start."""
    starts = F.sequence(F.col("start_pos"), F.col("end_pos") - BIN, F.lit(BIN))
    return clean.withColumn("start", F.explode(starts)).withColumn("end", F.col("start") + BIN).drop("start_pos", "end_pos")


def order_violations(segments: DataFrame, line: str, parts: int | None = None) -> DataFrame:
    """By eid, kept rows that sort before the kept row ahead of them in file order, which crosses the ranges of a file."""
    here = F.struct("chrom", "start_pos")
    met = R.before(segments, ("eid",), (line,), here, "__ahead", parts)
    late = F.coalesce(here < F.col("__ahead"), F.lit(False))
    return met.groupBy("eid").agg(F.count_if(late).alias("sort_order_violations"))


def lifted(places: DataFrame, blocks: DataFrame, min_match: float = MIN_MATCH) -> DataFrame:
    """Distinct (chrom, start, end) to status, q_chrom, q_start, q_end by ungapped blocks.

    A range join: both sides are exploded to buckets and joined on (chrom, bucket), so one
    chromosome is many keys. A pair that meets in two buckets counts once, in the first
    bucket that both have.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(s / BUCKET), F.floor((e - 1) / BUCKET)))
    p = places.select("chrom", "start", "end").withColumn("bucket", bucket(F.col("start"), F.col("end")))
    b = blocks.withColumn("bucket", bucket(F.col("t_start"), F.col("t_end")))
    first = F.col("bucket") == F.greatest(F.floor(F.col("start") / BUCKET), F.floor(F.col("t_start") / BUCKET))
    met = p.join(b, ["chrom", "bucket"]).where((F.col("start") < F.col("t_end")) & (F.col("end") > F.col("t_start")) & first)
    lo, hi = F.greatest("start", "t_start"), F.least("end", "t_end")
    plus = F.col("strand") == "+"
    q_lo = F.col("q_start") + F.when(plus, lo - F.col("t_start")).otherwise(F.col("t_end") - hi)
    met = met.select("chrom", "start", "end", "q_chrom", "strand", (hi - lo).alias("width"), q_lo.alias("q_lo"), (q_lo + hi - lo).alias("q_hi"))
    sums = met.groupBy("chrom", "start", "end").agg(
        F.sum("width").alias("covered"), F.min(F.struct("q_chrom", "strand")).alias("least"), F.max(F.struct("q_chrom", "strand")).alias("most"), F.min("q_lo").alias("q_start"), F.max("q_hi").alias("q_end")
    )
    size = F.col("end") - F.col("start")
    status = F.when(F.col("covered") < min_match * size, "partial").when((F.col("least") != F.col("most")) | (F.col("covered") > size), "split").otherwise("lifted")
    sums = sums.select("chrom", "start", "end", status.alias("status"), F.col("least.q_chrom").alias("q_chrom"), "q_start", "q_end")
    out = places.select("chrom", "start", "end").join(sums, ["chrom", "start", "end"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("deleted")))


def without_overlaps(rows: DataFrame, group: tuple[str, ...] = ("eid", "chrom"), ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Rows (start, end) that stay when each row that overlaps the pending row takes it away with itself.

    Rows that each overlap the one before are an island; its last row stays if the island is odd.
    """
    return R.odd_islands(rows, group, ("start", "end", *ties), parts=parts)


def with_reference(places: DataFrame, chunks: DataFrame, size: int = 1000) -> DataFrame:
    """places (chrom, start) with their letters, from chunks that carry the next 200 letters."""
    keyed = places.withColumn("chunk", F.floor(F.col("start") / size).cast("int"))
    chunks = chunks.select("chrom", "chunk", F.col("seq").alias("__seq"))
    joined = keyed.join(chunks, ["chrom", "chunk"], "left")
    return joined.withColumn("seq", F.upper(F.substr("__seq", F.col("start") % size + 1, F.lit(BIN)))).drop("__seq", "chunk")


def sequence_reason(s: Column) -> Column:
    """The first check that a bin's letters fail, or null. The letters are bound once, so that a filter on it does not fetch them for every check."""

    def reason(s: Column) -> Column:
        return (
            F.when(s.isNull() | (F.length(s) != BIN), "bad_sequence_length")
            .when(F.contains(s, F.lit("N")), "contains_n")
            .when(s.rlike("[^ACGT]"), "non_acgt")
            .when(S.entropy(s) <= MIN_ENTROPY, "low_complexity")
        )

    return F.get(F.transform(F.array(s), reason), F.lit(0))
