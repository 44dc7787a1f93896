"""Text formats: segment files, metadata, sizes, reference letters, line files, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_segments(spark: SparkSession, glob: str) -> DataFrame:
    """Tab-separated segments, one file a source, its id from the file name.

    Lines of fewer than four fields are kept with null fields, so that they can be counted
    as malformed; numbers that do not parse are null. An empty file gives no rows.
    """
    parts = F.split("value", "\t")
    fine = F.size(parts) >= 4
    field = lambda i, kind: F.when(fine, F.get(parts, F.lit(i)).try_cast(kind))
    return spark.read.text(glob).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(E\d{3})_", 1).alias("eid"),
        field(0, "string").alias("chrom"),
        field(1, "int").alias("start_pos"),
        field(2, "int").alias("end_pos"),
        field(3, "string").alias("state_name"),
    )


def write_segments(segments: DataFrame, path: str) -> None:
    """Gzip text, a folder for each source; read_partitioned_segments reads it."""
    line = F.concat_ws("\t", "chrom", "start_pos", "end_pos", "state_name")
    segments.select("eid", line.alias("value")).write.partitionBy("eid").option("compression", "gzip").text(path)


def read_partitioned_segments(spark: SparkSession, path: str) -> DataFrame:
    """As read_segments, for folders that name the source."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select("eid", F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("int").alias("start_pos"), F.get(parts, F.lit(2)).try_cast("int").alias("end_pos"), F.get(parts, F.lit(3)).alias("state_name"))


def read_metadata(spark: SparkSession, path: str, eids: list[str]) -> DataFrame:
    """Rows of the listed ids, column names trimmed, name falling back to the second name column; ids without a row are an error."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = raw.toDF(*(c.strip() for c in raw.columns)).withColumnRenamed("EID", "eid")
    names = [c for c in ("Standardized Epigenome name", "Epigenome name", "name") if c in rows.columns]
    rows = rows.where(F.col("eid").isin(eids)).withColumn("name", F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in names)))
    gone = sorted(set(eids) - {r["eid"] for r in rows.select("eid").distinct().collect()})
    if gone:
        raise ValueError(f"no metadata for {gone}")
    return rows.orderBy("eid")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size): the first two columns of an index file."""
    return spark.read.option("sep", "\t").csv(path).select(F.col("_c0").alias("chrom"), F.col("_c1").cast("long").alias("size"))


def read_reference(spark: SparkSession, path: str, chunk: int = 1000, tail: int = 200) -> DataFrame:
    """(chrom, chunk, seq) of a FASTA file, upper case, each chunk with the letters that follow it."""
    record = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", ""))
    rows = record.select(head.alias("chrom"), body.alias("body"))
    last = F.greatest(F.ceil(F.length("body") / chunk) - 1, F.lit(0)).cast("int")
    each = rows.select("chrom", "body", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select("chrom", "chunk", F.substr("body", F.col("chunk") * chunk + 1, F.lit(chunk + tail)).alias("seq"))


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (value, f, b, i) with their file, split and a number that rises by one inside a split, and the splits (f, b, n, least): rows and least number."""
    lines = spark.read.text(path)
    at = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return at, at.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("least"))


def placed(at: DataFrame, splits: DataFrame) -> DataFrame:
    """(row_id, value) of lines and splits by read_splits, in the order of files and splits."""
    from pyspark.sql import Window as W

    # A task reads a split from end to end, so a line's place is that of its split, by a prefix sum over the splits, and its number there.
    base = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = splits.select("f", "b", (base - F.col("least")).alias("shift"))
    return at.join(F.broadcast(bases), ["f", "b"]).select((F.col("i") + F.col("shift")).alias("row_id"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value) in file order; numbering is for import only, tables have keys. Lines are not shuffled."""
    return placed(*read_splits(spark, path))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two line files of equal length side by side; different lengths are an error."""
    a, b = left.withColumnRenamed("value", "left"), right.withColumnRenamed("value", "right")
    both = a.join(b, "row_id", "full")
    gone = F.col("left").isNull() | F.col("right").isNull()
    return both.select("row_id", F.when(gone, F.raise_error(F.lit("line counts differ"))).otherwise(F.col("left")).alias("left"), "right")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of a file of one or two columns with a header; without ids the line number is the id."""
    rows = spark.read.option("header", True).csv(path)
    if len(rows.columns) == 1:
        return read_lines(spark, path).where("row_id > 0").select((F.col("row_id") - 1).cast("string").alias("id"), F.col("value").alias("sequence"))
    return rows.toDF("id", "sequence", *rows.columns[2:]).select("id", "sequence")


def guess_columns(rows: DataFrame) -> tuple[str, str]:
    """(sequence column, label column): by name, else by longest mean text and most numeric values, in one aggregate."""
    named = lambda part: next((c for c in rows.columns if part in c.lower()), None)
    text, label = named("seq"), named("label")
    if text and label:
        return text, label
    stats = [F.avg(F.length(F.col(c).cast("string"))).alias(f"len_{i}") for i, c in enumerate(rows.columns)]
    stats += [F.avg(F.col(c).try_cast("double").isNotNull().cast("int")).alias(f"num_{i}") for i, c in enumerate(rows.columns)]
    found = rows.agg(*stats).first()
    place = range(len(rows.columns))
    text = text or rows.columns[max(place, key=lambda i: (found[f"len_{i}"] or 0, -i))]
    others = [i for i in place if rows.columns[i] != text]
    label = label or rows.columns[max(others, key=lambda i: (found[f"num_{i}"] or 0, -(found[f"len_{i}"] or 0), -i))]
    return text, label


def one_based(rows: DataFrame, label: str) -> Column:
    """The label column as 1..18: labels that begin at 0 are shifted."""
    least = rows.agg(F.min(F.col(label).try_cast("int")).alias("m")).first()["m"]
    return F.col(label).try_cast("int") + (1 if least == 0 else 0)


def write_predictions(rows: DataFrame, path: str) -> None:
    """One label a line in input order (row_id, label), no header."""
    rows.orderBy("row_id").select(F.col("label").cast("string").alias("value")).write.text(path)
