"""Round trips of the formats over the given tables, and the streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ctes, frame
from ..operators import raw
from ..operators.sampling import per_group, split_of
from ..scratch import path as scratch
from ..sources import fasta
from ..sources import tables as B
from ..sources import text as T
from ..streaming import metrics
from . import corpus, features
from .features import kmer_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, body: str, views=("segments",), steps=None):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = ctes(views, steps) + body
        return fn

    return add


@query("segment_files", "select eid, chrom, start_pos, end_pos, state_name, count(*) as n from segments group by all")
def segment_files(spark, sf):
    at = scratch(spark, "segments")
    T.write_segments(frame(spark, sf, "segments"), at)
    back = T.read_partitioned_segments(spark, at)
    return back.groupBy("eid", "chrom", "start_pos", "end_pos", "state_name").agg(F.count("*").alias("n"))


@query("aligned_lines", "select row_number() over (order by seq_key)-1 as row_id, seq as \"left\", cast(label as varchar) as \"right\" from sequences", ("sequences",))
def aligned_lines(spark, sf):
    """Two line files of one order are written, numbered as they are read, and joined by number."""
    rows = frame(spark, sf, "sequences").orderBy("seq_key")
    paths = scratch(spark, "seq"), scratch(spark, "labels")
    for c, at in zip(("seq", "label"), paths):
        rows.select(F.col(c).cast("string").alias("value")).write.text(at)
    return T.zipped(*(T.read_lines(spark, at) for at in paths))


@query("fasta_chunks", """select chrom, cast(c as int) as chunk, substr(body, c*1000+1, 1200) as seq from (
  select chrom, body, unnest(range(0, (length(body)+999)//1000)) as c from (select chrom, string_agg(seq, '' order by seq_key) as body from sequences group by chrom))""", ("sequences",))
def fasta_chunks(spark, sf):
    """Records of all sequences of a chromosome are written as FASTA and read in byte ranges, many to a record."""
    at = scratch(spark, "fasta")
    fasta.write_fasta(frame(spark, sf, "sequences"), at, "chrom", "seq_key", "seq", 100)
    return fasta.read_fasta(spark, at, letters=100_000, scan_bytes=1 << 20)


@query("guessed_columns", "select cast(label as int) as label, count(*) as n, cast(max(length(seq)) as int) as longest from sequences group by label", ("sequences",))
def guessed_columns(spark, sf):
    at = scratch(spark, "table")
    frame(spark, sf, "sequences").select(F.col("seq").alias("a"), (F.col("label") - 1).alias("b")).write.option("header", True).csv(at)
    rows = spark.read.option("header", True).csv(at)
    text, label = T.guess_columns(rows)
    rows = rows.withColumn("label", T.one_based(rows, label))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length(text)).alias("longest"))


@query("corpus_table", "select state_int, count(*) as n from (select *, " + corpus.SPLIT + " as split from bins) where split='val' group by state_int", ("states", "segments"), {s: corpus.STEPS[s] for s in ("norm", "bins")})
def corpus_table(spark, sf):
    at = scratch(spark, "corpus")
    B.write_corpus(corpus.bins(spark, sf).withColumn("split", split_of(F.col("chrom"))), at)
    return B.read_corpus(spark, at, "val", ["state_int"]).groupBy("state_int").agg(F.count("*").alias("n"))


@query("saved_selection", "select seq_key, seq from sequences where seq_key in (select seq_key from (select *, row_number() over (partition by label order by md5('20260408|'||seq_key), seq_key) as rk from sequences) where rk<=10)", ("sequences",))
def saved_selection(spark, sf):
    at, rows = scratch(spark, "selection"), frame(spark, sf, "sequences")
    B.write_selection(per_group(rows, ["label"], "seq_key", 10).select("seq_key"), at)
    return rows.join(spark.read.parquet(at), "seq_key", "left_semi").select("seq_key", "seq")


@query("feature_store", f"select seq_key, count(*) filter (v<>0) as entries, round(coalesce(sum(v),0),6) as total, round(coalesce(sum(v*v),0),6) as squares from (select seq_key, n/sum(n) over (partition by seq_key) as v from ({kmer_sql(2)}) union all select seq_key, 0 from sequences) group by seq_key", ("sequences",))
def feature_store(spark, sf):
    """Raw vectors are written with their vocabulary; the shares of two-letter words are read back, from their block alone."""
    at, rows = scratch(spark, "features"), features.raw_vectors(spark, sf)
    B.write_features(rows, raw.vocabulary(spark), at, "seq_key")
    x = B.read_features(spark, at, "seq_key", "name like 'word2:%'")
    add = lambda f: F.round(F.aggregate("x", F.lit(0.0), lambda a, e: a + f(e["v"])), 6)
    return x.select("seq_key", F.size("x").cast("long").alias("entries"), add(lambda v: v).alias("total"), add(lambda v: v * v).alias("squares"))


@query("feature_vocabulary", f"""select kmer, count(*) as n, round(sum(v),6) as total, round(min(v),9) as least, round(max(v),9) as most from (select seq_key, kmer, n/sum(n) over (partition by seq_key) as v from ({kmer_sql(5)})) group by kmer""", ("sequences",))
def feature_vocabulary(spark, sf):
    """Statistics of the vocabulary that is written with raw vectors: here of five-letter words that occur."""
    at, rows = scratch(spark, "features"), features.raw_vectors(spark, sf)
    B.write_features(rows, raw.vocabulary(spark), at, "seq_key")
    v = B.read_vocabulary(spark, at).where("name like 'word5:%' and n > 0")
    return v.select(F.substring_index("name", ":", -1).alias("kmer"), "n", F.round("total", 6).alias("total"), F.round("least", 9).alias("least"), F.round("most", 9).alias("most"))


@query("aligned_triple", "select row_number() over (order by seq_key)-1 as row_id, seq as sequences, cast(label as varchar) as labels, eid||chr(9)||chrom||chr(9)||seq_key as metadata from sequences", ("sequences",))
def aligned_triple(spark, sf):
    """Sequences, labels and metadata are written as line files of one order with a manifest, and read as one table."""
    at = scratch(spark, "triple")
    columns = {"sequences": F.col("seq"), "labels": F.col("label"), "metadata": F.concat_ws("\t", "eid", "chrom", "seq_key")}
    B.write_aligned(frame(spark, sf, "sequences"), at, "seq_key", columns)
    return B.read_aligned(spark, at, list(columns))


@query("prediction_lines", "select row_number() over (order by seq_key)-1 as row_id, cast(label as varchar) as value from sequences", ("sequences",))
def prediction_lines(spark, sf):
    at = scratch(spark, "predictions")
    T.write_predictions(frame(spark, sf, "sequences").select(F.col("seq_key").alias("row_id"), "label"), at)
    return T.read_lines(spark, at)


@query("streamed_counts", "select eid, coalesce(drop_reason,'kept') as reason, count(*) as n from norm group by all", ("states", "segments"), {"norm": corpus.STEPS["norm"]})
def streamed_counts(spark, sf):
    schema = frame(spark, sf, "lineitem").schema
    return metrics.run_available(spark, sf, "lineitem.parquet", schema, frame(spark, sf, "states"))
