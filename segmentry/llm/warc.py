"""WARC archives: writing pages with revisits, and reading them by boundary-chain verification.

Writing is Spark's text sink: a record is a line that ends in the two line breaks between
records, so commits, retries and file systems are Spark's own.

Reading splits archives at every occurrence of the version line, also inside payloads.
Tasks emit each candidate's offset and the offset of its successor by its own headers.
Offsets come from prefix sums over the pieces of a split and then over the splits of a
file. Pointer jumping from offset 0 doubles the stride each round, so candidates that the
chain from the file's start does not reach, such as version lines inside payloads, are
rejected after logarithmically many rounds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, scratch, stored, table

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are all written whole.
LEAST_BYTES = 0
#: Repeated payloads up to which their keys are broadcast; beyond it pages are joined by digest.
BROADCAST_ROWS = 100_000


def base32(hexed: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def http_head(n: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(GAP))


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(spark: SparkSession, pages: DataFrame, uri: str, least_bytes: int = LEAST_BYTES) -> None:
    """A record for each row of pages (page_id, url, html) in plain archives under `uri`.

    Of equal payloads of at least least_bytes the largest page_id is written whole and the
    others refer to it. A null html is an empty payload, a null url an empty one; rows that
    repeat the largest page_id are all whole, and without any page_id so are all. Without pages
    the archives hold no record.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    repeated = rows.groupBy("sha1", "bytes").agg(F.max("page_id").alias("whole"), F.count("*").alias("n"))
    repeated, path = stored(spark, repeated.where((F.col("n") > 1) & (F.col("bytes") >= least_bytes)).drop("n"), "repeated")
    small = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if small else repeated, ["sha1", "bytes"], "left")
    again = F.col("whole").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("whole"))
    block = F.concat(http_head(F.col("bytes")), F.when(again, "").otherwise(F.col("payload")))
    extra = F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("whole")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.lit("\r\n"),
        extra,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    rows = rows.select(head.alias("head"), block.alias("block"))
    record = F.concat("head", F.octet_length("block").cast("string"), F.lit(GAP), "block")
    rows.select(record.alias("value")).write.option("lineSep", GAP).option("compression", "none").text(uri)
    drop(spark, path)


def header(text: Column, name: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?i)(?:^|\r\n){name}: *({value})(?=\r\n|$)", 1), F.lit(""))


def candidates(spark: SparkSession, uri: str) -> DataFrame:
    """Every piece after a version line: its file, offset, successor by its headers, and what it holds if it is whole."""
    value = F.col("value")
    raw = spark.read.option("lineSep", MAGIC).text(uri)
    at = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    head = F.substring_index(value, GAP, 1)
    at = at.withColumn("head", F.when(F.contains(value, F.lit(GAP)), head)).withColumn("size", F.octet_length("value").cast("long"))
    at = at.withColumn("length", header(F.col("head"), "Content-Length", "[0-9]{1,17}").cast("long"))
    at = at.withColumn("declared", F.octet_length("head") + F.col("length") + 2 * len(GAP))
    body = F.expr("substring(cast(value as binary), octet_length(head) + 5, cast(length as int))")
    at = at.withColumn("whole", F.coalesce(F.col("declared") == F.col("size"), F.lit(False)))
    at = at.withColumn("body", F.when(F.col("whole"), body))
    http = F.substring_index(F.col("body").cast("string"), GAP, 1)
    at = at.withColumn("http", http).withColumn("payload", F.expr("substring(body, octet_length(http) + 5)"))
    narrow = at.select(
        "file",
        "split",
        "line",
        "size",
        "declared",
        "whole",
        header(F.col("head"), "WARC-Type", "[a-z]+").alias("record_type"),
        header(F.col("head"), "WARC-Record-ID", "<urn:page:-?[0-9]{1,18}>").alias("record_id"),
        header(F.col("head"), "WARC-Refers-To", "<urn:page:-?[0-9]{1,18}>").alias("refers_to"),
        header(F.col("head"), "WARC-Payload-Digest", "sha1:[A-Z2-7]{32}").alias("digest"),
        header(F.col("http"), "Content-Length", "[0-9]{1,17}").cast("long").alias("http_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_sha1"),
    )
    pieces, path = stored(spark, narrow, "pieces")
    step = F.col("size") + len(MAGIC)
    run = W.partitionBy("file", "split").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    sums = pieces.groupBy("file", "split").agg(F.sum(step).alias("total"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    placed = pieces.withColumn("inside", F.coalesce(F.sum(step).over(run), F.lit(0))).join(bases, ["file", "split"])
    start = F.col("base") + F.col("inside")
    placed = placed.withColumn("offset", start - len(MAGIC)).withColumn("next", start + F.col("declared"))
    found, _ = stored(spark, placed.where("offset >= 0").drop("split", "line", "inside", "base", "declared", "size"), "candidates")
    drop(spark, path)
    return found


def reachable(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(file, offset) of candidates on the chain from offset 0, by pointer jumping over nodes (file, offset, next)."""
    start = nodes.select("file", "offset", F.col("next").alias("to"), (F.col("offset") == 0).alias("on"))
    state, path = stored(spark, start, "chain")
    while True:
        ahead = state.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        told = state.where("on and to is not null").select("file", F.col("to").alias("offset")).distinct().withColumn("told", F.lit(True))
        moved = state.join(ahead, ["file", "to"], "left").join(told, ["file", "offset"], "left")
        moved = moved.select("file", "offset", F.col("further").alias("to"), (F.col("on") | F.coalesce("told", F.lit(False))).alias("on"))
        new, new_path = stored(spark, moved, "chain")
        drop(spark, path)
        state, path = new, new_path
        if state.where("on and to is not null").isEmpty():
            return state.where("on").select("file", "offset")


def whole_record(batches):
    """Records whose payload holds the version line, read by their byte range."""
    for batch in batches:
        rows = []
        for file, start, end in zip(batch["file"], batch["offset"], batch["next"]):
            fs, path = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(path) as f:
                raw = f.read_at(end - start, start)
            http, _, payload = raw.partition(b"\r\n\r\n")[2][: -len(GAP)].partition(b"\r\n\r\n")
            told = re.search(rb"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,17})", http)
            rows.append((file, start, int(told[1]) if told else None, len(payload), hashlib.sha1(payload).hexdigest()))
        out = pd.DataFrame(rows, columns=["file", "offset", "http_bytes", "payload_bytes", "payload_sha1"])
        yield out.astype({"http_bytes": "Int64"})


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit in the archives.

    Digests of responses are computed from what was read; those of revisits, whose payload
    is elsewhere, are the ones they state, as their sizes are. Archives without records, or no
    archives, give no rows.
    """
    found = candidates(spark, uri)
    chain = reachable(spark, found.select("file", "offset", "next"))
    records, _ = stored(spark, found.join(chain, ["file", "offset"]), "records")
    schema = "file string, offset long, http_bytes long, payload_bytes long, payload_sha1 string"
    split = records.where(~F.col("whole"))
    read = split.select("file", "offset", "next").mapInPandas(whole_record, schema)
    split = split.drop("http_bytes", "payload_bytes", "payload_sha1").join(read, ["file", "offset"])
    every = records.where("whole").unionByName(split)
    again = F.col("record_type") == "revisit"
    page = lambda c: F.regexp_extract(c, "(-?[0-9]+)>$", 1)
    return every.where("record_type in ('response', 'revisit')").select(
        F.expr("try_cast(regexp_extract(record_id, '(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
        F.when(again, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring("digest", 6, 32)).otherwise(base32(F.col("payload_sha1"))).alias("payload_digest"),
        "record_type",
        F.when(again, page("refers_to").cast("long")).alias("refers_to"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the record of every page. Edges as in `write_archives` and `read_archives`."""
    uri = scratch(spark, "warc")
    write_archives(spark, table(spark, sf_dir, "pages"), uri)
    return read_archives(spark, uri)


def _digest_sql() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = []
    for i in range(8):
        n = f"cast('0x' || substr(h, {1 + 5 * i}, 5) as bigint)"
        parts += [f"substr({letters}, 1 + cast((({n}) >> {s}) & 31 as integer), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


SQL = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
w as (select *, max(page_id) over (partition by body) as whole, count(*) over (partition by body) as n from p)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, {_digest_sql()} as payload_digest,
  case when page_id = whole then 'response' else 'revisit' end as record_type,
  case when page_id <> whole then whole end as refers_to
from w
"""
