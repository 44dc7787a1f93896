"""Audit of how the sources of each language differ in their words.

Terms that occur in enough documents of a language are kept. They get their ordinals, in byte
order, from a range-partitioned sort and prefix sums, and are cut into blocks of a bounded
number of bytes; a task builds the minimal acyclic transducer of each block. The whole texts
are then streamed through the transducers, many words at a time, and what is counted by
language, source and ordinal is summed inside the tasks first.

Shares are smoothed and in whole billionths. Sources are compared over all kept terms: the
counts of some terms and of two blocks of sources meet in one task, which has a row of shares
for each source, those of terms that a source lacks included, and emits one sum a pair. So a
term that all sources hold costs its counts, not their pairs.

All counts are 64-bit integers and shares are divided in decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop, stored, table
from .terms import APART_LETTERS, PIECE, pieces, spaced
from .transducer import SPACE, Transducer

LEAST_DOCS, TOP, UNIT, SMOOTH = 30, 50, 1_000_000_000, 5
SPACED = spaced(APART_LETTERS)
#: Terms that a task counts before it hands them on; keys of counts that it holds before it sums them.
MOST_TERMS, MOST_KEYS = 200_000, 1 << 21
#: Bytes of terms in one transducer; bytes of transducers that one pass over the texts broadcasts.
BLOCK_BYTES, PASS_BYTES = 1 << 19, 1 << 25
#: Terms, and sources of a side, that meet in one task.
CHUNK, SIDE = 4096, 128


def in_documents(batches):
    """(lang, text) to (lang, term, n): the documents of the task that hold a term."""

    def frame(held: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, counts in held.items() for _ in range(len(counts))]
        every = [list(x) for x in zip(*(e for counts in held.values() for e in counts.items()))] or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(every[0], pa.binary()), pa.array(every[1], pa.int64())], ["lang", "term", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            held.setdefault(lang, Counter()).update(set().union(*(p.split() for p in pieces(raw, SPACED))))
            if sum(map(len, held.values())) > MOST_TERMS:
                yield frame(held)
                held = {}
    yield frame(held)


def kept_terms(spark: SparkSession, rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, ordinal, block) of the terms in at least so many documents of their language."""
    counts = rows.select("lang", "text").mapInArrow(in_documents, "lang string, term binary, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")
    kept, path = stored(spark, kept, "kept")
    parted, parted_path = stored(spark, kept.repartitionByRange("lang", "term").withColumn("part", F.spark_partition_id()), "parted")
    # Ordinals are those inside a range plus what the ranges before it hold.
    size = F.length("term") + 1
    inside = W.partitionBy("lang", "part").orderBy("term")
    before = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = parted.groupBy("lang", "part").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    bases = sums.select("lang", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "bytes")))
    local = parted.select("lang", "part", "term", (F.row_number().over(inside) - 1).alias("place"), F.sum(size).over(inside).alias("end"))
    numbered = local.join(bases, ["lang", "part"]).select("lang", "term", (F.col("n") + F.col("place")).alias("ordinal"), F.expr(f"(bytes + end - 1) div {BLOCK_BYTES}").alias("block"))
    out, _ = stored(spark, numbered, "terms")
    drop(spark, path, parted_path)
    return out


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The transducer of a block of terms, with the ordinal of its first."""
    rows = rows.sort_values("ordinal")
    made = Transducer.of([bytes(t) for t in rows["term"]])
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "base": rows["ordinal"].iloc[:1], "packed": [made.packed()]})


def passes(transducers: DataFrame) -> Iterator[list[tuple[str, int, bytes]]]:
    """Transducers in lots of bounded size, one lot at a time in the driver."""
    held, size = [], 0
    for row in transducers.toLocalIterator():
        if held and size + len(row["packed"]) > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((row["lang"], row["base"], bytes(row["packed"])))
        size += len(row["packed"])
    if held:
        yield held


def recounted(told: Broadcast):
    """(lang, source, text) to (lang, source, ordinal, n): texts of a language are streamed through its transducers."""

    def counted(batches):
        machines: dict[str, list[tuple[int, Transducer]]] = {}
        for lang, base, packed in told.value:
            machines.setdefault(lang, []).append((base, Transducer.unpacked(packed)))
        groups: dict[tuple[str, str], int] = {}
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def run(lang: str, parts: list[bytes], owners: list[int]) -> None:
            data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
            word = data != SPACE
            at = np.flatnonzero(word[1:] & ~word[:-1]) + 1
            at = np.concatenate([[0], at]) if word[0] else at
            starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            owner = np.array(owners)[np.searchsorted(starts, at, side="right") - 1]
            for base, machine in machines[lang]:
                which, ordinal = machine.ordinals(data, at)
                found, n = np.unique((owner[which] << 40) | (ordinal + base), return_counts=True)
                keys.append(found)
                sums.append(n)

        def merge() -> None:
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, place, np.concatenate(sums))
            keys[:], sums[:] = [found], [total]

        def frame() -> pa.RecordBatch:
            merge()
            owner = pa.array(keys[0] >> 40)
            names = [pa.array([g[k] for g in groups], pa.string()).take(owner) for k in (0, 1)]
            out = pa.RecordBatch.from_arrays([*names, pa.array(keys[0] & ((1 << 40) - 1)), pa.array(sums[0])], ["lang", "source", "ordinal", "n"])
            keys.clear()
            sums.clear()
            groups.clear()
            return out

        for batch in batches:
            waiting: dict[str, tuple[list[bytes], list[int]]] = {}
            size: Counter = Counter()
            for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if lang not in machines:
                    continue
                for piece in pieces(raw, SPACED):
                    parts, owners = waiting.setdefault(lang, ([], []))
                    parts.append(piece)
                    owners.append(groups.setdefault((lang, source), len(groups)))
                    size[lang] += len(piece)
                    if size[lang] >= PIECE:
                        run(lang, *waiting.pop(lang))
                        size[lang] = 0
            for lang, (parts, owners) in waiting.items():
                run(lang, parts, owners)
            if sum(map(len, keys)) > MOST_KEYS:
                merge()
                if len(keys[0]) > MOST_KEYS // 2:
                    yield frame()
        if keys:
            yield frame()

    return counted


def counts_of(spark: SparkSession, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of each kept term in each source that has some."""
    built = terms.groupBy("lang", "block").applyInPandas(build, "lang string, base long, packed binary")
    built, path = stored(spark, built, "transducers")
    schema, found = "lang string, source string, ordinal long, n long", []
    for lot in passes(built):
        langs = sorted({lang for lang, _, _ in lot})
        counts = rows.where(F.col("lang").isin(langs)).mapInArrow(recounted(spark.sparkContext.broadcast(lot)), schema)
        counts, _ = stored(spark, counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")
        found.append(counts)
    drop(spark, path)
    return reduce(DataFrame.union, found, spark.createDataFrame([], schema))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)) in exact arithmetic; 1 without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, low = F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + SMOOTH), wide(total) + SMOOTH * wide(terms)
    return F.when(terms > 0, 1 + F.call_function("div", top, low)).otherwise(1).cast("long")


def sums_of_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Shares of some terms by two blocks of sources to the sums of differences of their pairs a < b."""
    i, j, width = (int(rows[c].iloc[0]) for c in ("i", "j", "width"))
    marks = rows[rows["at"] < 0].sort_values("place")
    places = marks["place"].to_numpy()
    shares = np.repeat(marks["p"].to_numpy()[:, None], width, axis=1)
    held = rows[rows["at"] >= 0]
    shares[np.searchsorted(places, held["place"].to_numpy()), held["at"].to_numpy()] = held["p"].to_numpy()
    block, none = places // SIDE, np.zeros(0, dtype=np.int64)
    ones, twos, values = [none], [none], [none]
    for x in np.flatnonzero(block == i):
        others = np.flatnonzero((block == j) & (places > places[x]))
        ones.append(np.repeat(places[x], len(others)))
        twos.append(places[others])
        values.append(np.abs(shares[others] - shares[x]).sum(axis=1))
    out = pd.DataFrame({"a": np.concatenate(ones), "b": np.concatenate(twos), "value": np.concatenate(values)})
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out


def divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source).

    Part `pair`: each other source of the language by the sum, over all kept terms, of how far
    their shares lie apart. Part `term`: the `top` terms whose share in the source most exceeds
    that in the language. Null text, language or source is the empty string; texts without a
    term still make their source one that is compared; a language without kept terms gives
    pairs of value 0, one with a single source no pairs. Repeated rows count each. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = kept_terms(spark, rows, least)
    counts = counts_of(spark, rows, terms)
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = rows.select("lang", "source").distinct().withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    names = names.join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "total"])
    names, _ = stored(spark, names, "sources")
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    shares, _ = stored(spark, counts.join(names, ["lang", "source"]).select("lang", "source", "place", "ordinal", "n", p.alias("p"), "kept"), "shares")

    every = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    whole = names.groupBy("lang").agg(F.sum("total").alias("total"), F.any_value("kept").alias("kept"))
    q = every.join(whole, "lang").select("lang", "ordinal", p.alias("q"))
    above = shares.select("lang", "source", "ordinal", "p").join(q, ["lang", "ordinal"]).where("p > q")
    above = above.select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))
    best = above.withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    # A mark for each source and chunk of terms tells the share of terms that the source lacks there.
    chunks = F.greatest(F.lit(1), F.ceil(F.col("kept") / CHUNK)).cast("long")
    marks = names.select("lang", "place", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(-1).alias("at"), share(F.lit(0), F.col("total"), F.col("kept")).alias("p"), "kept")
    held = shares.select("lang", "place", F.expr(f"ordinal div {CHUNK}").alias("chunk"), (F.col("ordinal") % CHUNK).cast("int").alias("at"), "p", "kept")
    sides = names.groupBy("lang").agg(F.floor(F.max("place") / SIDE).alias("last"))
    own = F.floor(F.col("place") / SIDE)
    met = marks.union(held).join(sides, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    width = F.least(F.lit(CHUNK), F.col("kept") - F.col("chunk") * CHUNK).cast("int")
    met = met.select("lang", "place", "chunk", "at", "p", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), width.alias("width"))
    sums = met.groupBy("lang", "chunk", "i", "j").applyInPandas(sums_of_pairs, "lang string, a long, b long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    sums = sums.select("lang", ways.alias("w"), "value").select("lang", "w.*", "value")
    called = lambda place, name: names.select("lang", F.col("place").cast("long").alias(place), F.col("source").alias(name))
    pairs = sums.join(called("x", "source"), ["lang", "x"]).join(called("y", "item"), ["lang", "y"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).union(best)


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, over all documents. Edges as in `divergence`."""
    return divergence(spark, table(spark, sf_dir, "documents"))


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""with docs as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, {TERMS} as terms from documents),
words as (select k, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct k) >= {LEAST_DOCS}),
sizes as (select lang, count(*) as v from kept group by lang),
sources as (select distinct lang, source from docs),
held as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
grid as (select s.lang, s.source, k.term, coalesce(h.n, 0) as n from sources s join kept k on s.lang = k.lang left join held h on h.lang = s.lang and h.source = s.source and h.term = k.term),
p as (select lang, source, term, n, 1 + ({UNIT}::hugeint * (n + {SMOOTH})) // (sum(n) over (partition by lang, source) + {SMOOTH} * v) as p from grid join sizes using (lang)),
q as (select lang, term, 1 + ({UNIT}::hugeint * (sum(n) + {SMOOTH})) // (sum(sum(n)) over (partition by lang) + {SMOOTH} * any_value(v)) as q from grid join sizes using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item, coalesce(d.value, 0) as value from sources a join sources b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) d
  on d.lang = a.lang and d.source = a.source and d.item = b.source),
best as (select lang, source, term as item, p - q as value, row_number() over (partition by lang, source order by p - q desc, term) as rank from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all select lang, source, 'term', item, cast(value as bigint), cast(rank as integer) from best where rank <= {TOP}"""
