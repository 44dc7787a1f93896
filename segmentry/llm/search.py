"""Ranked lexical search by bag deduplication.

Documents are restricted to the vocabulary of the items: what is left of a text is a bag, its
known terms with their counts, and the length factor m. Documents with the same bag and m
score alike for every item, so they are one class, found by a hash and verified by grouping
on the bag itself. Classes, not documents, are scored, by postings of the items' terms: a
task keeps the best of each item and nothing else. Only the members of classes that win are
looked up again, by hash and bag, and are listed by ascending doc_id.

The first k documents of an item are in its first k classes by (score, smallest doc_id), as
every class before another holds a document before each of the other's. So neither step
loses one.

Items are taken in blocks of a bounded number of words: the vocabulary, its weights and the
postings of one block are all that is broadcast, and for each block the documents are read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table
from .decontaminate import BLOCK_WORDS, blocks
from .terms import APART, pieces, spaced

K = 10
SPACED = spaced(APART)
#: Postings, and scores, that a task holds at once.
AT_ONCE = 1 << 20
#: Most that a term adds to a score for each unit of weight and each repeat in the item.
MOST = 1_000_000


@dataclass(frozen=True)
class Postings:
    """A block of items by term: places starts[t] to starts[t + 1] of `items` and `times` are the items with term t."""

    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int
    longest: int

    @classmethod
    def of(cls, block: list[tuple]) -> Postings:
        terms: dict[bytes, int] = {}
        codes = [np.array([terms.setdefault(w, len(terms)) for w in words], dtype=np.int64) for _, words in block]
        each = [np.unique(c, return_counts=True) for c in codes]
        ids, times = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[k] for x in each)]) for k in (0, 1))
        item = np.repeat(np.arange(len(block)), [len(x[0]) for x in each])
        order = np.argsort(ids, kind="stable")
        starts = np.searchsorted(ids[order], np.arange(len(terms) + 1))
        return cls(terms, starts, item[order], times[order], len(block), max(map(len, codes), default=0))


def bags(told: Broadcast):
    """(doc_id, text) to (doc_id, n, bag): the number of terms; ids and counts of known terms as 32-bit integers."""

    def cut(batches):
        get = told.value.get
        for batch in batches:
            sizes, held = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                n, known = 0, [np.zeros(0, dtype="<i4")]
                for piece in pieces(raw, SPACED):
                    words = piece.split()
                    ids = np.fromiter(map(get, words, repeat(-1)), dtype="<i4", count=len(words))
                    n += len(words)
                    known.append(ids[ids >= 0])
                ids, counts = np.unique(np.concatenate(known), return_counts=True)
                sizes.append(n)
                held.append(np.concatenate([ids, counts.astype("<i4")]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "n", "bag"])

    return cut


def halves(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bag, dtype="<i4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def frequencies(n_terms: int):
    """Bags to (term, df), summed within the task."""

    def counted(batches):
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                df[halves(bag)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    return counted


def summed(keys: np.ndarray, values: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Sums of values by key. Sums below 2**53 are exact in doubles; others are added as integers."""
    if exact:
        return np.bincount(keys, weights=values, minlength=n).astype(np.int64)
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, keys, values)
    return out


def scorer(told: Broadcast, k: int):
    """Classes (cid, first, m, bag) in order of `first` to the k best of each item as (item, cid, first, score)."""

    def scored(batches):
        p, weights = told.value
        exact = int(weights.max(initial=0)) * MOST * p.longest < 1 << 53
        best, who = np.zeros((p.n_items, k), dtype=np.int64), np.zeros((p.n_items, k), dtype=np.int64)
        firsts, kind = np.full((p.n_items, k), None, dtype=object), pa.int64()
        for batch in batches:
            kind = batch.schema.field("first").type
            cids, m, first = batch.column("cid").to_numpy(), batch.column("m").to_numpy(), batch.column("first")
            sides = [halves(b) for b in batch.column("bag").to_pylist()]
            row = np.repeat(np.arange(len(sides)), [len(ids) for ids, _ in sides])
            ids = np.concatenate([ids for ids, _ in sides])
            tf = np.concatenate([tf for _, tf in sides]).astype(np.int64)
            gain = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            many = p.starts[ids + 1] - p.starts[ids]
            # Rows are cut where their postings, or their scores, fill a part.
            load = np.maximum(np.bincount(row, weights=many, minlength=len(sides)), p.n_items)
            part = np.cumsum(load) // AT_ONCE
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(edges, edges[1:]):
                a, b = np.searchsorted(row, [lo, hi])
                n, count = hi - lo, many[a:b]
                place = np.repeat(p.starts[ids[a:b]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                keys = np.repeat(row[a:b] - lo, count) * p.n_items + p.items[place]
                scores = summed(keys, np.repeat(gain[a:b], count) * p.times[place], n * p.n_items, exact).reshape(n, p.n_items)
                # Rows come by ascending `first`, so of equal scores the earlier one stays ahead.
                at, item = np.nonzero(scores > best[:, -1])
                order = np.argsort(item, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                    i, rows = item[group[0]], at[group]
                    every = np.concatenate([best[i], scores[rows, i]])
                    top = np.argsort(-every, kind="stable")[:k]
                    new = [(firsts[i, t] if t < k else first[int(lo + rows[t - k])].as_py()) for t in top]
                    who[i] = np.concatenate([who[i], cids[lo + rows]])[top]
                    best[i] = every[top]
                    firsts[i] = np.array([*new, None], dtype=object)[:-1]
        item, place = np.nonzero(best > 0)
        columns = [pa.array(item.astype(np.int32)), pa.array(who[item, place]), pa.array(list(firsts[item, place]), kind), pa.array(best[item, place])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "cid", "first", "score"])

    return scored


def search_block(spark: SparkSession, docs: DataFrame, block: list[tuple], item_kind: str, k: int) -> DataFrame | None:
    """Results for one block of items; None where no item has a term or no document has one."""
    postings, kind = Postings.of(block), dict(docs.dtypes)["doc_id"]
    if not postings.terms:
        return None
    context = spark.sparkContext
    held, _ = stored(spark, docs.select("doc_id", "text").mapInArrow(bags(context.broadcast(postings.terms)), f"doc_id {kind}, n long, bag binary"), "bags")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    # As many rows as the block has terms.
    df = np.zeros(len(postings.terms), dtype=np.int64)
    for term, n in held.select("bag").mapInArrow(frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    bare = Postings({}, postings.starts, postings.items, postings.times, postings.n_items, postings.longest)

    held = held.where("length(bag) > 0").withColumn("m", F.expr(f"25 + (75 * n * {n_docs}) div {n_terms}"))
    held = held.withColumn("h", F.xxhash64("m", "bag"))
    # The hash brings candidates together; grouping by m and the bag verifies them.
    classes = held.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first")).withColumn("cid", F.monotonically_increasing_id())
    classes, _ = stored(spark, classes, "classes")
    ranked = classes.select("cid", "first", "m", "bag").sortWithinPartitions(F.col("first").asc_nulls_last())
    ranked = ranked.mapInArrow(scorer(context.broadcast((bare, weights)), k), f"item int, cid long, first {kind}, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last()))
    tops, _ = stored(spark, ranked.withColumn("place", place).where(F.col("place") <= k).select("item", "cid", "score"), "tops")

    winners = classes.join(tops.select("cid").distinct(), "cid", "left_semi").select("cid", "h", "m", "bag")
    # At most k hashes for each item of the block.
    near = held.join(F.broadcast(winners.select("h").distinct()), "h", "left_semi")
    members = near.join(winners, ["h", "m", "bag"]).select("cid", "doc_id")
    by_id = F.col("doc_id").asc_nulls_last()
    members = members.withColumn("place", F.row_number().over(W.partitionBy("cid").orderBy(by_id))).where(F.col("place") <= k).drop("place")
    listed = tops.join(members, "cid")
    listed = listed.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), by_id))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_kind}")
    return listed.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal ones by ascending doc_id.

    Null and empty texts have no term and are neither counted nor found; items without a term
    have no rows. Each row is a document or an item of its own: repeated rows are ranked one by
    one, rows without a doc_id after those of equal score with one. Empty tables give no rows.
    Other columns are not read.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    found = (search_block(spark, docs, block, item_kind, k) for block in blocks(items, block_words))
    none = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.union, (x for x in found if x is not None), none)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item. Edges as in `search`."""
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""with docs as (select row_number() over () as k, doc_id, {TERMS} as terms from documents),
items as (select row_number() over () as i, item_id, {TERMS} as terms from benchmark),
held as (select k, term, count(*) as tf from (select k, unnest(terms) as term from docs) group by all),
asked as (select i, term, count(*) as times from (select i, unnest(terms) as term from items) group by all),
sums as (select count(*) filter (len(terms) > 0) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from docs),
weighed as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from held, sums group by term),
lengths as (select k, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms as m from docs, sums),
scores as (select i, k, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weighed using (term) join held using (term) join lengths using (k) group by i, k, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id, k) as rank from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked join items using (i) where rank <= {K}"""
