"""Benchmark decontamination with a generalised suffix automaton of the items.

The automaton is built over the words of the normalised items. Each document streams its
words through it and tracks the longest suffix that is a substring of an item; where that
length reaches `WINDOW`, the last WINDOW words are a window of some item. Items of fewer
words are terminals that the suffix links reach.

Items are taken in blocks of at most `block_words` words, so that what is broadcast and
held by a worker has a fixed bound: workers build the automaton of one block from its words
and keep it for that block's tasks. If there are more blocks than one, documents are matched
against each in a job of its own, whose hits are stored, and their spans are merged last.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, stored, table

WINDOW = 10
#: Most words of items that one automaton holds: it has at most twice as many states, of about 350 bytes each.
BLOCK_WORDS = 400_000
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(TO_SPACE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    window: int = WINDOW
    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items of the window that ends in a state, at the state that stands for that window.
    items: dict[int, list] = field(default_factory=dict)
    #: (words, items) of whole short items that end in a state, longest first.
    short: dict[int, list] = field(default_factory=dict)
    #: The state of the last `window` words; the nearest state up the links that ends a short item.
    at_window: list[int] = field(default_factory=list)
    at_short: list[int] = field(default_factory=list)

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of exactly the words that reach q from p, apart from longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> Automaton:
        """From (item_id, words) pairs; items without words are left out."""
        self = cls(window)
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words]) for i, words in items if words]
        for _, codes in coded:
            last = 0
            for w in codes:
                last = self._extend(last, w)
        for v in range(len(self.length)):
            u = v
            while u and self.length[self.link[u]] >= window:
                u = self.link[u]
            self.at_window.append(u)
        for item, codes in coded:
            v, seen = 0, set()
            for n, w in enumerate(codes, 1):
                v = self.next[v][w]
                if n >= window and (u := self.at_window[v]) not in seen:
                    seen.add(u)
                    self.items.setdefault(u, []).append(item)
            if len(codes) < window:
                self.short.setdefault(v, []).append((len(codes), item))
        for v in self.short:
            self.short[v].sort(key=lambda x: -x[0])
        near = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            near[v] = v if v in self.short else near[self.link[v]] if v else -1
        self.at_short = near
        return self

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit spans (word positions, end exclusive) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at_short, any_short = self.at_short, bool(self.short)
        v = n = 0
        for pos, w in enumerate(map(self.ids.get, words)):
            if w is None:
                v = n = 0
                continue
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w not in nxt[v]:
                continue
            v = nxt[v][w]
            n += 1
            reach = 0
            if n >= window:
                reach = window
                found.update(self.items[self.at_window[v]])
            if any_short:
                u = at_short[v]
                while u > 0:
                    for size, item in self.short[u]:
                        if u != v or size <= n:
                            found.add(item)
                            reach = max(reach, size)
                    u = at_short[link[u]]
            if reach:
                if spans and spans[-1][1] >= pos + 1 - reach:
                    start = pos + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, pos + 1))
                else:
                    spans.append((pos + 1 - reach, pos + 1))
        return spans, found


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Items as (item_id, words), streamed to the driver in blocks of a bounded number of words."""
    held: list[tuple] = []
    n = 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if held and n + len(words) > block_words:
            yield held
            held, n = [], 0
        held.append((row["item_id"], words))
        n += len(words)
    yield held


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping or adjoining spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def with_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (any columns, with text) and a struct `hits` (n_words, starts, ends, item_ids).

    starts and ends are the maximal hit spans in words. Null and empty texts have no words
    and no hits; null or wordless items match nothing; of repeated items each id is
    reported. Rows are kept one by one; an empty table gives no rows; a column `hits` that
    docs already has is replaced. With one block of items there is no shuffle.
    """
    kind = dict(items.dtypes)["item_id"]
    schema = f"n_words long, starts array<int>, ends array<int>, item_ids array<{kind}>"
    ready = blocks(items, block_words)
    block, following = next(ready), next(ready, None)
    if following is None:
        return docs.withColumn("hits", F.pandas_udf(matcher(spark, block, window), schema)("text"))
    rows, _ = stored(spark, docs.select(F.struct(*docs.columns).alias("doc"), "text", F.monotonically_increasing_id().alias("key")), "documents")
    parts, paths = [], []
    while block is not None:
        part = rows.select("key", F.pandas_udf(matcher(spark, block, window), schema)("text").alias("hits"))
        part, path = stored(spark, part.where(F.size("hits.starts") > 0).select("key", "hits.*"), "hits")
        parts.append(part)
        paths.append(path)
        block, following = following, next(ready, None)
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "item_ids")]
    merged_, _ = stored(spark, every.groupBy("key").agg(*lists).select("key", F.pandas_udf(union_of, schema)("starts", "ends", "item_ids").alias("found")), "merged")
    drop(spark, *paths)
    found = rows.join(merged_, "key", "left")
    hits = F.struct(
        count_words("text").alias("n_words"),
        F.coalesce("found.starts", F.expr("cast(array() as array<int>)")).alias("starts"),
        F.coalesce("found.ends", F.expr("cast(array() as array<int>)")).alias("ends"),
        F.coalesce("found.item_ids", F.expr(f"cast(array() as array<{kind}>)")).alias("item_ids"),
    )
    return found.select("doc.*", hits.alias("__hits")).drop("hits").withColumnRenamed("__hits", "hits")


@F.pandas_udf(T.LongType())
def count_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in texts], dtype="int64")


def union_of(starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
    """Hits of several blocks as those of one; n_words is left open."""
    rows = []
    for s, e, found in zip(starts, ends, items):
        spans = merged([*zip(map(int, s), map(int, e))])
        rows.append((None, [a for a, _ in spans], [b for _, b in spans], sorted(set(found))))
    return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "item_ids"])


union_of.__annotations__ = {"starts": pd.Series, "ends": pd.Series, "items": pd.Series, "return": pd.DataFrame}
#: The automaton of the block that this worker is at.
BUILT: dict[str, Automaton] = {}


def automaton(name: str, block: Broadcast, window: int) -> Automaton:
    """Built once for a worker and block; the one before it is let go."""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Automaton.of(block.value, window)
    return BUILT[name]


def matcher(spark: SparkSession, block: list[tuple], window: int) -> Callable:
    """A function over batches of texts, which gives their hits by one block of items."""
    told, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def matched(texts: pd.Series) -> pd.DataFrame:
        match, rows = automaton(name, told, window).match, []
        for text in texts:
            words = words_of(text)
            spans, found = match(words)
            rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(found)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "item_ids"])

    matched.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return matched


def n_hit() -> Column:
    """Words in hit spans."""
    widths = F.zip_with("hits.ends", "hits.starts", lambda e, s: (e - s).cast("long"))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)


@F.pandas_udf(T.StringType())
def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the words of the spans and what stands between them."""

    def one(text, spans):
        if text is None or not spans:
            return text
        at = [m.span() for m in WORD_CHARS.finditer(text)]
        out, last = [], 0
        for s, e in spans:
            out.append(text[last : at[s][0]])
            last = at[e - 1][1]
        return "".join([*out, text[last:]])

    return pd.Series([one(t, list(zip(s, e))) for t, s, e in zip(texts, starts, ends)], dtype=object)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document, by all benchmark items. Edges as in `with_hits`."""
    found = with_hits(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hits.item_ids", lambda i: i.cast("string"))), ",")
    found = found.select("doc_id", "hits.n_words", n_hit().alias("n_hit"), F.size("hits.item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, max_span: int = 0, max_coverage: float = 1.0) -> DataFrame:
    """docs without hit spans of over max_span words and without documents of which over max_coverage is hit.

    Columns, whatever their names, and the texts of documents without such spans stay as they
    are. Null and empty texts stay; repeated rows are judged one by one.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = with_hits(spark, packed, items).where(n_hit() <= F.lit(max_coverage) * F.col("hits.n_words"))
    if max_coverage <= 0:
        return found.select("doc.*")
    long_spans = F.filter(F.arrays_zip("hits.starts", "hits.ends"), lambda s: s["ends"] - s["starts"] > max_span)
    found = found.withColumn("hits", long_spans)
    text = F.when(F.size("hits") > 0, cut("text", "hits.starts", "hits.ends")).otherwise(F.col("text"))
    return found.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the coverage limit is zero, so documents that hold a window of an item go whole; others stay as they are.

    Null and empty texts, and repeats of clean rows, stay; an empty table gives no rows.
    """
    return clean(spark, docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)
