"""The pipeline's near-duplicate stage: SimHash links, completed to a shingle similarity.

Two texts are near copies if the Jaccard coefficient of their sets of `WORDS`-word shingles
is at least `SIMILARITY`. Fingerprints of those shingles go through the deletion-variant
index of `simhash`, which links within `simhash.LIMIT` bits. At a coefficient of 0.8 two
fingerprints differ in about 10 of 64 bits, which no index of few segments reaches, so
candidates come from `BANDS` keys, each made of `ROWS` minimum hashes, as well: a pair at
0.8 is missed with a probability of (1 - 0.8^5)^20, 0.04 %. Every candidate of either kind
that links is verified on the words themselves.

Texts of equal shingle sets are one class first. A key is then compared in rounds, the first
together with the links of the index: in each its members meet one member drawn by a hash,
but for those that are connected to it. When a round links little, what is still apart is compared whole: of each key the members outside
its largest component meet all members, in pairs where the key is small, else in blocks whose
shared shingles are counted by matrix products. So no candidate that could join two components is left out, and a large group of copies costs members, not their square; only texts that share
keys with very many and link with none meet them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import chosen, components, drop, stored

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 20, 5, 42
#: A round that links a smaller share of its pairs is the last; most rounds.
LEAST_LINKED, ROUNDS = 0.05, 12
#: Keys of at most so many members are compared pair by pair.
SMALL = 16
#: Most members of a block, shingles that fill one, and columns of a matrix product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 500_000, 8192
#: Pairs with one text that go to one task.
SLICE = 256
SKETCH = T.StructType().add("digest", "binary").add("n", "long").add("fp", "long").add("bands", T.ArrayType(T.LongType()))
#: Odd factors and summands of the permutations of 64-bit hashes.
FACTORS, SUMMANDS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS |= np.uint64(1)


def windows(text: str | None, words: int = WORDS):
    """Shingles of a text in order: all runs of so many words, or the whole of a shorter text; none without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) < words:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*(tokens[i:] for i in range(words))))


def jaccard(one: set, two: set) -> float:
    shared = len(one & two)
    return shared / (len(one) + len(two) - shared) if one or two else 1.0


def sketched(text: str | None, words: int = WORDS) -> tuple[bytes, int, int, list[int]]:
    """(digest of the shingle set, its size, SimHash, band keys); no keys without a word."""
    digest = xxhash.xxh64_intdigest
    every = np.fromiter((digest(s, SEED) for s in windows(text, words)), dtype="<u8")
    hashes = np.unique(every)
    whole = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return whole, 0, 0, []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS * hashes[at : at + 1024] + SUMMANDS).min(axis=1), out=least)
    keys = [digest(rows.tobytes(), band) for band, rows in enumerate(least.reshape(BANDS, ROWS))]
    return whole, len(hashes), simhash.majority(every), np.array(keys, dtype="<u8").view("<i8").tolist()


def sketch(words: int):
    def sketches(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketched(t, words) for t in texts], columns=["digest", "n", "fp", "bands"])

    sketches.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(sketches, SKETCH)


def similar(words: int, similarity: float):
    def alike(ones: pd.Series, twos: pd.Series) -> pd.Series:
        held: dict[str, set] = {}

        def shingles(text: str) -> set:
            # Pairs come by their first text, so one set serves many pairs.
            if text not in held:
                if len(held) > 8:
                    held.clear()
                held[text] = set(windows(text, words))
            return held[text]

        return pd.Series([jaccard(shingles(a), set(windows(b, words))) >= similarity for a, b in zip(ones, twos)], dtype=bool)

    alike.__annotations__ = {"ones": pd.Series, "twos": pd.Series, "return": pd.Series}
    return F.pandas_udf(alike, T.BooleanType())


def sized(m: str, n: str, similarity: float):
    """Whether sets of these sizes can be that similar."""
    return F.least(m, n) >= F.greatest(m, n) * similarity


def with_text(pairs: DataFrame, texts: DataFrame, side: str, name: str) -> DataFrame:
    """pairs (a, b, ...) and the text of one side. A text in very many pairs is sent once for each SLICE of them."""
    other = "b" if side == "a" else "a"
    slices = pairs.groupBy(side).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    cut = pairs.join(slices, side).withColumn("slice", F.pmod(F.xxhash64(other), F.col("slices")).cast("int")).drop("slices")
    told = texts.toDF(side, name).join(slices, side).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return cut.join(told, [side, "slice"]).drop("slice")


def overlaps(left: list[set], right: list[set]) -> np.ndarray:
    """Numbers of shingles that each of left shares with each of right."""
    ids: dict[bytes, int] = {}
    held = set().union(*right)
    places = [[ids.setdefault(x, len(ids)) for x in one if x in held] for one in left]
    others = [[ids[x] for x in two if x in ids] for two in right]
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], dtype=np.int64)
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    sides = [(flat(places), len(left)), (flat(others), len(right))]
    for at in range(0, len(ids), COLUMNS):
        parts = []
        for (row, col), n in sides:
            lo, hi = np.searchsorted(col, [at, at + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(ids) - at)), dtype=np.float32)
            part[row[lo:hi], col[lo:hi] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def across(words: int, similarity: float):
    """Of a block of outsiders and a block of members of a key: edges that span their links."""

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["outside"]], rows[~rows["outside"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.array([], "int64"), "b": pd.array([], "int64")})
        one, two = ([set(windows(t, words)) for t in side["text"]] for side in (left, right))
        m, n = np.array([len(x) for x in one])[:, None], np.array([len(x) for x in two])[None, :]
        shared = overlaps(one, two).astype(np.float64)
        la, lb, a, b = left["label"].to_numpy(), right["label"].to_numpy(), left["rep"].to_numpy(), right["rep"].to_numpy()
        # As in jaccard, the quotient of whole numbers in double precision.
        i, j = np.nonzero((shared / (m + n - shared) >= similarity) & (la[:, None] != lb[None, :]))
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        found = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(la[x]), find(lb[y])
            if p != q:
                top[max(p, q)] = min(p, q)
                found.append((int(a[x]), int(b[y])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return compared


def in_blocks(parted: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) that span all links between members (band, rep, n, label) of a key with different labels."""
    largest = parted.groupBy("band", "label").count().groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    marked = parted.join(largest, "band").withColumn("outside", F.col("label") != F.col("largest"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    outside = F.col("outside")
    sizes = marked.groupBy("band").agg(
        blocks(F.count_if(outside), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0))).alias("lefts"), blocks(F.count("*"), F.sum("n")).alias("rights")
    )
    placed = marked.join(sizes, "band").withColumn("h", F.xxhash64("rep"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = placed.where(outside).withColumn("i", F.pmod("h", F.col("lefts")).cast("int")).withColumn("j", F.explode(every("rights")))
    right = placed.withColumn("outside", F.lit(False)).withColumn("j", F.pmod("h", F.col("rights")).cast("int")).withColumn("i", F.explode(every("lefts")))
    names = ["band", "i", "j", "rep", "label", "outside"]
    both = left.select(*names).union(right.select(*names)).join(texts.withColumnRenamed("key", "rep"), "rep")
    return both.groupBy("band", "i", "j").applyInPandas(across(words, similarity), "a long, b long")


def near_copies(spark: SparkSession, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, rounds: int = ROUNDS, sketcher=None) -> tuple[DataFrame, DataFrame]:
    """(doc, key) for each row of docs (text, ...), key being its own, and (key, label) with the same label for all that link.

    Texts without a word (null, empty, white space) link with each other only. Rows that
    repeat an id are rows of their own. An empty table gives no rows. A `sketcher` other than
    `sketch` gives other keys of candidates.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("key"), (sketcher or sketch(words))("text").alias("s"))
    rows, _ = stored(spark, rows, "shingled")
    classes, _ = stored(spark, rows.groupBy(F.col("s.digest").alias("digest")).agg(F.min("key").alias("rep")), "classes")
    heads = rows.select(F.col("key").alias("rep"), "s.n", "s.fp", "s.bands").where("n > 0").join(classes, "rep", "left_semi")
    heads, held = stored(spark, heads, "heads")

    # Links of the SimHash index, between the first class of each fingerprint, and of those with it.
    prints, told = stored(spark, heads.groupBy("fp").agg(F.min(F.struct("rep", "n")).alias("x")).select("fp", "x.*"), "prints")
    near = simhash.links(spark, prints.select("fp")).toDF("f", "g")
    near = near.join(prints.toDF("f", "a", "m"), "f").join(prints.toDF("g", "b", "n"), "g")
    equal = heads.select("fp", F.col("rep").alias("b"), "n").join(prints.toDF("fp", "a", "m"), "fp").where("a <> b")
    pairs = near.select("a", "m", "b", "n").unionByName(equal.select("a", "m", "b", "n")).where(sized("m", "n", similarity))
    pairs, pairs_path = stored(spark, pairs.select("a", "b").distinct(), "pairs")

    entries = heads.select("rep", "n", F.explode("bands").alias("band"))
    several = entries.groupBy("band").count().where("count > 1").select("band")
    members, kept = stored(spark, entries.join(several, "band"), "members")
    needed = members.select(F.col("rep").alias("key")).union(pairs.select("a")).union(pairs.select("b"))
    needed, bitmaps = chosen(spark, rows.select("key", F.col("doc.text").alias("text")), needed.distinct())
    texts, texts_path = stored(spark, needed, "texts")
    paths = [held, told, pairs_path, kept, texts_path, *bitmaps]
    edges: list[DataFrame] = []

    def add(found: DataFrame) -> int:
        sure, path = stored(spark, found, "linked")
        edges.append(sure)
        paths.append(path)
        return sure.count()

    def linking(found: DataFrame) -> DataFrame:
        both = with_text(with_text(found, texts, "b", "two"), texts, "a", "one")
        return both.where(similar(words, similarity)("one", "two")).select("a", "b")

    def connected() -> DataFrame:
        every = edges[0]
        for more in edges[1:]:
            every = every.union(more)
        return components(spark, every).withColumnRenamed("v", "rep")

    def stars(parted: DataFrame, turn: int) -> DataFrame:
        """Pairs of each key's members with one of them, but for those that are connected to it."""
        centre = parted.groupBy("band").agg(F.min_by(F.struct("rep", "n", "label"), F.xxhash64(F.lit(turn), "rep")).alias("c"))
        met = parted.join(centre, "band").select(F.col("rep").alias("b"), "n", "label", F.col("c.rep").alias("a"), F.col("c.n").alias("m"), F.col("c.label").alias("other"))
        return met.where((F.col("label") != F.col("other")) & sized("m", "n", similarity)).select("a", "b")

    def compare(found: DataFrame) -> tuple[int, int]:
        """Numbers of distinct pairs compared and linked."""
        found, path = stored(spark, found.distinct(), "pairs")
        paths.append(path)
        return found.count(), add(linking(found))

    # The links of the SimHash index and the first stars need no labels, so they are compared at once.
    compared, linked = compare(pairs.union(stars(members.withColumn("label", F.col("rep")), 0)))
    for turn in range(1, max(rounds, 1) + 1):
        labels = connected()
        parted = members.join(labels, "rep", "left").select("band", "rep", "n", F.coalesce("label", "rep").alias("label"))
        apart = parted.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
        parted, path = stored(spark, parted.join(apart, "band", "left_semi"), "parted")
        paths.append(path)
        if parted.isEmpty():
            break
        if turn >= rounds or linked < LEAST_LINKED * compared:
            small = parted.groupBy("band").count().where(F.col("count") <= SMALL).select("band")
            few = parted.join(small, "band", "left_semi")
            left, right = few.toDF("band", "a", "m", "la"), few.toDF("band", "b", "n", "lb")
            rest = left.join(right, "band").where((F.col("la") < F.col("lb")) & sized("m", "n", similarity)).select("a", "b").distinct()
            add(linking(rest).union(in_blocks(parted.join(small, "band", "left_anti"), texts, words, similarity)))
            labels = connected()
            break
        compared, linked = compare(stars(parted, turn))
    labelled = classes.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    labelled, _ = stored(spark, labelled, "labelled")
    drop(spark, *paths)
    return rows.select("doc", "key"), rows.select("key", F.col("s.digest").alias("digest")).join(labelled, "digest").select("key", "label")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, that of the smallest (doc_id, text hash, row hash, row key).

    A row without a doc_id comes after those with one, and stays if its component has no
    other. Rows that share a doc_id but link with nothing all stay. Null and empty texts are
    one component. Repeated rows are one component, of which one row stays. Columns stay as
    they are, whatever their names; an empty table gives no rows.
    """
    rows, labels = near_copies(spark, docs)
    doc = lambda c: F.col(f"doc.{c}")
    order = F.struct(doc("doc_id").isNull(), doc("doc_id"), F.xxhash64(doc("text")), F.xxhash64("doc"), "key")
    # Only keys and their order are brought together; documents are not moved.
    places = rows.select("key", order.alias("place")).join(labels, "key")
    winners = places.groupBy("label").agg(F.min_by("key", "place").alias("key")).select("key")
    return chosen(spark, rows, winners)[0].select("doc.*")
