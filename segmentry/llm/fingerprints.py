"""Document fingerprints by spot signatures.

A common word is an anchor. With the `CHAIN` content words that follow it, common words
skipped, it is one signature; a text's fingerprint is the sorted set of the 64-bit hashes of
its signatures. Anchors are spread over running text and hardly occur in menus and lists, so
a fingerprint follows the prose of a document. A text without a whole chain has the runs of
CHAIN words as signatures, or, if shorter, all its words as one.

Fingerprints are compared by Jaccard. Sets of which the smaller has under `least` times the
larger's size are not compared at all. `near_duplicates` uses that for a search: sets are
partitioned by length so that similar ones are in the same or the next partition, and meet in
it by one of the first signatures, of which similar sets share one.

For the contract each document meets the next one in descending order. Documents are dealt
into ranges of the order by bounds from a bounded sample, the first document of a range is
sent to the range before as well, and a task streams its ranges in order, so texts are
shuffled once and a task holds two of them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, stored, table
from .shingles import SKETCH, near_copies
from .terms import APART, pieces, spaced

# The most common function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au "
    "de la que el en y los se del las un por con no su una para es al lo"
)
COMMON = frozenset(w.encode() for w in ANCHORS.split())
CHAIN, SEED, SIMILARITY = 3, 42, 0.8
SPACED = spaced(APART)
#: Bytes of texts in a range; most ranges; sampled rows for each of them.
RANGE_BYTES, MOST_RANGES, SAMPLED = 1 << 25, 8192, 40
NONE = np.zeros(0, dtype="<u8")


def hashed(chains: Iterator[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(c, SEED) for c in chains), dtype="<u8"))


def signatures(raw: bytes | None, chain: int = CHAIN, common: frozenset[bytes] = COMMON) -> np.ndarray:
    """The fingerprint of a UTF-8 text: sorted distinct hashes; none of a null text or one without a word."""
    found, spots, content = [NONE], [], []
    for piece in pieces(raw, SPACED):
        for word in piece.split():
            if word in common:
                spots.append((word, len(content)))
            else:
                content.append(word)
        whole = bisect.bisect_right(spots, len(content) - chain, key=lambda s: s[1])
        found.append(hashed(b" ".join((w, *content[i : i + chain])) for w, i in spots[:whole]))
        # What later pieces can still complete is kept.
        keep = spots[whole][1] if whole < len(spots) else len(content)
        spots, content = [(w, i - keep) for w, i in spots[whole:]], content[keep:]
    out = np.unique(np.concatenate(found))
    return out if len(out) else runs(raw, chain)


def runs(raw: bytes | None, chain: int) -> np.ndarray:
    """Hashes of all runs of `chain` words, or of all words of a shorter text."""
    found, words, n = [NONE], [], 0
    for piece in pieces(raw, SPACED):
        words += piece.split()
        found.append(hashed(map(b" ".join, zip(*(words[i:] for i in range(chain))))))
        n, words = max(n, len(words)), words[-(chain - 1) :] if chain > 1 else []
    out = np.unique(np.concatenate(found))
    return out if len(out) or not n else hashed(iter([b" ".join(words)]))


def likeness(one: np.ndarray, two: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two fingerprints, 1 for two empty ones; 0 without a comparison where sizes alone keep it under `least`."""
    small, large = sorted((len(one), len(two)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (small + large - shared)


def spelled(fingerprint: np.ndarray) -> str:
    """Base64 of the hashes as little-endian 64-bit integers; read() gives them back."""
    return base64.b64encode(fingerprint.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def placed(docs: DataFrame) -> DataFrame:
    """Rows with `none`, `back` and `h`, by which descending ids come in ascending order, null ids last, equal ones by text hash."""
    return docs.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).alias("back"), F.xxhash64("text").alias("h"))


def range_of(bounds: list[tuple]):
    def ranged(none: pd.Series, back: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(none.tolist(), back.tolist(), h.tolist())], dtype="int32")

    ranged.__annotations__ = {"none": pd.Series, "back": pd.Series, "h": pd.Series, "return": pd.Series}
    return F.pandas_udf(ranged, "int")("none", "back", "h")


def dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of `placed` with the range of the order that they go to; the first of a range goes, `borrowed`, to the range before too.

    Bounds of ranges come from a sample of SAMPLED rows for each of at most MOST_RANGES ranges; beyond
    that ranges grow. The first range comes after the last.
    """
    light, path = stored(spark, rows.select("none", "back", "h", F.octet_length("text").alias("size")), "places")
    size = light.agg(F.sum("size")).first()[0] or 0
    n = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    key = ["none", "back", "h"]
    sample = sorted(map(tuple, light.select(*key).orderBy(F.xxhash64(*key)).limit(n * SAMPLED).collect())) if n > 1 else []
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    firsts = sorted((r, tuple(f)) for r, f in light.groupBy(range_of(bounds).alias("r")).agg(F.min(F.struct(*key))).collect())
    drop(spark, path)
    before = {r: firsts[i - 1][0] for i, (r, _) in enumerate(firsts)}
    told = spark.createDataFrame([(*f, before[r]) for r, f in firsts], "none int, back long, h long, earlier int")
    # As many rows as there are ranges.
    marked = rows.withColumn("range", range_of(bounds)).join(F.broadcast(told), key, "left")
    own = F.struct(F.col("range"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("earlier").alias("range"), F.lit(True).alias("borrowed"))
    goes = F.explode(F.when(F.col("earlier").isNull(), F.array(own)).otherwise(F.array(own, lent)))
    return marked.select("doc_id", "text", *key, goes.alias("to")).select("doc_id", "text", *key, "to.*")


def beside_next(batches):
    """Rows in order, the borrowed ones of a range last, to each row's fingerprints and likenesses."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for doc, text, where, borrowed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "borrowed"))):
            text = text or ""
            # Of several borrowed rows, which are equal, the first is met.
            if borrowed and held is None:
                continue
            print_ = signatures(text.encode())
            if held is not None:
                before, was, own = held
                k = len(was) // 3
                edited = (was[: len(was) - k] + text[:k]).encode()
                other = signatures(edited)
                out.append((before, len(was), hashlib.sha256(edited).hexdigest(), spelled(own), spelled(other), likeness(own, other), likeness(own, print_)))
            held = None if borrowed else (doc, text, print_)
        columns = list(zip(*out)) or [()] * len(RESULT)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [batch.schema.field("doc_id").type, *RESULT.values()])], ["doc_id", *RESULT])


RESULT = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text).

    The next document is the one of the next smaller id, after the smallest (null ids come
    last) the first; rows that share an id follow each other by text hash; a single row is
    its own next. Ids are integers. Null and empty texts have no code points and an empty
    fingerprint, which is like another empty one (1) and unlike any other (0). An empty table
    gives no rows; other columns are not read.
    """
    rows = dealt(spark, placed(docs))
    rows = rows.repartition("range").sortWithinPartitions("range", "borrowed", "none", "back", "h")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "range", "borrowed").mapInArrow(beside_next, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edges_of_lengths(similarity: float) -> list[int]:
    """Least sizes of the partitions by length: sets that similar are in the same partition or in adjoining ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] / similarity) + 1)
    return out


def sketcher(similarity: float):
    """Of texts of spelled hashes, what the search of near copies needs: as keys, for the set's partition by length and the
    next one, the signatures of which similar sets share one: the smallest n - ceil(similarity * n) + 1."""
    edges = edges_of_lengths(similarity)

    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = np.array([int(x, 16) for x in (text or "").split()], dtype="<u8")
            digest, n = xxhash.xxh3_128_digest(found.tobytes()), len(found)
            part = bisect.bisect_right(edges, n)
            first = found[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
            keys = [xxhash.xxh64_intdigest(s.tobytes(), p) for p in (part, part + 1) for s in first] if n else []
            rows.append((digest, n, 0, np.array(keys, dtype="<u8").view("<i8").tolist()))
        out = pd.DataFrame(rows, columns=["digest", "n", "fp", "bands"])
        # All sets get a fingerprint of their own, as the index of SimHash is not asked.
        out["fp"] = [int.from_bytes(d[:8], "little", signed=True) for d in out["digest"]]
        return out

    sketched.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(sketched, SKETCH)


@F.pandas_udf(T.StringType())
def listed(texts: pd.Series) -> pd.Series:
    return pd.Series([" ".join(f"{x:016x}" for x in signatures((t or "").encode()).tolist()) for t in texts], dtype=object)


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text): the smallest id among all documents that links of at
    least that likeness reach.

    Null and empty texts, and others without a word, link with each other only. Rows that
    repeat an id are rows of their own; a component's id is null only if all its ids are.
    An empty table gives no rows.
    """
    rows = docs.select("doc_id", listed("text").alias("text"))
    rows, labels = near_copies(spark, rows, 1, similarity, sketcher=sketcher(similarity))
    both = rows.select("key", "doc.doc_id").join(labels, "key")
    first = both.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return both.join(first, "label").select("doc_id", "component_id")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. Edges as in `fingerprints`."""
    return fingerprints(spark, table(spark, sf_dir, "documents"))
