"""Near duplicates by SimHash, linked through deletion-variant signatures.

A fingerprint of 64 bits is cut into `SEGMENTS` = 2 halves: of 3 differing bits, one half
holds at most one. Each half is indexed once as it is and once for each bit left out
(one-wildcard variants). Two fingerprints meet by equality of the whole half, or by
equality of the variant in which exactly the bit left out differs; so a linked pair meets
at most twice, and each meeting is verified on all 64 bits.

Copies never meet: fingerprints are made distinct first. An index entry with over
`heavy` fingerprints is not expanded into pairs: there, every member emits the entry with
1 to 3 further bits of the other half left out, and members that share such a key are
linked to the smallest of them. This is exact too (sharing a key with at most 3 bits left
out means differing in at most those) and grows with the members, not with their square.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop, stored, table

SEGMENTS, BITS, WORDS, LIMIT, SEED = 2, 64, 3, 3, 42
#: Fingerprints in one index entry up to which pairs are cheaper than deletion keys.
HEAVY = 4096


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of word shingles; 0 where there is no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = np.array([digest(join(tokens), seed)], dtype="<u8")
    else:
        hashes = np.array([digest(join(s), seed) for s in zip(*(tokens[i:] for i in range(words)))], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes, as a signed integer."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return int(np.array(bits, dtype="<u8").view("<i8"))


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def entries(halves: DataFrame) -> DataFrame:
    """Index entries of halves (seg, half, ...): wild -1 is the whole half; side is the value of the bit left out."""
    whole = F.array(F.struct(F.lit(-1).alias("wild"), F.col("half").alias("rest"), F.lit(-1).alias("side")))
    variants = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(
            i.alias("wild"),
            F.col("half").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("rest"),
            F.call_function("getbit", F.col("half"), i).cast("int").alias("side"),
        ),
    )
    others = [c for c in halves.columns if c != "half"]
    return halves.select(*others, F.explode(F.concat(whole, variants)).alias("e")).select(*others, "e.*")


def halves(prints: DataFrame) -> DataFrame:
    """(seg, half, fp): both halves of each fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    parts = F.array(*(F.struct(F.lit(k).alias("seg"), half.alias("half")) for k, half in enumerate((low, high))))
    return prints.select("fp", F.explode(parts).alias("h")).select("h.*", "fp")


def masks(bits: int) -> list[int]:
    """All ways to leave out 1 to `bits` of the bits of a half."""
    return [sum(1 << b for b in c) for n in range(1, bits + 1) for c in combinations(range(32), n)]


def links(spark: SparkSession, prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that link within LIMIT bits."""
    key = ["seg", "wild", "rest"]
    index = entries(halves(prints))
    # An entry holds the fingerprints of two halves at most, so only large halves make large entries.
    large = halves(prints).groupBy("seg", "half").count().where(F.col("count") > heavy // 2).drop("count")
    crowded, path = stored(spark, entries(large).select(*key).distinct(), "crowded")
    any_crowded = not crowded.isEmpty()
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT
    left, right = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    if any_crowded:
        left = left.join(crowded, key, "left_anti")
        right = right.join(crowded, key, "left_anti")
    whole = F.col("wild") < 0
    # Of a whole half all pairs meet once; of a variant only those whose left-out bits differ.
    left = left.where(whole | (F.col("side") == 0)).drop("side")
    right = right.where(whole | (F.col("side") == 1)).drop("side")
    # An index is far larger than the table it is made of, whose size Spark knows: it must not be broadcast.
    pairs = left.join(right.hint("merge"), key).where((~whole | (F.col("a") < F.col("b"))) & within).select("a", "b")
    if not any_crowded:
        drop(spark, path)
        return pairs
    dense = index.join(crowded, key)
    other = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    sets = F.when(F.col("wild") < 0, F.array(*map(F.lit, masks(LIMIT)))).otherwise(F.array(*map(F.lit, masks(LIMIT - 1))))
    keyed = dense.select(*key, "fp", other.alias("other"), F.explode(sets).alias("mask"))
    keyed = keyed.withColumn("left", F.col("other").bitwiseAND(F.bitwise_not("mask")))
    group = [*key, "mask", "left"]
    stars = keyed.groupBy(*group).agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    return pairs.union(keyed.join(stars, group).where("fp <> a").select("a", F.col("fp").alias("b")))


def near_duplicates(spark: SparkSession, docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any
    other. Rows that repeat a doc_id are kept, each with its own fingerprint; a component's
    id is the smallest doc_id in it, null only if all are null. An empty table gives no rows.
    """
    prints, _ = stored(spark, docs.select("doc_id", simhash("text").alias("fp")), "simhash")
    distinct, path = stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(spark, links(spark, distinct.select("fp"), heavy))
    labelled = distinct.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes, _ = stored(spark, labelled.join(first, "label").select("fp", "component_id"), "classes")
    drop(spark, path)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Edges as in `near_duplicates`."""
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
