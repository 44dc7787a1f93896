"""Near-duplicate vectors through a pivot-permutation index.

Pivots are a bounded, seeded sample of the vectors, thinned so that no two are nearer than
`SEPARATION`: where vectors crowd, pivots do not, and near vectors keep the same ones. Every
vector is described by its `PREFIX` nearest pivots in order; an inverted list holds, for each
pivot, the vectors with it in their prefix. Two vectors are candidates if they share `SHARED`
pivots, and are compared once, in the list of the smallest pivot that they share. A list is
cut into blocks of a bounded number of vectors and tasks compare pairs of blocks, so a crowded
list is many tasks; they give numbers of links and edges that span them, never all pairs.

Lists hold vectors rounded to 16 bits. Where rounding could decide, the pair is verified on
the values themselves, in double precision; all other pairs come out the same either way.

Equal vectors are one class first: copies are counted, not compared. Vectors of one length
are an index of their own; a length of at most one block of vectors is one list.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop, stored, table

LIMIT = 0.95
PREFIX, SHARED = 8, 2
#: Pivots for the square root of the number of vectors; most pivots of all lengths, and most bytes of them; cosine of two at most.
PER_ROOT, MOST_PIVOTS, PIVOT_BYTES, SEPARATION = 8, 1 << 17, 1 << 26, 0.9
BLOCK = 1024
STEPS = 32767


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors of at least one component, all present and finite, and not all zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thinned(x: np.ndarray, most: int, separation: float = SEPARATION) -> np.ndarray:
    """Of unit rows in order, those not nearer than that to one kept before, up to `most`."""
    kept = np.zeros((0, x.shape[1]), dtype=np.float32)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK].astype(np.float32)
        part = part[(part @ kept.T).max(axis=1, initial=-1.0) < separation]
        near, take = part @ part.T >= separation, []
        for i in range(len(part)):
            if not near[i, take].any():
                take.append(i)
        kept = np.concatenate([kept, part[take]])[:most]
    return kept


def pivots_of(classes: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Pivots by length, for lengths of over a block of vectors while MOST_PIVOTS and PIVOT_BYTES last; the longest lists come first.

    Vectors of other lengths are in one list of their length, whose blocks are all compared.
    """
    widths = classes.groupBy(F.size("v").alias("width")).count().where(F.col("count") > BLOCK)
    wanted, left, room = {}, MOST_PIVOTS, PIVOT_BYTES
    for r in widths.orderBy(F.desc("count"), "width").limit(MOST_PIVOTS // (PER_ROOT * 32)).collect():
        n = min(left, int(PER_ROOT * math.sqrt(r["count"])), room // (4 * r["width"]))
        if n:
            wanted[r["width"]] = (n, min(1.0, 1.5 * n / r["count"]))
        left, room = left - n, room - 4 * n * r["width"]
    out = {}
    if wanted:
        parts = classes.sparkSession.createDataFrame([(w, p) for w, (_, p) in wanted.items()], "width int, part double")
        place = F.xxhash64(F.lit(seed), "v")
        drawn = F.shiftrightunsigned(place, 11).cast("double") / float(1 << 53) < F.col("part")
        sample = classes.withColumn("width", F.size("v")).join(F.broadcast(parts), "width").where(drawn).select("width", "v", place.alias("place"))
        # About one and a half times the pivots, as arrays.
        held = sample.toArrow().combine_chunks()
        for w, (n, _) in wanted.items():
            own = held.filter(pc.equal(held["width"], w)).sort_by("place")
            v = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w)
            if len(v):
                out[w] = thinned(unit(v), n)
    return out


def describe(pivots, prefix: int):
    """Batches of (rep, n, v) to (rep, n, width, q, scale, pivots): rounded unit vectors and their nearest pivots in order."""

    def described(batches):
        for batch in batches:
            by: dict[int, list[int]] = {}
            for i, v in enumerate(batch["v"]):
                by.setdefault(len(v), []).append(i)
            for width, rows in by.items():
                for at in range(0, len(rows), BLOCK):
                    some = rows[at : at + BLOCK]
                    x = unit(np.array([batch["v"].iloc[i] for i in some], dtype=np.float64))
                    order = np.zeros((len(some), 1), dtype=np.int32)
                    if width in pivots.value:
                        p = pivots.value[width]
                        k = min(prefix, len(p))
                        near = x.astype(np.float32) @ p.T
                        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                        order = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
                    scale = np.abs(x).max(axis=1) / STEPS
                    out = batch.iloc[some][["rep", "n"]].copy()
                    out["width"], out["q"] = width, [r.tobytes() for r in np.rint(x / scale[:, None]).astype("<i2")]
                    out["scale"], out["pivots"] = scale, list(order)
                    yield out

    return described


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes is connected to by edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(limit: float, shared: dict[int, int]):
    """Of a block pair in a pivot's list: links of each vector (b null), edges that span them (n 0), pairs to verify (n -1).

    shared has the pivots that candidates share, by the vectors' length; one where it has none.
    """

    def compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = (rows[rows["at"] == s] for s in (key[-2], key[-1]))
        out = [pd.DataFrame({"a": pd.array([], "int64"), "b": pd.array([], "Int64"), "n": pd.array([], "int64")})]
        if not len(one) or not len(two):
            return out[0]
        values = lambda side: np.stack([np.frombuffer(q, dtype="<i2") for q in side["q"]]).astype(np.float32) * side["scale"].to_numpy(dtype=np.float32)[:, None]
        near = values(one) @ values(two).T
        # A rounded component is off by half a step at most, and the other vector's components sum to the root of their number at most.
        off = (one["scale"].max() + two["scale"].max()) * math.sqrt(key[0]) / 2 * 1.01 + 1e-5
        i, j = np.nonzero(near >= limit - off)
        if key[-2] == key[-1]:
            i, j = i[i < j], j[i < j]
        pa, pb = np.stack(one["pivots"]), np.stack(two["pivots"])
        own = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 17):
            p, q = pa[i[at : at + (1 << 17)]], pb[j[at : at + (1 << 17)]]
            common = p[:, :, None] == q[:, None, :]
            least = np.where(common.any(axis=2), p, np.iinfo(np.int32).max).min(axis=1)
            own[at : at + (1 << 17)] = (common.sum(axis=(1, 2)) >= shared.get(key[0], 1)) & (least == key[1])
        i, j = i[own], j[own]
        sure = near[i, j] >= limit + off
        ra, rb, na, nb = one["rep"].to_numpy(), two["rep"].to_numpy(), one["n"].to_numpy(), two["n"].to_numpy()
        out.append(pd.DataFrame({"a": ra[i[~sure]], "b": rb[j[~sure]], "n": -1}))
        i, j = i[sure], j[sure]
        for r, more in ((ra, np.bincount(i, nb[j], len(ra))), (rb, np.bincount(j, na[i], len(rb)))):
            out.append(pd.DataFrame({"a": r[more > 0], "b": None, "n": more[more > 0]}))
        ids = ra if key[-2] == key[-1] else np.concatenate([ra, rb])
        label = labels_of(len(ids), i, j if key[-2] == key[-1] else j + len(ra))
        led = label != np.arange(len(ids))
        out.append(pd.DataFrame({"a": ids[label[led]], "b": ids[led], "n": 0}))
        return pd.concat([x.astype({"a": "int64", "b": "Int64", "n": "int64"}) for x in out if len(x)] or out[:1])

    return compared


def exact(limit: float):
    def linked(ones: pd.Series, twos: pd.Series) -> pd.Series:
        found = [float(np.dot(*unit(np.array([a, b], dtype=np.float64)))) >= limit for a, b in zip(ones, twos)]
        return pd.Series(found, dtype=bool)

    linked.__annotations__ = {"ones": pd.Series, "twos": pd.Series, "return": pd.Series}
    return F.pandas_udf(linked, T.BooleanType())


def near_duplicates(spark: SparkSession, vectors: DataFrame, limit: float = LIMIT, prefix: int = PREFIX, shared: int = SHARED, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as do vectors of different lengths with each other, however many lengths there
    are. Copies link with each other; rows that repeat an id count as vectors. A null id is
    kept, and names a component only if no other id is in it. An empty table gives no rows.
    """
    # Minus zero is zero.
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).alias("embedding"))
    good = usable(rows)
    classes = good.groupBy(F.col("embedding").alias("v")).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes, _ = stored(spark, classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    pivots = pivots_of(classes, seed)
    told = spark.sparkContext.broadcast(pivots)
    schema = "rep long, n long, width int, q binary, scale double, pivots array<int>"
    described, path = stored(spark, classes.select("rep", "n", "v").mapInPandas(describe(told, prefix), schema), "described")
    lists = described.select("width", F.explode("pivots").alias("pivot"))
    sizes = lists.groupBy("width", "pivot").count().where(F.col("count") > 1)
    sizes, sizes_path = stored(spark, sizes.select("width", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "sizes")
    entries = described.select("width", F.explode("pivots").alias("pivot"), "rep", "n", "q", "scale", "pivots").join(sizes, ["width", "pivot"])
    entries = entries.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("at")).alias("one"), F.greatest(o, F.col("at")).alias("two")))
    entries = entries.withColumn("pair", F.explode(pairs)).select("width", "pivot", "pair.one", "pair.two", "at", "rep", "n", "q", "scale", "pivots")
    counts = {w: min(shared, prefix, len(p)) for w, p in pivots.items()}
    found = entries.groupBy("width", "pivot", "one", "two").applyInPandas(compare(limit, counts), "a long, b long, n long")
    found, _ = stored(spark, found, "found")
    drop(spark, path, sizes_path)
    values = classes.select("rep", "v", F.col("n").alias("copies"))
    unsure = found.where("n < 0").select("a", "b").join(values.toDF("a", "va", "na"), "a").join(values.toDF("b", "vb", "nb"), "b")
    verified, _ = stored(spark, unsure.where(exact(limit)("va", "vb")).select("a", "b", "na", "nb"), "verified")
    each = found.where("b is null").select(F.col("a").alias("rep"), "n")
    each = each.union(verified.select("a", "nb")).union(verified.select("b", "na"))
    links = each.groupBy("rep").agg(F.sum("n").alias("others"))
    labels = components(spark, found.where("n = 0").select("a", "b").union(verified.select("a", "b")))
    named = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(links, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(first, "label").select(F.col("v").alias("embedding"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, "embedding", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Edges as in `near_duplicates`."""
    found = near_duplicates(spark, table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
with recursive e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from e),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.95),
r as (select vec_id as v, vec_id as label from embeddings union select p.b, r.label from r join p on p.a = r.v)
select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, (select min(label) from r where r.v = e.vec_id) as component_id,
  e.vec_id = (select min(label) from r where r.v = e.vec_id) as kept
from embeddings e
"""
