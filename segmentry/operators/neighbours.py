"""Exact nearest neighbours by metric partitioning.

Known rows are dealt into balls around pivots and each ball into rings by the distance to its
pivot, so a unit is a few thousand rows with a least and a greatest distance. By the triangle
inequality no row of a unit is nearer to a query than the query's distance to the pivot lies
outside those, and none is farther than their sum. A query first meets the units that must
hold k rows within the smallest bound; the k-th distance found there is its radius, and the
second round visits only units that can hold a row within it. In a unit, a row is compared
only if its own distance to the pivot lies within the radius of the query's. All is exact:
what is left out is so by its bound.

In the first round a query and its few units meet by a shuffle. In the second, where units may
be most of all, packed blocks of queries and of units meet (`tiles`), a task judges by the same
bounds which units a query visits, and only its k nearest of a part of the rows leave the task.

What is sent to all tasks is bounded: the pivots, and five numbers for each unit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from . import ranges as R
from . import tiles as T
from .sampling import overall

#: Pivots for each root of the number of known rows, most pivots, and most bytes of them.
PER_ROOT, MOST_PIVOTS, PIVOT_BYTES = 3, 4096, 1 << 25
#: Rows of a unit, about; rings of a ball at most. Larger rings are split by a hash.
UNIT, RINGS = 2048, 64
#: Queries that meet a unit in one task; queries and known rows of a part of the second round, at most.
QUERIES, QUERY_PART, PART = 1024, 1 << 14, 1 << 17
#: Distances of queries to pivots or units that a task holds at once.
CELLS = 1 << 18
#: Slack for rounding, as a share of the distances: bounds are kept wide of it.
SLACK = 1e-9
#: Error of a squared distance by products, as a share of the squared lengths, at most.
ERROR = 1e-11


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, by differences, a few rows of a at a time."""
    step = max(1, (1 << 22) // max(1, b.size))
    parts = [np.sqrt(((a[i : i + step, None] - b[None]) ** 2).sum(axis=2)) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)))


def matrix(h: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in h]) if len(h) else np.zeros((0, width))


def nearest_pivot(pivots: np.ndarray):
    step = max(1, CELLS // len(pivots))

    def near(h: pd.Series) -> pd.DataFrame:
        ats, ds = [np.zeros(0, dtype="int32")], [np.zeros(0)]
        for i in range(0, len(h), step):
            d = lengths(matrix(h.iloc[i : i + step], pivots.shape[1]), pivots)
            at = d.argmin(axis=1)
            ats.append(at.astype("int32"))
            ds.append(d[np.arange(len(d)), at])
        return pd.DataFrame({"pivot": np.concatenate(ats), "d": np.concatenate(ds)})

    near.__annotations__ = {"h": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(near, "pivot int, d double")


@dataclass(frozen=True)
class Units:
    """Pivot, ring, rows, and least and greatest distance to the pivot of each unit."""

    pivots: np.ndarray
    pivot: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def codes(self) -> np.ndarray:
        """Numbers of the units by pivot and ring, which rise as units are in that order."""
        return self.pivot.astype(np.int64) * RINGS + self.ring

    def bounds(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the distances of queries to the pivots of all units, the least and greatest distance that a row of each can have."""
        slack = SLACK * (1 + d + self.high)
        return np.maximum(0, np.maximum(d - self.high, self.low - d)) - slack, d + self.high + slack


def placed(known: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Known rows (other, class_id, g, d, pivot, ring, salt) and the units (pivot, ring, n, low, high, salts)."""
    near = known.withColumn("p", nearest_pivot(pivots)("g")).select("other", "class_id", "g", "p.pivot", "p.d")
    near = R.stored(near, "near")
    steps = [i / RINGS for i in range(1, RINGS)]
    balls = near.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("d", steps, 10_000).alias("cuts"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / UNIT)).cast("int")
    # Of the cuts, those that part the ball into so many rings.
    chosen = F.transform(F.sequence(F.lit(1), F.greatest(rings - 1, F.lit(1))), lambda i: F.get("cuts", F.floor(i * RINGS / rings).cast("int") - 1))
    balls = R.stored(balls.select("pivot", F.when(rings > 1, chosen).otherwise(F.array().cast("array<double>")).alias("cuts")), "balls")
    ringed = near.join(F.broadcast(balls), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
    units = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    units = R.stored(units.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("n") / UNIT)).cast("int")), "units")
    salted = ringed.join(F.broadcast(units.select("pivot", "ring", "salts")), ["pivot", "ring"])
    return salted.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int")).drop("salts"), units


def planned(u: Units, h: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Of each query the distances to the pivots of all units, the units of the smallest upper bounds that together hold k rows, and the largest of these bounds."""
    away = lengths(h, u.pivots)[:, u.pivot]
    _, high = u.bounds(away)
    first, reach = [], []
    for i, by in enumerate(np.argsort(high, axis=1, kind="stable")):
        held = np.cumsum(u.n[by])
        first.append(by[: int(np.searchsorted(held, k)) + 1])
        reach.append(float(high[i, first[-1][-1]]) if held[-1] >= k else math.inf)
    return away, first, reach


def pieces(u: Units, n: int) -> list[slice]:
    """Queries planned at once: with many units a task plans few, so that what it holds grows with neither."""
    step = max(1, CELLS // max(1, len(u.n)))
    return [slice(i, i + step) for i in range(0, n, step)]


def visits(queries: DataFrame, told, k: int) -> DataFrame:
    """(row_key, h, most, away, pivot, ring): the units that a query meets first, the distance up to which rows count, and that to the pivot."""
    dims = told.value.pivots.shape[1]

    def plan(batches):
        u = told.value
        for batch in (b.iloc[i] for b in batches for i in pieces(u, len(b))):
            away, first, reach = planned(u, matrix(batch["h"], dims), k)
            rows, units = np.repeat(np.arange(len(first)), [len(f) for f in first]), np.concatenate(first)
            yield pd.DataFrame({"row_key": batch["row_key"].to_numpy()[rows], "h": batch["h"].iloc[rows].to_numpy(), "most": np.array(reach)[rows], "away": away[rows, units], "pivot": u.pivot[units].astype("int32"), "ring": u.ring[units].astype("int32")})

    kind, vector = dict(queries.dtypes)["row_key"], dict(queries.dtypes)["h"]
    return queries.mapInPandas(plan, f"row_key {kind}, h {vector}, most double, away double, pivot int, ring int")


def compared(k: int, dims: int):
    """A block of queries and a unit to the k nearest of each query within its reach, and one row that counts the pairs compared."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["row_key", "other", "class_id", "x", "pairs"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        q, r, most = matrix(left["h"], dims), matrix(right["g"], dims), left["most"].to_numpy()
        away, d = left["away"].to_numpy(), right["d"].to_numpy()
        reach = most + SLACK * (1 + away)
        at, near = np.nonzero(np.abs(away[:, None] - d[None]) <= reach[:, None] + SLACK * d[None])
        step = max(1, (1 << 22) // dims)
        x = np.concatenate([np.zeros(0), *(np.sqrt(((q[at[i : i + step]] - r[near[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(at), step))])
        n, on = len(at), x <= most[at]
        at, near, x = at[on], near[on], x[on]
        other = right["other"].to_numpy()
        order = np.lexsort((other[near], x, at))
        first = np.searchsorted(at[order], np.arange(len(left)))
        order = order[np.arange(len(order)) - first[at[order]] < k]
        # The count comes last, under the first query's key and the first row's.
        at, near, x = np.append(at[order], 0), np.append(near[order], 0), np.append(x[order], -1.0)
        pairs = np.append(np.zeros(len(order), dtype=np.int64), n)
        return pd.DataFrame({"row_key": left["row_key"].to_numpy()[at], "other": other[near], "class_id": right["class_id"].to_numpy()[near], "x": x, "pairs": pairs})

    return meet


def met(where: DataFrame, known: DataFrame, k: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (row_key, other, class_id, x) of all visits, and counts (pairs). A unit with many queries meets them in blocks."""
    counts = where.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    unit = ["pivot", "ring", "salt", "block"]
    salts = known.select("pivot", "ring", "salt").distinct()
    left = where.join(F.broadcast(counts), ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("row_key"), F.col("blocks")).cast("int")).join(F.broadcast(salts), ["pivot", "ring"])
    right = known.join(F.broadcast(counts), ["pivot", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kinds = dict(known.dtypes) | dict(where.dtypes)
    # Columns of its own, as both sides come from the same tables.
    left = left.select("row_key", "h", "most", "away", *(F.col(c).alias(f"q_{c}") for c in unit))
    right = right.select("other", "class_id", "g", "d", *unit)
    both = left.groupBy(*(f"q_{c}" for c in unit)).cogroup(right.groupBy(*unit))
    out = both.applyInPandas(compared(k, dims), f"row_key {kinds['row_key']}, other {kinds['other']}, class_id {kinds['class_id']}, x double, pairs long")
    out = R.stored(out, "met")
    return out.where("x >= 0").drop("pairs"), out.where("x < 0").select("pairs")


def packed_units(known: DataFrame, told, parts: int) -> DataFrame:
    """Blocks (no, other, class_id, unit, n, d, g) of known rows in the order of units: keys and classes, the units with their numbers of rows, and all distances and vectors."""
    kinds = {f.name: f.dataType for f in known.schema}
    block = StructType().add("no", LongType()).add("other", ArrayType(kinds["other"])).add("class_id", ArrayType(kinds["class_id"]))
    for c in ("unit", "n", "d", "g"):
        block = block.add(c, BinaryType())

    def pack(batches):
        codes = told.value.codes()
        for no, part in T.parts(batches, "g"):
            unit = np.searchsorted(codes, part.column("pivot").to_numpy().astype(np.int64) * RINGS + part.column("ring").to_numpy())
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("other", "class_id")]
            numbers = unit[first], np.diff(np.append(first, len(unit))), part.column("d").to_numpy(), T.dense(part.column("g"))
            yield pa.RecordBatch.from_arrays([pa.array([no]), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in numbers)], block.fieldNames())

    dealt = known.select("other", "class_id", "d", "g", "pivot", "ring", "salt").repartitionByRange(parts, "pivot", "ring", "salt")
    return R.stored(dealt.sortWithinPartitions("pivot", "ring", "salt").mapInArrow(pack, block), "packed", large=True)


def packed_queries(queries: DataFrame, told, k: int, parts: int) -> DataFrame:
    """Blocks (no, row_key, most, unit, n, h) of queries: keys, distances up to which rows count, units met already with their number by query, and vectors."""
    block = StructType().add("no", LongType()).add("row_key", ArrayType(queries.schema["row_key"].dataType))
    for c in ("most", "unit", "n", "h"):
        block = block.add(c, BinaryType())

    def pack(batches):
        u = told.value
        for no, part in T.parts(batches, "h", QUERIES):
            h = T.dense(part.column("h"))
            first = [f for i in pieces(u, len(h)) for f in planned(u, h[i], k)[1]]
            keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("row_key"))
            numbers = part.column("most").to_numpy(), np.concatenate(first).astype(np.int64), np.array([len(f) for f in first], dtype=np.int64), h
            yield pa.RecordBatch.from_arrays([pa.array([no]), keys, *(pa.array([x.tobytes()], pa.binary()) for x in numbers)], block.fieldNames())

    # Blocks are dealt anew, as their tasks hold the queries of a part.
    return R.stored(queries.select("row_key", "h", "most").repartition(parts).mapInArrow(pack, block), "packed", large=True).repartition(parts)


class Known:
    """A block of known rows in a task."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda c: batch.column(f"k_{c}")[row]
        self.no, self.other, self.classes = cell("no").as_py(), cell("other").values, cell("class_id").values
        self.unit, self.n, self.d = (T.numbers(cell(c), kind) for c, kind in (("unit", np.int64), ("n", np.int64), ("d", np.float64)))
        self.g = T.numbers(cell("g")).reshape(len(self.d), -1)
        self.squares = np.einsum("ij,ij->i", self.g, self.g)


class Seekers:
    """A block of queries in a task, with the nearest rows found so far."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda c: batch.column(f"q_{c}")[row]
        self.keys, self.most = cell("row_key").values, T.numbers(cell("most"))
        self.h = T.numbers(cell("h")).reshape(len(self.keys), -1)
        self.squares = np.einsum("ij,ij->i", self.h, self.h)
        unit = T.numbers(cell("unit"), np.int64)
        by = np.argsort(unit, kind="stable")
        self.unit, self.met = unit[by], np.repeat(np.arange(len(self.keys)), T.numbers(cell("n"), np.int64))[by]
        self.bound, self.pairs = self.most.copy(), 0
        self.at, self.x, self.other, self.classes = np.zeros(0, dtype=np.int64), np.zeros(0), None, None

    def meet(self, u: Units, known: Known, k: int) -> None:
        pivots, of = np.unique(u.pivot[known.unit], return_inverse=True)
        away = lengths(self.h, u.pivots[pivots])
        ends = np.cumsum(known.n)
        ats, nears, xs = [], [], []
        for unit, a, begin, end in zip(known.unit, away.T[of], ends - known.n, ends):
            slack = SLACK * (1 + a + u.high[unit])
            visit = np.maximum(0, np.maximum(a - u.high[unit], u.low[unit] - a)) - slack <= self.most
            visit[self.met[np.searchsorted(self.unit, unit) : np.searchsorted(self.unit, unit, side="right")]] = False
            q = np.flatnonzero(visit)
            if not len(q):
                continue
            a, d, g = a[q, None], known.d[None, begin:end], known.g[begin:end]
            on = np.abs(a - d) <= self.most[q, None] + SLACK * (1 + a) + SLACK * d
            self.pairs += int(np.count_nonzero(on))
            # Products tell which pairs are surely too far; the others are compared by differences.
            lengths_ = self.squares[q, None] + known.squares[None, begin:end]
            on &= ~(lengths_ * (1 - ERROR) - 2 * (self.h[q] @ g.T) > self.bound[q, None] ** 2 * (1 + SLACK))
            if not on.any():
                continue
            at, near = np.nonzero(on)
            step = max(1, (1 << 20) // g.shape[1])
            x = np.concatenate([np.sqrt(((self.h[q[at[i : i + step]]] - g[near[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(at), step)])
            held = x <= self.bound[q[at]]
            ats.append(q[at[held]])
            nears.append(near[held] + begin)
            xs.append(x[held])
        if ats and sum(map(len, ats)):
            self.add(np.concatenate(ats), np.concatenate(xs), pa.array(np.concatenate(nears)), known, k)

    def add(self, at: np.ndarray, x: np.ndarray, near: pa.Array, known: Known, k: int) -> None:
        other, classes = known.other.take(near), known.classes.take(near)
        if self.other is not None:
            at, x = np.concatenate([self.at, at]), np.concatenate([self.x, x])
            other, classes = (pa.concat_arrays(c) for c in ((self.other, other), (self.classes, classes)))
        order = np.lexsort((other.to_numpy(zero_copy_only=False), x, at))
        first = np.searchsorted(at[order], np.arange(len(self.keys)))
        order = order[np.arange(len(order)) - first[at[order]] < k]
        self.at, self.x, self.other, self.classes = at[order], x[order], other.take(pa.array(order)), classes.take(pa.array(order))
        n = np.bincount(self.at, minlength=len(self.keys))
        last = np.cumsum(n) - 1
        full = n >= k
        self.bound[full] = np.minimum(self.most[full], self.x[last[full]])


def met_again(queries: DataFrame, units: DataFrame, told, k: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (row_key, other, class_id, x) of all later visits, the k nearest of each query and part of the known rows, and counts (pairs)."""
    kinds = {f.name: f.dataType.elementType for blocks in (queries, units) for f in blocks.schema if isinstance(f.dataType, ArrayType)}
    out = StructType()
    for c in ("row_key", "other", "class_id"):
        out = out.add(c, kinds[c])
    out = out.add("x", "double").add("pairs", LongType())

    def meet(batches):
        u, held, known = told.value, {}, None
        types = None
        for batch in batches:
            types = types or [batch.schema.field(c).type.value_type for c in ("q_row_key", "k_other", "k_class_id")]
            for row in range(batch.num_rows):
                if known is None or known.no != batch.column("k_no")[row].as_py():
                    known = Known(batch, row)
                no = batch.column("q_no")[row].as_py()
                if no not in held:
                    held[no] = Seekers(batch, row)
                held[no].meet(u, known, k)
        for q in held.values():
            if q.other is not None:
                yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(q.at)), q.other, q.classes, pa.array(q.x), pa.array(np.zeros(len(q.x), dtype=np.int64))], out.fieldNames())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([-1.0]), pa.array([q.pairs])], out.fieldNames())

    both = T.crossed(units.select(*(F.col(c).alias(f"k_{c}") for c in units.columns)), queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)), F.lit(True))
    found = R.stored(both.mapInArrow(meet, out), "met")
    return found.where("x >= 0").drop("pairs"), found.where("x < 0").select("pairs")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("row_key").orderBy("x", "other"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(queries: DataFrame, known: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(row_key, rank, other, class_id, x): the k known rows (row_key, class_id, h) nearest to each query (row_key, h), equal
    distances by key; and (queries, known, compared): how many pairs were compared of queries times known.

    Rows without a vector are left out; with fewer than k known rows all are listed; without
    any, or without queries, there are no rows. Keys are unique; vectors have one length.
    """
    spark = queries.sparkSession
    known = known.where("h is not null").select(F.col("row_key").alias("other"), "class_id", F.col("h").alias("g"))
    queries = queries.where("h is not null").select("row_key", "h")
    n = known.count()
    kinds = dict(known.dtypes) | dict(queries.dtypes)
    if not n:
        none = spark.createDataFrame([], f"row_key {kinds['row_key']}, rank int, other {kinds['other']}, class_id {kinds['class_id']}, x double")
        return none, queries.agg(F.count("*").alias("queries"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("compared"))
    dims = len(known.first()["g"])
    many = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * dims), math.ceil(PER_ROOT * math.sqrt(n))))
    pivots = np.array([r["g"] for r in overall(known, "other", many).select("g").collect()], dtype=np.float64)
    held, units = placed(known, pivots)
    # At most MOST_PIVOTS times RINGS rows.
    u = units.select("pivot", "ring", "n", "low", "high").toPandas().sort_values(["pivot", "ring"])
    told = spark.sparkContext.broadcast(Units(pivots, *(u[c].to_numpy() for c in ("pivot", "ring", "n", "low", "high"))))
    first_visits = R.stored(visits(queries, told, k), "visits")
    near, pairs = met(first_visits, held, k, dims)
    first = ranked(near, k).drop("rank")
    reach = first.groupBy("row_key").agg(F.when(F.count("*") == k, F.max("x")).otherwise(math.inf).alias("most"))
    left, cores = queries.join(reach, "row_key"), spark.sparkContext.defaultParallelism
    asked = queries.count()
    parts = max(-(-n // PART), min(cores, -(-n // T.ROWS)))
    asks = max(-(-asked // QUERY_PART), min(cores, -(-asked // 64)), 1)
    more, more_pairs = met_again(packed_queries(left, told, k, asks), packed_units(held, told, parts), told, k)
    seen = pairs.union(more_pairs).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))
    cost = seen.crossJoin(queries.agg(F.count("*").alias("queries"))).select("queries", F.lit(n).cast("long").alias("known"), "compared")
    return ranked(first.union(more), k).select("row_key", "rank", "other", "class_id", "x"), cost
