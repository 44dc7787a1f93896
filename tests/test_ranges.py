"""Work along an order in ranges, against plain Python, with one group in many tasks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators import intervals as I
from segmentry.operators import ranges as R
from segmentry.operators import sampling as P


def kept_of(bins):
    """Islands written out: rows that each start before the end of the one before; the last of an odd one stays."""
    out, island = [], []
    for b in [*sorted(bins), None]:
        if b is None or (island and not b[0] < island[-1][1]):
            out += [island[-1]] if len(island) % 2 else []
            island = []
        island.append(b)
    return out


def overlapping(rng, n, long_island):
    if long_island:
        return [(100 * i, 100 * i + 150) for i in range(n)]
    return [(s := rng.randrange(0, 60 * n), s + rng.choice([50, 200, 5000])) for _ in range(n)]


@pytest.mark.parametrize(("n", "parts", "long_island"), [(500, 12, False), (301, 9, True), (300, 16, True), (40, 30, False), (3, 8, False)])
def test_islands_cross_ranges(spark, n, parts, long_island):
    rng = random.Random(n)
    groups = {("E1", "chr1"): sorted(set(overlapping(rng, n, long_island))), ("E1", "chr2"): sorted(set(overlapping(rng, 20, False))), ("E2", None): [(5, 9)]}
    rows = [(*g, s, e, "x") for g, b in groups.items() for s, e in b]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "eid string, chrom string, start int, end int, more string").repartition(5)
    got = sorted(map(tuple, I.without_overlaps(frame, parts=parts).select("eid", "chrom", "start", "end").collect()), key=str)
    assert got == sorted(((*g, *b) for g, x in groups.items() for b in kept_of(x)), key=str)
    used = R.in_ranges(frame, ("eid", "chrom"), ("start", "end"), parts).where("chrom = 'chr1'").select(R.PART).distinct().count()
    assert used > 8 or n < 40


def test_violations_cross_ranges(spark):
    rng = random.Random(1)
    rows = [("E1", rng.choice(["chr1", "chr2", None]), rng.choice([*range(500), None]), i) for i in range(600)] + [("E2", "chr1", 5, 1000), ("E2", "chr1", 5, 1001), ("E2", "chr1", 4, 1002)]
    frame = spark.createDataFrame(rows, "eid string, chrom string, start_pos int, line long").repartition(4)
    low = lambda r: tuple((x is not None, x) for x in r[1:3])  # noqa: E731  nulls sort first in structs
    want = {e: sum(low(b) < low(a) for a, b in zip(x, x[1:])) for e in ("E1", "E2") for x in [[r for r in rows if r[0] == e]]}
    for parts in (1, 10):
        assert {r["eid"]: r["sort_order_violations"] for r in I.order_violations(frame, "line", parts).collect()} == want
    assert I.order_violations(frame.limit(0), "line").count() == 0


def drawn(key, seed=P.SEED):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key


def test_ranks_and_folds(spark, monkeypatch):
    rows = [(None if i % 11 == 0 else "abc"[min(2, i % 7)], i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "label string, id long").repartition(6)
    want = {}
    for label in {r[0] for r in rows}:
        for place, i in enumerate(sorted((i for g, i in rows if g == label), key=drawn), 1):
            want[i] = place
    for digits in (1, 4):
        monkeypatch.setattr(R, "DIGITS", digits)
        assert {r["id"]: r["place"] for r in R.ranked(frame, ("label",), P.draw("id"), "id", "place").collect()} == want
        for k in (1, 17, 100, 5000):
            got = sorted(r["id"] for r in R.first_by_draw(frame, ("label",), P.draw("id"), "id", k).collect())
            assert got == sorted(i for i, place in want.items() if place <= k)
    assert {r["id"]: r["fold"] for r in P.folds(frame, "label", "id").collect()} == {i: (p - 1) % 5 + 1 for i, p in want.items()}
    plan = P.folds(frame, "label", "id")._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan


@pytest.mark.parametrize(("cap", "sources"), [(60, 4), (60, 30), (3, 9), (10_000, 4)])
def test_fill_equals_windows(spark, cap, sources):
    rng = random.Random(cap)
    rows = [(rng.choice("aaaaaabc") + str(rng.randrange(3)), rng.randrange(3), i) for i in range(900)]
    each = max(1, cap // sources)
    want = []
    for state in range(3):
        place, listed = {}, []
        names = sorted({r[0] for r in rows if r[1] == state})
        held = {e: sorted((r[2] for r in rows if r[:2] == (e, state)), key=drawn) for e in names}
        for e in names:
            place |= {i: rank for rank, i in enumerate(held[e], 1)}
        for e in names:
            listed += [(rank > each, -len(held[e]) if rank > each else 0, e, rank, i) for rank, i in enumerate(held[e], 1)]
        want += [x[-1] for x in sorted(listed)[:cap]]
    frame = spark.createDataFrame(rows, "eid string, state_int int, id long").repartition(5)
    assert sorted(r["id"] for r in P.capped_with_fill(frame, cap, sources, "id").collect()) == sorted(want)


def test_a_cap_that_drops(spark):
    rows = spark.range(3000).select(F.concat(F.lit("E"), F.col("id") % 2).alias("eid"), F.lit(1).alias("state_int"), F.when(F.col("id") < 2500, "train").alias("split"), "id")
    got = P.capped(rows, 200, 2, "id")
    counts = {(r["eid"], r["split"]): r["count"] for r in got.groupBy("eid", "split").count().collect()}
    assert counts == {("E0", "train"): 100, ("E1", "train"): 100, ("E0", None): 250, ("E1", None): 250}
    first = sorted(range(0, 2500, 2), key=drawn)[:100]
    assert sorted(r["id"] for r in got.where("split = 'train' and eid = 'E0'").collect()) == sorted(first)
