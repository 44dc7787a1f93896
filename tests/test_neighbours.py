"""Exact neighbours by metric partitioning against all pairs."""

import numpy as np
import pytest

from segmentry.operators import neighbours as N


def frame(spark, keys, x, classes=None, parts=4):
    rows = [(int(i), int(c), None if v is None else [float(a) for a in v]) for i, c, v in zip(keys, classes if classes is not None else [0] * len(keys), x)]
    return spark.createDataFrame(rows, "row_key long, class_id int, h array<double>").repartition(parts)


def brute(q, r, k):
    out = {}
    for i, v in q:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in r)
        out[i] = [j for _, j in d[:k]]
    return out


def listed(near):
    out = {}
    for r in near.orderBy("row_key", "rank").collect():
        out.setdefault(r["row_key"], []).append(r["other"])
    return out


@pytest.mark.parametrize(("kind", "k"), [("clusters", 5), ("even", 7), ("one", 3), ("few", 50)])
def test_equals_all_pairs(spark, monkeypatch, kind, k):
    monkeypatch.setattr(N, "UNIT", 40)
    rng = np.random.default_rng(3)
    n = 20 if kind == "few" else 900
    if kind == "clusters":
        x = rng.normal(size=(30, 6))[rng.integers(0, 30, n)] * 20 + rng.normal(size=(n, 6))
    elif kind == "one":
        # Over a third of the rows are one point, and many lie at one distance of it.
        x = np.where(np.arange(n)[:, None] % 3 == 0, np.zeros((n, 4)), rng.integers(-2, 3, (n, 4)))
    else:
        x = rng.normal(size=(n, 8))
    keys = rng.permutation(n)
    q = [(int(i), v) for i, v in zip(keys, x) if i % 7 == 0]
    r = [(int(i), v) for i, v in zip(keys, x) if i % 7]
    queries, known = frame(spark, *zip(*q)), frame(spark, *zip(*r))
    near, cost = N.nearest(queries, known, k)
    assert listed(near) == brute(q, r, k)
    c = cost.first()
    assert (c["queries"], c["known"]) == (len(q), len(r)) and c["compared"] <= len(q) * len(r)
    if kind == "clusters":
        assert c["compared"] < 0.2 * len(q) * len(r)


def test_edges(spark):
    some = frame(spark, [1, 2, 3], [[0.0, 1.0], None, [2.0, 2.0]])
    assert listed(N.nearest(some, some, 2)[0]) == {1: [1, 3], 3: [3, 1]}
    assert N.nearest(some, some.limit(0), 2)[0].count() == 0
    assert N.nearest(some.limit(0), some, 2)[0].count() == 0
    assert N.nearest(some, some.limit(0), 2)[1].first()["compared"] == 0


def test_what_is_written_grows_with_queries_and_not_with_units(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT", 20)
    monkeypatch.setattr(N, "PART", 300, raising=False)
    written = []

    def stored(rows, name, *more, store=N.R.stored, **told):
        out = store(rows, name, *more, **told)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(N.R, "stored", stored)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 12))
    x[500:520] = x[3]
    queries, known = frame(spark, range(100), x[:100]), frame(spark, range(100, 1000), x[100:])
    near, cost = N.nearest(queries, known, 3)
    assert listed(near) == brute([(i, x[i]) for i in range(100)], [(i, x[i]) for i in range(100, 1000)], 3)
    # Nearly all units are visited, yet no row is written for a visit beyond the first.
    assert cost.first()["compared"] > 0.5 * 100 * 900
    assert sum(n for name, n in written if name == "visits") <= 100 * 3
    assert sum(n for name, n in written if name == "met") <= 100 * 3 * 3 + 100 * 3 * 4 + 100
