"""Feature store, aligned line files and class enrichment against plain Python."""

import math
import random
import shutil
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from segmentry.operators import motifs as M
from segmentry.sources import tables as B


def test_features_come_back_by_vocabulary(spark, tmp_path):
    rng = random.Random(1)
    data = {k: {i: rng.random() - 0.5 for i in rng.sample(range(40), rng.randint(0, 12))} for k in range(60)}
    rows = [(k, [(i, v) for i, v in x.items()] if k % 9 else None) for k, x in data.items()]
    frame = spark.createDataFrame(rows, "id long, x array<struct<i: int, v: double>>").repartition(4)
    names = spark.createDataFrame([(i, f"{'ab'[i % 2]}{i}") for i in range(40)], "i int, name string")
    at = str(tmp_path / "f")
    B.write_features(frame, names, at, "id", block=8)
    kept = {k: x if k % 9 else {} for k, x in data.items()}
    for chosen, keep in ((None, lambda i: True), ("name like 'a%'", lambda i: i % 2 == 0), (F.col("i") < 8, lambda i: i < 8), ("false", lambda i: False)):
        got = {r["id"]: [(e["i"], e["v"]) for e in r["x"]] for r in B.read_features(spark, at, "id", chosen).collect()}
        assert got == {k: sorted((i, v) for i, v in x.items() if keep(i)) for k, x in kept.items()}
    plan = B.read_features(spark, at, "id", "i < 8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "block#" in plan.split("PartitionFilters: [")[-1]
    for r in B.read_vocabulary(spark, at).collect():
        vs = [x[r["i"]] for x in kept.values() if r["i"] in x]
        assert (r["n"], r["block"]) == (len(vs), r["i"] // 8) and r["total"] == pytest.approx(sum(vs)) and r["squares"] == pytest.approx(sum(v * v for v in vs))
        assert (r["least"], r["most"]) == ((min(vs), max(vs)) if vs else (None, None))


def test_features_without_entries_or_rows(spark, tmp_path):
    names = spark.createDataFrame([(0, "a")], "i int, name string")
    for k, rows in enumerate(([(1, None), (2, [])], [])):
        B.write_features(spark.createDataFrame(rows, "id long, x array<struct<i: int, v: double>>"), names, str(tmp_path / str(k)), "id")
        assert [(r["id"], r["x"]) for r in B.read_features(spark, str(tmp_path / str(k)), "id").orderBy("id").collect()] == [(i, []) for i, _ in rows]


def test_aligned_files(spark, tmp_path):
    rows = [(i, "" if i % 7 == 0 else f"line {i}", None if i % 11 == 0 else i * 3) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, a string, b long").repartition(5)
    at = str(tmp_path / "t")
    B.write_aligned(frame, at, "id", {"a": F.col("a"), "b": F.col("b")}, parts=9)
    got = [tuple(r) for r in B.read_aligned(spark, at, ["a", "b"]).orderBy("row_id").collect()]
    assert got == [(i, a, "" if b is None else str(b)) for i, a, b in rows]
    assert spark.read.text(f"{at}/a").select("part").distinct().count() == 9
    shutil.rmtree(f"{at}/b/part=000003")
    with pytest.raises(ValueError, match="manifest"):
        B.read_aligned(spark, at, ["a", "b"])
    B.write_aligned(frame.limit(0), str(tmp_path / "none"), "id", {"a": F.col("a")})
    assert B.read_aligned(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_aligned_files_are_read_with_one_shuffle_of_each_column(spark, tmp_path):
    rows = [(i // 2, f"a{i}", f"b{i}" * 9, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, a string, b string, c long").repartition(5)
    at = str(tmp_path / "t")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # Files of many splits, also those that the lines are written from.
        for k, v in zip(kept, ("1500", "0", "-1")):
            spark.conf.set(k, v)
        B.write_aligned(frame, at, "id", {c: F.col(c) for c in "abc"}, parts=4)
        back = B.read_aligned(spark, at, ["a", "b", "c"])
        assert back._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 3
        got = [tuple(r) for r in back.orderBy("row_id").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # Rows of one place in the order stay together, whichever comes first.
    assert [r[0] for r in got] == list(range(3000))
    assert all(a[1:] == c and b == f"b{c}" * 9 and int(c) // 2 == i // 2 for i, a, b, c in got)


def tail(n, m, k, total):
    return sum(Fraction(math.comb(k, x) * math.comb(total - k, m - x), math.comb(total, m)) for x in range(n, min(m, k) + 1))


def test_planted_classes_are_found(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(6)) for i in range(600)]
    # Filter 0 has windows of class 2 above all, filter 1 of any; a sequence may hold several.
    windows = [(0, i, c) for i, c in rows if rng.random() < (0.5 if c == 2 else 0.05)]
    windows += [(1, i, c) for i, c in rows if rng.random() < 0.15]
    windows += rng.sample(windows, 30)
    got = {(r["f"], r["label"]): r for r in M.enrichment(spark.createDataFrame(windows, "f int, seq_key long, label int"), spark.createDataFrame(rows, "seq_key long, label int"), 1.0).collect()}
    tests = []
    for f in (0, 1):
        held = {(i, c) for g, i, c in windows if g == f}
        for c in range(6):
            n, k = sum(x == c for _, x in held), sum(x == c for _, x in rows)
            tests.append((float(tail(n, len(held), k, 600)), f, c, n, len(held), k))
    tests.sort()
    q, least = {}, 1.0
    for rank in range(len(tests), 0, -1):
        least = min(least, tests[rank - 1][0] * len(tests) / rank)
        q[tests[rank - 1][1:3]] = least
    assert len(got) == 12
    for p, f, c, n, m, k in tests:
        r = got[f, c]
        assert (r["n"], r["m"], r["k"], r["total"]) == (n, m, k, 600)
        assert r["log10_p"] == pytest.approx(math.log10(p), abs=1e-8) and r["q"] == pytest.approx(q[f, c], rel=1e-6)
    found = M.enrichment(spark.createDataFrame(windows, "f int, seq_key long, label int"), spark.createDataFrame(rows, "seq_key long, label int")).collect()
    assert [(r["f"], r["label"]) for r in found] == [(0, 2)]


def test_no_windows(spark):
    rows = spark.createDataFrame([(1, 1)], "seq_key long, label int")
    assert M.enrichment(spark.createDataFrame([], "f int, seq_key long, label int"), rows).count() == 0
