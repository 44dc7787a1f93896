"""Whole profiles against NumPy and their parts, and that they are one scan."""

import random
from itertools import product

import numpy as np

from segmentry.functions import sequence as S
from segmentry.operators import profiles as P
from pyspark.sql import functions as F


def some(n=120):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 2, 5]), "".join(rng.choice("ACGT" if i % 5 else "ACGTN") for _ in range(rng.randint(3, 90)))) for i in range(n)]
    return rows + [(n, 1, "NNNN"), (n + 1, 2, ""), (n + 2, 5, "A" * 50)]


def test_components_and_means_equal_numpy(spark):
    rows = some()
    frame = spark.createDataFrame(rows + [(900, None, "ACGT"), (901, 1, None)], "id long, label int, seq string").repartition(7)
    names, labels, means, places = P.label_profiles(frame)
    words = ["".join(w) for w in product("ACGT", repeat=P.WORD)]
    x = np.zeros((len(rows), len(words)))
    for r, (_, _, s) in enumerate(rows):
        found = [s[i : i + P.WORD] for i in range(len(s) - P.WORD + 1) if set(s[i : i + P.WORD]) <= set("ACGT")]
        for w in found:
            x[r, words.index(w)] += 1 / len(found)
    of = np.array([label for _, label, _ in rows])
    z = x - x.mean(axis=0)
    scale = z.std(axis=0)
    z = z / np.where(scale > 1e-12, scale, 1)
    values, right = np.linalg.eigh(z.T @ z / len(z))
    best = right[:, np.argsort(-values)[: P.COMPONENTS]]
    assert labels.tolist() == [1, 2, 5]
    for k, label in enumerate(labels):
        own = of == label
        assert np.allclose(np.abs(places[k]), np.abs((z[own] @ best).mean(axis=0)), atol=1e-8)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = np.nan_to_num(-x[own] * np.log2(x[own])).sum(axis=1).mean()
        assert means[k, names.index("n")] == own.sum() and np.isclose(means[k, names.index("h3")], h)


def test_no_rows(spark):
    _, labels, means, places = P.label_profiles(spark.createDataFrame([], "label int, seq string"))
    assert len(labels) == len(means) == len(places) == 0


def test_full_profile_equals_its_parts_in_one_scan(spark):
    s = F.col("seq")
    frame = spark.createDataFrame(some(), "id long, label int, seq string")
    out = frame.select("id", P.full_profile(s).alias("f"), S.gc_fraction(s).alias("gc"), S.cpg_ratio(s).alias("cpg"), S.repeats_by_patterns(s).alias("rep"), S.motif_count(s, "ETS").alias("ets"))
    for r in out.collect():
        f = r["f"]
        assert (f["gc_content"], f["cpg_ratio"], f["repeat_density"], f["motif_ETS"]) == (r["gc"], r["cpg"], r["rep"], r["ets"])
        assert f["cpg_freq"] == f["dinuc_CG"] and abs(sum(f[f"dinuc_{p}"] for p in P.PAIRS) - 1) < 1e-9 or not any(f[f"dinuc_{p}"] for p in P.PAIRS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    null = spark.createDataFrame([(1, None)], "id long, seq string").select(P.full_profile(s).alias("f")).first()["f"]
    assert null is None


def test_names_of_queries_are_unique():
    from segmentry.plans import analysis, corpus, features, formats, matching, motifs

    parts = [p.QUERIES for p in (corpus, features, formats, matching, analysis, motifs)]
    assert sum(map(len, parts)) == len(set().union(*parts))
