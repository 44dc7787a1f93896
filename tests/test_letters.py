"""Counts of letters, words and runs by arrays against plain Python and the column functions, also on odd texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmentry.functions import letters as L
from segmentry.functions import sequence as S
from segmentry.operators import classes as C
from segmentry.operators import kmers as K
from segmentry.operators import raw as R

ODD = [None, "", "A", "acgt", "NNNNN", "ACGTéACGTACG", "日本ACGTN", "ATATATATAA", "TATATATATAT" + "AATATATATATG", "AAAAAAAAGGGG", "CGCGCGCGN" + "GCGCGCGC"]


def some():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for alphabet in ("ACGT", "AT", "CGN", "ACacgt") for _ in range(30)]


def words(s, k):
    s = (s or "").upper()
    return [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def test_words_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(L, "LETTERS", 50)
    texts = some()
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").repartition(3)
    for k in (1, 3, 5):
        got = {(r["id"], r["kmer"]): (r["n"], r["freq"]) for r in K.frequencies(frame, ["id"], "seq", k).collect()}
        want = {(i, w): (n, n / len(words(s, k))) for i, s in enumerate(texts) for w, n in Counter(words(s, k)).items()}
        assert got == want
    every = Counter(w for s in texts for w in words(s, 3))
    assert {r["kmer"]: r["n"] for r in K.totals(frame, [], "seq", 3).collect()} == every
    assert {r["id"] for r in K.entropies(frame, ["id"], "seq", 3).collect()} == {i for i, s in enumerate(texts) if words(s, 3)}
    got = {(r["id"], r["slice"], r["kmer"]): r["n"] for r in K.positional(frame, ["id"], "seq", 2, 4).collect()}
    cut = lambda s, j: s[j * (len(s) // 4) : (j + 1) * (len(s) // 4) if j < 3 else None]
    assert got == {(i, j, w): n for i, s in enumerate(texts) for j in range(4) for w, n in Counter(words(cut(s or "", j), 2)).items()}


def test_measures_equal_the_column_functions(spark):
    s, m = F.col("seq"), F.col("m")
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(some()) if t is not None], "id long, seq string")
    out = frame.select("seq", L.measures(s).alias("m"), S.longest_run(s).alias("longest"), F.aggregate(F.filter(S.run_lengths(s), lambda n: n >= 3), F.lit(0), lambda n, x: n + x).alias("in_runs"), S.repeats_of_pairs(s).alias("pairs"), S.occurrences(s, "CG").alias("cg"))
    for r in out.collect():
        got, text = r["m"], r["seq"]
        assert (got["n"], got["a"], got["c"], got["g"], got["t"]) == (len(text), *(text.count(b) for b in "ACGT"))
        assert (got["longest"], got["in_runs"], got["cg"]) == (r["longest"], r["in_runs"], r["cg"]), text
        assert min(1.0, got["in_pairs"] / len(text) if text else 0.0) == r["pairs"], text


def test_blocks_hold_the_sparse_vectors(spark):
    texts = some()
    frame = spark.createDataFrame(list(enumerate(texts)), "seq_key long, seq string").coalesce(2)
    sparse = {r["seq_key"]: r["x"] for r in frame.select("seq_key", R.sparse(F.col("seq")).alias("x")).collect()}
    assert sparse[0] is None and sparse[1] == []
    seen = 0
    for batch in R.blocks(frame, "seq").toArrow().to_batches():
        for i in range(batch.num_rows):
            for key, row in zip(*R.block_rows(batch.slice(i, 1))):
                assert {j: row[j] for j in np.flatnonzero(row)} == {e["i"]: e["v"] for e in sparse[key] or []}
                seen += 1
    assert seen == len(texts)


def test_blocks_hold_a_few_bytes_an_entry_and_are_read_a_few_at_once(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    from segmentry.operators import ranges

    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq_key long, seq string").coalesce(1)
    sizes, i, v = R.entries(pa.array(texts))
    held = [bytes(r["block"]) for r in R.blocks(frame, "seq").collect()]
    assert sum(map(len, held)) < 4 * len(i) + 4000 * len(held)
    monkeypatch.setattr(ranges, "scratch", lambda _, name: str(tmp_path / name))
    ranges.stored(spark.range(48).coalesce(1).select(F.expr("cast(repeat(uuid(), 28000) as binary)").alias("block")), "large", "uncompressed", large=True)
    (file,) = glob.glob(str(tmp_path / "large" / "*.parquet"))
    told = pq.ParquetFile(file).metadata
    assert told.num_rows == 48 and max(told.row_group(g).num_rows for g in range(told.num_row_groups)) <= 16


def test_silhouettes_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    h = rng.normal(size=(90, 4)) + 1000
    h[:12] = h[0]
    label = np.arange(90) % 4
    label[:6] = 0
    label[89] = 9
    got = {r["row_key"]: r["s"] for r in C.silhouettes(spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, h))], "row_key long, class_id int, h array<double>")).collect()}
    x = np.sqrt(((h[:, None] - h[None]) ** 2).sum(axis=2))
    for i in range(90):
        own = (label == label[i]) & (np.arange(90) != i)
        a, b = x[i, own].mean() if own.any() else None, min(x[i, label == c].mean() for c in set(label) - {label[i]})
        want = 0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b)
        assert abs(got[i] - want) < 1e-9
    assert C.silhouettes(spark.createDataFrame([(1, 1, [1.0])], "row_key long, class_id int, h array<double>")).count() == 0


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_report_of_embeddings_counts_every_row(spark, tmp_path, monkeypatch, part):
    from segmentry.plans import analysis

    monkeypatch.setattr(analysis, "PER", 3)
    monkeypatch.setattr(C, "PART", part, raising=False)
    rng = np.random.default_rng(4)
    h = rng.normal(size=(60, 64)).astype(np.float32)
    label = np.arange(60) % 3
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(h, label))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["method"]: r for r in analysis.embedding_report(spark, str(tmp_path)).collect()}
    for method, x in (("raw", h.astype(float)), ("pooled", h.astype(float).reshape(60, 16, 4).mean(axis=2))):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        s = []
        for i in range(60):
            own = (label == label[i]) & (np.arange(60) != i)
            a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in range(3) if c != label[i])
            s.append((b - a) / max(a, b))
        centre = np.stack([x[label == c].mean(axis=0) for c in range(3)])
        assert abs(got[method]["silhouette"] - np.mean(s)) < 2e-6
        assert abs(got[method]["spread"] - np.sqrt(((x - centre[label]) ** 2).sum(axis=1)).mean()) < 2e-6
        assert abs(got[method]["nearest_centroids"] - min(np.sqrt(((centre[a] - centre[b]) ** 2).sum()) for a in range(3) for b in range(a))) < 2e-6


def test_silhouettes_leave_out_equal_keys_and_keep_vectors_without_a_distance(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 3, raising=False)
    rows = [(1, 0, [0.0, 0.0]), (1, 0, [0.0, 0.0]), (2, 0, [3.0, 4.0]), (3, 1, [6.0, 8.0]), (4, None, [0.0, 1.0]), (5, 1, [None, 1.0]), (6, 1, None)]
    got = {}
    for r in C.silhouettes(spark.createDataFrame(rows, "row_key long, class_id int, h array<double>")).collect():
        got.setdefault(r["row_key"], set()).add(round(r["s"], 9))
    assert got == {1: {0.5}, 2: {0.0}, 3: {0.0}, 4: {0.0}, 5: {0.0}}


def test_no_texts():
    assert len(L.measured(pa.array([], pa.string()))) == 0


def test_responses_by_tables_equal_the_products():
    from segmentry.operators import motifs as M
    from segmentry.plans.motifs import filters

    texts = [t for t in some() if t is not None]
    assert np.allclose(M.looked_up(texts, filters(), 40), M.responses(M.one_hot(texts, 40), filters()).transpose(1, 0, 2), atol=1e-12)


def test_encoding_equals_the_column_function(spark):
    from segmentry.operators import encoding as E

    texts = [t for t in some() if t is None or t.isascii()]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    want = {r["id"]: r["x"] for r in frame.select("id", S.one_hot(F.col("seq"), 20).alias("x")).collect()}
    got = {(r["id"], r["pos"], r["channel"]): r["v"] for r in E.long_rows(frame, "id", "seq", 20).collect()}
    assert got == {(i, p, c): x[p][c] for i, x in want.items() if x for p in range(20) for c in range(4)} | {(i, None, None): None for i, x in want.items() if x is None}
    for r in E.channel_sums(frame, "id", "seq", 20, reverse=True).collect():
        x = want[r["id"]]
        column = [row[3 - r["channel"]] for row in x[::-1]] if x else None
        assert (r["total"], r["placed"]) == ((sum(column), sum(v * (p + 1) for p, v in enumerate(column))) if x else (None, None))


def test_long_rows_leave_python_as_a_byte_a_place(spark):
    from segmentry.operators import encoding as E

    texts = some()
    out = E.long_rows(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), "id", "seq", 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Generate ") == 2
    assert out.schema.simpleString() == "struct<id:bigint,pos:int,channel:int,v:double>"
    want = Counter()
    for i, t in enumerate(texts):
        for p in range(7 if t is not None else 0):
            b = (t.upper() if t.isascii() else t)[p : p + 1]
            want.update((i, p, c, 0.25 if b not in "ACGT" or not b else float(b == "ACGT"[c])) for c in range(4))
        if t is None:
            want[i, None, None, None] += 1
    assert Counter(tuple(r) for r in out.collect()) == want


def test_stable_features_equal_the_column_functions(spark):
    s = F.col("seq")
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(some())], "id long, seq string")
    old = (S.gc_fraction(s), 1 - S.gc_fraction(s), S.cpg_ratio(s), S.cpg_frequency(s), S.repeats_of_pairs(s), S.entropy_of_known(s))
    u = F.upper(s)
    fine = F.array(S.gc_of_known(u), S.cpg_of_pairs(u), S.entropy_of_known(u), S.longest_run(u).cast("double"), S.repeats_in_runs(u))
    was = F.when(S.known(u) > 0, fine).otherwise(F.array(*map(F.lit, (0.5, 1.0, 2.0, 1.0, 0.0))))
    for r in frame.select("seq", F.array(*S.stable_features(s)).alias("a"), F.array(*old).alias("b"), S.engineered(s).alias("c"), was.alias("d")).collect():
        assert np.allclose(r["a"], r["b"], atol=1e-12) and np.allclose(r["c"], r["d"], atol=1e-12), r["seq"]


def test_a_large_table_is_dealt_into_more_tasks(spark, monkeypatch):
    from segmentry import fixtures

    monkeypatch.setattr(fixtures, "SPREAD", 100)
    assert fixtures.spread(spark.range(2000).coalesce(6), "id").rdd.getNumPartitions() == 20


def test_plans_of_many_units_are_held_in_parts(spark, monkeypatch):
    from segmentry.operators import neighbours as N

    rng = np.random.default_rng(2)
    h = rng.normal(size=(300, 5))
    frame = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(h)], "row_key long, class_id int, h array<double>")
    monkeypatch.setattr(N, "CELLS", 64)
    near, _ = N.nearest(frame.where("row_key < 40"), frame.where("row_key >= 40"), 4)
    got = {(r["row_key"], r["rank"]): r["other"] for r in near.collect()}
    x = np.sqrt(((h[:40, None] - h[None, 40:]) ** 2).sum(axis=2))
    assert got == {(i, k + 1): int(j) + 40 for i in range(40) for k, j in enumerate(np.argsort(x[i], kind="stable")[:4])}
