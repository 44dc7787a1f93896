"""Literal edge cases and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.functions import sequence as S
from segmentry.operators import evaluation as E
from segmentry.operators import intervals as I
from segmentry.operators import matching, motifs
from segmentry.operators import sampling as P
from segmentry.plans.motifs import filters
from segmentry.sources import text as T


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "NNNN"])
def test_engineered_defaults(spark, text):
    assert one(spark, text, S.engineered) == [0.5, 1.0, 2.0, 1.0, 0.0]


def test_occurrences_and_overlaps(spark):
    assert one(spark, "CGCGCG", lambda s: S.occurrences(s, "CG")) == 3
    assert one(spark, "CGCGCG", lambda s: S.motif_count(s, "CpG_dense")) == 1
    assert one(spark, "CGCGCG", lambda s: S.motif_rate(s, "CpG_dense")) == pytest.approx(2 / 0.03)


def test_runs(spark):
    assert one(spark, "AAATTNNNCG", S.run_lengths) == [3, 2, 1, 1]
    assert one(spark, "AAATTNNNCG", S.longest_run) == 3


def test_reverse_complement(spark):
    assert one(spark, "AACGT", S.reverse_complement) == "ACGTT"
    assert one(spark, "aNcG", S.reverse_complement_any) == "CgNt"


def test_low_complexity(spark):
    assert one(spark, "A" * 200, I.sequence_reason) == "low_complexity"
    assert one(spark, "N" + "ACGT" * 49 + "ACG", I.sequence_reason) == "contains_n"
    assert one(spark, None, I.sequence_reason) == "bad_sequence_length"


def test_unknown_chromosome_is_an_error(spark):
    with pytest.raises(Exception, match="unknown chromosome"):
        spark.createDataFrame([("chrZ",)], "c string").select(P.split_of(F.col("c"))).collect()


def automaton(bins):
    """The pending-row rule, written out: an overlap takes both rows away, or the pending one alone is gone already."""
    kept, pending, gone = [], None, False
    for s, e in sorted(bins):
        if pending is not None and s < pending[1]:
            if gone:
                pending, gone = (s, e), False
            else:
                pending, gone = (s, e), True
            continue
        if pending is not None and not gone:
            kept.append(pending)
        pending, gone = (s, e), False
    if pending is not None and not gone:
        kept.append(pending)
    return kept


@pytest.mark.parametrize("partitions", [1, 8])
def test_overlap_islands(spark, partitions):
    rng = random.Random(3)
    groups = {f"E{g:03d}": [(s := rng.randrange(0, 4000, 50), s + 200) for _ in range(rng.randint(1, 20))] for g in range(30)}
    groups = {g: sorted(set(b)) for g, b in groups.items()}
    rows = [(g, "chr1", s, e) for g, b in groups.items() for s, e in b]
    frame = spark.createDataFrame(rows, "eid string, chrom string, start int, end int").repartition(partitions)
    got = {}
    for r in I.without_overlaps(frame).collect():
        got.setdefault(r["eid"], []).append((r["start"], r["end"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: k for g, b in groups.items() if (k := automaton(b))}


def test_lift_over_bucket_edges(spark):
    edge = I.BUCKET
    blocks = spark.createDataFrame([("chr1", 0, 3 * edge, "chr2", 100, "+"), ("chr3", 0, 400, "chr3", 0, "-")], "chrom string, t_start long, t_end long, q_chrom string, q_start long, strand string")
    places = spark.createDataFrame([("chr1", edge - 100, edge + 100), ("chr3", 0, 200), ("chr3", 300, 500), ("chr9", 0, 200)], "chrom string, start long, end long")
    got = {(r["chrom"], r["start"]): (r["status"], r["q_start"]) for r in I.lifted(places, blocks).collect()}
    assert got == {("chr1", edge - 100): ("lifted", edge), ("chr3", 0): ("lifted", 200), ("chr3", 300): ("partial", 0), ("chr9", 0): ("deleted", None)}


def test_caps(spark):
    rows = spark.range(1000).select(F.lit("E001").alias("eid"), (F.col("id") % 3).cast("int").alias("state_int"), F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"), "id")
    got = {(r["split"], r["state_int"]): r["count"] for r in P.capped(rows, 50, 5, "id").groupBy("split", "state_int").count().collect()}
    assert all(n == 10 for (split, _), n in got.items() if split == "train") and sum(n for (split, _), n in got.items() if split == "val") == 500


def test_bin_edges(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.2,), (0.21,), (1.0,)], "c double").select(E.bin_of(F.col("c"), 5)).collect()]
    assert got == [1, 1, 2, 5]


def test_temperature_recovers_scale(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 4)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = [int(rng.choice(4, p=q)) for q in p]
    rows = [(i, y[i], k, float(3 * z[i, k])) for i in range(len(z)) for k in range(4)]
    t = E.fit_temperature(spark.createDataFrame(rows, "row_key long, class_id int, k int, logit double"))
    assert 2.7 < t < 3.3


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        cost = rng.normal(size=(n, n))
        got = matching.assign(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sorted(got) == list(range(n)) and cost[range(n), got].sum() == pytest.approx(best)


def test_mutations_equal_rescans(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    w = filters()
    rows = spark.createDataFrame([(1, 1, text)], "seq_key long, label int, seq string")
    total = lambda t: motifs.responses(motifs.one_hot([t], 200), w).sum()
    got = motifs.mutations(rows, w).collect()
    assert len(got) == 800
    for r in rng.sample(got, 60):
        mutant = text[: r["pos"]] + r["base"] + text[r["pos"] + 1 :]
        assert r["delta"] == pytest.approx(total(mutant) - total(text), abs=1e-6)


def test_top_windows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, i % 5, "".join(rng.choice("ACGTN") for _ in range(200))) for i in range(40)]
    frame = spark.createDataFrame(rows, "seq_key long, label int, seq string").repartition(3)
    scores = np.round(motifs.responses(motifs.one_hot([r[2] for r in rows], 200), filters()), 9)
    got = {}
    for r in motifs.top_windows(frame, filters(), 7).orderBy("f", "rank").collect():
        got.setdefault(r["f"], []).append((r["seq_key"], r["pos"]))
    for f in range(8):
        best = sorted(((-scores[i, f, p], i, p) for i in range(40) for p in range(200)))[:7]
        assert got[f] == [(i, p) for _, i, p in best]


def test_segment_files(spark, tmp_path):
    (tmp_path / "E007_x.bed").write_text("chr1\t0\t200\t1_TssA\nbroken\n1\t200\t400\t5_Tx\nchr2\tx\t9\t5_Tx\n")
    (tmp_path / "E008_x.bed").write_text("")
    rows = T.read_segments(spark, str(tmp_path / "*.bed"))
    got = sorted(map(str, [(r["eid"], r["chrom"], r["start_pos"]) for r in rows.collect()]))
    assert got == sorted(map(str, [("E007", "chr1", 0), ("E007", None, None), ("E007", "1", 200), ("E007", "chr2", None)]))
    states = spark.createDataFrame([(1, "1_TssA"), (5, "5_Tx")], "state_int int, state_name string")
    reasons = {r["drop_reason"]: r["count"] for r in I.normalised(rows, states).groupBy("drop_reason").count().collect()}
    assert reasons == {None: 2, "malformed": 2}


def test_reference_and_metadata(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 first\nacgt\nACGT\n>chr2\nTTTT\n")
    got = {(r["chrom"], r["chunk"]): r["seq"] for r in T.read_reference(spark, str(tmp_path / "r.fa"), 4, 2).collect()}
    assert got == {("chr1", 0): "ACGTAC", ("chr1", 1): "ACGT", ("chr2", 0): "TTTT"}
    (tmp_path / "m.tsv").write_text("EID\t Epigenome name \tGROUP\nE001\tes\ta\nE002\tx\tb\n")
    assert [r["name"] for r in T.read_metadata(spark, str(tmp_path / "m.tsv"), ["E001"]).collect()] == ["es"]
    with pytest.raises(ValueError, match="E009"):
        T.read_metadata(spark, str(tmp_path / "m.tsv"), ["E001", "E009"])
