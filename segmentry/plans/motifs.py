"""Queries of the linear filters. The scan has no SQL: it is held against brute force on the small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import ctes, frame
from ..operators import motifs as M
from ..operators.ranges import stored
from ..operators.sampling import per_group

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOP, PER_CLASS = 500, 16


def filters() -> np.ndarray:
    """8 filters of 19 places and 4 letters, as the view `filters` has them."""
    f, off, b = np.meshgrid(np.arange(8), np.arange(M.WIDTH), np.arange(4), indexing="ij")
    return ((f * 31 + off * 7 + b * 13) % 11 - 5) / 5.0


def windows(spark, sf):
    """The scan's few rows, stored as they are read several times."""
    return stored(M.top_windows(frame(spark, sf, "sequences"), filters(), TOP), "windows")


def motif_windows(spark, sf):
    return windows(spark, sf).withColumn("score", F.round("score", 6))


def motif_matrices(spark, sf):
    return M.weight_matrices(windows(spark, sf)).withColumn("p", F.round("p", 6))


def motif_information(spark, sf):
    w = windows(spark, sf)
    return M.information(M.weight_matrices(w)).join(M.consensus(M.weight_matrices(w)), "f").withColumn("bits", F.round("bits", 6))


def motif_classes(spark, sf):
    return windows(spark, sf).groupBy("f", "label").agg(F.count("*").alias("n"))


def motif_hypotheses(spark, sf):
    return M.hypotheses(windows(spark, sf))


def motif_enrichment(spark, sf):
    """Filters with the classes that hold their windows more often than chance has it, their information and consensus."""
    w = windows(spark, sf)
    pwm = M.weight_matrices(w)
    found = M.enrichment(w, frame(spark, sf, "sequences"))
    out = found.join(M.information(pwm), "f").join(M.consensus(pwm), "f")
    return out.select("f", "label", "n", "m", "k", "total", F.round("fold", 6).alias("fold"), F.round("log10_p", 6).alias("log10_p"), F.round("q", 9).alias("q"), F.round("bits", 6).alias("bits"), "consensus")


def sampled(spark, sf):
    """A seeded sample of each class: the scan is 800 mutants a row, and a sample is what it is for."""
    fine = frame(spark, sf, "sequences").where("not seq rlike '[^ACGT]'")
    return per_group(fine, ["label"], "seq_key", PER_CLASS)


def mutation_effects(spark, sf):
    m = M.mutations(sampled(spark, sf), filters())
    return m.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("delta")), 6).alias("mean_effect"), F.round(F.max("delta"), 6).alias("most"))


def mutation_profile(spark, sf):
    m = M.mutations(sampled(spark, sf), filters())
    return m.groupBy("label", "pos").agg(F.round(F.avg(F.abs("delta")), 6).alias("mean_effect"))


def class_consensus(spark, sf):
    """Consensus of the sequences of each label: counts of letters by place, then as for weight matrices."""
    letters = frame(spark, sf, "sequences").select(F.col("label").alias("f"), F.posexplode(F.split("seq", "")).alias("off", "base"))
    counts = letters.where("base in ('A', 'C', 'G', 'T')").groupBy("f", "off", "base").agg(F.count("*").alias("n"))
    total = counts.groupBy("f", "off").agg(F.sum("n").alias("t"))
    pwm = counts.join(total, ["f", "off"]).select("f", "off", "base", F.round(F.col("n") / F.col("t"), 9).alias("p"))
    return M.consensus(pwm, 0.3).withColumnRenamed("f", "label")


SQL["class_consensus"] = ctes(("sequences",)) + """select label, string_agg(case when p>=0.3 then base else lower(base) end, '' order by off) as consensus from (
  select label, off, base, p, row_number() over (partition by label, off order by p desc, base) as rk from (select label, off, base, round(count(*)/sum(count(*)) over (partition by label, off),9) as p from (
    select label, off, substr(seq, off+1, 1) as base from (select label, seq, unnest(range(0,length(seq))) as off from sequences)) where base in ('A','C','G','T') group by label, off, base)) where rk=1 group by label"""

for _q in (motif_windows, motif_matrices, motif_information, motif_classes, motif_hypotheses, motif_enrichment, mutation_effects, mutation_profile, class_consensus):
    QUERIES[_q.__name__] = _q
