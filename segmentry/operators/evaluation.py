"""Classifier outputs as long tables (row_key, class_id, k, logit): predictions, confusion, calibration, strands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vectors(logits: DataFrame) -> DataFrame:
    """(row_key, class_id, z): logits as arrays in class order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "logit"))), lambda x: x["logit"])
    return logits.groupBy("row_key", "class_id").agg(ordered.alias("z"))


def probabilities(z: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda n, x: n + x)
    return F.transform(e, lambda x: x / total)


def predicted(z: Column) -> Column:
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def predictions(logits: DataFrame) -> DataFrame:
    """(row_key, class_id, pred, conf)."""
    v = vectors(logits)
    return v.select("row_key", "class_id", predicted(F.col("z")).alias("pred"), F.array_max(probabilities(F.col("z"))).alias("conf"))


def confusion(pred: DataFrame) -> DataFrame:
    """(class_id, pred, n, share): shares of the true class."""
    n = pred.groupBy("class_id", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.greatest(F.lit(1), F.sum("n").over(W.partitionBy("class_id"))))


def confused_pairs(pred: DataFrame, k: int) -> DataFrame:
    """The k class pairs (a < b) with the largest mean share of confusion either way."""
    off = confusion(pred).where("class_id <> pred")
    pairs = off.groupBy(F.least("class_id", "pred").alias("a"), F.greatest("class_id", "pred").alias("b")).agg((F.sum("share") / 2).alias("score"))
    return pairs.orderBy(F.round("score", 9).desc(), "a", "b").limit(k)


def bin_of(conf: Column, bins: int) -> Column:
    """Equal bins (lo, hi], the first with its lower end."""
    return F.greatest(F.ceil(conf * bins), F.lit(1)).cast("int")


def reliability(pred: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, accuracy, confidence)."""
    hit = (F.col("pred") == F.col("class_id")).cast("double")
    return pred.groupBy(bin_of(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg("conf").alias("confidence"))


def calibration_error(pred: DataFrame, bins: int = 15) -> DataFrame:
    return reliability(pred, bins).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def fit_temperature(logits: DataFrame, steps: int = 20) -> float:
    """The scalar temperature of least negative log likelihood, at least 1e-3.

    Newton steps on the inverse temperature; the likelihood is convex in it, its first two
    derivatives are the mean and variance of the logits under the model, and each step is
    one aggregate over the stored logits. Without rows it is 1.
    """
    v = vectors(logits).select("z", F.element_at("z", F.col("class_id") + 1).alias("own")).persist()
    b = 1.0
    try:
        for _ in range(steps):
            p = probabilities(F.col("z"), 1.0 / b)
            mean = F.aggregate(F.zip_with(p, F.col("z"), lambda q, x: q * x), F.lit(0.0), lambda n, x: n + x)
            square = F.aggregate(F.zip_with(p, F.col("z"), lambda q, x: q * x * x), F.lit(0.0), lambda n, x: n + x)
            slope, bend = v.select(F.avg(mean - F.col("own")), F.avg(square - mean * mean)).first()
            if slope is None or not bend:
                break
            step = slope / bend
            b = min(max(b - step, b / 4), b * 4, 1e3)
            if abs(step) < 1e-9 * b:
                break
    finally:
        v.unpersist()
    return max(1.0 / b, 1e-3) if math.isfinite(b) else 1.0


def strands(plus: DataFrame, minus: DataFrame) -> DataFrame:
    """(row_key, class_id, p, q): probabilities of both strands, clamped at 1e-12."""
    clamp = lambda z: F.transform(probabilities(z), lambda x: F.greatest(x, F.lit(1e-12)))
    a = vectors(plus).select("row_key", "class_id", clamp(F.col("z")).alias("p"))
    b = vectors(minus).select("row_key", clamp(F.col("z")).alias("q"))
    return a.join(b, "row_key")


def divergence(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: x * F.ln(x / y)), F.lit(0.0), lambda n, x: n + x)
