"""Quality classifier: regularised quadratic discriminant analysis.

Documents are described by transformed statistics of their whole text. Labelled rows give
each class its mean and covariance through sums that Spark aggregates (counts, sums,
products), so all labelled rows count and only those sums reach the driver. Covariances
are shrunk towards the pooled one and its diagonal; their Cholesky factors are kept, and
a score is the logistic of the difference of the two log densities plus log priors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

FEATURES = (
    "words",
    "word_length",
    "upper",
    "digits",
    "symbols",
    "bars",
    "bangs",
    "stops",
    "unique",
    "short_words",
    "same_lines",
    "line_words",
)
THRESHOLD, FOLDS = 0.3, 5
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1

ASCII = {
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "symbols": b"$%&*#@^~=<>{}[]\\_`+/",
    "bars": b"|",
    "bangs": b"!?",
    "stops": b".,;:",
}
KEPT = {k: bytes(b for b in range(256) if b not in v) for k, v in ASCII.items()}


def describe(text: str | None) -> tuple[float, ...]:
    """Transformed statistics of a whole text; a text without words has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, size = len(words), sum(map(len, words))
    share = {k: math.sqrt(len(raw.translate(None, v)) / size) for k, v in KEPT.items()}
    different = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    short = sum(len(w) <= 3 for w in words)
    return (
        math.log1p(n),
        math.log(size / n),
        share["upper"],
        share["digits"],
        share["symbols"],
        share["bars"],
        share["bangs"],
        share["stops"],
        math.log(len(different) / n) / math.log(n + 1),
        math.sqrt(short / n),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log(n / len(lines)),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([describe(t) for t in texts])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log-density offsets of class 0 and class 1."""

    means: tuple[tuple[float, ...], ...]
    factors: tuple[tuple[tuple[float, ...], ...], ...]
    offsets: tuple[float, ...]

    def log_density(self, x: Column, k: int) -> Column:
        """Of the array column x, without the constant that both classes share."""
        total = F.lit(self.offsets[k])
        for i, row in enumerate(self.factors[k]):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(row[j]) * (x[j] - F.lit(self.means[k][j]))
            total = total - F.lit(0.5) * z * z
        return total

    def score(self, x: Column) -> Column:
        """Probability of class 1."""
        gap = self.log_density(x, 1) - self.log_density(x, 0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(gap, F.lit(-700.0)), F.lit(700.0))))


def fit(rows: DataFrame) -> Model:
    """From rows (x array<double>, y 0 or 1). A class without rows is given the pooled shape and a prior of one row."""
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    by = {int(r["y"]): r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()}

    def moments(r) -> tuple[float, np.ndarray, np.ndarray]:
        n, mean, product = r["n"], np.array([r[f"s{i}"] for i in range(d)]) / r["n"], np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                product[i, j] = product[j, i] = r[f"p{i}_{j}"]
        return n, mean, product / n - np.outer(mean, mean)

    found = {k: moments(r) for k, r in by.items()}
    n = sum(m[0] for m in found.values())
    pooled = sum(m[0] * m[2] for m in found.values()) / n if n else np.eye(d)
    centre = sum(m[0] * m[1] for m in found.values()) / n if n else np.zeros(d)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        count, mean, cov = found.get(k, (1, centre, pooled))
        cov = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * cov + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * np.diag(np.diag(pooled))
        cov = cov + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        inverse = np.linalg.inv(lower)
        means.append(tuple(map(float, mean)))
        factors.append(tuple(tuple(map(float, r)) for r in inverse))
        offsets.append(float(math.log(count / max(n, 1)) - np.log(np.diag(lower)).sum()))
    return Model(tuple(means), tuple(factors), tuple(offsets))


def bucket(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; that of a null id is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % FOLDS, F.lit(0))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learned from rows outside bucket 0; null labels and labels of absent
    documents teach nothing. Null and empty texts are scored by the features of a text
    without words. Repeated rows are scored each and, if labelled, learned each.
    """
    described, _ = stored(spark, docs.select("doc_id", features("text").alias("x")), "features")
    taught = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(bucket() != 0)
    model = fit(described.join(taught, "doc_id").select("x", "y"))
    out = described.select("doc_id", (bucket() == 0).alias("held_out"), model.score(F.col("x")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document. Edges as in `scored`."""
    return scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. All columns stay as they are, whatever their names.

    Labels teach as in `scored`. Null and empty texts are judged by the features of a text
    without words, repeated rows alike; without labels every document scores as the two
    classes would at even odds; an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels")
    taught = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(bucket() != 0)
    # Texts are described before the join, so that it moves features and no text.
    teaching = docs.select("doc_id", features("text").alias("x")).join(taught, "doc_id")
    model = fit(teaching.select("x", "y"))
    kept = docs.select(F.struct(*docs.columns).alias("doc"), features("text").alias("x"))
    return kept.where(model.score(F.col("x")) >= THRESHOLD).select("doc.*")
