"""Linear filters over sequences: responses, top windows, weight matrices, hypotheses, mutation effects."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 19


def one_hot(texts, length: int) -> np.ndarray:
    """(n, length, 4); unknown letters and padding are a quarter each."""
    shares = np.full((256, 4), 0.25)
    shares[list(b"ACGT")] = np.eye(4)
    raw = b"".join(t[:length].encode("ascii", "replace").ljust(length, b"N") for t in texts)
    return shares[np.frombuffer(raw, dtype=np.uint8).reshape(len(texts), length)]


def responses(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, filters, length): rectified responses, the window centred, zero beyond the ends. weights (filters, width, 4)."""
    n, length, _ = x.shape
    f, width, _ = weights.shape
    padded = np.zeros((n, length + width - 1, 4))
    padded[:, width // 2 : width // 2 + length] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded.reshape(n, -1), 4 * width, axis=1)[:, ::4]
    out = windows.reshape(n * length, 4 * width) @ weights.reshape(f, 4 * width).T
    return np.maximum(out, 0.0).reshape(n, length, f).transpose(0, 2, 1)


#: Rows whose responses a task holds at once; places whose letters one look-up answers; codes of a letter: four known, other, none.
ROWS, TOGETHER, CODES = 1024, 4, 6
CODE = np.full(256, 4, dtype=np.int32)
CODE[list(b"ACGT")] = np.arange(4)


def looked_up(texts, weights: np.ndarray, length: int) -> np.ndarray:
    """(filters, n, length): what `responses` gives for one_hot(texts, length), by tables of the sums of TOGETHER places."""
    f, width, _ = weights.shape
    raw = b"".join(t[:length].encode("ascii", "replace").ljust(length, b"N") for t in texts)
    padded = np.full((len(texts), length + width - 1), CODES - 1, dtype=np.int32)
    padded[:, width // 2 : width // 2 + length] = CODE[np.frombuffer(raw, dtype=np.uint8).reshape(len(texts), length)]
    values = np.concatenate([weights, weights.sum(axis=2, keepdims=True) / 4, np.zeros((f, width, 1))], axis=2)
    out = np.zeros((len(texts), length, f))
    for at in range(0, width, TOGETHER):
        place, table = np.zeros((len(texts), length), dtype=np.int32), np.zeros((1, f))
        for j in range(at, min(at + TOGETHER, width)):
            place = place * CODES + padded[:, j : j + length]
            table = (table[:, None] + values[:, j].T[None]).reshape(-1, f)
        out += table[place]
    return np.maximum(out, 0.0).transpose(2, 0, 1)


def top_windows(rows: DataFrame, weights: np.ndarray, k: int, length: int = 200) -> DataFrame:
    """(f, rank, seq_key, label, pos, score, window): the k largest responses of each filter over all rows.

    Each task sends its own k best a filter, so what is ranked at last is small.
    """

    def best(batches):
        held: list[pd.DataFrame] = [pd.DataFrame(columns=["seq_key", "label", "pos", "score", "seq"]) for _ in weights]
        for batch in batches:
            batch = batch[batch["seq"].notna()]
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                keys = part["seq_key"].to_numpy()
                scores = np.round(looked_up(list(part["seq"]), weights, length), 9)
                for f in range(len(weights)):
                    flat = scores[f].ravel()
                    if len(held[f]) == k:
                        # Only what comes before the last row held, equal scores by key and place.
                        last = held[f].iloc[-1]
                        place = np.flatnonzero(flat >= last["score"])
                        key, pos = keys[place // length], place % length
                        place = place[(flat[place] > last["score"]) | (key < last["seq_key"]) | ((key == last["seq_key"]) & (pos < last["pos"]))]
                    else:
                        place = np.arange(len(flat))
                    if len(place) > k:
                        place = place[flat[place] >= np.partition(flat[place], -k)[-k]]
                    if len(place):
                        new = part.iloc[place // length].assign(pos=place % length, score=flat[place])
                        both = new if held[f].empty else pd.concat([held[f], new])
                        held[f] = both.sort_values(["score", "seq_key", "pos"], ascending=[False, True, True]).head(k)
        for f, found in enumerate(held):
            if len(found):
                yield found.assign(f=f)[["f", "seq_key", "label", "pos", "score", "seq"]]

    found = rows.select("seq_key", "label", "seq").mapInPandas(best, "f int, seq_key long, label int, pos int, score double, seq string")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("f").orderBy(F.col("score").desc(), "seq_key", "pos"))).where(F.col("rank") <= k)
    start = F.least(F.greatest(F.col("pos") - WIDTH // 2, F.lit(0)), F.length("seq") - WIDTH)
    return ranked.withColumn("window", F.substr("seq", start + 1, F.lit(WIDTH))).drop("seq")


def weight_matrices(windows: DataFrame) -> DataFrame:
    """(f, off, base, p): shares of the four letters at each place; unknown letters count a quarter each."""
    letters = windows.select("f", F.posexplode(F.split("window", "")).alias("off", "x"))
    shares = [F.when(F.col("x") == b, 1.0).when(F.col("x").isin(*"ACGT"), 0.0).otherwise(0.25) for b in "ACGT"]
    each = letters.select("f", "off", F.explode(F.array(*(F.struct(F.lit(b).alias("base"), s.alias("v")) for b, s in zip("ACGT", shares)))).alias("e"))
    sums = each.groupBy("f", "off", "e.base").agg(F.sum("e.v").alias("v"))
    return sums.withColumn("p", F.col("v") / F.greatest(F.lit(1.0), F.sum("v").over(W.partitionBy("f", "off")))).drop("v")


def information(pwm: DataFrame) -> DataFrame:
    """(f, bits): sum over places of 2 minus the entropy."""
    h = pwm.groupBy("f", "off").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-9))).alias("h"))
    return h.groupBy("f").agg(F.sum(2 - F.col("h")).alias("bits"))


def consensus(pwm: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(f, consensus): the likeliest letter of each place, lower case under the threshold."""
    best = pwm.groupBy("f", "off").agg(F.max_by(F.struct("base", "p"), F.struct("p", -F.ascii("base"))).alias("b"))
    letter = F.when(F.col("b.p") >= threshold, F.col("b.base")).otherwise(F.lower("b.base"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "letter"))), lambda x: x["letter"]), "")
    return best.withColumn("letter", letter).groupBy("f").agg(joined.alias("consensus"))


def hypotheses(windows: DataFrame, n_classes: int = 18, least_bits: float = 0.3, least_share: float = 0.15, top: int = 50) -> DataFrame:
    """Filters with enough information and a leading class, ranked by information times class specificity."""
    pwm = weight_matrices(windows)
    counts = windows.groupBy("f", "label").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(W.partitionBy("f")))
    part = F.col("n") / F.col("m")
    by = counts.groupBy("f").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("top_class"), F.max(part).alias("share"), (-F.sum(part * F.log2(part))).alias("entropy"))
    out = by.join(information(pwm), "f").join(consensus(pwm), "f").where((F.col("bits") >= least_bits) & (F.col("share") >= least_share))
    return out.withColumn("score", F.col("bits") * (1 - F.col("entropy") / F.log2(F.lit(float(n_classes))))).orderBy(F.col("score").desc(), "f").limit(top)


def upper_tail(n: pd.Series, m: pd.Series, k: pd.Series, total: pd.Series) -> pd.Series:
    """Logarithm to base 10 of the chance to draw n or more of k marked rows in m of total, summed from the largest term down."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def one(n: int, m: int, k: int, total: int) -> float:
        if n <= max(0, m + k - total):
            return 0.0
        terms = [choose(k, x) + choose(total - k, m - x) - choose(total, m) for x in range(n, min(m, k) + 1)]
        most = max(terms)
        return min(0.0, (most + math.log(math.fsum(math.exp(t - most) for t in terms))) / math.log(10))

    return pd.Series([one(*map(int, x)) for x in zip(n, m, k, total)], dtype="float64")


def enrichment(windows: DataFrame, rows: DataFrame, rate: float = 0.05) -> DataFrame:
    """(f, label, n, m, k, total, fold, log10_p, q): classes that a filter's windows are of more often than chance has it.

    Of all rows (seq_key, label), `total`, k are of the class; of the m rows that hold the windows of a
    filter, n are. The hypergeometric tail of each filter and class is a test, also of classes without
    a window; those with a false-discovery rate (Benjamini-Hochberg) up to `rate` are returned. No
    windows give no rows; rows without a label are in no class and not in the total.
    """
    rows = rows.where("label is not null")
    classes = rows.groupBy("label").agg(F.count("*").alias("k"))
    classes = classes.withColumn("total", F.sum("k").over(W.partitionBy()))
    held = windows.where("label is not null").select("f", "seq_key", "label").distinct()
    counts = held.groupBy("f", "label").agg(F.count("*").alias("n"))
    filters = counts.groupBy("f").agg(F.sum("n").alias("m"))
    # Filters times classes: both are fixed dimensions.
    tests = filters.crossJoin(F.broadcast(classes)).join(counts, ["f", "label"], "left").fillna(0, ["n"])
    tail = F.pandas_udf(upper_tail, "double")
    tests = tests.withColumn("log10_p", tail("n", "m", "k", "total"))
    every = W.partitionBy()
    place = F.row_number().over(W.orderBy("log10_p", "f", "label"))
    tests = tests.withColumn("raw", F.pow(F.lit(10.0), "log10_p") * F.count("*").over(every) / place)
    tests = tests.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(W.orderBy(F.col("log10_p").desc(), F.col("f").desc(), F.col("label").desc()))))
    fold = (F.col("n") / F.col("m")) / (F.col("k") / F.col("total"))
    return tests.where(F.col("q") <= rate).select("f", "label", "n", "m", "k", "total", fold.alias("fold"), "log10_p", "q")


def mutations(rows: DataFrame, weights: np.ndarray, length: int = 200) -> DataFrame:
    """(seq_key, label, pos, base, delta): change of the summed responses for every place and letter.

    Only the windows that hold the place change, so only those are scored again.
    """
    filters, width, _ = weights.shape
    half = width // 2
    # Response p = pos + half - o holds the place pos at offset o.
    offs = np.arange(width)
    at = np.arange(length)[:, None] + half - offs[None, :]
    inside = (at >= 0) & (at < length)

    def scan(batches):
        for batch in batches:
            for key, label, text in zip(batch["seq_key"], batch["label"], batch["seq"]):
                x = one_hot([text], length)[0]
                padded = np.zeros((length + width - 1, 4))
                padded[half : half + length] = x
                windows = np.lib.stride_tricks.sliding_window_view(padded.ravel(), 4 * width)[::4]
                raw = windows @ weights.reshape(filters, 4 * width).T
                old = raw[np.clip(at, 0, length - 1)]
                change = weights.transpose(1, 0, 2)[None] - np.einsum("pc,foc->pof", x, weights)[..., None]
                new = np.maximum(old[..., None] + change, 0) - np.maximum(old, 0)[..., None]
                delta = np.where(inside[:, :, None, None], new, 0).sum(axis=(1, 2))
                out = {"seq_key": key, "label": label, "pos": np.repeat(np.arange(length), 4), "base": list("ACGT") * length, "delta": delta.ravel()}
                yield pd.DataFrame(out)

    return rows.select("seq_key", "label", "seq").mapInPandas(scan, "seq_key long, label int, pos int, base string, delta double")
