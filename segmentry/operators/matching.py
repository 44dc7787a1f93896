"""Labels to states: similarities of feature profiles, anchors, one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def similarity(labels: DataFrame, states: DataFrame, own_scale: bool = False) -> DataFrame:
    """(label, state, sim): minus the distance of z-scores; both sides by the labels' scale, or each by its own.

    labels (label, feature, value) and states (state, feature, value); a missing value is 0.
    """
    scale = lambda rows: rows.groupBy("feature").agg(F.avg("value").alias("mu"), (F.stddev_pop("value") + 1e-8).alias("sd"))
    z = lambda rows, by: rows.join(F.broadcast(by), "feature").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))
    told = scale(labels)
    a = z(labels, told).select("label", "feature", F.col("z").alias("x"))
    b = z(states, scale(states) if own_scale else told).select("state", "feature", F.col("z").alias("y"))
    met = a.join(F.broadcast(b), "feature")
    return met.groupBy("label", "state").agg((-F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))))).alias("sim"))


def best_states(sim: DataFrame, k: int = 3) -> DataFrame:
    """(label, place, state, sim, margin): the k most similar states; margin is to the next one."""
    order = W.partitionBy("label").orderBy(F.round("sim", 9).desc(), "state")
    ranked = sim.withColumn("place", F.row_number().over(order)).withColumn("margin", F.col("sim") - F.lead("sim").over(order))
    return ranked.where(F.col("place") <= k)


def wide(profiles: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return profiles.groupBy("label").pivot("feature", list(features)).agg(F.first("value"))


def anchors(profiles: DataFrame, states: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(state, label): four picks in turn, each leaving the pool. The pool is one row a label."""
    pool = wide(profiles, features)
    target = {s: states.where(F.col("state") == s).groupBy("state").pivot("feature", list(features)).agg(F.first("value")).drop("state") for s in ("Quies", "ZnfRpts")}
    out = None

    def take(rows: DataFrame, state: str, *order) -> DataFrame:
        return rows.orderBy(*order).limit(1).select(F.lit(state).alias("state"), "label")

    def near(rows: DataFrame, state: str) -> DataFrame:
        t = target[state].select(*(F.col(f).alias(f"t_{f}") for f in features))
        gap = sum(((F.col(f) - F.col(f"t_{f}")) * (F.col(f) - F.col(f"t_{f}")) for f in features), F.lit(0.0))
        return rows.crossJoin(F.broadcast(t)).withColumn("gap", F.round(F.sqrt(gap), 9))

    down = lambda c: F.round(c, 9).desc()
    steps = (
        lambda p: take(p, "TssA", down("cpg_ratio"), down("cpg_freq"), down("gc_content"), "label"),
        lambda p: take(p.orderBy(F.round("gc_content", 9), "label").limit(4), "Het", down(F.col("repeat_density") - 0.1 * F.col("entropy")), F.round("gc_content", 9), "label"),
        lambda p: take(near(p, "Quies"), "Quies", "gap", "label"),
        lambda p: take(near(p, "ZnfRpts"), "ZnfRpts", "gap", "label"),
    )
    for step in steps:
        picked = step(pool)
        out = picked if out is None else out.union(picked)
        pool = pool.join(F.broadcast(picked.select("label")), "label", "left_anti")
    return out


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of least total cost, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[j] = True
            free = ~used[1:]
            gap = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = free & (gap < least[1:])
            least[1:][better] = gap[better]
            way[1:][better] = j
            j_next = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[j_next]
            u[match[used]] += step
            v[used] -= step
            least[1:][free] -= step
            j = j_next
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.zeros(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def assignments(profiles: DataFrame, states: pd.DataFrame, fixed: dict[str, int], features: tuple[str, ...]) -> DataFrame:
    """(eid, label, state) from profiles (eid, label, feature, value): one problem a source, anchors fixed.

    states is the prototype matrix, one row a state, of fixed size.
    """

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="label", columns="feature", values="value").reindex(columns=list(features)).fillna(0.0)
        held = {s: label for s, label in fixed.items() if label in x.index}
        free_labels = [label for label in x.index if label not in held.values()]
        free_states = [s for s in states.index if s not in held]
        part = x.loc[free_labels].to_numpy()
        out = [(key[0], int(label), s) for s, label in held.items()]
        if free_labels:
            mu, sd = part.mean(axis=0), part.std(axis=0) + 1e-8
            a, b = (part - mu) / sd, (states.loc[free_states].to_numpy() - mu) / sd
            size = max(len(a), len(b))
            cost = np.zeros((size, size))
            cost[: len(a), : len(b)] = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            out += [(key[0], int(free_labels[i]), free_states[j]) for i, j in enumerate(assign(cost)[: len(a)]) if j < len(b)]
        return pd.DataFrame(out, columns=["eid", "label", "state"])

    return profiles.groupBy("eid").applyInPandas(solve, "eid string, label int, state string")
