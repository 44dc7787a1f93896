"""Whole profiles in one pass: all features of a sequence as one struct, and all means and components of the labels from one scan."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import sequence as S
from ..schema import MOTIFS
from . import components as C

#: Letters of the words whose entropy and components a label profile has; motifs of which it has means; components.
WORD, MEANS, COMPONENTS = 3, ("TATA_box", "GC_box", "AP1", "ETS", "CpG_dense", "CTCF_core"), 6
PAIRS = ["".join(p) for p in product("ACGT", repeat=2)]


def full_profile(s: Column) -> Column:
    """Struct of composition, shares of all sixteen pairs, runs of four equal letters, and counts of all motifs.

    A sequence without known letters has no pairs, runs or motifs, all 0. A null sequence gives null.
    """

    pairs = L.shares(s, 2)
    found = F.map_from_entries(pairs)
    gc = S.gc_fraction(s)
    shares = [F.coalesce(F.try_element_at(found, F.lit(i)), F.lit(0.0)).alias(f"dinuc_{p}") for i, p in enumerate(PAIRS)]
    cpg = F.coalesce(F.try_element_at(found, F.lit(PAIRS.index("CG"))), F.lit(0.0))
    poly = {b: S.homopolymers(s, b) for b in "ACGT"}
    counts = [S.motif_count(s, m).alias(f"motif_{m}") for m in MOTIFS]
    total = poly["A"] + poly["C"] + poly["G"] + poly["T"]
    made = F.struct(
        gc.alias("gc_content"), S.cpg_ratio(s).alias("cpg_ratio"), S.repeats_by_patterns(s).alias("repeat_density"), (1 - gc).alias("at_content"), *shares, cpg.alias("cpg_freq"),
        poly["A"].alias("poly_A"), poly["T"].alias("poly_T"), total.alias("total_homopolymers"), *counts,
    )
    return F.when(s.isNotNull(), made)


NAMES = ("n", "max_run", "h3", *(f"motif_{m}" for m in MEANS))


def add(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Labels, their sums and the second moments of words of several parts as those of all."""
    labels, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros((len(labels), parts[0][1].shape[1]))
    np.add.at(sums, at, np.concatenate([p[1] for p in parts]))
    return [labels, sums, sum(p[2] for p in parts)]


def label_profiles(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (label, seq), in one scan: names of the means; labels; their means; and (label, component) the mean place of
    the label's rows on the principal components of the shares of words, standardised over all rows.

    What tasks sum is as large as labels times features and words squared, and is merged in a
    tree. Rows without a label or sequence are left out; no rows give no labels.
    """
    s, size = F.col("seq"), 4**WORD
    ready = rows.where("label is not null and seq is not null").select("label", s, F.array(*(S.motif_count(s, m).cast("double") for m in MEANS)).alias("motifs"))

    def run(batches):
        held = None
        for batch in batches:
            for first, last in L.pieces(batch.column("seq")):
                part, n = batch.slice(first, last - first), last - first
                code, at = L.codes(part.column("seq"))
                row, word, count, total = L.counted(code, at, WORD)
                dense, share = np.zeros((n, size)), count / total
                dense[row, word] = share
                h = np.bincount(row, -share * np.log2(share), minlength=n)
                most = L.longest(code, L.parts(at), n).max(axis=1, initial=1)
                motifs = part.column("motifs").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                numbers = np.column_stack([np.ones(n), most, h, motifs, dense])
                labels, place = np.unique(part.column("label").to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
                # Rows of a label lie together, so that its sum is one slice.
                order = np.argsort(place, kind="stable")
                sums = np.add.reduceat(numbers[order], np.searchsorted(place[order], np.arange(len(labels))), axis=0)
                new = [labels, sums, dense.T @ dense]
                held = add([held, new]) if held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([C.packed(*held)], pa.binary())], ["part"])

    found = C.together(ready.mapInArrow(run, "part binary"), add)
    if found is None:
        return list(NAMES), np.zeros(0, dtype=np.int64), np.zeros((0, len(NAMES))), np.zeros((0, COMPONENTS))
    labels, sums, second = found
    n, total = sums[:, :1], sums[:, 0].sum()
    means = np.concatenate([n, sums[:, 1 : len(NAMES)] / n], axis=1)
    shares = sums[:, len(NAMES) :] / n
    mean = sums[:, len(NAMES) :].sum(axis=0) / total
    spread = second / total - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    values, vectors = np.linalg.eigh(spread / np.outer(scale, scale))
    vectors = vectors[:, np.argsort(-values)[:COMPONENTS]].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return list(NAMES), labels, means, (shares - mean) / scale @ (vectors * signs[:, None]).T
