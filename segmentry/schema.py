"""Constants that carry meaning: states, chromosomes, splits, motifs, prototypes."""

from __future__ import annotations

# State number, name, family, family number, subcluster.
STATES = (
    (1, "1_TssA", "promoter", 0, 1),
    (2, "2_TssFlnk", "promoter", 0, 1),
    (3, "3_TssFlnkU", "promoter", 0, 1),
    (4, "4_TssFlnkD", "promoter", 0, 1),
    (5, "5_Tx", "transcribed", 1, 3),
    (6, "6_TxWk", "transcribed", 1, 3),
    (7, "7_EnhG1", "enhancer", 2, 4),
    (8, "8_EnhG2", "enhancer", 2, 4),
    (9, "9_EnhA1", "enhancer", 2, 5),
    (10, "10_EnhA2", "enhancer", 2, 5),
    (11, "11_EnhWk", "enhancer", 2, 5),
    (12, "12_ZNF/Rpts", "heterochromatin", 4, 7),
    (13, "13_Het", "heterochromatin", 4, 7),
    (14, "14_TssBiv", "promoter", 0, 2),
    (15, "15_EnhBiv", "enhancer", 2, 5),
    (16, "16_ReprPC", "polycomb", 3, 6),
    (17, "17_ReprPCWk", "polycomb", 3, 6),
    (18, "18_Quies", "quiescent", 5, 7),
)
CHROMOSOMES = tuple(f"chr{i}" for i in [*range(1, 23), "X", "Y"])
VALIDATION, TEST = ("chr18", "chr19"), ("chr20", "chr21", "chr22")
BIN = 200
MIN_MATCH = 0.95
MIN_ENTROPY = 0.5
MINORITY = (12, 14, 15)
SEED = 20260408
CAP = 50_000
N_CLASSES = 18

# Motif patterns of the counting and of the overlapping scan.
MOTIFS = {
    "TATA_box": "TATA[AT]A[AT]",
    "CAAT_box": "GG[CT]CAATCT",
    "GC_box": "GGGCGG",
    "Inr": "[CT][CT]A[ACGT][AT][CT][CT]",
    "AP1": "TGA[CG]TCA",
    "ETS": "[AC]GGA[AT]G",
    "GATA": "[AT]GATA[AG]",
    "CEBP": "T[TG]NNGNAA[TG]",
    "CpG_dense": "CGCG",
    "CTCF_core": "CC[AG]C[CG]AGGGGGC",
    "KRAB_ZNF": "TGCAG",
}
OVERLAPPING = ("TATA_box", "GC_box", "AP1", "ETS", "CTCF_core", "Inr", "CpG_dense", "KRAB_ZNF")
# Repeat patterns of the first density, with single letters spelled out, and the units of the second.
REPEATS = ("(?:AT){4,}", "(?:TA){4,}", "(?:CA){4,}", "(?:TG){4,}", "A{6,}|C{6,}|G{6,}|T{6,}", "(?:AAT){3,}", "(?:ATT){3,}")
PAIRS = ("AT", "TA", "CA", "AC", "TG", "GT", "CG", "GC")
# Expected levels of six stable features by state: gc, at, cpg ratio, cpg frequency, repeats, entropy.
SAFE = ("gc_content", "at_content", "cpg_ratio", "cpg_freq", "repeat_density", "entropy")
PROTOTYPES = {
    "TssA": (0.65, 0.35, 0.85, 0.08, 0.05, 1.8),
    "TssFlnk": (0.55, 0.45, 0.60, 0.05, 0.10, 1.9),
    "TssFlnkU": (0.52, 0.48, 0.55, 0.04, 0.10, 1.9),
    "TssFlnkD": (0.50, 0.50, 0.45, 0.035, 0.12, 1.95),
    "Tx": (0.45, 0.55, 0.35, 0.025, 0.15, 1.95),
    "TxWk": (0.42, 0.58, 0.30, 0.020, 0.18, 1.95),
    "EnhG1": (0.48, 0.52, 0.40, 0.030, 0.12, 1.95),
    "EnhG2": (0.46, 0.54, 0.38, 0.028, 0.14, 1.95),
    "EnhA1": (0.47, 0.53, 0.42, 0.032, 0.10, 1.95),
    "EnhA2": (0.45, 0.55, 0.38, 0.028, 0.12, 1.95),
    "EnhWk": (0.42, 0.58, 0.32, 0.022, 0.18, 1.95),
    "ZnfRpts": (0.52, 0.48, 0.45, 0.035, 0.35, 1.7),
    "Het": (0.35, 0.65, 0.20, 0.010, 0.45, 1.3),
    "TssBiv": (0.58, 0.42, 0.70, 0.060, 0.08, 1.85),
    "EnhBiv": (0.48, 0.52, 0.45, 0.035, 0.15, 1.95),
    "ReprPC": (0.50, 0.50, 0.55, 0.040, 0.12, 1.8),
    "ReprPCWk": (0.45, 0.55, 0.40, 0.028, 0.18, 1.9),
    "Quies": (0.40, 0.60, 0.25, 0.015, 0.25, 1.8),
}
