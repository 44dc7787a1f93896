"""Scalar functions of sequences. All are built-in column expressions; variants that give other numbers have other names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters as L
from ..schema import MOTIFS, OVERLAPPING, PAIRS, REPEATS

BASES = "ACGT"
NO_RUNS = "cast(array() as array<int>)"


def count_of(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def occurrences(s: Column, word: str) -> Column:
    """Non-overlapping, from the left."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)).cast("long")


def share(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def known(s: Column) -> Column:
    return count_of(s, BASES)


def gc_fraction(s: Column) -> Column:
    """G and C over the length."""
    return share(count_of(s, "GC"), F.length(s))


def gc_of_known(s: Column) -> Column:
    """G and C over the known letters."""
    return share(count_of(s, "GC"), known(s))


def cpg_ratio(s: Column) -> Column:
    """Observed CG over C * G / length; 0 where none is expected."""
    return share(occurrences(s, "CG"), share(count_of(s, "C") * count_of(s, "G"), F.length(s)))


def cpg_of_pairs(s: Column) -> Column:
    """Observed CG over (n - 1) * share of C * share of G among known letters, the expectation floored at 1e-8."""
    n = known(s)
    expected = (n - 1) * share(count_of(s, "C"), n) * share(count_of(s, "G"), n)
    return occurrences(s, "CG") / F.greatest(expected, F.lit(1e-8))


def cpg_frequency(s: Column) -> Column:
    return share(occurrences(s, "CG"), F.length(s) - 1)


def entropy(s: Column, total: Column | None = None) -> Column:
    """Shannon entropy in bits of the four letters over the length, or over another total; each share is computed once."""
    shares = F.array(*(share(count_of(s, b), F.length(s) if total is None else total) for b in BASES))
    return F.aggregate(shares, F.lit(0.0), lambda h, p: h - F.when(p > 0, p * F.log2(F.greatest(p, F.lit(1e-300)))).otherwise(0.0))


def entropy_of_known(s: Column) -> Column:
    return entropy(s, known(s))


def run_lengths(s: Column, letters: str = BASES) -> Column:
    """Lengths of the runs of one letter; other letters end a run."""
    found = F.regexp_extract_all(s, F.lit("(" + "|".join(f"{b}+" for b in letters) + ")"), F.lit(1))
    return F.transform(found, F.length)


def longest_run(s: Column) -> Column:
    """Of any known letter, 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(run_lengths(s)), F.lit(1)))


def longest_run_of(s: Column, base: str) -> Column:
    return F.coalesce(F.array_max(run_lengths(s, base)), F.lit(0))


def matched(s: Column, pattern: str) -> Column:
    """Letters in the matches of a pattern."""
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))


def repeats_in_runs(s: Column) -> Column:
    """Share of letters in runs of 3 or more."""
    long_runs = F.filter(run_lengths(s), lambda n: n >= 3)
    return share(F.aggregate(long_runs, F.lit(0), lambda n, x: n + x), F.length(s))


def repeats_by_patterns(s: Column) -> Column:
    """Letters of seven patterns, that may overlap, over the length; 1 at most."""
    return F.least(share(sum((matched(s, p) for p in REPEATS), F.lit(0)), F.length(s)), F.lit(1.0))


def repeats_of_pairs(s: Column) -> Column:
    """Letters in runs of 4 and more and in pairs repeated 4 times and more, over the length; 1 at most."""
    patterns = [f"{b}{{4,}}" for b in BASES] + [f"(?:{p}){{4,}}" for p in PAIRS]
    return F.least(share(sum((matched(s, p) for p in patterns), F.lit(0)), F.length(s)), F.lit(1.0))


def engineered(s: Column) -> Column:
    """(gc, cpg, entropy, longest run, repeats) of the upper-cased sequence; fixed values without known letters."""
    m = L.measures(F.upper(s))
    n = m["a"] + m["c"] + m["g"] + m["t"]
    expected = (n - 1) * share(m["c"], n) * share(m["g"], n)
    fine = F.array(share(m["g"] + m["c"], n), m["cg"] / F.greatest(expected, F.lit(1e-8)), entropy_of(m, n), m["longest"].cast("double"), share(m["in_runs"], m["n"]))
    return F.when(n > 0, fine).otherwise(F.array(*map(F.lit, (0.5, 1.0, 2.0, 1.0, 0.0))))


def entropy_of(m: Column, total: Column) -> Column:
    """Shannon entropy of the four letters from their counts."""
    return -sum((p * F.log2(F.when(p > 0, p).otherwise(1.0)) for p in (share(m[b], total) for b in "acgt")), F.lit(0.0))


def stable_features(s: Column) -> tuple[Column, ...]:
    """gc_fraction, its rest, cpg_ratio, cpg_frequency, repeats_of_pairs and entropy_of_known, from counts made once."""
    m = L.measures(s)
    gc, n = share(m["g"] + m["c"], m["n"]), m["a"] + m["c"] + m["g"] + m["t"]
    cpg = share(m["cg"], share(m["c"] * m["g"], m["n"]))
    return gc, 1 - gc, cpg, share(m["cg"], m["n"] - 1), F.least(share(m["in_pairs"], m["n"]), F.lit(1.0)), entropy_of(m, n)


def homopolymers(s: Column, base: str, n: int = 4) -> Column:
    """Non-overlapping runs of n letters."""
    return occurrences(s, base * n)


def motif_count(s: Column, name: str) -> Column:
    return F.regexp_count(s, F.lit(MOTIFS[name])).cast("long")


def motif_rate(s: Column, name: str) -> Column:
    """Overlapping occurrences for every 200 letters."""
    if name not in OVERLAPPING:
        raise ValueError(f"{name} is not scanned with overlaps")
    return F.regexp_count(s, F.lit(f"(?=({MOTIFS[name]}))")) / F.greatest(F.length(s) / 200.0, F.lit(1e-6))


def windows(s: Column, n: int) -> Column:
    """n slices of equal length; the last takes the rest."""
    width = F.floor(F.length(s) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(s, i * width + 1, F.when(i == n - 1, F.length(s)).otherwise(width)))


def kmers(s: Column, k: int) -> Column:
    """All words of k letters, step 1; none of a shorter or null sequence."""
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.expr("cast(array() as array<string>)"))


def known_kmers(s: Column, k: int) -> Column:
    """The words of k letters that hold no other letter than A, C, G and T: an overlapping match at each place."""
    return F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def reverse_complement_any(s: Column) -> Column:
    """Keeps N and lower case."""
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def padded(s: Column, length: int) -> Column:
    return F.rpad(F.substr(s, F.lit(1), F.lit(length)), length, "N")


def one_hot(s: Column, length: int) -> Column:
    """length rows of four shares; unknown letters and padding are a quarter each."""
    rows = F.split(padded(F.upper(s), length), "")
    row = lambda b: F.when(b.isin(*BASES), F.array(*((b == x).cast("double") for x in BASES))).otherwise(F.array(*[F.lit(0.25)] * 4))
    return F.transform(F.slice(rows, 1, length), row)


def reverse_complement_one_hot(x: Column) -> Column:
    """Rows and channels reversed."""
    return F.transform(F.reverse(x), F.reverse)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from md5 of the parts, the same in any engine."""
    text = F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def state_family(state: Column) -> Column:
    """Coarse family by the state's name."""
    return (
        F.when(state.startswith("Tss") | state.startswith("ReprPC"), "promoter_polycomb")
        .when(state.startswith("Enh"), "enhancer")
        .when(state.startswith("Tx"), "transcribed")
        .otherwise("other")
    )
