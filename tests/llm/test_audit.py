"""The transducer and the divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from segmentry.llm import audit
from segmentry.llm.transducer import Transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def walk(machine, words):
    data = b" ".join(words) + b" "
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    which, ordinals = machine.ordinals(np.frombuffer(data, dtype=np.uint8), starts)
    return dict(zip(which.tolist(), ordinals.tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_ordinals_of_terms_only(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "z", "é", "漢"]
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))).encode() for _ in range(400)} | {b"x" * 5000})
    machine = Transducer.unpacked(Transducer.of(terms).packed())
    place = {t: i for i, t in enumerate(terms)}
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))).encode() for _ in range(2000)] + terms + [b"x" * 4999, b"x" * 5001, b"y"]
    assert walk(machine, words) == {i: place[w] for i, w in enumerate(words) if w in place}


def test_is_minimal():
    rng = random.Random(9)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(200)})
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    futures = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}
    assert len(Transducer.of(terms).final) == len(futures)
    assert len(Transducer.of([]).final) == 1 and not walk(Transducer.of([]), [b"a"])


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(A_TO_Z))) for lang, source, text in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        df[lang].update(set(words))
        groups[lang].add(source)
    kept = {lang: {t for t, n in df[lang].items() if n >= least} for lang in groups}
    for lang, source, words in docs:
        for t in words:
            if t in kept[lang]:
                counts[lang, source][t] += 1
                counts[lang, None][t] += 1
    out = []
    for lang, sources in groups.items():
        def shares(source):
            n = sum(counts[lang, source].values())
            return {t: 1 + 10**9 * (counts[lang, source][t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

        p = {s: shares(s) for s in [*sources, None]}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept[lang]), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            best = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept[lang] if counts[lang, s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(best, 1)]
    return sorted(out)


def audited(spark, rows, parts=3, **kwargs):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "lang string, source string, text string, n long, p long, kept long, place long, ordinal long").repartition(parts)
    return sorted(map(tuple, audit.divergence(spark, frame, **kwargs).collect()))


def some(n, sources, words, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "abé漢" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyzß"][: words - 2] + ["Zed", "ÉA"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "7", "-", "\n", "\x00"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", "de", "de", None]), rng.choice(sources), text))
    return rows + [("en", "only", None), ("xx", "one", "rare"), ("xx", "two", None), ("yy", "alone", "rare"), (None, None, "a b"), ("de", None, "")] + rows[:5] * 3


@pytest.mark.parametrize(("n", "n_sources", "words", "least", "top"), [(150, 4, 40, 10, 50), (150, 4, 40, 1, 3), (400, 150, 30, 5, 2), (600, 3, 2600, 1, 5), (60, 3, 40, 1000, 50)])
def test_equals_brute_force(spark, n, n_sources, words, least, top):
    rows = some(n, [f"s{i}" for i in range(n_sources)] + ["Ä"], words)
    assert audited(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_over_a_chunk_of_terms_and_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"{rng.getrandbits(64):x}".translate({48 + i: 103 + i for i in range(10)}) for i in range(9000)]
    rows = [("en", f"s{i % 3}", " ".join(rng.sample(words, 1500))) for i in range(30)]
    monkeypatch.setattr(audit, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(audit, "PASS_BYTES", 300_000)
    assert audited(spark, rows, least=2, top=20) == brute(rows, 2, 20)


def test_empty_and_long(spark):
    assert audited(spark, []) == []
    rows = [("en", "a", "word " * 500_000 + "y" * 2_000_000), ("en", "b", "word other"), ("en", "b", "y" * 2_000_000)]
    assert audited(spark, rows, least=1) == brute(rows, 1, 50)
