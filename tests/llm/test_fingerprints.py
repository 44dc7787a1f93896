"""Spot signatures, their order and likeness, and the search by length partitions, against brute force."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash

from segmentry.llm import fingerprints as fp

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain(text, chain=3):
    """Signatures as hashes, written out."""
    words = TERM.findall((text or "").translate(A_TO_Z))
    found = set()
    for i, w in enumerate(words):
        after = list(itertools.islice((words[j] for j in range(i + 1, len(words)) if words[j].encode() not in fp.COMMON), chain))
        if w.encode() in fp.COMMON and len(after) == chain:
            found.add(" ".join([w, *after]))
    if not found and words:
        found = {" ".join(words[i : i + chain]) for i in range(max(1, len(words) - chain + 1))}
    return {xxhash.xxh64_intdigest(s.encode(), fp.SEED) for s in found}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def some(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Of", "und", "für", "la", "à", "x7", *(f"w{i}" for i in range(80))]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "🙂 "]) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    return texts + [None, "", " ..", "the of and", "the", "one two", "one two three four five", "漢字 " * 20, texts[0], texts[0]]


def test_signatures_equal_plain_ones(monkeypatch):
    texts = some()
    for piece in (fp.pieces.__globals__["PIECE"], 7):
        monkeypatch.setitem(fp.pieces.__globals__, "PIECE", piece)
        for t in texts:
            got = fp.signatures((t or "").encode())
            assert set(got.tolist()) == plain(t) and (fp.read(fp.spelled(got)) == got).all()
    assert fp.likeness(fp.signatures(b"the a1 b1 c1"), fp.signatures(b"the a1 b1 c1 the a2 b2 c2"), 0.6) == 0.0


def check(spark, rows, parts):
    frame = spark.createDataFrame([(*r, 9, 8, 7, 6, True) for r in rows], "doc_id long, text string, n_chars long, h long, none long, range long, borrowed boolean").repartition(parts)
    got = sorted(map(tuple, fp.fingerprints(spark, frame).collect()), key=str)
    hashes = {t: h for t, h in frame.selectExpr("text", "xxhash64(text)").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for (doc, text), (_, other) in zip(order, [*order[1:], *order[:1]]):
        text, other = text or "", other or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        own, new = plain(text), plain(edited)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, jaccard(own, new), jaccard(own, plain(other))))
    got = [(*r[:3], set(fp.read(r[3]).tolist()), set(fp.read(r[4]).tolist()), *r[5:]) for r in got]
    assert sorted(got, key=lambda r: str(r[:3])) == sorted(want, key=lambda r: str(r[:3]))


@pytest.mark.parametrize(("size", "parts"), [(1 << 25, 3), (2000, 4), (300, 1)])
def test_equals_brute_force(spark, monkeypatch, size, parts):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    rng = random.Random(2)
    rows = [(i - 20, t) for i, t in enumerate(some(2))]
    rng.shuffle(rows)
    rows += [(None, "the one without an id"), (None, None), (3, "again the same id here"), (3, "again the same id here"), (-(1 << 63), "least of the ids"), ((1 << 63) - 1, "most of the ids")] + [(3, "again the same id here")] * 30
    check(spark, rows, parts)


def test_one_none_and_long(spark):
    check(spark, [(1, "the only one of them")], 1)
    check(spark, [(1, None)], 1)
    check(spark, [(1, "the word of it is here " * 60_000), (2, "y" * 2_000_000), (3, "🙂" * 1000)], 2)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprints(spark, none).count() == 0 and fp.near_duplicates(spark, none).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 50)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
    texts += [None, "", "..", texts[0], texts[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets, top = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= fp.SIMILARITY:
                links += sets[a] != sets[b]
                top[find(a)] = find(b)
    assert links > 10
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), 1 << 40), ids[i])
    want = sorted((ids[i], least[find(i)]) for i in range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, fp.near_duplicates(spark, docs).collect())) == want


def test_partitions_by_length_lose_no_pair():
    edges = fp.edges_of_lengths(0.8)
    place = lambda n: sum(e <= n for e in edges)
    assert all(place(b) - place(a) <= 1 for a in range(1, 400) for b in range(a, int(a / 0.8 + 1e-9) + 1))
