"""Ranked lexical search against brute force, and its edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from segmentry.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, n long, m long, bag string, cid long, first long, h long, score long"


def terms(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def brute(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in held), sum(len(x) for _, x in held)
    df = Counter(t for _, x in held for t in set(x))
    out = []
    for item, text in items:
        found = []
        for doc, words in held:
            tf = Counter(words)
            m = 25 + 75 * len(words) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **kwargs):
    rows = [(*d, 1, 2, "x", 4, 5, 6, 7) for d in docs]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, search.search(spark, frame, spark.createDataFrame(items, "item_id long, text string"), **kwargs).collect()), key=str)


def some(seed=3, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "Und", "é", "ÉCLAIR", "x1", "42", *(f"w{i}" for i in range(60))]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x00", "\x7f"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += [None, "", " .. ", "the " * 40] + texts[:20] + [texts[3]] * 30
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [(None, texts[3]), (None, "the w1 w1"), (5, "w7 w8 the"), (5, "w7 w8 the")]
    items = [(i, rng.choice(texts[:120])) for i in range(12)] + [(20, None), (21, "..."), (22, "w1"), (22, "w1"), (23, "w5 W5 w5 unseen"), (24, "é É"), (None, "w9 the")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_words": 40}, {"k": 1}, {"k": 3, "parts": 1}])
def test_equals_brute_force(spark, options):
    docs, items = some()
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_edges(spark):
    docs, items = some(4, 10)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "")], items) == []
    assert found(spark, docs, [(1, None), (2, "unseen")]) == []


def test_long_texts_and_pieces(spark, monkeypatch):
    docs = [(1, "alpha beta " * 200_000), (2, "alpha " + "y" * 3_000_000), (3, "gamma"), (4, "alpha, beta")]
    items = [(1, "alpha beta"), (2, "beta delta"), (3, "y" * 3_000_000)]
    assert found(spark, docs, items) == brute(docs, items)


def test_sums_beyond_doubles_are_exact():
    keys, values = np.array([0, 1, 0]), np.array([1 << 60, 3, 1])
    assert search.summed(keys, values, 3, False).tolist() == [(1 << 60) + 1, 3, 0]
