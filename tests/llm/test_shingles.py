"""The pipeline's near copies against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from segmentry.llm import common, shingles, simhash


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "two words", "Two  words"]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(4, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            # Changes spread over the text, so that many fingerprint bits differ.
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    sets = {i: set(shingles.windows(t)) for i, t in zip(ids, texts)}
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if shingles.jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    kept = [r["doc_id"] for r in shingles.keep_one(spark, docs, "").collect()]
    assert sorted(kept) == sorted({find(i) for i in ids})


def test_unlike_texts_stay(spark):
    # No five words in a row are shared.
    a = [f"w{i}" for i in range(80)]
    b = [w if i % 4 else f"x{i}" for i, w in enumerate(a)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert shingles.keep_one(spark, docs, "").count() == 2


def test_rows_without_or_with_shared_ids_stay(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(None, one), (None, two), (7, two), (7, three), (8, three), (9, "alone"), (9, "another"), (None, one)]
    want = sorted([(None, one), (7, two), (7, three), (9, "alone"), (9, "another")], key=str)
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, shingles.keep_one(spark, docs, "").collect()), key=str) == want


@pytest.mark.parametrize("most", [common.MOST_BITMAPS, 2])
def test_chosen_rows_are_those_of_the_keys(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITMAPS", most)
    held = [(part << 33) + k for part in (0, 1, 7) for k in [*range(40), 32767, 32768, 32769, 100_000]]
    want = set(random.Random(3).sample(held, 60)) | {0, 32768}
    rows = spark.createDataFrame([(k, f"t{k}") for k in held], "key long, text string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in [*want, 5 << 33]], "key long")
    found, _ = common.chosen(spark, rows, keys)
    assert found.columns == ["key", "text"] and sorted(map(tuple, found.collect())) == sorted((k, f"t{k}") for k in want)
    assert common.chosen(spark, rows, keys.limit(0))[0].count() == 0


def test_documents_are_not_moved_and_the_index_is_not_broadcast(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 50}x{j}" for j in range(30))) for i in range(300)], "doc_id long, text string")
    # As where a table of keys is too large to be broadcast.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = shingles.keep_one(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 50 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    links = simhash.links(spark, spark.range(50).select(F.col("id").alias("fp")))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
