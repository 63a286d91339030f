"""What hubs leave apart meets by rare words: every pair that reaches the limit, and no square of texts with a passage in common."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from confab.llm import order_minhash

U = np.uint64


def sequences(spark, texts: list[np.ndarray]):
    return spark.createDataFrame([(k, t.view(np.int64).tolist()) for k, t in enumerate(texts)], "k long, seq array<long>")


def test_rare_words_lose_no_pair_that_reaches_the_limit(spark):
    rng = random.Random(1)
    word = lambda: min(rng.randrange(1, 60) for _ in range(rng.randrange(1, 4)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((3, 4, 8, 9, 20, 60)))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 10)):
                own[rng.randrange(len(own))] = word()
            own.insert(rng.randrange(len(own) + 1), word())
            texts.append(np.array(own, U))
    found = spark.createDataFrame([(k, k - k % 4) for k in range(0, 40)], "k long, c long")
    near = {(a, b) for a in range(len(texts)) for b in range(a) if order_minhash.similarity(texts[a], texts[b], 0.8) >= 0.8 and not (a < 40 and a // 4 == b // 4)}
    got = {tuple(r) for r in order_minhash.rest_pairs(order_minhash.rare_buckets(sequences(spark, texts), 0.8), found, 0.8).collect()}
    assert len(near) > 50 and near <= got
    assert not [p for p in got if max(p) < 40 and p[0] // 4 == p[1] // 4]


def test_a_common_passage_and_a_large_class_make_no_square(spark, monkeypatch):
    """Texts of which two thirds are one passage, in any bucket of which all pairs would meet, and a class of 200 beside one other text."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(1, 1 << 62, n).astype(U)
    passage, common_words = draw(40), draw(50)
    apart = [np.concatenate((passage, draw(20))) for _ in range(200)]
    close = [np.concatenate((common_words, draw(2))) for _ in range(200)]
    other = [np.concatenate((common_words[:41], draw(11)))]
    found = spark.createDataFrame([(k, 200) for k in range(200, 400)], "k long, c long")
    asked = []
    docs = spark.createDataFrame([(k, " ".join(map(str, t))) for k, t in enumerate(apart + close + other)], "doc_id long, text string")
    real = order_minhash.rest_pairs
    monkeypatch.setattr(order_minhash, "rest_pairs", lambda *a: (asked.append(real(*a)), asked[-1])[1])
    got = order_minhash.near_duplicates(docs)
    assert got.groupBy("class_size").agg(F.count("*").alias("n")).orderBy("class_size").collect() == [(1, 201), (200, 200)]
    assert asked[0].count() <= 400
    assert order_minhash.rest_pairs(order_minhash.rare_buckets(sequences(spark, apart + close + other), 0.8), found, 0.8).count() <= 200


def test_deduplicate_needs_no_second_shuffle_of_texts_without_repeated_ids(spark, monkeypatch):
    """Distinct ids: the kept rows are joined by id only. Repeated ids: texts are held against their keys as before."""
    texts = ["one two three four five six"] * 2 + ["Seven eight, nine ten.", None, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = order_minhash.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    twice = order_minhash.deduplicate(docs.union(spark.createDataFrame([(0, "another text here")], docs.schema)))
    assert sorted((r.doc_id, r.text) for r in twice.where("doc_id < 3").collect()) == [(0, "another text here"), (0, texts[0]), (2, texts[2])]
