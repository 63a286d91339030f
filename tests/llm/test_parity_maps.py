"""Pairs that small maps rule out never move their sequences, and no pair that reaches the limit is ruled out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import common, order_minhash, wordhash

U = np.uint64


def prose(rng, n: int) -> np.ndarray:
    """Words of a small vocabulary, so that long texts have many words in common."""
    return wordhash.mix(rng.integers(1, 2000, n).astype(U))


def test_a_map_never_rules_out_what_is_similar():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 63, 64, 65, 129, 500, 1025, 3000):
        x = prose(rng, n)
        texts = [x, prose(rng, n), prose(rng, 2 * n), x[::-1].copy()]
        for edits in (1, n // 20, n // 9, n // 4):
            other = x.copy()
            other[rng.integers(0, n, edits)] = prose(rng, edits)
            texts += [other, other[: max(1, n - edits)], np.concatenate((other, prose(rng, edits)))]
        for y in texts:
            bound = order_minhash.most_similar(order_minhash.parity_map(x), order_minhash.parity_map(y), len(x), len(y))
            assert bound >= order_minhash.similarity(x, y, 0.0)
            assert bound == order_minhash.most_similar(order_minhash.parity_map(y), order_minhash.parity_map(x), len(y), len(x))
    x, y = prose(rng, 2000), prose(rng, 2000)
    assert order_minhash.most_similar(order_minhash.parity_map(x), order_minhash.parity_map(y), 2000, 2000) < order_minhash.SIMILARITY


@pytest.mark.parametrize("most", (0, 1 << 20))
def test_only_sequences_of_pairs_that_maps_leave_move(spark, monkeypatch, most):
    """Of all pairs of twenty long texts one is near; only its sequences go through a join. By broadcast pairs or not."""
    rng = np.random.default_rng(4)
    texts = [prose(rng, 1500 + 10 * i) for i in range(19)]
    near = texts[0].copy()
    near[::50] = prose(rng, 30)
    texts.append(near)
    docs = spark.createDataFrame([(i, " ".join(map(str, t))) for i, t in enumerate(texts)], "doc_id long, text string").cache()
    monkeypatch.setattr(order_minhash, "FEW_PAIRS", most)
    keys = docs.select("doc_id", "text")
    signed = order_minhash.signatures(keys, "doc_id", "text", 5, 1, 1).select("id", "k")
    seqs = order_minhash.sequences(docs, signed.select("k", "id"), "doc_id", "text")
    pairs = seqs.select(F.col("k").alias("a")).crossJoin(seqs.select(F.col("k").alias("b"))).where("a > b")
    moved = spark.sparkContext.accumulator(0)
    real = order_minhash.similarity

    def counted(a, b, least):
        moved.add(1)
        return real(a, b, least)

    monkeypatch.setattr(order_minhash, "similarity", counted)
    met = common.cut(order_minhash.aligned(pairs, seqs, 0.8), "met").collect()
    id_of = {r.k: r.id for r in signed.collect()}
    assert len(met) == 190 and moved.value == 1
    assert [{id_of[r.a], id_of[r.b]} for r in met if r.s >= 0.8] == [{0, 19}]


def test_rows_of_rare_words_move_once(spark):
    """The rows go through one exchange to sums and join alike, but for buckets of more than 1024 rows, which give the same pairs."""
    rows = [(k, 10 + k % 2, b) for b, size in ((1, 2), (2, 7), (3, 1300)) for k in range(size)]
    found = spark.createDataFrame([(k, 5) for k in range(5, 1290)], "k long, c long")
    pairs = order_minhash.rest_pairs(spark.createDataFrame(rows, "k long, n long, bucket long"), found, 0.8)
    c = {k: 5 if 5 <= k < 1290 else k for k in range(1300)}
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(1300) for b in range(a) if c[a] != c[b]}
    # Four places of the plan take them, three of these from the exchange of the first.
    assert pairs._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 3


def test_buckets_of_one_class_do_not_move_their_rows(spark, monkeypatch):
    """Of 600 buckets one is of two classes. Only its rows are held against its hub, and these are the same as before."""
    rows = spark.createDataFrame([(k, 9, k, k // 2, k // 2) for k in range(1200)] + [(1, 9, 1, 0, 7000), (3, 9, 3, 1, 7000), (5, 9, 5, 1, 7000)], "k long, n long, met long, c long, bucket long")
    kept = []
    real = order_minhash.likely
    monkeypatch.setattr(order_minhash, "likely", lambda *a: (kept.append(real(*a)), kept[-1])[1])
    got = [tuple(r) for r in order_minhash.towards_hub(rows).collect()]
    assert got == [(7000, 1, 9, 1, 5, 9)]
    assert len(kept) == 1 and 3 <= kept[0].count() < 200
