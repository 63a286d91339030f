"""Near-duplicates in a bucket whose hub is far from both of them."""

from __future__ import annotations

from confab.llm import order_minhash


def test_pairs_that_no_hub_joins_are_found(spark, monkeypatch):
    """Three pairs of texts share a passage. By the coarse sketch alone, which gives all one bucket, only pairs within it are left."""
    passage = [f"p{i}" for i in range(5)]
    bodies = [[f"t{g}w{i}" for i in range(60)] for g in range(3)]
    texts = [" ".join(passage + b + [e]) for b in bodies for e in ("x", "y z")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def one_bucket(docs, id_col, text_col, size, bands, picks):
        return real(docs, id_col, text_col, size, bands, picks).selectExpr("id", "k", "array(7L) as sketch", "n")

    def none(seqs):
        return seqs.selectExpr("k", "cast(size(seq) as long) as n", "met", "c", "k as bucket")

    real = order_minhash.signatures
    monkeypatch.setattr(order_minhash, "signatures", one_bucket)
    monkeypatch.setattr(order_minhash, "fine_buckets", none)
    got = {r.doc_id: (r.class_id, r.class_size) for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (2, 2), 4: (4, 2), 5: (4, 2)}
    # By the public form of the step, with classes that are joined already.
    rows = spark.createDataFrame([(1, 10, 7), (2, 10, 7), (3, 10, 7), (4, 4, 7), (5, 10, 8)], "k long, n long, bucket long")
    found = spark.createDataFrame([(1, 1), (2, 1)], "k long, c long")
    assert sorted(map(tuple, order_minhash.rest_pairs(rows, found, 0.8).collect())) == [(3, 1), (3, 2)]
