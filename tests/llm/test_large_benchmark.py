"""Decontamination against a benchmark that is joined: the same rows as with one that is broadcast."""

import random

import pytest

from confab.llm import decontaminate
from tests.llm.test_text_operators import AWKWARD, documents, prose


@pytest.mark.parametrize("bits", [1 << 27, 64])  # a map of 64 bits lets nearly everything pass
def test_joined_and_broadcast_agree(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAP_BITS", bits)
    rng = random.Random(31)
    passages = [prose(rng, n) for n in (12, 30, 10, 4, 1)]
    items = [(i, f"{prose(rng, 6)} {rng.choice(passages[:3])} {prose(rng, 6)}") for i in range(12)] + [(20, passages[3]), (21, passages[4]), (22, None), (None, passages[0]), (23, ""), (24, passages[0]), (24, passages[1])]
    texts = [f"{prose(rng, 40)} {rng.choice(passages)} {prose(rng, 40)} {rng.choice(['', passages[0]])}" for _ in range(60)] + [passages[0]] * 30 + AWKWARD
    docs, bench = documents(spark, texts).drop("n_chars"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    one = decontaminate.mark_contamination(docs, bench)
    many = decontaminate.mark_contamination(docs, bench, block_bytes=1)
    assert many.columns == one.columns and rows(many) == rows(one)
    assert one.where("size(item_ids) > 3").count() > 20


def test_joined_benchmark_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    clash = documents(spark, ["one two three four", "", None]).withColumnsRenamed({"lang": "_row", "source": "n_words"})
    got = {r.doc_id: (r.n_words, len(r.hit_spans), r.item_ids) for r in decontaminate.mark_contamination(clash, bench, block_bytes=1).collect()}
    assert got == {0: (4, 1, ["1"]), 1: (0, 0, []), 2: (0, 0, [])}
    assert decontaminate.mark_contamination(clash.where("false"), bench, block_bytes=1).count() == 0
    assert decontaminate.mark_contamination(clash, bench.where("false"), block_bytes=-1).where("size(item_ids) > 0").count() == 0
