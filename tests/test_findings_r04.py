"""Cases of the fourth round's findings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from confab.operators import listing


def test_pairs_of_a_large_group_take_little_disk(spark, tmp_path):
    n = 3000
    listing.related_guides(spark.range(n).select("id", F.lit(None).cast("long").alias("group_id"))).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.2 * n * (n - 1)


def test_pairs_of_many_parts_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(listing, "PAIR_PART", 7)
    monkeypatch.setattr(listing, "PAIR_BLOCK", 3)
    of = random.Random(3)
    rows = [(of.choice([None, -5, 3, 3, 2**62, *range(40)]), of.choice([None, 0, 1, -1])) for _ in range(400)]
    got = listing.related_guides(spark.createDataFrame(rows, "id long, group_id long"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, g in rows for b, h in rows if g == h and None not in (a, b) and a != b)


def test_no_task_holds_the_pairs_of_a_block(spark):
    """The explode of guides hands on its rows one at a time, so it must not be compiled into one loop with the next."""
    found = listing.related_guides(spark.range(100).select("id", (F.col("id") % 3).alias("group_id")))
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    lines = [x for x in plan.toString().splitlines() if "Generate explode(" in x]
    assert "explode(_block" in lines[0] and "*(" in lines[0], lines
    assert "explode(transform(_a" in lines[1] and "*(" not in lines[1], lines
