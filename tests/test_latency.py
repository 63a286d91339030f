"""Latency sketches against exact quantiles, merged in parts and stored."""

import datetime as dt
import math
import random

from confab.operators import latency
from confab.sources.versions import Versions

KIND = "stage string, started_at timestamp_ntz, duration_ms long"


def traces(spark, rng, n, stages=("RULES", "GUIDE_GENERATION")):
    rows = [(rng.choice(stages), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 600)), rng.choice([None, 0, int(rng.lognormvariate(5, 2))])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, KIND)


def exact(values, q):
    return sorted(values)[max(1, math.ceil(q * len(values))) - 1]


def test_quantiles_are_within_the_error(spark):
    rows, df = traces(spark, random.Random(1), 5000)
    shares = {f"q{int(q * 100)}": q for q in (0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 1.0)}
    got = {r.stage: r for r in latency.quantiles(latency.sketches(df), shares).collect()}
    for stage in ("RULES", "GUIDE_GENERATION"):
        values = [d for s, _, d in rows if s == stage and d is not None]
        assert got[stage].n == len(values)
        for name, q in shares.items():
            assert abs(got[stage][name] - exact(values, q)) <= latency.ERROR * exact(values, q) + 1e-9


def test_parts_merge_to_the_whole(spark, tmp_path):
    rng = random.Random(2)
    parts = [traces(spark, rng, 400)[1] for _ in range(3)]
    whole = parts[0].union(parts[1]).union(parts[2])
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(latency.merged(*map(latency.sketches, parts))) == rows(latency.sketches(whole))
    table = Versions(spark, f"{tmp_path}/latency")
    for n, p in enumerate(parts):
        table.append(latency.sketches(p), tag=f"batch-{n}")
    table.append(latency.sketches(parts[2]), tag="batch-2")  # a batch that comes again
    assert rows(latency.quantiles(table.read())) == rows(latency.quantiles(latency.sketches(whole)))
    assert rows(latency.quantiles(table.read(), by=["hour", "stage"])) == rows(latency.quantiles(latency.sketches(whole), by=["hour", "stage"]))


def test_nothing_to_measure(spark):
    none = spark.createDataFrame([("RULES", dt.datetime(2024, 1, 1), None)], KIND)
    assert latency.quantiles(latency.sketches(none)).count() == 0 and latency.quantiles(latency.sketches(none.where("false"))).count() == 0
