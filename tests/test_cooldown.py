"""Admission of requests by key: against a plain version, over batches, and what state is left."""

import datetime as dt
import random

import pytest

from confab.streaming import cooldown

EVENT = "key string, kind string, at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plain(events, cooldown_ms, lease_ms):
    state, out = {}, []
    for at, kind, key in sorted((at, kind, key) for key, kind, at in events):
        last, until = state.get(key, (None, None))
        if kind == "done":
            state[key] = (last, None)
        elif last is not None and at - last < cooldown_ms:
            out.append((key, at, False, "cooldown"))
        elif until is not None and at < until:
            state[key] = (at, until)
            out.append((key, at, False, "in flight"))
        else:
            state[key] = (at, at + lease_ms)
            out.append((key, at, True, "admitted"))
    return sorted(out)


def test_decisions():
    d = lambda last, until, at: cooldown.decide(last, until, at, 5, 60)[2:]
    assert d(None, None, 0) == (True, "admitted") and d(0, 60, 4) == (False, "cooldown") and d(0, 60, 5) == (False, "in flight") and d(0, None, 5) == (True, "admitted") and d(0, 60, 60) == (True, "admitted")


@pytest.fixture
def feed(spark, tmp_path):
    folder, n = tmp_path / "events", [0]
    folder.mkdir()

    def write(events):
        n[0] += 1
        rows = [(k, kind, START + dt.timedelta(milliseconds=at)) for k, kind, at in events]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}")

    return str(folder), write


def run(spark, folder, tmp_path, **settings):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    out = f"{tmp_path}/out"
    query = cooldown.admitted(stream, **settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("key string, at timestamp, admitted boolean, reason string").parquet(out).collect()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return sorted((r.key, round((r.at.astimezone(dt.timezone.utc) - START).total_seconds() * 1000), r.admitted, r.reason) for r in rows), states


def test_requests_of_many_keys_over_batches(spark, feed, tmp_path):
    folder, write = feed
    rng, events, at = random.Random(4), [], 0
    for _ in range(200):
        at += rng.choice([100, 900, 2500])
        events.append((rng.choice("abcd"), rng.choice(["request", "request", "request", "done"]), at))
    for i in range(0, 200, 50):
        write(events[i : i + 50])
    got, _ = run(spark, folder, tmp_path, cooldown_ms=5000, lease_ms=20_000)
    want = plain(events, 5000, 20_000)
    assert got == want and {r[3] for r in want} == {"admitted", "cooldown", "in flight"}


def test_state_goes_after_its_timer_and_lives_through_a_restart(spark, feed, tmp_path):
    folder, write = feed
    write([("a", "request", 0), ("b", "request", 100)])
    got, _ = run(spark, folder, tmp_path, cooldown_ms=5000, lease_ms=5000, late="0 seconds")
    assert got == [("a", 0, True, "admitted"), ("b", 100, True, "admitted")]
    write([("a", "request", 4000)])  # after a restart, still in the cooldown
    got, _ = run(spark, folder, tmp_path, cooldown_ms=5000, lease_ms=5000, late="0 seconds")
    assert ("a", 4000, False, "cooldown") in got
    write([("c", "request", 60_000)])
    write([("c", "done", 60_001)])
    got, states = run(spark, folder, tmp_path, cooldown_ms=5000, lease_ms=5000, late="0 seconds")
    assert ("c", 60_000, True, "admitted") in got
    write([("a", "request", 61_000)])
    got, _ = run(spark, folder, tmp_path, cooldown_ms=5000, lease_ms=5000, late="0 seconds")
    assert ("a", 61_000, True, "admitted") in got
