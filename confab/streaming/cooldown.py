"""Admission of requests by key: a cooldown after each admitted request, and one at a time, with state by key and timers.

Requests and the ends of what they started come as one stream of events (key, kind, at). A request whose key was admitted less than
``cooldown_ms`` ago is refused. One that comes after that, but while the one before it still runs, is refused too, and begins the
cooldown anew. A run ends with its ``done`` event, or after ``lease_ms`` if that is lost.

Each key's state is two numbers. A timer removes it once it can no longer refuse anything, so the state holds the keys of the last
cooldown or lease, however many there ever were. Time is that of the events; what is later than the watermark allows is dropped by Spark.

Defined cases: of events of one key in a micro-batch the earlier come first, ``done`` before requests of the same time; a ``done`` without
a run changes nothing; null keys are a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Of message syncs, of topic refreshes, and after which a run counts as lost.
SYNC_MS, TOPICS_MS, LEASE_MS = 5_000, 15_000, 60_000
REQUEST, DONE = "request", "done"
OUT = "key string, at timestamp, admitted boolean, reason string"


def decide(last: int | None, until: int | None, at: int, cooldown_ms: int, lease_ms: int) -> tuple[int, int | None, bool, str]:
    """A request at ``at``: (last, until, admitted, reason). last: when the cooldown began. until: when the lease of a run ends."""
    if last is not None and at - last < cooldown_ms:
        return last, until, False, "cooldown"
    if until is not None and at < until:
        return at, until, False, "in flight"
    return at, at + lease_ms, True, "admitted"


class Admission(StatefulProcessor):
    def __init__(self, cooldown_ms: int, lease_ms: int):
        self.cooldown_ms, self.lease_ms = cooldown_ms, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("admission", "last long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, until = tuple(self.state.get()) if self.state.exists() else (None, None)
        for at, kind in sorted((r.at_ms, r.kind) for r in rows):
            if kind == DONE:
                until = None
                continue
            last, until, admitted, reason = decide(last, until, at, self.cooldown_ms, self.lease_ms)
            yield Row(key=key[0], at_ms=at, admitted=admitted, reason=reason)
        self._keep(last, until)

    def _keep(self, last: int | None, until: int | None) -> None:
        """Stores the state, and sets the one timer by which it will mean nothing."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if last is None:
            self.state.clear()
            return
        self.state.update((last, until))
        self.handle.registerTimer(max(last + self.cooldown_ms, until or 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted(events: DataFrame, *, cooldown_ms: int = SYNC_MS, lease_ms: int = LEASE_MS, late: str = "10 seconds") -> DataFrame:
    """key, at, admitted and reason of every request of a stream. events: key, kind and at (timestamp)."""
    use_rocks(events.sparkSession)
    timed = events.select(F.col("key").cast("string").alias("key"), "kind", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    out = timed.groupBy("key").transformWithState(Admission(cooldown_ms, lease_ms), "key string, at_ms long, admitted boolean, reason string", "Append", "EventTime")
    return out.select("key", F.timestamp_millis("at_ms").alias("at"), "admitted", "reason")


def use_rocks(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


sync_requests, topic_requests = partial(admitted, cooldown_ms=SYNC_MS), partial(admitted, cooldown_ms=TOPICS_MS)
