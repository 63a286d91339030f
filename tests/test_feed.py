"""The chat feed's data source: pages, time-outs, and what a killed stream has afterwards."""

import json
import time

import pytest
from pyspark.sql import functions as F

from confab.sources import feed
from confab.streaming import ingest
from tests import fake_feed

CLIENT = "tests.fake_feed:client"
NOW = "2024-01-10"


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/feed.json"


def test_pages_shrink_after_time_outs(path):
    numbers = list(range(1, 200))
    for slow, sizes in ((1000, [100]), (50, [100, 20]), (15, [100, 20, 10]), (7, [100, 20, 10, 5])):
        fake_feed.write(path, chats={"1": numbers}, slow={"1": slow})
        before = len(fake_feed.asked(path))
        assert [m["id"] for m in feed.history_page(fake_feed.Client({"path": path}), 1, 0, 100)] == numbers[::-1][: sizes[-1]]
        assert [int(x.split()[2]) for x in fake_feed.asked(path)[before:]] == sizes
    fake_feed.write(path, chats={"1": numbers}, slow={"1": 3})
    with pytest.raises(TimeoutError):
        feed.history_page(fake_feed.Client({"path": path}), 1, 0, 100)
    assert [m["id"] for m in feed.latest_messages(fake_feed.Client({"path": path}), 1, 100)] == [199]


def test_other_errors_are_not_asked_again(path):
    fake_feed.write(path, chats={"1": [1, 2]}, broken=[1])
    with pytest.raises(ValueError):
        feed.history_page(fake_feed.Client({"path": path}), 1, 0, 100)
    assert len(fake_feed.asked(path)) == 1


def test_a_call_that_hangs_is_a_time_out():
    began = time.time()
    with pytest.raises(TimeoutError):
        feed.within(0.2, lambda: time.sleep(5))
    assert time.time() - began < 2 and feed.within(2, lambda: 7) == 7


@pytest.mark.parametrize("page", [1, 3, 100])
@pytest.mark.parametrize(("after", "upto", "most", "want"), [(None, 9, None, [9, 7, 5, 3, 1]), (3, 7, None, [7, 5]), (None, 9, 2, [9, 7]), (9, 9, None, []), (None, 8, 3, [7, 5, 3]), (0, 100, None, [9, 7, 5, 3, 1])])
def test_messages_of_a_range(path, page, after, upto, most, want):
    fake_feed.write(path, chats={"1": [1, 3, 5, 7, 9]})
    assert [m["id"] for m in feed.messages_between(fake_feed.Client({"path": path}), 1, after, upto, most, page)] == want


def polled(spark, path, **options):
    spark.dataSource.register(feed.ChatFeed)
    rows = spark.read.format("chat_feed").options(client=CLIENT, path=path, **options).load()
    return sorted((r.chat_id, r.id) for r in rows.collect())


def test_polls_ask_known_chats_for_more(spark, path):
    numbers = list(range(1, 300))
    fake_feed.write(path, chats={"1": numbers, "2": numbers, "3": [], "4": numbers, "5": numbers}, slow={"4": 1}, broken=[5], mute=[5])
    got = polled(spark, path, marks=json.dumps({"2": 150}), chatsPerPartition="2")
    assert [n for c, n in got if c == 1] == numbers[-20:] and [n for c, n in got if c == 2] == numbers[-100:]
    assert [n for c, n in got if c == 4] == [299] and not any(c in (3, 5) for c, _ in got)  # a chat that fails does not stop the others
    assert polled(spark, path, chats="[2]", first="3") == [(2, 297), (2, 298), (2, 299)] and polled(spark, path, chats="[]") == []


def stored(spark, table):
    return sorted((r.telegram_chat_id, r.telegram_message_id) for r in spark.read.parquet(table).collect())


def test_stream_goes_on_after_a_kill(spark, path, tmp_path):
    """A batch whose read fails and one whose write fails are repeated whole: nothing is lost, nothing comes twice."""
    table, checkpoint = f"{tmp_path}/messages", f"{tmp_path}/checkpoint"
    go = lambda: ingest.ingest_chats(spark, CLIENT, table, checkpoint, now=F.lit(NOW).cast("timestamp_ntz"), path=path, first="all", page="7").awaitTermination()
    fake_feed.write(path, chats={"-5": list(range(1, 30)), "6": [2, 4], "7": []})
    go()
    assert stored(spark, table) == [(-5, n) for n in range(1, 30)] + [(6, 2), (6, 4)]

    fake_feed.write(path, chats={"-5": list(range(1, 60)), "6": [2, 4, 9], "7": [1]}, slow={"-5": 3})  # every page is too slow
    with pytest.raises(Exception, match="timed out"):
        go()
    assert stored(spark, table) == [(-5, n) for n in range(1, 30)] + [(6, 2), (6, 4)]
    # Meanwhile more has come; the repeated batch has its own messages, the next one the rest.
    fake_feed.write(path, chats={"-5": list(range(1, 71)), "6": [2, 4, 9], "7": [1]}, slow={"-5": 6})
    go()
    go()
    want = [(-5, n) for n in range(1, 71)] + [(6, 2), (6, 4), (6, 9), (7, 1)]
    assert stored(spark, table) == want
    go()
    assert stored(spark, table) == want


def test_batches_do_not_overlap(spark, path, tmp_path):
    spark.dataSource.register(feed.ChatFeed)
    seen, fail = [], [True]

    def take(batch, number):
        rows = sorted(r.id for r in batch.collect())
        if number == 1 and fail.pop():
            raise RuntimeError("killed before the batch was stored")
        seen.append((number, rows))

    def go():
        rows = spark.readStream.format("chat_feed").options(client=CLIENT, path=path, first="4").load()
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()

    fake_feed.write(path, chats={"1": list(range(1, 11))})
    go()
    fake_feed.write(path, chats={"1": list(range(1, 16))})
    with pytest.raises(Exception, match="killed"):
        go()
    fake_feed.write(path, chats={"1": list(range(1, 21))})
    fail.append(False)
    go()
    go()
    numbers = [n for _, rows in seen for n in rows]
    assert seen[0] == (0, [7, 8, 9, 10]) and numbers == list(range(7, 21)) and seen[1] == (1, [11, 12, 13, 14, 15])
