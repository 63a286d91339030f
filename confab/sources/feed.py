"""The chat feed as a Python data source: the latest messages of each chat as a batch, new ones as a stream.

The feed is reached through a client, named by the option ``client`` as ``module:factory`` and made in each Python worker from the
options. A client has ``chats()``, ``history(chat, before, limit)`` (newest first, only below the number ``before``, 0: from the newest;
``TimeoutError`` if the feed takes too long) and ``latest(chat)`` (a message or None). Messages are dicts of ``FEED``'s fields.

    spark.dataSource.register(ChatFeed)
    spark.read.format("chat_feed").option("client", "my.clients:connect").load()        # polls every chat once
    spark.readStream.format("chat_feed").option("client", "my.clients:connect").load()  # goes on where it stopped

A page that times out is asked again with fewer messages (n, 20, 10, 5). A poll then makes do with the chat's last message, or
leaves the chat out: the next poll has the rest. The stream cannot do that, since what it leaves out would not come again: there
a page that cannot be had fails the task, and the batch is repeated.

The stream's offsets are the last message number of each chat. A batch's messages are those above one offset and up to the next,
whatever the chat has got meanwhile, so a batch that is repeated after a lost executor or a killed query has the same messages, and
each message is in one batch. Offsets are one number a chat on the driver; messages are only read in the tasks, one chat at a time,
page by page.

Defined cases: a chat without messages gives none; the first batch of a chat has its newest ``first`` messages (``all``: all of them);
a last message that was deleted does not move an offset back.
"""

from __future__ import annotations

import importlib
import json
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FEED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("chat_id", T.LongType()), T.StructField("thread_id", T.LongType()), T.StructField("topic_name", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("sender_name", T.StringType()), T.StructField("sender_id", T.LongType()),
    T.StructField("is_bot", T.BooleanType()), T.StructField("reply_to", T.LongType()), T.StructField("date", T.LongType()),
])
#: Messages of a page at most, those of a chat's first and further polls, pages after a time-out, and seconds that a page may take.
PAGE, FIRST, NEXT, SMALLER, SECONDS = 100, 20, 100, (20, 10, 5), 8.0


class FeedClient(Protocol):
    def chats(self) -> list[int]: ...
    def history(self, chat: int, before: int, limit: int) -> list[dict[str, Any]]: ...
    def latest(self, chat: int) -> dict[str, Any] | None: ...


def connect(options: dict[str, str]) -> FeedClient:
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


def within(seconds: float, call):
    """What ``call`` returns, or ``TimeoutError`` if it takes longer; a call that hangs is left behind."""
    out: list[tuple[bool, Any]] = []

    def work() -> None:
        try:
            out.append((True, call()))
        except BaseException as error:
            out.append((False, error))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer in {seconds} s")
    good, got = out[0]
    if not good:
        raise got
    return got


def history_page(client: FeedClient, chat: int, before: int, limit: int, seconds: float = SECONDS) -> list[dict[str, Any]]:
    """A page of a chat's history, a smaller one after each time-out. Other errors, and a time-out of the smallest page, are raised."""
    sizes = [n for n in (limit, *(min(limit, n) for n in SMALLER)) if n > 0]
    for at, size in enumerate(sizes):
        try:
            return within(seconds, lambda: client.history(chat, before, size))
        except TimeoutError:
            if size <= SMALLER[-1] or at == len(sizes) - 1:
                raise
    return []


def latest_messages(client: FeedClient, chat: int, limit: int, seconds: float = SECONDS) -> list[dict[str, Any]]:
    """A poll of one chat: a page from its newest message; if it cannot be had, the last message alone, or nothing."""
    try:
        return history_page(client, chat, 0, limit, seconds)
    except Exception:  # whatever stops one chat must not stop the others
        try:
            last = within(seconds, lambda: client.latest(chat))
        except Exception:
            return []
        return [] if last is None else [last]


def messages_between(client: FeedClient, chat: int, after: int | None, upto: int, most: int | None, page: int = PAGE, seconds: float = SECONDS) -> Iterator[dict[str, Any]]:
    """Messages above ``after`` (None: from the first) and up to ``upto``, newest first, ``most`` at most."""
    before = upto + 1
    while True:
        got = [m for m in history_page(client, chat, before, page if most is None else min(page, most), seconds) if m["id"] < before]
        for m in got:
            if (after is not None and m["id"] <= after) or most == 0:
                return
            yield m
            most = None if most is None else most - 1
        if not got or most == 0:
            return
        before = min(m["id"] for m in got)


def as_row(chat: int, message: dict[str, Any]) -> tuple:
    return tuple(chat if f == "chat_id" else message.get(f) for f in FEED.names)


@dataclass
class Polled(InputPartition):
    """Chats and how many messages to ask each for."""

    chats: list[tuple[int, int]]


@dataclass
class Between(InputPartition):
    """A chat's messages above ``after`` (None: its newest ``most``) and up to ``upto``."""

    chat: int
    after: int | None
    upto: int
    most: int | None


class ChatReader(DataSourceReader):
    """Options: chats (JSON list; the client's), marks (JSON map of chats that were polled before), first, next, chatsPerPartition, seconds."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Polled]:
        o = self.options
        chats = json.loads(o["chats"]) if "chats" in o else connect(o).chats()
        known = {int(c) for c, mark in json.loads(o.get("marks", "{}")).items() if mark}
        wanted = [(c, int(o.get("next", NEXT)) if c in known else int(o.get("first", FIRST))) for c in chats]
        size = int(o.get("chatsperpartition", 16))
        return [Polled(wanted[at : at + size]) for at in range(0, len(wanted), size)] or [Polled([])]

    def read(self, partition: Polled) -> Iterator[tuple]:
        if partition.chats:
            client, seconds = connect(self.options), float(self.options.get("seconds", SECONDS))
            for chat, limit in partition.chats:
                yield from (as_row(chat, m) for m in latest_messages(client, chat, min(limit, PAGE), seconds))


class ChatStream(DataSourceStreamReader):
    """Options: chats (JSON list; the client's, asked again at each batch), first (or ``all``), page, seconds."""

    def __init__(self, options: dict[str, str]):
        self.options, self.client, self.known = options, connect(options), {}

    def initialOffset(self) -> dict:
        return {"chats": {}}

    def latestOffset(self) -> dict:
        chats = json.loads(self.options["chats"]) if "chats" in self.options else self.client.chats()
        for chat in chats:
            last = within(float(self.options.get("seconds", SECONDS)), lambda chat=chat: self.client.latest(chat))
            if last is not None:
                self.known[str(chat)] = max(self.known.get(str(chat), 0), last["id"])
        return {"chats": dict(self.known)}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        began = start.get("chats", {})
        self.known = {c: max(n, self.known.get(c, 0)) for c, n in {**self.known, **began, **end["chats"]}.items()}
        first = self.options.get("first", str(FIRST))
        out = []
        for chat, upto in end["chats"].items():
            after = began.get(chat)
            if after is None or upto > after:
                out.append(Between(int(chat), after, upto, None if after is not None or first == "all" else int(first)))
        return out

    def read(self, partition: Between) -> Iterator[tuple]:
        p, o = partition, self.options
        found = messages_between(connect(o), p.chat, p.after, p.upto, p.most, int(o.get("page", PAGE)), float(o.get("seconds", SECONDS)))
        yield from (as_row(p.chat, m) for m in found)


class ChatFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_feed"

    def schema(self) -> T.StructType:
        return FEED

    def reader(self, schema: T.StructType) -> ChatReader:
        return ChatReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> ChatStream:
        return ChatStream(dict(self.options))
