"""Conversation chains: replies up and down, what was said nearby, put in order.

Messages carry id, telegram_message_id, group_id, reply_to_message_id, topic_id, sender_telegram_user_id, message_date. Roots
are messages too; every function works on all roots at once. Each level of a reply tree is one equi-join on (group, message
number); levels are written to the shared folder, so plans stay short, and a path of visited ids ends cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab import config as K
from confab.sources.storage import cut


def reply_parents(messages: DataFrame) -> DataFrame:
    """id and parent_id of every message that replies; null where the parent is missing."""
    parent = messages.select(F.col("group_id").alias("_g"), F.col("telegram_message_id").alias("_t"), F.col("id").alias("parent_id"))
    m = messages.where("reply_to_message_id is not null")
    return m.join(parent, (F.col("group_id") == F.col("_g")) & (F.col("reply_to_message_id") == F.col("_t")), "left").select("id", "parent_id")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """root_id, id, depth of all that edges (from, to) lead to from each start (root_id), the start itself left out."""
    frontier = start.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"), F.array("root_id").alias("path"))
    found = []
    while True:
        step = frontier.join(edges, F.col("id") == F.col("from")).where(~F.array_contains("path", F.col("to")))
        frontier = cut(step.select("root_id", F.col("to").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("to")).alias("path")), "closure")
        if not frontier.head(1):
            break
        found.append(frontier.select("root_id", "id", "depth"))
    out = reduce(DataFrame.unionByName, found) if found else frontier.select("root_id", "id", "depth")
    return out.groupBy("root_id", "id").agg(F.min("depth").alias("depth"))


def ancestors(messages: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    edges = reply_parents(messages).where("parent_id is not null").select(F.col("id").alias("from"), F.col("parent_id").alias("to"))
    return closure(edges, (messages if roots is None else roots).select(F.col("id").alias("root_id")))


def descendants(messages: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    edges = reply_parents(messages).where("parent_id is not null").select(F.col("parent_id").alias("from"), F.col("id").alias("to"))
    return closure(edges, (messages if roots is None else roots).select(F.col("id").alias("root_id")))


def is_context(root: str, other: str, include_replies: bool) -> Column:
    """Whether a message nearby belongs to the root's conversation. root, other: prefixes of their columns."""
    r, o = (lambda c: F.col(f"{root}{c}")), (lambda c: F.col(f"{other}{c}"))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = no(r("topic_id") == o("topic_id")) | no(r("reply_to_message_id") == o("telegram_message_id")) | no(r("sender_telegram_user_id") == o("sender_telegram_user_id"))
    if include_replies:
        out = out | no(o("reply_to_message_id") == r("telegram_message_id"))
    return out | (r("topic_id").isNull() & o("reply_to_message_id").isNull())


NEEDED = ["id", "telegram_message_id", "group_id", "reply_to_message_id", "topic_id", "sender_telegram_user_id", "message_date"]


def nearby(messages: DataFrame, roots: DataFrame | None = None, *, window_minutes: int = 5, include_replies: bool = True) -> DataFrame:
    """root_id and id of the messages of a root's group after its window's begin (exclusive) and up to its end (inclusive).

    A band join on slots of the window's width: an equi-join probes the slot before, the own and the next, so a busy group is
    spread over its time line and no two far-apart messages meet.
    """
    seconds = window_minutes * 60
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    r = (messages if roots is None else roots).select(*(F.col(c).alias(f"r_{c}") for c in NEEDED)).withColumn("_slot", F.explode(F.array(*(slot("r_message_date") + i for i in (-1, 0, 1)))))
    o = messages.select(*(F.col(c).alias(f"o_{c}") for c in NEEDED)).withColumn("_slot", slot("o_message_date"))
    width = F.expr(f"interval {seconds} seconds")
    met = r.join(o, (F.col("r_group_id") == F.col("o_group_id")) & (r["_slot"] == o["_slot"])).where(
        (F.col("o_message_date") > F.col("r_message_date") - width) & (F.col("o_message_date") <= F.col("r_message_date") + width) & (F.col("r_id") != F.col("o_id"))
    )
    return met.where(is_context("r_", "o_", include_replies)).select(F.col("r_id").alias("root_id"), F.col("o_id").alias("id"))


def chains(messages: DataFrame, roots: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """root_id, position and id: each root's conversation, oldest first, cut after ``max_messages``.

    The cut keeps the oldest, so a root can drop out of its own chain. Equal times stay in the order root, ancestors from the
    nearest, replies by level, nearby.
    """
    config = K.CHAIN if config is None else config
    roots = messages if roots is None else roots
    parts = [roots.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("kind"), F.lit(0).alias("depth"))]
    parts.append(ancestors(messages, roots).select("root_id", "id", F.lit(1).alias("kind"), "depth"))
    if config["include_replies"]:
        parts.append(descendants(messages, roots).select("root_id", "id", F.lit(2).alias("kind"), "depth"))
    if config["window_minutes"] > 0:
        near = nearby(messages, roots, window_minutes=config["window_minutes"], include_replies=config["include_replies"])
        parts.append(near.select("root_id", "id", F.lit(3).alias("kind"), F.lit(0).alias("depth")))
    members = reduce(DataFrame.unionByName, parts).groupBy("root_id", "id").agg(F.min(F.struct("kind", "depth")).alias("rank"))
    dated = members.join(messages.select("id", "message_date"), "id")
    w = W.partitionBy("root_id").orderBy("message_date", "rank", "id")
    return dated.withColumn("position", F.row_number().over(w)).where(F.col("position") <= config["max_messages"]).select("root_id", "position", "id")


def chain_view(messages: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """What a reader sees: the direct parent, the root, and all replies below it. root_id, id, depth, kind."""
    roots = messages if roots is None else roots
    parent = reply_parents(messages).join(roots.select("id"), "id", "left_semi").where("parent_id is not null")
    own = roots.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    rows = parent.select(F.col("id").alias("root_id"), F.col("parent_id").alias("id"), F.lit(-1).alias("depth")).unionByName(own).unionByName(descendants(messages, roots))
    threads = parent.select(F.col("id").alias("root_id"), F.lit("reply_branch").alias("kind"))
    return rows.join(threads, "root_id", "left").select("root_id", "id", "depth", F.coalesce("kind", F.lit("thread_root")).alias("kind"))


def relation(root: str, other: str) -> Column:
    """How a chain's message stands to its root."""
    r, o = (lambda c: F.col(f"{root}{c}")), (lambda c: F.col(f"{other}{c}"))
    return (
        F.when(r("id").isNull() | o("id").isNull(), F.lit("UNKNOWN")).when(r("id") == o("id"), F.lit("ROOT")).when(r("reply_to_message_id") == o("telegram_message_id"), F.lit("PARENT_REPLY"))
        .when(o("reply_to_message_id") == r("telegram_message_id"), F.lit("DIRECT_REPLY")).when(o("reply_to_message_id").isNotNull() | r("reply_to_message_id").isNotNull(), F.lit("THREAD_REPLY"))
        .when(r("topic_id") == o("topic_id"), F.lit("SAME_TOPIC_NEARBY")).when(r("sender_telegram_user_id") == o("sender_telegram_user_id"), F.lit("SAME_AUTHOR_NEARBY"))
        .otherwise(F.lit("TIMELINE_NEARBY"))
    )


def chain_relations(messages: DataFrame, chain: DataFrame) -> DataFrame:
    r = messages.select(*(F.col(c).alias(f"r_{c}") for c in NEEDED))
    o = messages.select(*(F.col(c).alias(f"o_{c}") for c in NEEDED))
    met = chain.join(r, F.col("root_id") == F.col("r_id")).join(o, F.col("id") == F.col("o_id"))
    return met.select("root_id", "position", "id", relation("r_", "o_").alias("relation"))


def collected(messages: DataFrame, chain: DataFrame) -> DataFrame:
    """root_id and chain: array of its messages' structs in order. A chain is bounded by ``max_messages``."""
    fields = ["id", "sender_name", "text", "is_bot", "reply_count", "topic_id"]
    rows = chain.join(messages.select(*fields), "id").groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("chain"))
    return rows


def joined_text(chain: Column, separator: str = " ", blank: bool = True) -> Column:
    """Texts of a chain on end; nulls are left out, and blank ones unless ``blank``."""
    kept = F.filter(F.transform(chain, lambda m: m["text"]), lambda t: t.isNotNull() if blank else t.isNotNull() & t.rlike(r"\S"))
    return F.array_join(kept, separator)
