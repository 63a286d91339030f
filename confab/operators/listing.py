"""Lists as callers see them: filtered, joined to names, sorted with a tie-break by id, cut to pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions import text as X
from confab.sources import storage


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> dict:
    """A page as the interface returns it."""
    total = rows.count()
    return {"content": page(rows, order, number, size), "page": number, "size": size, "total_elements": total, "total_pages": -(-total // size)}


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All ``rows`` with ``place``, from 1, in the order. Sorted by ranges and numbered in each, so no task has all rows."""
    number = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    parts = storage.cut(rows.orderBy(*order).withColumn("_n", number), "placed").withColumn("_part", F.shiftright("_n", 33))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(before), "_part").withColumn("place", place).drop("_part", "_n", "_before")


def by_columns(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters; null and blank arguments do not filter."""
    for name, value in wanted.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows


def by_keys(rows: DataFrame, column: str, keys: list | DataFrame) -> DataFrame:
    """Rows of the given keys: a literal list, or a table of keys (first column)."""
    if isinstance(keys, DataFrame):
        return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    return rows.where(F.col(column).isin(keys))


def bound(value: str, end: bool) -> dt.datetime:
    """An ISO instant, or an ISO date as its first or last microsecond in UTC."""
    try:
        day = dt.date.fromisoformat(value)
        return dt.datetime.combine(day, dt.time(23, 59, 59, 999999) if end else dt.time())
    except ValueError:
        at = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def in_enabled_groups(messages: DataFrame, groups: DataFrame) -> DataFrame:
    return messages.join(groups.where("enabled").select(F.col("id").alias("group_id")), "group_id", "left_semi")


def queue(messages: DataFrame, groups: DataFrame, *, statuses=("UNPROCESSED", "QUEUED"), limit: int = 20) -> DataFrame:
    """What is processed next: oldest first, of enabled groups."""
    return in_enabled_groups(messages.where(F.col("processing_status").isin(*statuses)), groups).orderBy("message_date", "id").limit(limit)


def queue_items(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """Queued messages beside their group's title, their text cut to 120 characters."""
    names = groups.select(F.col("id").alias("group_id"), "title")
    return messages.where("processing_status in ('QUEUED', 'UNPROCESSED')").join(names, "group_id", "left").select(
        "id", "group_id", F.coalesce("title", F.lit("Unknown group")).alias("group_title"), X.truncate(F.col("text"), 120).alias("preview"), "message_date"
    )


def search_groups(groups: DataFrame, query: str, enabled: bool | None = None, account_id: int | None = None) -> DataFrame:
    """Title, name or chat number like the query, whose % and _ are wildcards."""
    pattern = f"%{query.lower()}%"
    like = F.lower("title").like(pattern) | F.col("telegram_chat_id").cast("string").like(pattern) | F.coalesce(F.lower("username").like(pattern), F.lit(False))
    return by_columns(groups.where(like), enabled=enabled, account_id=account_id)


def group_cards(groups: DataFrame, messages: DataFrame, guides: DataFrame, now: Column) -> DataFrame:
    m = messages.where(F.col("message_date") > now - F.expr("interval 24 hours")).groupBy("group_id").agg(F.count("*").alias("_m"))
    g = guides.groupBy("group_id").agg(F.count("*").alias("_g"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return groups.withColumnRenamed("id", "group_id").join(m, "group_id", "left").join(g, "group_id", "left").select(
        "group_id", "title", zero("_m").alias("messages_24h"), zero("_g").alias("guides"), X.source_type(F.col("title"), F.col("telegram_chat_id")).alias("source_type")
    )


def filter_guides(guides: DataFrame, *, min_confidence: float | None = None, max_cost: float | None = None, **equal) -> DataFrame:
    """An absent argument does not filter; a null value fails a range."""
    out = by_columns(guides, **equal)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out if max_cost is None else out.where(F.col("estimated_cost_usd") <= max_cost)


#: Columns of guides that a search looks at, beside the group's title.
SEARCHED = ["title", "model", "generation_error"]


def search_guides(guides: DataFrame, groups: DataFrame, query: str, status: str | None = None) -> DataFrame:
    """Guides whose title, model, group, tags or error have the query in them, whatever the case; of one status if given. Columns that are absent are not searched."""
    names = groups.select(F.col("id").alias("group_id"), F.col("title").alias("group_title"))
    rows = by_columns(guides, status=status).join(names, "group_id", "left")
    group = F.concat(F.coalesce("group_title", F.lit("")), F.lit(" "), F.coalesce(F.col("group_id").cast("string"), F.lit("")))
    fields = [*(F.col(c) for c in SEARCHED if c in guides.columns), group, *([F.array_join("tags", " ")] if "tags" in guides.columns else [])]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(X.text_or_empty(f)).contains(query.strip().lower())
    return rows.where(hit)


def guide_sources(guides: DataFrame, bridge: DataFrame, messages: DataFrame) -> DataFrame:
    """Source messages of guides; a message that is gone keeps its row."""
    m = messages.select(F.col("id").alias("message_id"), "sender_name", "message_date", "text")
    return guides.select(F.col("id").alias("guide_id")).join(bridge, "guide_id").join(m, "message_id", "left").select(
        "guide_id", "message_id", "used_in_prompt", X.sender_or_unknown(F.col("sender_name")).alias("sender"), "message_date",
        F.row_number().over(W.partitionBy("guide_id").orderBy(F.asc_nulls_last("message_date"), "message_id")).alias("position"),
    )


def source_summary(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("guide_id").agg(F.count("*").alias("sources"), F.count_if("used_in_prompt").alias("used"))


#: Guides of a part, about. Parts of a group meet in pairs; a pair is a row of two lists before it is written out.
PAIR_PART = 4096
#: Guides of a block. A block is repeated for each guide of the other part, so that columns are runs and short cycles, which files keep in few bytes.
PAIR_BLOCK = 256
#: Tasks for all pairs, at most; each then has several pairs of parts, one after another.
PAIR_TASKS = 20_000


def related_guides(guides: DataFrame) -> DataFrame:
    """Pairs of guides of one group (nulls are one group). A group's guides are a list on the screen of each of them.

    Their number is the square of a group's size. Pairs of parts of a group are dealt out, so no task has all of a group's, and none holds more than
    two parts and a block of pairs. What is moved for it are lists of ids, some 16 / ``PAIR_PART`` bytes for each pair.
    """
    spark, none = guides.sparkSession, F.lit(0).cast(guides.schema["group_id"].dataType)
    own = guides.where("id is not null").select("id", F.coalesce("group_id", none).alias("_g"), F.col("group_id").isNull().alias("_null"))
    sizes = own.groupBy("_g", "_null").agg(F.count("*").alias("_size")).withColumn("_parts", F.ceil(F.col("_size") / PAIR_PART).cast("int"))
    meet, pairs = sizes.agg(F.sum(F.col("_parts").cast("long") * F.col("_parts")), F.sum(F.col("_size").cast("double") * F.col("_size"))).first()
    tasks = max(1, min(2 * (meet or 0), PAIR_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((pairs or 0) / 2**20))))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    parts = own.join(sizes, ["_g", "_null"]).groupBy("_g", "_null", "_parts", part.alias("_part")).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    keys = ["_g", "_null", "_p", "_q"]
    a = parts.select("_g", "_null", F.col("_part").alias("_p"), every.alias("_q"), F.col("_ids").alias("_a")).repartition(tasks, *keys)
    b = parts.select("_g", "_null", every.alias("_p"), F.col("_part").alias("_q"), F.col("_ids").alias("_b")).repartition(tasks, *keys)
    starts = F.sequence(F.lit(1), F.size("_b"), F.lit(PAIR_BLOCK))
    blocks = a.join(b, keys).select("_a", F.explode(F.transform(starts, lambda at: F.slice("_b", at, PAIR_BLOCK))).alias("_block"))
    # An explode with a function in it hands on row by row; compiled into one loop with the next it would hold all pairs of a block.
    each = blocks.select(F.explode(F.transform("_a", lambda x: x)).alias("guide_id"), "_block")
    return each.select("guide_id", F.explode("_block").alias("related_id")).where("guide_id <> related_id")


def related_classes(guides: DataFrame) -> DataFrame:
    """guide_id, class_id and related: each guide's group of related ones (nulls are one group), by its smallest id, and how many others there are."""
    own = guides.groupBy("group_id").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("related")).withColumnRenamed("group_id", "_g")
    return guides.join(own, F.col("group_id").eqNullSafe(F.col("_g"))).select(F.col("id").alias("guide_id"), "class_id", "related")


def related_to(guides: DataFrame, ids: DataFrame) -> DataFrame:
    """guide_id and related_id for the guides of ``ids`` (first column) only."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    a = guides.join(wanted, "id", "left_semi").select(F.col("id").alias("guide_id"), F.col("group_id").alias("_g"))
    b = guides.select(F.col("id").alias("related_id"), F.col("group_id").alias("_h"))
    return a.join(b, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("guide_id") != F.col("related_id"))).select("guide_id", "related_id")


def possible_duplicates(guides: DataFrame) -> DataFrame:
    return guides.select(F.col("id").alias("guide_id"), "title").join(
        guides.where("duplicate_of_id is not null").select(F.col("duplicate_of_id").alias("guide_id"), F.col("id").alias("duplicate_id")), "guide_id"
    )


def first_per_topic(messages: DataFrame, top: int = 500) -> DataFrame:
    """Of a group's newest ``top`` messages with a topic, the newest of each topic."""
    newest = W.partitionBy("group_id").orderBy(F.desc("message_date"), F.desc("id"))
    recent = messages.where("topic_id is not null").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= top)
    return recent.withColumn("_k", F.row_number().over(W.partitionBy("group_id", "topic_id").orderBy("_r"))).where("_k = 1").drop("_r", "_k")


def merge_topics(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the first table wins a key."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(*(F.min_by(c, "_src").alias(c) for c in rest))


def order_topics(topics: DataFrame, limit: int) -> DataFrame:
    general = X.is_general_topic(F.col("topic_id"), F.col("topic_name"))
    return topics.orderBy(F.desc(general), F.lower("topic_name"), "topic_id").limit(limit)


def latest_per_chat(messages: DataFrame, n: int) -> DataFrame:
    """chat and its newest n messages, newest first."""
    w = W.partitionBy("group_id").orderBy(F.desc("telegram_message_id"))
    top = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "telegram_message_id"))), lambda x: x["telegram_message_id"]).alias("message_ids"))


def day_separators(messages: DataFrame) -> DataFrame:
    """Whether a message begins a new day in its group. The first message of each (group, day) does, so no task has a whole group."""
    day = F.to_date("message_date")
    first = messages.groupBy("group_id", day.alias("_day")).agg(F.min(F.struct("message_date", "id")).alias("_first")).select(F.col("_first.id").alias("id"), F.lit(True).alias("new_day"))
    return messages.join(first, "id", "left").withColumn("new_day", F.coalesce("new_day", F.lit(False)))


def unique_usernames(users: DataFrame, name: str = "username") -> DataFrame:
    """Later users of a name (by id, ignoring case) get their id appended."""
    n = F.row_number().over(W.partitionBy(F.lower(name)).orderBy("id"))
    return users.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("_"), F.col("id").cast("string"))).otherwise(F.col(name)))


def pick_provider(providers: DataFrame) -> DataFrame:
    """A usable provider: a real one before the stand-in, then the smallest id."""
    return providers.where(F.col("status").isin("ACTIVE", "HEALTHY", "WARNING")).orderBy(F.col("protocol") == "MOCK", "id").limit(1)


def filter_traces(traces: DataFrame, *, stage: str = "ALL", status: str = "ALL") -> DataFrame:
    return by_columns(traces, stage="" if stage == "ALL" else stage, status="" if status == "ALL" else status)


def group_order() -> list[Column]:
    """Groups before direct chats, then by title, then by chat number."""
    return [X.source_type(F.col("title"), F.col("telegram_chat_id")) == "DIRECT_CHAT", F.lower("title"), F.col("telegram_chat_id")]


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A dictionary in which the first entry of a key stays."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    one = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return one.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in (order, *rest)))


def pick_prompt(prompts: DataFrame) -> DataFrame:
    active, generation = F.col("status") == "ACTIVE", F.col("type") == "GENERATION"
    rank = F.when(active & generation, 0).when(generation, 1).when(active, 2)
    return prompts.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")
