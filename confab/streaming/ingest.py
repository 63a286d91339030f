"""Live ingest: feed records become messages, once each.

The stream is any readStream with the feed's columns. Each micro-batch is merged against the stored table, so the history that
duplicates are told from is the table itself and stream state stays empty. The table is partitioned by a hash of the chat, and
a batch only reads the partitions of its own chats. Groups' high-water marks are ``marks`` of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confab.functions import text as X
from confab.sources.feed import FEED, ChatFeed
from confab.sources.storage import cut

FALLBACK_TEXT = {"photo": "[photo]", "video": "[video]", "document": "[document]", "sticker": "[sticker]", "voice": "[voice]"}


def feed_text(kind: Column, text: Column) -> Column:
    out = F.lit("")
    for k, v in FALLBACK_TEXT.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return F.when(~X.is_blank(text), text).otherwise(out)


def to_messages(feed: DataFrame, now: Column) -> DataFrame:
    """Feed records as messages; 0 stands for no thread and no reply, a date that is not positive for now.

    A message's id is a hash of its chat and number, the same whenever it comes; its group has the chat's number.
    """
    return feed.select(
        F.xxhash64("chat_id", "id").alias("id"), F.col("chat_id").alias("group_id"), F.col("chat_id").alias("telegram_chat_id"), F.col("id").alias("telegram_message_id"), X.sender_or_unknown(F.col("sender_name")).alias("sender_name"),
        F.col("sender_id").alias("sender_telegram_user_id"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"), feed_text(F.col("content_type"), F.col("text")).alias("text"),
        F.nullif("reply_to", F.lit(0)).alias("reply_to_message_id"), F.lit(0).alias("reply_count"), F.nullif("thread_id", F.lit(0)).alias("topic_id"), "topic_name",
        F.when(F.col("date") > 0, F.timestamp_seconds("date").cast("timestamp_ntz")).otherwise(now).alias("message_date"), F.lit("UNPROCESSED").alias("processing_status"),
    )


def recent(messages: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The cut-off of polled syncs (pushed messages are not cut)."""
    return messages.where(F.col("message_date") >= now - F.expr(f"interval {days} days"))


def unknown_groups(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """Chats that are no group yet become disabled groups; the chat number is their id."""
    fresh = messages.select("telegram_chat_id").distinct().join(groups.select("telegram_chat_id"), "telegram_chat_id", "left_anti")
    return fresh.select(F.col("telegram_chat_id").alias("id"), "telegram_chat_id", F.concat(F.lit("Telegram chat "), F.col("telegram_chat_id").cast("string")).alias("title"), F.lit(False).alias("enabled"))


def not_stored(messages: DataFrame, stored: DataFrame) -> DataFrame:
    key = ["telegram_chat_id", "telegram_message_id"]
    return messages.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


#: Partitions of the stored table.
BUCKETS = 256


def bucket(chat: Column) -> Column:
    return F.pmod(F.xxhash64(chat), F.lit(BUCKETS)).cast("int")


def marks(messages: DataFrame) -> DataFrame:
    """The last message of each chat, by number and by date."""
    return messages.groupBy("telegram_chat_id").agg(F.max("telegram_message_id").alias("last_read_message_id"), F.max("message_date").alias("last_read_at"))


def merge_batch(batch: DataFrame, path: str, now: Column) -> None:
    """Appends the batch's new messages to the table at ``path``. Writing a batch again adds nothing."""
    spark = batch.sparkSession
    messages = to_messages(batch, now).withColumn("bucket", bucket(F.col("telegram_chat_id")))
    try:
        own = [r["bucket"] for r in messages.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = spark.read.schema(messages.schema).parquet(path).where(F.col("bucket").isin(own))
        stored.schema  # noqa: B018  a missing table shows here
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = messages.where("false")
    # The anti-join reads the table that is appended to, so its result is settled first.
    cut(not_stored(messages, stored), "batch").write.mode("append").partitionBy("bucket").parquet(path)


def ingest(spark: SparkSession, feed_path: str, table_path: str, checkpoint: str, *, now: Column | None = None, interval: str | None = None, files_per_batch: int = 20) -> StreamingQuery:
    """Starts the ingest of JSON feed files: to the end of what is there, or every ``interval``."""
    at = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).json(feed_path)
    return into_table(feed, table_path, checkpoint, at, interval)


def ingest_chats(spark: SparkSession, client: str, table_path: str, checkpoint: str, *, now: Column | None = None, interval: str | None = None, **options: str) -> StreamingQuery:
    """Starts the ingest of a chat feed (``sources.feed``): to the newest message of each chat, or every ``interval``. client: module:factory."""
    at = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    spark.dataSource.register(ChatFeed)
    return into_table(spark.readStream.format("chat_feed").options(client=client, **options).load(), table_path, checkpoint, at, interval)


def into_table(feed: DataFrame, table_path: str, checkpoint: str, at: Column, interval: str | None) -> StreamingQuery:
    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(batch, table_path, at))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream-side deduplication with bounded state, for sinks that cannot be read back. The bound is an extension."""
    return stream.withWatermark("message_date", delay).dropDuplicatesWithinWatermark(["telegram_chat_id", "telegram_message_id"])
