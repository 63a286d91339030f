"""The live processor: new messages of the stored table go through the pipeline, and their results are added to it.

A micro-batch is the messages that were stored since the last one. Only what their chats need is read: chains never leave a chat, so the
batch's buckets (``ingest.bucket``) are the only folders of messages, statuses and used-up messages that are opened, and of these
only the batch's chats are worked on. Nothing of a message is changed in place: its state is its row joined to its results.

Batches go on from each other as the queue does. What an earlier guide has used up (``taken``) is no root any more, whichever batch it
comes in, and what was processed before is not used up again; n batches in the order of dates leave what one sequential run leaves.

Results are versioned tables (``sources.versions``), a part a batch, with the batch's number as its tag: a batch that is repeated after a
fault replaces its own part and does not see it, so each message has its results once. Parts are joined by ``compact`` now and then.

Faults. What is wrong with one message is a row's affair: a model's error on one prompt is that message's reason. If a batch fails for
what is in its data, its messages are halved in their order until the ones that fail stand alone, which are SKIPPED with the error
as reason. If it fails because something is away (a model, a store, executors), the query stops, nothing is skipped, and the batch is
repeated when it is resumed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confab.plans import pipeline
from confab.plans.pipeline import Outcome
from confab.sources.storage import cut
from confab.sources.versions import Versions
from confab.streaming.ingest import bucket

TABLES = ["statuses", "guides", "sources", "usage", "traces", "taken"]
#: Tables that later batches read, in folders by bucket.
BY_BUCKET = {"statuses", "taken"}
#: Halvings after which what still fails is given up together; 2 ** 20 parts tell any batch's messages apart.
HALVINGS = 20
#: Parts of a table after which they are joined.
PARTS = 200
#: What the text of an error says if something is away, whatever the data.
AWAY = re.compile(
    r"ExecutorLostFailure|FetchFailed|OutOfMemory|out of memory|java\.(io|net|nio)\.\w*Exception|SocketTimeout|TimeoutError|timed out|ConnectionError|Connection(Refused|Reset|Aborted)Error|BrokenPipe|Outage|OSError|IOError"
    r"|SparkContext was shut down|stopped SparkContext|Job \d+ cancelled|No space left|Python worker (exited|failed)"
)
Run = Callable[[DataFrame, DataFrame, DataFrame], Outcome]


def is_away(error: BaseException) -> bool:
    """Whether an error says nothing about the messages."""
    return isinstance(error, (TimeoutError, ConnectionError, OSError)) or bool(AWAY.search(str(error)))


def live_run(messages: DataFrame, groups: DataFrame, roots: DataFrame, **settings) -> Outcome:
    """``pipeline.run`` as the queue has it; a model that is away fails the batch."""
    return pipeline.run(messages, groups, roots=roots, sequential=True, **({"away": "raise"} | settings))


def table_of(spark: SparkSession, results_path: str, name: str) -> Versions:
    return Versions(spark, f"{results_path}/{name}", partition_by=("bucket",) if name in BY_BUCKET else ())


def results(spark: SparkSession, results_path: str, name: str) -> DataFrame:
    """All stored results of one kind."""
    rows = table_of(spark, results_path, name).read()
    if rows is None:
        raise ValueError(f"nothing is stored under {results_path}/{name}")
    return rows.drop("bucket")


def stored_messages(spark: SparkSession, messages_path: str, schema, buckets: list[int]) -> DataFrame:
    """The stored messages of some buckets; only their folders are opened if the table has folders by bucket."""
    rows = spark.read.schema(schema).parquet(messages_path)
    rows = rows if "bucket" in rows.columns else rows.withColumn("bucket", bucket(F.col("group_id")))
    return rows.where(F.col("bucket").isin(buckets))


def earlier(spark: SparkSession, results_path: str, name: str, tag: str, buckets: list[int]) -> DataFrame | None:
    """What batches other than ``tag`` have left in some buckets."""
    rows = table_of(spark, results_path, name).read(tags=lambda t: t != tag)
    return None if rows is None else rows.where(F.col("bucket").isin(buckets))


def state(messages: DataFrame, statuses: DataFrame) -> DataFrame:
    """``messages`` with the status and reason that processing gave them; those not processed yet stay as they are."""
    s = statuses.select("id", F.col("outcome").alias("_outcome"), F.col("reason").alias("classifier_reason"))
    joined = messages.drop("classifier_reason").join(s, "id", "left")
    return joined.withColumn("processing_status", F.coalesce("_outcome", "processing_status")).drop("_outcome")


def status_rows(ids: DataFrame, outcome: str, reason: str, guide) -> DataFrame:
    text, number = (lambda v: F.lit(v).cast("string")), F.lit(None).cast("double")
    return ids.select(
        "id", text(outcome).alias("outcome"), text(reason).alias("reason"), number.alias("signal_score"), number.alias("classifier_score"), text(None).alias("rule_result_json"), text(None).alias("signal_breakdown"),
        guide.cast("long").alias("guide_id"),
    )


def failed(ids: DataFrame, error: Exception) -> DataFrame:
    """Statuses of messages that the pipeline cannot process."""
    said = f"error: {str(error).splitlines()[0][:200] if str(error) else type(error).__name__}"
    return status_rows(ids, "SKIPPED", said, F.lit(None))


def without_used(context: DataFrame, roots: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The context in which used-up messages have their guide, the roots that are left, and statuses of those that are not."""
    used = taken.select("id", F.col("root_message_id").alias("_guide"))
    marked = context.join(used, "id", "left").withColumn("processing_status", F.when(F.col("_guide").isNotNull(), F.lit("GUIDE_FOUND")).otherwise(F.col("processing_status"))).drop("_guide")
    gone = status_rows(roots.select("id").join(used, "id"), "GUIDE_FOUND", "used by an earlier guide", F.col("_guide"))
    return marked, roots.join(used, "id", "left_anti"), gone


def settled(outcome: Outcome) -> Outcome:
    """The outcome with its tables written, so that a failure shows here and not when results are stored."""
    return Outcome(*(cut(getattr(outcome, name), name) for name in TABLES))


def halves(context: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """The earlier and the later half of some roots."""
    dated = cut(roots.join(context.select("id", F.unix_micros(F.col("message_date").cast("timestamp")).alias("_at")), "id"), "half")
    for by in ("_at", "id"):
        middle, least, most = dated.agg(F.percentile_approx(by, 0.5), F.min(by), F.max(by)).first()
        if least != most:
            at = middle if middle < most else most - 1
            return [dated.where(F.col(by) <= at).drop("_at"), dated.where(F.col(by) > at).drop("_at")]
    return [dated.drop("_at")]


def isolated(context: DataFrame, groups: DataFrame, roots: DataFrame, run: Run, depth: int = 0) -> list[Outcome | DataFrame]:
    """Outcomes of the parts of ``roots`` that run, in order, and statuses of the messages that fail or were used up."""
    try:
        return [settled(run(context, groups, roots))]
    except Exception as error:  # what a configured pattern or a text brings about must not stop the others
        if is_away(error):
            raise
        parts = halves(context, roots) if depth < HALVINGS and roots.count() > 1 else []
        if len(parts) < 2:
            return [failed(roots, error)]
    first = isolated(context, groups, parts[0], run, depth + 1)
    for got in first:
        context = state(context, got if isinstance(got, DataFrame) else got.statuses).select(*context.columns)
        if isinstance(got, Outcome):
            context, parts[1], gone = without_used(context, parts[1], got.taken)
            first.append(gone) if gone.head(1) else None
    rest = cut(parts[1], "half")
    return first + (isolated(cut(context, "context"), groups, rest, run, depth + 1) if rest.head(1) else [])


def process(batch: DataFrame, batch_id: int, messages_path: str, groups: DataFrame, results_path: str, run: Run = live_run) -> None:
    """Takes the messages of a batch through the pipeline and stores their results under the batch's number."""
    spark, tag = batch.sparkSession, f"batch-{batch_id}"
    own_bucket = F.col("bucket") if "bucket" in batch.columns else bucket(F.col("group_id"))
    own = cut(batch.select("id", "group_id", own_bucket.alias("bucket")).distinct(), "batch-ids")
    buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # ingest.BUCKETS at most
    if not buckets:
        return
    context = stored_messages(spark, messages_path, batch.schema, buckets).join(own.select("group_id").distinct(), "group_id", "left_semi")
    roots, parts = own.select("id"), []
    done, taken = (earlier(spark, results_path, name, tag, buckets) for name in ("statuses", "taken"))
    if done is not None:
        context = state(context, done).drop("classifier_reason")
        roots = roots.join(done.select("id"), "id", "left_anti")  # a message comes once, even if it was stored twice
    if taken is not None:
        context, roots, gone = without_used(context, roots, taken)
        parts.append(gone)
    context, roots = cut(context, "context"), cut(roots, "roots")
    parts += isolated(context, groups, roots, run) if roots.head(1) else []
    of_bucket = own.select("id", "bucket")
    for name in TABLES:
        rows = [p if isinstance(p, DataFrame) else getattr(p, name) for p in parts if isinstance(p, Outcome) or name == "statuses"]
        if not rows:
            continue
        all_rows = rows[0]
        for r in rows[1:]:
            all_rows = all_rows.unionByName(r)
        if name == "statuses":
            all_rows = all_rows.join(of_bucket, "id")
        elif name == "taken":
            all_rows = all_rows.join(of_bucket.withColumnRenamed("id", "root_message_id"), "root_message_id").select("id", "root_message_id", "bucket")
        table = table_of(spark, results_path, name)
        table.append(all_rows, tag)
        if len(table.manifest(table.version())["parts"]) > PARTS:
            table.compact()


class Processor:
    """The processor's stream over a table of messages. It pauses by stopping, and resumes from its checkpoint."""

    def __init__(
        self, spark: SparkSession, messages_path: str, groups: DataFrame, results_path: str, checkpoint: str, *, files_per_batch: int = 20,
        run: Run | None = None, on_batch: Callable[[int], None] | None = None, **settings,
    ):
        """on_batch: told of each batch after its results are stored, as events follow what they tell of. settings: of ``pipeline.run``."""
        self.spark, self.messages_path, self.groups, self.results_path, self.checkpoint = spark, messages_path, groups, results_path, checkpoint
        self.files_per_batch, self.run, self.on_batch = files_per_batch, run or partial(live_run, **settings), on_batch
        self.query: StreamingQuery | None = None

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        process(batch, batch_id, self.messages_path, self.groups, self.results_path, self.run)
        if self.on_batch is not None:
            self.on_batch(batch_id)

    def resume(self, interval: str | None = None) -> StreamingQuery:
        """Starts or goes on: to the end of what is stored, or every ``interval``."""
        schema = self.spark.read.parquet(self.messages_path).schema
        source = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(self.messages_path)
        writer = source.writeStream.option("checkpointLocation", self.checkpoint).foreachBatch(self._step)
        self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        return self.query

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
