"""Reports over usage, tasks, traces, groups and guides. Each is one aggregation over the rows it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGE_COUNTS = {
    "telegram_read": ("TELEGRAM_READ", None), "rules_passed": ("RULES", "PASSED"), "rules_rejected": ("RULES", "REJECTED"), "classified": ("CLASSIFICATION", "PASSED"),
    "classification_rejected": ("CLASSIFICATION", "REJECTED"), "guides_generated": ("GUIDE_GENERATION", "COMPLETED"), "guides_failed": ("GUIDE_GENERATION", "FAILED"),
    "moderation": ("MODERATION", None), "auto_published": ("AUTO_PUBLISH", None),
}


def zero_sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def tokens_between(usage: DataFrame, start: Column, end: Column) -> DataFrame:
    """total_tokens and cost (6 decimals) of [start, end]; zeros if there is nothing."""
    rows = usage.where((F.col("created_at") >= start) & (F.col("created_at") <= end))
    return rows.agg(zero_sum("total_tokens").alias("total_tokens"), F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("cost"))


def tokens_daily(usage: DataFrame, first: str, last: str) -> DataFrame:
    """Tokens by UTC day. The range ends with, and so includes, the instant at which the day after ``last`` begins."""
    end = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    rows = usage.where((F.col("created_at") >= F.lit(first).cast("timestamp_ntz")) & (F.col("created_at") <= end))
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens")
    )


def tokens_by_provider(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Tokens and their share by provider; usage without a provider is left out, a provider without a row is Unknown."""
    sums = usage.where("provider_id is not null").groupBy("provider_id").agg(F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("estimated_cost_usd"), 6).alias("cost"))
    names = providers.select(F.col("id").alias("provider_id"), "name")
    total = usage.where("provider_id is not null").agg(F.greatest(F.coalesce(F.sum("total_tokens"), F.lit(0)), F.lit(1)).alias("t")).scalar()
    return sums.join(names, "provider_id", "left").select(
        "provider_id", F.coalesce("name", F.lit("Unknown")).alias("provider_name"), "total_tokens", "cost",
        F.round(F.least(F.lit(100.0), F.col("total_tokens") * 100.0 / total), 6).alias("share"),
    )


def usage_csv(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Unquoted lines of an export: unknown models, guides and provider names are empty, an absent provider id reads null."""
    names = providers.select(F.col("id").alias("_p"), F.col("name").alias("_name"))
    text = lambda c, empty="": F.coalesce(F.col(c).cast("string"), F.lit(empty))
    joined = usage.join(names, F.col("provider_id") == F.col("_p"), "left")
    parts = [text("id"), text("task_type"), text("provider_id", "null"), text("_name"), text("model"), text("guide_id"), text("input_tokens"), text("output_tokens"), text("total_tokens")]
    return joined.select("id", F.concat_ws(",", *parts).alias("line"))


CSV_HEADER = "id,taskType,providerId,providerName,model,guideId,inputTokens,outputTokens,totalTokens"


def queue_status(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("QUEUED", "RUNNING", "STUCK")))


def stuck_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Failed for good, stuck, and running for over half an hour: a bag, a task may come twice."""
    late = now - F.expr("interval 30 minutes")
    return (
        tasks.where("status = 'FAILED' and retry_count >= max_retries").withColumn("why", F.lit("failed"))
        .unionByName(tasks.where("status = 'STUCK'").withColumn("why", F.lit("stuck")))
        .unionByName(tasks.where((F.col("status") == "RUNNING") & (F.col("started_at") < late)).withColumn("why", F.lit("long")))
    )


def group_stats(groups: DataFrame, messages: DataFrame, guides: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts by enabled group; every side is aggregated before it is joined."""
    by = lambda df, key, *aggs: df.groupBy(F.col(key).alias("_k")).agg(*aggs)
    m = by(messages.where(F.col("message_date") > F.lit("1970-01-01").cast("timestamp_ntz")), "group_id", F.count("*").alias("messages"))
    g = by(guides, "group_id", F.count("*").alias("guides"), F.count_if(F.col("status") == "PUBLISHED").alias("published"))
    t = by(tasks.where("status = 'FAILED' and input_ref_type = 'GROUP'"), "input_ref_id", F.count("*").alias("failed_tasks"))
    out = groups.where("enabled").select(F.col("id").alias("group_id"), "title")
    for side in (m, g, t):
        out = out.join(side, F.col("group_id") == F.col("_k"), "left").drop("_k")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("group_id", "title", zero("messages"), zero("guides"), zero("published"), zero("failed_tasks"), F.lit(0).cast("long").alias("chains"))


def messages_per_day(groups: DataFrame, messages: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Messages of the last 30 days by enabled group, divided by 30 in whole numbers; the most first."""
    n = messages.where(F.col("message_date") > now - F.expr("interval 30 days")).groupBy("group_id").agg(F.count("*").alias("n"))
    out = groups.where("enabled").select(F.col("id").alias("group_id"), "title").join(n, "group_id", "left")
    out = out.select("group_id", "title", F.expr("coalesce(n, 0) div 30").alias("per_day"))
    return out if limit is None else out.orderBy(F.desc("per_day"), "group_id").limit(limit)


def busy(per_day: DataFrame, least: int = 5000) -> DataFrame:
    """Groups of high volume."""
    return per_day.where(F.col("per_day") > least)


PRESETS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "all": None}


def by_preset(rows: DataFrame, column: str, now: Column, name: str) -> DataFrame:
    """Rows up to now of each preset span, in one pass."""
    at = F.col(column)
    inside = lambda span: (at <= now) if span is None else (at <= now) & (at >= now - F.expr(f"interval {span}"))
    counts = rows.agg(*(F.count_if(inside(span)).alias(k) for k, span in PRESETS.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias(name)) for k in PRESETS))).alias("x")).select("x.*")


def source_stats(groups: DataFrame, guides: DataFrame) -> DataFrame:
    n = guides.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("_n"))
    return groups.join(n, "id", "left").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if("forum").alias("forums"), zero_sum("_n").alias("guides"))


def dashboard_counts(guides: DataFrame, providers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Published and failed guides, unhealthy providers, accounts that are online: four figures."""
    g = guides.agg(F.count_if(F.col("status") == "PUBLISHED").alias("published"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    unhealthy, online = provider_health(providers).select("unhealthy"), accounts.agg(F.count_if(F.col("status") == "ACTIVE").alias("n"))
    return g.withColumns({"unhealthy": unhealthy.scalar(), "online": online.scalar()})


def order_bounds(rows: DataFrame, kind: str, order: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def login_counts(users: DataFrame, logins: list[str], hidden: Column, name: str = "username") -> DataFrame:
    return users.agg(F.count_if(F.lower(name).isin([x.lower() for x in logins])).alias("existing"), F.count_if(hidden).alias("hidden"))


def guides_by_group(groups: DataFrame, guides: DataFrame) -> DataFrame:
    g = guides.groupBy("group_id").agg(F.count("*").alias("guides"), F.avg("confidence").alias("avg_confidence"))
    return groups.select(F.col("id").alias("group_id"), "title").join(g, "group_id", "left").select(
        "group_id", "title", F.coalesce("guides", F.lit(0).cast("long")).alias("guides"), F.round(F.coalesce("avg_confidence", F.lit(0.0)), 9).alias("avg_confidence")
    )


def status_counts(messages: DataFrame, groups: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Messages of enabled groups by status, in one pass. Finished ones count only in the window; an end alone is ignored."""
    on = groups.where("enabled").select(F.col("id").alias("group_id"))
    rows = messages.join(on, "group_id", "left_semi")
    date = F.col("message_date")
    inside = F.lit(True)
    if start is not None:
        at = lambda s: F.lit(s).cast("timestamp_ntz")
        inside = date.between(at(start), at(end)) if end is not None else date > at(start)
    is_ = lambda s: F.col("processing_status") == s
    return rows.agg(
        *(F.count_if(is_(s)).alias(s.lower()) for s in ("UNPROCESSED", "QUEUED", "PROCESSING")), *(F.count_if(is_(s) & inside).alias(s.lower()) for s in ("CLASSIFIED", "SKIPPED", "GUIDE_FOUND"))
    )


def flow_metrics(traces: DataFrame) -> DataFrame:
    """Stage counts and sums of all traces, in one pass."""

    def at(stage: str, status: str | None) -> Column:
        hit = F.col("stage") == stage
        return hit if status is None else hit & (F.col("status") == status)

    sums = [zero_sum(c).alias(f"sum_{c}") for c in ("input_tokens", "output_tokens", "duration_ms")]
    return traces.agg(*(F.count_if(at(*v)).alias(k) for k, v in STAGE_COUNTS.items()), *sums)


def funnel(metrics: DataFrame, steps: list[str]) -> DataFrame:
    """step, name, value and its share of the step before (null where that is 0; 100 for the first)."""
    from pyspark.sql import Window as W

    rows = metrics.select(F.posexplode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).alias("value")) for s in steps))).alias("step", "s")).select("step", "s.name", "s.value")
    before = F.lag("value").over(W.partitionBy(F.lit(0)).orderBy("step"))  # one row per step
    return rows.select("step", "name", "value", F.when(F.col("step") == 0, F.lit(100.0)).when(before > 0, F.round(F.col("value") * 100.0 / before, 1)).alias("conversion"))


def account_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("account_id").agg(F.count("*").alias("groups"), F.count_if("enabled").alias("enabled"), F.count_if("forum").alias("forums"))


def limit_usage(used: Column, limit: int) -> Column:
    return F.least(F.lit(100.0), used * 100.0 / limit) if limit > 0 else F.lit(0.0)


def high_watermarks(messages: DataFrame) -> DataFrame:
    return messages.groupBy("group_id").agg(F.max("telegram_message_id").alias("last_read_message_id"), F.max("message_date").alias("last_read_at"))


def provider_health(providers: DataFrame) -> DataFrame:
    return providers.agg(F.count("*").alias("providers"), F.count_if(~F.col("status").isin("ACTIVE", "HEALTHY")).alias("unhealthy"))
