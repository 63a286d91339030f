"""The domain's tables, projected from the test tables by expressions that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FENCE = "```"
#: name: base table, select list, filter. {ts} is how an engine adds seconds to the first day.
VIEWS: dict[str, tuple[str, str, str]] = {
    "messages": (
        "conversations",
        f"""conv_id*1000+turn as id, conv_id*1000+turn+1 as telegram_message_id, conv_id%5 as group_id, role as sender_name,
 case when role='system' then null when role='user' then conv_id%7 else conv_id%7+100 end as sender_telegram_user_id, role='system' as is_bot,
 case (conv_id*7+turn)%10 when 0 then 'ok' when 1 then 'ab' when 2 then '' when 3 then text when 4 then concat(text, chr(10), '1. first', chr(10), '2. second')
  when 5 then concat(text,' https://example.com/docs') when 6 then concat(text,' how to install the prompt?') when 7 then 'where is the provider link?'
  when 8 then concat(text,' {FENCE}code{FENCE}') else substring(text,1,40) end as text,
 case when turn>0 and (conv_id+turn)%3<>0 then conv_id*1000+turn end as reply_to_message_id, cast((conv_id+turn)%4 as int) as reply_count,
 case when conv_id%2=0 then conv_id%5+1 end as topic_id, case when conv_id%2=0 then concat('topic ', cast(conv_id%5+1 as varchar(10))) end as topic_name, {{ts}} as message_date,
 case (conv_id*3+turn)%8 when 0 then 'UNPROCESSED' when 1 then 'QUEUED' when 2 then 'PROCESSING' when 3 then 'CLASSIFIED' when 4 then 'SKIPPED' when 5 then 'GUIDE_FOUND'
  when 6 then 'ERROR' else 'CLEARED' end as processing_status""",
        "true",
    ),
    "groups": (
        "nation",
        """cast(n_nationkey as bigint) as id, case when n_nationkey%6=0 then cast(n_nationkey+1000 as bigint) else cast(-1000-n_nationkey as bigint) end as telegram_chat_id, n_name as title,
 case when n_nationkey%3<>0 then lower(n_name) end as username, n_nationkey%4<>0 as enabled, n_nationkey%2=0 as forum, cast(n_regionkey as bigint) as account_id""",
        "true",
    ),
    "providers": (
        "region",
        """cast(r_regionkey as bigint) as id, r_name as name, case when r_regionkey=0 then 'MOCK' else 'OPENAI_COMPATIBLE' end as protocol,
 case r_regionkey when 2 then 'ERROR' when 3 then 'WARNING' else 'ACTIVE' end as status""",
        "r_regionkey<4",
    ),
    "usage_log": (
        "events",
        """event_id as id, ts as created_at, concat('TASK_',event_type) as task_type, case when user_id%10<>0 then user_id%5 end as provider_id,
 case when user_id%3<>0 then concat('model-',cast(user_id%3 as varchar(10))) end as model, case when user_id%4<>0 then user_id%25 end as guide_id,
 cast(floor(value) as bigint) as input_tokens, cast(floor(value/2) as bigint) as output_tokens, cast(floor(value) as bigint)+cast(floor(value/2) as bigint) as total_tokens,
 cast(cast(floor(value) as bigint)+cast(floor(value/2) as bigint) as double)*cast(0.00002 as double) as estimated_cost_usd""",
        "true",
    ),
    "traces": (
        "events",
        """event_id as id, user_id%100*1000 as message_id, user_id%5 as group_id,
 case event_type when 'signup' then 'TELEGRAM_READ' when 'view' then 'RULES' when 'click' then 'CLASSIFICATION' when 'purchase' then 'GUIDE_GENERATION' else 'AUTO_PUBLISH' end as stage,
 case event_id%4 when 0 then 'PASSED' when 1 then 'COMPLETED' when 2 then 'FAILED' else 'REJECTED' end as status,
 ts as started_at, cast(floor(value*10) as bigint) as duration_ms, cast(floor(value) as bigint) as input_tokens, cast(floor(value/2) as bigint) as output_tokens""",
        "true",
    ),
    "task_queue": (
        "orders",
        """o_orderkey as id, case o_orderkey%4 when 0 then 'QUEUED' when 1 then 'RUNNING' when 2 then 'FAILED' else 'STUCK' end as status, o_orderkey%3 as priority,
 o_orderkey%5 as retry_count, cast(3 as bigint) as max_retries, case when o_orderkey%2=0 then 'GROUP' end as input_ref_type, o_custkey%25 as input_ref_id,
 o_orderdate as created_at, case when o_orderkey%4=1 and o_orderkey%8<>5 then o_orderdate end as started_at""",
        "true",
    ),
    "guides": (
        "documents",
        """doc_id as id, substring(text,1,60) as title, doc_id%25 as group_id, case when doc_id%7<>0 then doc_id%5 end as provider_id, doc_id%3 as classifier_id,
 case doc_id%4 when 0 then 'DRAFT' when 1 then 'PUBLISHED' when 2 then 'FAILED' else 'REJECTED' end as status,
 case when doc_id%11<>0 then cast(doc_id%100 as double)/cast(100 as double) end as confidence, cast(n_chars as double)*cast(0.00002 as double) as estimated_cost_usd,
 case when doc_id%50=49 then doc_id-1 end as duplicate_of_id""",
        "true",
    ),
    "guide_source_messages": ("conversations", "conv_id as guide_id, conv_id*1000+turn+case when turn=7 then 500 else 0 end as message_id, turn<6 as used_in_prompt", "true"),
}
TS = {
    "spark": "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0,0,0,conv_id*60+turn*45)",
    "duckdb": "timestamp '2024-01-01 00:00:00' + to_seconds(conv_id*60+turn*45)",
}
#: The instant that queries take for now.
NOW = "2024-01-31 00:00:00"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns, keep = VIEWS[name]
    spark_columns = columns.replace("{ts}", TS["spark"]).replace("{{ts}}", TS["spark"])
    table = spark.read.parquet(f"{sf_dir}/{base}.parquet").where(keep)
    return table.sparkSession.sql(f"select {spark_columns} from {{t}}", t=table)


def ctes(*names: str, recursive: bool = False) -> str:
    """The head of a DuckDB query over the named tables."""
    parts = []
    for name in names:
        base, columns, keep = VIEWS[name]
        parts.append(f"{name} as (select {columns.replace('{ts}', TS['duckdb'])} from {base} where {keep})")
    return ("with recursive " if recursive else "with ") + ",\n".join(parts)
