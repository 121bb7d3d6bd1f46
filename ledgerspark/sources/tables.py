"""Usage records from the tables of the driver contract, so that every query runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Queries that compare periods look at the data from here: 2024-01-20 12:00 UTC.
NOW_MS = 1_705_752_000_000


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record an event; two sources, seven projects, five models of which one has no price."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = events.selectExpr("*", "cast(get_json_object(props, '$.k') as bigint) as k")
    return counted.selectExpr(
        "concat('evt:', cast(event_id as string)) as id",
        "event_id",
        "case when user_id % 2 = 0 then 'codex' else 'claude' end as source",
        "case when event_id % 17 = 0 then null else concat('s', cast(user_id as string)) end as session_id",
        # in parts, as no session's time zone plays a part in these
        """datediff(ts, date'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L
           + cast(floor(extract(second from ts) * 1000) as bigint) as ts_ms""",
        """case event_type when 'click' then 'gpt-5.4' when 'view' then 'gpt_5.4_codex' when 'purchase' then 'gpt-5-codex'
           when 'signup' then 'claude-sonnet-4-20250514' else 'brand-new-model' end as model""",
        "concat('/work/p', cast(user_id % 7 as string)) as project_key",
        "cast(round(value * 100) as bigint) as input_tokens",
        "k * 3 as cached_input_tokens",
        "case when user_id % 2 = 1 then k else 0 end as cache_creation_input_tokens",
        "k + event_id % 50 as output_tokens",
        "case when user_id % 2 = 0 then event_id % 13 else 0 end as reasoning_output_tokens",
    )


#: The same in DuckDB, as the first of a query's common tables.
RECORDS_SQL = """records AS (
  SELECT 'evt:' || CAST(event_id AS VARCHAR) AS id, event_id,
         CASE WHEN user_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 's' || CAST(user_id AS VARCHAR) END AS session_id,
         epoch_us(ts) // 1000 AS ts_ms,
         CASE event_type WHEN 'click' THEN 'gpt-5.4' WHEN 'view' THEN 'gpt_5.4_codex' WHEN 'purchase' THEN 'gpt-5-codex'
           WHEN 'signup' THEN 'claude-sonnet-4-20250514' ELSE 'brand-new-model' END AS model,
         '/work/p' || CAST(user_id % 7 AS VARCHAR) AS project_key,
         CAST(round(value * 100) AS BIGINT) AS input_tokens, k * 3 AS cached_input_tokens,
         CASE WHEN user_id % 2 = 1 THEN k ELSE 0 END AS cache_creation_input_tokens,
         k + event_id % 50 AS output_tokens,
         CASE WHEN user_id % 2 = 0 THEN event_id % 13 ELSE 0 END AS reasoning_output_tokens,
         CAST(round(value * 100) AS BIGINT) + k * 3 + CASE WHEN user_id % 2 = 1 THEN k ELSE 0 END + k + event_id % 50
           + CASE WHEN user_id % 2 = 0 THEN event_id % 13 ELSE 0 END AS total_tokens
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

BUCKETS_SQL = (
    RECORDS_SQL
    + """,
buckets AS (
  SELECT source, model, project_key, CAST(floor(ts_ms / 1800000) * 1800000 AS BIGINT) AS bucket_start,
         CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
         CAST(sum(cache_creation_input_tokens) AS BIGINT) AS cache_creation_input_tokens,
         CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
         CAST(sum(reasoning_output_tokens) AS BIGINT) AS reasoning_output_tokens,
         CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
         count(*) AS record_count, count(DISTINCT coalesce(session_id, id)) AS session_count
  FROM records GROUP BY ALL)"""
)


def counter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a session with a counter that is reset by errors: total is missing in a quarter of the rows,
    an increment is given in a third."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "concat('s', cast(user_id as string)) as session",
        "event_id as event_index",
        """datediff(ts, date'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L
           + cast(floor(extract(second from ts) * 1000) as bigint) as ts_ms""",
        "event_type",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "concat('r', cast(event_id div 3 as string)) as response_id",
        "case when event_id % 5 = 0 then null else concat('m', cast(event_id % 2 as string)) end as model",
    )
    segments = events.selectExpr(
        "*", "sum(case when event_type = 'error' then 1 else 0 end) over (partition by session order by event_index) as _segment"
    )
    summed = segments.selectExpr("*", "sum(k) over (partition by session, _segment order by event_index) as _total")
    return summed.selectExpr(
        "session", "event_index", "ts_ms", "event_type", "k", "response_id", "model",
        "case when event_index % 4 <> 1 then _total end as total",
        "case when event_index % 3 = 0 then k end as last",
    )


COUNTERS_SQL = """counters AS (
  SELECT session, event_index, ts_ms, event_type, k, response_id, model, CASE WHEN event_index % 4 <> 1 THEN CAST(t AS BIGINT) END AS total,
         CASE WHEN event_index % 3 = 0 THEN k END AS last
  FROM (SELECT *, sum(k) OVER (PARTITION BY session, segment ORDER BY event_index) AS t
    FROM (SELECT 's' || CAST(user_id AS VARCHAR) AS session, event_id AS event_index, epoch_us(ts) // 1000 AS ts_ms, event_type,
            CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'r' || CAST(event_id // 3 AS VARCHAR) AS response_id,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'm' || CAST(event_id % 2 AS VARCHAR) END AS model,
            sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment
          FROM events)))"""
