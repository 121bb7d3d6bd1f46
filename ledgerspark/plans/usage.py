"""Queries on records and buckets, by name, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import usage as fn
from ..operators import activity, periods, pricing, rollup, sessions
from ..sources.tables import BUCKETS_SQL, NOW_MS, RECORDS_SQL, usage_records
from ..operators.pricing import COST_SQL, PRICES_SQL

TODAY = date(2024, 1, 20)


def _records(spark, d):
    return usage_records(spark, d)


def _buckets(spark, d):
    return rollup.buckets(usage_records(spark, d))


def _prices(spark):
    return pricing.catalogue(spark)


def _daily(spark, d):
    return rollup.daily(_buckets(spark, d))


def _filtered(spark, d):
    rows = rollup.filtered(_records(spark, d), 1_704_844_800_000, 1_705_708_800_000, source="codex", model="gpt-5.4")
    return rows.select("id", "ts_ms", "project_key", "session_id", fn.total_tokens().alias("total_tokens"))


def _page(spark, d):
    rows, _ = rollup.page(_records(spark, d), 3, 50)
    return rows.select("id", "ts_ms", "source", "model", fn.total_tokens().alias("total_tokens"))


def _dimension(spark):
    rows = [("/work/p1", "One", False), ("/work/p2", "", True), ("/work/p3", None, False), ("/work/p9", "Nine", True)]
    return spark.createDataFrame(rows, "project_key string, alias string, hidden boolean")


def _visible(spark, d):
    dim = _dimension(spark)
    shown = sessions.named(sessions.visible(_records(spark, d), dim), dim)
    return shown.groupBy("project_name").agg(F.count("*").alias("record_count"), F.sum(fn.total_tokens()).cast("long").alias("total_tokens"))


def _summaries(spark, d):
    found = sessions.summaries(_records(spark, d), _prices(spark))
    lists = {c: F.array_join(c, ",") for c in ("models", "projects")}
    return found.withColumns(lists)


def _top(spark, d):
    found = sessions.listed(sessions.summaries(_records(spark, d), _prices(spark)), "tokens", 1, 20)
    return found.select("source", "session_id", "total_tokens", "last_active_ms", "span_ms", "primary_model")


def _by_span(spark, d):
    found = sessions.listed(sessions.summaries(_records(spark, d), _prices(spark)), "span", 2, 20)
    return found.select("source", "session_id", "total_tokens", "span_ms")


def _project_top(spark, d):
    found = sessions.top_of_project(_records(spark, d), _prices(spark), "/work/p3")
    return found.select("source", "session_id", "total_tokens", "record_count", "cost_usd")


def _models(spark, d):
    r = _records(spark, d).select("model").distinct()
    return r.select("model", fn.model_identity(F.col("model")).alias("m")).select("model", "m.*")


def _texts(spark, d):
    docs = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    path = F.concat(F.lit("/home/u"), (F.col("o_orderkey") % 11).cast("string"), F.lit("/work/p"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/"))
    return docs.select("o_orderkey", path.alias("path"))


def _redaction(spark, d):
    text = F.concat(F.lit("failed at "), F.col("path"), F.lit("x.jsonl"))
    return _texts(spark, d).select("o_orderkey", fn.redacted(text).alias("text"))


def _names(spark, d):
    return _texts(spark, d).select("o_orderkey", fn.project_display_name(F.col("path")).alias("name"))


def _compact(spark, d):
    value = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return _texts(spark, d).select("o_orderkey", fn.compact_number(value).alias("text"))


def _fnv(spark, d):
    return _texts(spark, d).select("o_orderkey", fn.fnv1a32(F.col("path")).alias("hash"))


def _url(spark, d):
    text = F.concat(F.col("path"), F.lit(" a~(b)!*"), (F.col("o_orderkey") % 5).cast("string"))
    return _texts(spark, d).select("o_orderkey", fn.url_component(text).alias("text"))


def _grid(kind):
    return lambda spark, d: kind(_daily(spark, d), TODAY)


def _export(spark, d):
    """Five of the seven projects have names, of which one has to be made safe."""
    names = "concat(case when user_id % 7 = 3 then '=' else 'Project ' end, cast(user_id % 7 as string)) as name"
    projects = spark.read.parquet(f"{d}/events.parquet").filter("user_id % 7 < 5").selectExpr("concat('/work/p', cast(user_id % 7 as string)) as project_key", names).distinct()
    return rollup.export_rows(_records(spark, d), _prices(spark), projects)


QUERIES = {
    "bucket_rollup": _buckets,
    "dashboard_totals": lambda s, d: rollup.totals(_buckets(s, d), _prices(s)),
    "by_source": lambda s, d: rollup.by_key(_buckets(s, d), _prices(s), "source"),
    "stats_by_model": lambda s, d: rollup.by_key(_buckets(s, d), _prices(s), "model"),
    "stats_by_project": lambda s, d: rollup.by_key(_buckets(s, d), _prices(s), "project_key"),
    "daily_trend": _daily,
    "agent_summaries": lambda s, d: rollup.agents(_records(s, d), _prices(s)),
    "report_grouping_sets": lambda s, d: rollup.report(rollup.filtered(_records(s, d), source="codex"), _prices(s)),
    "source_summary": lambda s, d: rollup.source_summary(_records(s, d), "claude"),
    "usage_audit": lambda s, d: rollup.usage_audit(_records(s, d)),
    "peak_days": lambda s, d: rollup.peak_days(_records(s, d)),
    "model_options": lambda s, d: rollup.options(_records(s, d), "model"),
    "project_options": lambda s, d: rollup.options(_records(s, d), "project_key"),
    "token_metrics": lambda s, d: rollup.with_metrics(_records(s, d)),
    "filtered_records": _filtered,
    "records_page": _page,
    "pricing_resolution": lambda s, d: pricing.resolve(_records(s, d), _prices(s)),
    "pricing_coverage": lambda s, d: rollup.coverage(_buckets(s, d), _prices(s)),
    "pricing_by_model": lambda s, d: rollup.coverage_by_model(_buckets(s, d), _prices(s)),
    "csv_export": _export,
    "csv_projection": lambda s, d: rollup.csv_rows(_records(s, d), _prices(s)),
    "period_comparison": lambda s, d: periods.comparison(_buckets(s, d), NOW_MS),
    "change_drivers": lambda s, d: periods.drivers(_buckets(s, d), "week", NOW_MS),
    "activity_daily": _grid(activity.daily_grid),
    "activity_weekly": _grid(activity.weekly_grid),
    "activity_monthly": _grid(activity.monthly_grid),
    "activity_cumulative": _grid(activity.cumulative),
    "activity_streaks": lambda s, d: activity.streaks(_daily(s, d), TODAY),
    "activity_summary": lambda s, d: activity.grid_summary(activity.daily_grid(_daily(s, d), TODAY)),
    "activity_month_labels": lambda s, d: activity.month_labels(activity.daily_grid(_daily(s, d), TODAY), 7),
    "session_summaries": _summaries,
    "session_list_top": _top,
    "session_list_span": _by_span,
    "session_timeline": lambda s, d: sessions.timeline(_records(s, d), "codex", "s4"),
    "unassigned_usage": lambda s, d: sessions.unassigned(_records(s, d)),
    "project_insight": lambda s, d: sessions.insight(_records(s, d), "/work/p3", 1_705_017_600_000, 1_705_622_400_000),
    "project_insight_trend": lambda s, d: sessions.trend(_records(s, d), _prices(s), "/work/p3", TODAY),
    "project_insight_breakdown": lambda s, d: sessions.breakdown(_records(s, d), "/work/p3", 1_704_844_800_000, NOW_MS),
    "project_insight_top_sessions": _project_top,
    "visible_projects": _visible,
    "model_identity": _models,
    "path_redaction": _redaction,
    "project_display_name": _names,
    "token_format": _compact,
    "fnv_hash": _fnv,
    "url_component": _url,
}

_PRICED_RECORDS = f"WITH {RECORDS_SQL}, {PRICES_SQL}, priced AS (SELECT r.*, p.match_kind, p.price_id, {COST_SQL} AS units FROM records r JOIN prices p USING (model))"
_PRICED_BUCKETS = f"WITH {BUCKETS_SQL}, {PRICES_SQL}, priced AS (SELECT b.*, p.match_kind, p.price_id, {COST_SQL} AS units FROM buckets b JOIN prices p USING (model))"
_LABEL = f"CASE price_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in pricing.LABELS.items())} END"
_COST = "CAST(coalesce(sum(units), 0) AS DOUBLE) / 1e9 AS cost_usd"
_FIVE = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in fn.COUNTERS)
_CONTEXT = "(input_tokens + cached_input_tokens + cache_creation_input_tokens)"
_SHARE = f"CASE WHEN {_CONTEXT} > 0 THEN CAST(cached_input_tokens AS DOUBLE) / CAST({_CONTEXT} AS DOUBLE) END"
_DAILY = f"""WITH {BUCKETS_SQL},
daily AS (SELECT CAST(make_timestamp(bucket_start * 1000) AS DATE) AS day, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(session_count) AS BIGINT) AS session_count FROM buckets GROUP BY 1)"""
_DAY = "CAST(make_timestamp(ts_ms * 1000) AS DATE)"


def _key(key: str) -> str:
    return f"{_PRICED_BUCKETS} SELECT {key} AS key, CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_COST} FROM priced GROUP BY 1"


def _spine(first: str, end: str, more: str = "") -> str:
    """Days from first to before end with figures, as table days."""
    return f"""{_DAILY}, days AS (
  SELECT s.day, coalesce(total_tokens, 0) AS total_tokens, coalesce(record_count, 0) AS record_count, coalesce(session_count, 0) AS session_count
  FROM (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{end}' - 1, INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN daily USING (day)){more}"""


def _intensity(cells: str, columns: str) -> str:
    return f"""SELECT {columns}, CAST(CASE WHEN total_tokens > 0 THEN least(4, floor((rank() OVER (PARTITION BY total_tokens > 0 ORDER BY total_tokens) - 1)
  / greatest(count(*) OVER (PARTITION BY total_tokens > 0) - 1, 1) * 4) + 1) ELSE 0 END AS INTEGER) AS intensity FROM {cells}"""


def _summed(start: str) -> str:
    return f""", cells AS (SELECT {start} AS day, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(record_count) AS BIGINT) AS record_count,
  CAST(sum(session_count) AS BIGINT) AS session_count, count(*) FILTER (total_tokens > 0) AS active_days FROM days GROUP BY 1)"""


_CELL = "day, total_tokens, record_count, session_count"
_TWO_WEEKS = [("today", 1705708800000, 1705622400000), ("week", 1705276800000, 1704672000000), ("month", 1704067200000, 1701388800000)]
_PERIOD_ROWS = " UNION ALL ".join(
    f"SELECT '{p}' AS period, coalesce(sum(total_tokens) FILTER (bucket_start >= {a} AND bucket_start < {NOW_MS + 1}), 0) AS c, "
    f"coalesce(sum(total_tokens) FILTER (bucket_start >= {b} AND bucket_start < {min(a, b + NOW_MS + 1 - a)}), 0) AS p FROM buckets"
    for p, a, b in _TWO_WEEKS
)
_W, _V = _TWO_WEEKS[1][1:]
_VTO = min(_W, _V + NOW_MS + 1 - _W)


def _driver(dimension: str, key: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {key} AS key,
  CAST(coalesce(sum(total_tokens) FILTER (bucket_start >= {_W}), 0) AS BIGINT) AS current_tokens,
  CAST(coalesce(sum(total_tokens) FILTER (bucket_start < {_VTO}), 0) AS BIGINT) AS previous_tokens
  FROM buckets WHERE bucket_start >= {_V} AND bucket_start < {NOW_MS + 1} GROUP BY 2"""


_SESSIONS = f"""{_PRICED_RECORDS},
by_model AS (SELECT source, session_id, model, sum(total_tokens) AS t FROM priced WHERE coalesce(session_id, '') <> '' GROUP BY ALL),
by_project AS (SELECT source, session_id, project_key, sum(total_tokens) AS t FROM priced WHERE coalesce(session_id, '') <> '' GROUP BY ALL),
sessions AS (
  SELECT *, last_active_ms - started_ms AS span_ms, string_split(models, ',')[1] AS primary_model, string_split(projects, ',')[1] AS primary_project,
    {_CONTEXT} AS input_context, {_SHARE} AS cached_share
  FROM (SELECT source, session_id, min(ts_ms) AS started_ms, max(ts_ms) AS last_active_ms, count(*) AS record_count, {_FIVE},
          CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_COST} FROM priced WHERE coalesce(session_id, '') <> '' GROUP BY ALL)
  JOIN (SELECT source, session_id, string_agg(model, ',' ORDER BY t DESC, model) AS models FROM by_model GROUP BY ALL) USING (source, session_id)
  JOIN (SELECT source, session_id, string_agg(project_key, ',' ORDER BY t DESC, project_key) AS projects FROM by_project GROUP BY ALL) USING (source, session_id))"""
_METRICS = {
    "current_total": "total_tokens",
    "without_cached": "total_tokens - cached_input_tokens",
    "without_cache_creation": "total_tokens - cache_creation_input_tokens",
    "without_reasoning": "total_tokens - reasoning_output_tokens",
    "without_all_cache": "total_tokens - cached_input_tokens - cache_creation_input_tokens",
    "plain_input_output": "input_tokens + output_tokens",
    "raw_io_equivalent": "total_tokens - cache_creation_input_tokens",
}
_METRIC_SUMS = ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in _METRICS.items())
_AUDIT = "count(*) AS record_count, count(DISTINCT CASE WHEN session_id <> '' THEN source || ':' || session_id END) AS session_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, " + _METRIC_SUMS
_ORDER_PATH = "'/home/u' || CAST(o_orderkey % 11 AS VARCHAR) || '/work/p' || CAST(o_orderkey % 7 AS VARCHAR) || '/'"
_V2 = "abs(CAST(o_orderkey AS BIGINT) * o_orderkey * 37)"


def _unit(scale: str, name: str) -> str:
    tenths = f"CAST(floor({_V2} / {scale} * 10 + 0.5) AS BIGINT)"
    return f"CAST({tenths} // 10 AS VARCHAR) || CASE WHEN {tenths} % 10 > 0 THEN '.' || CAST({tenths} % 10 AS VARCHAR) ELSE '' END || '{name}'"


ORACLES = {
    "bucket_rollup": f"WITH {BUCKETS_SQL} SELECT * EXCLUDE (total_tokens) FROM buckets",
    "dashboard_totals": f"""{_PRICED_BUCKETS}, t AS (SELECT CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_FIVE}, {_COST} FROM priced)
SELECT *, {_SHARE} AS cached_share FROM t""",
    "by_source": _key("source"),
    "stats_by_model": _key("model"),
    "stats_by_project": _key("project_key"),
    "daily_trend": f"{_DAILY} SELECT * FROM daily",
    "agent_summaries": f"""{_PRICED_RECORDS} SELECT source, count(*) AS record_count, count(DISTINCT nullif(session_id, '')) AS session_count,
  count(DISTINCT project_key) AS project_count, count(DISTINCT model) AS model_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_COST}, CAST(sum(total_tokens) AS DOUBLE) / CAST((SELECT sum(total_tokens) FROM records) AS DOUBLE) AS share
FROM priced GROUP BY source""",
    "report_grouping_sets": f"""{_PRICED_RECORDS}, f AS (SELECT * FROM priced WHERE source = 'codex')
SELECT 'total' AS level, '' AS key, count(*) AS record_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_COST} FROM f
UNION ALL SELECT 'model', model, count(*), CAST(sum(total_tokens) AS BIGINT), {_COST} FROM f GROUP BY model
UNION ALL SELECT 'project', project_key, count(*), CAST(sum(total_tokens) AS BIGINT), {_COST} FROM f GROUP BY project_key""",
    "source_summary": f"WITH {RECORDS_SQL} SELECT count(*) AS record_count, count(DISTINCT nullif(session_id, '')) AS session_count, {_FIVE}, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM records WHERE source = 'claude'",
    "usage_audit": f"""WITH {RECORDS_SQL} SELECT 'total' AS level, '' AS key, {_AUDIT} FROM records
UNION ALL SELECT 'source', source, {_AUDIT} FROM records GROUP BY source
UNION ALL SELECT 'model', model, {_AUDIT} FROM records GROUP BY model
UNION ALL SELECT 'day', CAST({_DAY} AS VARCHAR), {_AUDIT} FROM records GROUP BY {_DAY}""",
    "peak_days": f"WITH {RECORDS_SQL} SELECT {_DAY} AS day, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS record_count FROM records GROUP BY 1 ORDER BY total_tokens DESC, day LIMIT 20",
    "model_options": f"WITH {RECORDS_SQL} SELECT DISTINCT model AS option FROM records",
    "project_options": f"WITH {RECORDS_SQL} SELECT DISTINCT project_key AS option FROM records",
    "token_metrics": f"WITH {RECORDS_SQL} SELECT id, {', '.join(f'{e} AS {n}' for n, e in _METRICS.items())}, {_CONTEXT} AS input_context, {_SHARE} AS cached_share FROM records",
    "filtered_records": f"WITH {RECORDS_SQL} SELECT id, ts_ms, project_key, session_id, total_tokens FROM records WHERE ts_ms >= 1704844800000 AND ts_ms < 1705708800000 AND source = 'codex' AND model = 'gpt-5.4'",
    "records_page": f"WITH {RECORDS_SQL} SELECT id, ts_ms, source, model, total_tokens FROM records ORDER BY ts_ms DESC, id DESC LIMIT 50 OFFSET 100",
    "pricing_resolution": f"""WITH {RECORDS_SQL}, {PRICES_SQL} SELECT model, normalized_model, match_kind, price_id, in_price, cached_price,
  CASE WHEN price_id LIKE 'anthropic%' THEN creation_price END AS creation_price, out_price FROM prices""",
    "pricing_coverage": f"""{_PRICED_BUCKETS}, c AS (SELECT CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  {", ".join(f"CAST(coalesce(sum(total_tokens) FILTER (match_kind = '{k}'), 0) AS BIGINT) AS {n}_tokens" for k, n in (("exact", "exact"), ("alias", "alias"), ("family-fallback", "fallback"), ("unmatched", "unmatched")))}, {_COST} FROM priced)
SELECT *, total_tokens - unmatched_tokens AS priced_tokens, CAST(total_tokens - unmatched_tokens AS DOUBLE) / total_tokens AS coverage_ratio,
  CAST(exact_tokens + alias_tokens AS DOUBLE) / total_tokens AS exact_coverage FROM c""",
    "pricing_by_model": f"""{_PRICED_BUCKETS} SELECT model, match_kind, price_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(units) AS DOUBLE) / 1e9 AS cost_usd FROM priced GROUP BY ALL""",
    "csv_export": f"""{_PRICED_RECORDS} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time, source AS agent, coalesce(session_id, '') AS session_id, model,
  CASE project_key WHEN '/work/p3' THEN '''=3' WHEN '/work/p5' THEN project_key WHEN '/work/p6' THEN project_key ELSE 'Project ' || right(project_key, 1) END AS project, {', '.join(fn.COUNTERS)}, total_tokens,
  CAST(units AS DOUBLE) / 1e9 AS estimated_cost_usd, match_kind AS pricing_status, {_LABEL} AS pricing_label FROM priced""",
    "csv_projection": f"""{_PRICED_RECORDS} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time, id, source, coalesce(session_id, '') AS session_id, model, project_key,
  {', '.join(fn.COUNTERS)}, total_tokens, CAST(units AS DOUBLE) / 1e9 AS cost_usd FROM priced""",
    "period_comparison": f"""WITH {BUCKETS_SQL} SELECT period, CAST(c AS BIGINT) AS current_tokens, CAST(p AS BIGINT) AS previous_tokens, CAST(c - p AS BIGINT) AS delta_tokens,
  CASE WHEN p > 0 THEN CAST(c - p AS DOUBLE) / CAST(p AS DOUBLE) * 100 END AS change_percent FROM ({_PERIOD_ROWS})""",
    "change_drivers": f"""WITH {BUCKETS_SQL}, e AS ({_driver("source", "source")} UNION ALL {_driver("model", "model")} UNION ALL {_driver("project", "project_key")})
SELECT dimension, key, current_tokens, previous_tokens, current_tokens - previous_tokens AS delta_tokens,
  CASE WHEN previous_tokens > 0 THEN CAST(current_tokens - previous_tokens AS DOUBLE) / CAST(previous_tokens AS DOUBLE) * 100 END AS change_percent,
  CAST(current_tokens - previous_tokens AS DOUBLE) / CAST(nullif(sum(current_tokens - previous_tokens) OVER (PARTITION BY dimension), 0) AS DOUBLE) AS share_of_net_change,
  CASE WHEN previous_tokens = 0 AND current_tokens > 0 THEN 'new' WHEN current_tokens = 0 AND previous_tokens > 0 THEN 'inactive'
    WHEN current_tokens > previous_tokens THEN 'increased' ELSE 'decreased' END AS state FROM e""",
    "activity_daily": f"{_spine('2023-01-16', '2024-01-22')} {_intensity('days', _CELL)}",
    "activity_weekly": f"{_spine('2023-01-23', '2024-01-22', _summed('day - (isodow(day) - 1)'))} {_intensity('cells', _CELL + ', active_days')}".replace("day - (isodow(day) - 1)", "CAST(date_trunc('week', day) AS DATE)"),
    "activity_monthly": _spine("2023-02-01", "2024-02-01", _summed("CAST(date_trunc('month', day) AS DATE)")) + " " + _intensity("cells", _CELL + ", active_days"),
    "activity_cumulative": f"""{_DAILY}, days AS (SELECT s.day, coalesce(total_tokens, 0) AS total_tokens, coalesce(record_count, 0) AS record_count, coalesce(session_count, 0) AS session_count
  FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily WHERE total_tokens > 0), DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN daily USING (day)),
r AS (SELECT *, CAST(sum(total_tokens) OVER (ORDER BY day) AS BIGINT) AS cumulative_tokens, max(total_tokens) OVER () AS most FROM days)
SELECT * EXCLUDE (most), CAST(CASE WHEN cumulative_tokens > 0 THEN least(4, greatest(1, ceil(cumulative_tokens / most * 4))) ELSE 0 END AS INTEGER) AS intensity FROM r""",
    "activity_streaks": f"""{_DAILY}, runs AS (SELECT count(*) AS n, min(day) AS first, max(day) AS last FROM
  (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM daily WHERE total_tokens > 0) GROUP BY island)
SELECT coalesce(max(CASE WHEN first <= DATE '2024-01-20' AND last >= DATE '2024-01-20' THEN DATE '2024-01-20' - first + 1 END), 0) AS current_streak, coalesce(max(n), 0) AS longest_streak FROM runs""",
    "activity_summary": f"""{_spine('2023-01-16', '2024-01-22')} SELECT CAST(sum(total_tokens) AS BIGINT) AS range_tokens, max(total_tokens) AS peak_tokens,
  (SELECT day FROM days ORDER BY total_tokens DESC, day LIMIT 1) AS peak_day FROM days""",
    "activity_month_labels": """WITH c AS (SELECT i AS "column", strftime(DATE '2023-01-16' + CAST(7 * i AS INTEGER), '%Y-%m') AS label FROM range(53) t(i))
SELECT label, "column" FROM (SELECT *, lag(label) OVER (ORDER BY "column") AS before FROM c) WHERE before IS NULL OR before <> label""",
    "session_summaries": f"{_SESSIONS} SELECT * FROM sessions",
    "session_list_top": f"{_SESSIONS} SELECT source, session_id, total_tokens, last_active_ms, span_ms, primary_model FROM sessions ORDER BY total_tokens DESC, last_active_ms DESC, source, session_id LIMIT 20",
    "session_list_span": f"{_SESSIONS} SELECT source, session_id, total_tokens, span_ms FROM sessions ORDER BY span_ms DESC, last_active_ms DESC, source, session_id LIMIT 20 OFFSET 20",
    "session_timeline": f"WITH {RECORDS_SQL} SELECT CAST(floor(ts_ms / 900000) * 900000 AS BIGINT) AS start_ms, count(*) AS record_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM records WHERE source = 'codex' AND session_id = 's4' GROUP BY 1",
    "unassigned_usage": f"WITH {RECORDS_SQL} SELECT count(*) AS record_count, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM records WHERE coalesce(session_id, '') = ''",
    "project_insight": f"""WITH {RECORDS_SQL}, i AS (SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS all_tokens,
  CAST(coalesce(sum(total_tokens) FILTER (ts_ms >= 1705017600000 AND ts_ms < 1705622400000), 0) AS BIGINT) AS range_tokens,
  CAST(coalesce(sum(total_tokens) FILTER (ts_ms >= 1704412800000 AND ts_ms < 1705017600000), 0) AS BIGINT) AS previous_tokens,
  count(*) FILTER (ts_ms >= 1705017600000 AND ts_ms < 1705622400000) AS range_records,
  count(DISTINCT CASE WHEN session_id <> '' AND ts_ms >= 1705017600000 AND ts_ms < 1705622400000 THEN source || ':' || session_id END) AS range_sessions,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM records WHERE project_key = '/work/p3')
SELECT *, CASE WHEN previous_tokens > 0 THEN CAST(range_tokens - previous_tokens AS DOUBLE) / previous_tokens * 100 END AS change_percent FROM i""",
    "project_insight_trend": f"""{_PRICED_RECORDS}, p AS (SELECT {_DAY} AS day, {_FIVE}, sum(units) AS units FROM priced WHERE project_key = '/work/p3' GROUP BY 1)
SELECT s.day, {', '.join(f'coalesce({c}, 0) AS {c}' for c in fn.COUNTERS)}, CAST(coalesce(units, 0) AS DOUBLE) / 1e9 AS cost_usd
FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-22', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN p USING (day)""",
    "project_insight_breakdown": f"""WITH {RECORDS_SQL}, r AS (SELECT * FROM records WHERE project_key = '/work/p3' AND ts_ms >= 1704844800000 AND ts_ms < {NOW_MS}),
e AS (SELECT 'source' AS dimension, source AS key, count(*) AS record_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM r GROUP BY 2
  UNION ALL SELECT 'model', model, count(*), CAST(sum(total_tokens) AS BIGINT) FROM r GROUP BY 2)
SELECT *, CAST(total_tokens AS DOUBLE) / CAST(sum(total_tokens) OVER (PARTITION BY dimension) AS DOUBLE) AS share FROM e""",
    "project_insight_top_sessions": f"{_SESSIONS.replace('FROM records r JOIN prices p USING (model))', chr(70) + 'ROM records r JOIN prices p USING (model) WHERE project_key = ' + repr('/work/p3') + ')', 1)} SELECT source, session_id, total_tokens, record_count, cost_usd FROM sessions ORDER BY total_tokens DESC, last_active_ms DESC, source, session_id LIMIT 5",
    "visible_projects": f"""WITH {RECORDS_SQL} SELECT CASE project_key WHEN '/work/p1' THEN 'One' ELSE split_part(project_key, '/', 3) END AS project_name, count(*) AS record_count,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM records WHERE project_key <> '/work/p2' GROUP BY 1""",
    "model_identity": f"""WITH {RECORDS_SQL}, m AS (SELECT DISTINCT model, regexp_replace(regexp_replace(trim(model), '^model[-_]?', '', 'i'), '[-_]\\d{{8,}}$', '') AS display_name FROM records)
SELECT model, lower(display_name) AS id, display_name, CASE WHEN lower(display_name) LIKE '%claude%' THEN 'anthropic'
  WHEN regexp_matches(lower(display_name), 'gpt|codex|^o[0-9]') THEN 'openai' ELSE 'unknown' END AS provider FROM m""",
    "path_redaction": f"SELECT o_orderkey, 'failed at ~/work/p' || CAST(o_orderkey % 7 AS VARCHAR) || '/x.jsonl' AS text FROM orders",
    "project_display_name": "SELECT o_orderkey, 'p' || CAST(o_orderkey % 7 AS VARCHAR) AS name FROM orders",
    "token_format": f"""SELECT o_orderkey, CASE WHEN {_V2} >= 1e12 THEN {_unit('1e12', 'T')} WHEN {_V2} >= 1e9 THEN {_unit('1e9', 'B')} WHEN {_V2} >= 1e6 THEN {_unit('1e6', 'M')}
  WHEN {_V2} >= 1e3 THEN {_unit('1e3', 'K')} ELSE CAST({_V2} AS VARCHAR) END AS text FROM orders""",
    "fnv_hash": f"""SELECT o_orderkey, printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(path, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda h, c: ((xor(h, c)) * 16777619) & 4294967295)) AS hash FROM (SELECT o_orderkey, {_ORDER_PATH} AS path FROM orders)""",
    "url_component": f"SELECT o_orderkey, replace(replace({_ORDER_PATH}, '/', '%2F') || ' a~(b)!*' || CAST(o_orderkey % 5 AS VARCHAR), ' ', '%20') AS text FROM orders",
}

#: Days go out as texts, so that they compare alike everywhere.
_DAYS = {
    "daily_trend": "day", "peak_days": "day", "activity_daily": "day", "activity_weekly": "day", "activity_monthly": "day",
    "activity_cumulative": "day", "activity_summary": "peak_day", "project_insight_trend": "day",
}


def _with_text(query, column):
    return lambda spark, d: query(spark, d).withColumn(column, F.col(column).cast("string"))


for _name, _column in _DAYS.items():
    QUERIES[_name] = _with_text(QUERIES[_name], _column)
    ORACLES[_name] = f"SELECT * REPLACE (CAST({_column} AS VARCHAR) AS {_column}) FROM ({ORACLES[_name]})"
