"""Queries on counters, duplicates, forks, matching and audits, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.usage import total_tokens
from ..operators import audits, counters, lineage, matching
from ..sources.tables import COUNTERS_SQL, RECORDS_SQL, counter_events, usage_records

FORK_MS = 1_704_844_800_000
_ORDER = (["session"], ["event_index"])


def _contributions(spark, d):
    return counters.contributions(counter_events(spark, d), *_ORDER)


def _delta(spark, d):
    return _contributions(spark, d).select("session", "event_index", "total", "last", "previous", "relation", "method", "tokens")


def _seeded(spark, d):
    events = counter_events(spark, d).withColumn("_seed", F.lit(40).cast("long"))
    found = counters.contributions(events, *_ORDER, seed=F.col("_seed"))
    return found.groupBy("session").agg(F.sum("tokens").cast("long").alias("tokens"), F.count_if(F.col("method") == "total-initial").alias("initial"))


def _segments(spark, d):
    return counters.segments(counter_events(spark, d), *_ORDER).select("session", "event_index", "segment")


def _transitions(spark, d):
    return counters.transitions(counter_events(spark, d), *_ORDER).select("session", "event_index", "total", "previous_distinct")


def _carried(spark, d):
    rows = counter_events(spark, d)
    return rows.select("session", "event_index", counters.carried("model", *_ORDER).alias("carried_model"))


def _doubled(spark, d):
    """Counter events and copies of every eleventh, of four kinds."""
    rows = counter_events(spark, d).select("session", "event_index", "ts_ms", "total", "last", "response_id", "model")
    base = rows.selectExpr("*", "2 * event_index as at", "concat('f', cast(event_index as string)) as fingerprint").drop("event_index")
    again = rows.filter("event_index % 11 = 0").selectExpr(
        "session", "ts_ms", "total", "last",
        "case when event_index % 55 = 0 then 'other' when event_index % 33 = 0 or event_index % 22 = 0 then response_id end as response_id",
        "model", "2 * event_index + 1 as at",
        "concat(case when event_index % 22 = 0 then 'f' else 'g' end, cast(event_index as string)) as fingerprint",
    )
    return base.unionByName(again).withColumnRenamed("at", "event_index")


def _raw_unique(spark, d):
    found = lineage.raw_unique(_doubled(spark, d), ["session", "fingerprint"], ["event_index"])
    return found.select("session", "fingerprint", "event_index", "total")


def _duplicate_groups(spark, d):
    return lineage.duplicate_groups(_doubled(spark, d), ["session", "fingerprint"], "event_index")


def _survivors(spark, d):
    """What counts once duplicates are gone."""
    events = _doubled(spark, d)
    gone = lineage.semantic_duplicates(events).filter("suppressed").select("session", "event_index")
    left = events.join(gone, ["session", "event_index"], "left_anti")
    found = counters.contributions(left, *_ORDER)
    return found.groupBy("session").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))


def _sessions(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    parent = "case when user_id % 5 = 0 and user_id % 15 <> 0 then concat('s', cast(user_id - 1 as string)) when user_id % 45 = 0 then 'gone' end"
    return users.selectExpr(
        "concat('s', cast(user_id as string)) as session", f"{parent} as parent", f"case when user_id % 20 <> 0 then {FORK_MS}L end as fork_ms"
    )


def _fork_events(spark, d):
    """Counter events, those of some children only from after the fork."""
    rows = counter_events(spark, d)
    return rows.filter(f"ts_ms >= {FORK_MS} or cast(substr(session, 2) as bigint) % 10 <> 0")


def _baselines(spark, d):
    return lineage.fork_baselines(_sessions(spark, d), _fork_events(spark, d))


def _replays(spark, d):
    """A child repeats its parent's first rows, all but its fourth alike."""
    rows = counter_events(spark, d).select("session", "event_index", "ts_ms", "response_id", F.col("k").alias("tokens"))
    children = _sessions(spark, d).filter("parent is not null and fork_ms is not null").select("session", "parent")
    n = F.expr("row_number() over (partition by session order by ts_ms, event_index)")
    copied = rows.withColumn("n", n).filter("n <= 8").withColumnRenamed("session", "parent").join(children, "parent")
    copied = copied.selectExpr("session", "-1000000 + event_index as event_index", "ts_ms", "response_id", "case when n = 4 then tokens + 1 else tokens end as tokens")
    own = rows.join(children.select("session"), "session", "left_anti")
    return lineage.replay_prefix(_sessions(spark, d), own.unionByName(copied))


def _cycles(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    up = "case when user_id % 10 < 4 then user_id - user_id % 10 + (user_id % 10 + 1) % 4 when user_id % 30 > 25 then user_id - 1 end"
    return lineage.cycles(users.selectExpr("cast(user_id as string) as session", f"cast({up} as string) as parent"))


def _files(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.selectExpr(
        "concat('f', cast(user_id as string)) as path",
        "case when user_id = 140 then null else concat('s', cast(user_id div 3 as string)) end as session",
        "case when user_id div 3 % 7 = 0 and user_id % 3 = 1 then 'x' end as parent",
        "user_id % 2 = 1 as archived",
        "user_id % 4 * 100 as size",
        "user_id % 3 * 10 as modified_ms",
        "user_id",
    )


def _reconciled(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "user_id as base", "event_id", "row_number() over (partition by user_id order by event_id) as n", "count(*) over (partition by user_id) as total"
    )
    files = _files(spark, d)
    took = "user_id % 3 <> 1 or 2 * n <= total"  # a copy that ends half-way through the file
    held = files.selectExpr("path", "user_id", "user_id - user_id % 3 as base").join(rows, "base").filter(took)
    changed = "user_id % 3 = 2 and user_id div 3 % 4 = 0 and n = 5"
    events = held.selectExpr("path", "cast(n as bigint) as event_index", f"concat('e', cast(event_id as string), case when {changed} then 'x' else '' end) as identity")
    return lineage.reconcile(files.drop("user_id"), events)


def _preferred(spark, d):
    return lineage.preferred_files(_files(spark, d).filter("session is not null"))


def _sides(spark, d):
    rows = counter_events(spark, d)
    payloads = rows.filter("event_index % 3 = 0").selectExpr(
        "concat('p', cast(event_index as string)) as id", "session", "event_index as key", "response_id", "model",
        "case when event_index % 9 = 0 then 0 when event_index % 4 = 0 then k + 1 else k end as tokens", "ts_ms + event_index % 5 * 700 as ts_ms",
    )
    tokens = rows.filter("event_index % 2 = 0 or event_index % 7 = 0").selectExpr(
        "concat('t', cast(event_index as string)) as id", "session", "event_index as key", "response_id", "model", "k as tokens", "ts_ms"
    )
    return payloads, tokens


def _overlap(spark, d):
    return matching.overlap(*_sides(spark, d))


def _audited_sides(spark, d):
    """Payloads and tokens of which some lack a response or a turn, share a turn, or have other parts of the same total."""
    rows = counter_events(spark, d).withColumn("turn", F.expr("concat('u', cast(event_index div 400 as string))"))
    payloads = rows.filter("event_index % 3 = 0").selectExpr(
        "concat('p', cast(event_index as string)) as id", "session", "ts_ms + event_index % 5 * 700 as ts_ms",
        "case when event_index % 4 = 0 then response_id end as response_id", "case when event_index % 5 = 0 then turn end as turn_id",
        "case when event_index % 9 = 0 then k + 1 else k end as tokens", "event_index % 7 as parts",
    )
    tokens = rows.filter("event_index % 2 = 0 or event_index % 7 = 0").selectExpr(
        "concat('t', cast(event_index as string)) as id", "session", "ts_ms", "response_id", "turn as turn_id", "k as tokens", "0 as parts"
    )
    usage = "case when parts in (0, 2, 4) then named_struct('input', tokens - tokens div 4, 'output', tokens div 4) else named_struct('input', tokens - tokens div 5, 'output', tokens div 5) end"
    return tuple(x.selectExpr("*", f"{usage} as usage", "tokens > 0 as counted") for x in (payloads, tokens))


def _overlap_report(spark, d):
    """Of the audited payloads every thirteenth is shadowed by other usage of its event, so it isn't audited; some have no type or model."""
    payloads, tokens = _audited_sides(spark, d)
    number = "cast(substr(id, 2) as bigint)"
    payloads = payloads.selectExpr(
        "*", f"{number} % 13 <> 0 as eligible", f"case {number} % 4 when 0 then null when 1 then 'response_item' else 'turn_context' end as semantic_type", f"if({number} % 5 = 0, null, concat('m', cast({number} % 2 as string))) as model"
    )
    return payloads, tokens, matching.overlap_audit(payloads.filter("eligible"), tokens)


def _overlap_dimensions(spark, d):
    payloads, _, audit = _overlap_report(spark, d)
    return matching.overlap_dimensions(payloads, audit)


def _overlap_models(spark, d):
    payloads, _, audit = _overlap_report(spark, d)
    return matching.overlap_by_model(payloads, audit)


def _overlap_classes(spark, d):
    payloads, tokens = _audited_sides(spark, d)
    return matching.overlap_classes(payloads, matching.overlap_audit(payloads, tokens))


def _replayed(spark, d):
    """A child repeats its parent's first rows; by its number some lack the turn or the response, or have another model or precision."""
    rows = counter_events(spark, d).selectExpr(
        "session", "event_index", "ts_ms", "case when event_index % 6 <> 1 then response_id end as response_id", "concat('u', cast(event_index div 9 as string)) as turn_id", "model",
        "k as tokens", "named_struct('input', k - k div 4, 'output', k div 4) as usage", "case when event_index % 8 = 0 then 'aggregate-exact' else 'components-exact' end as precision",
    )
    children = _sessions(spark, d).filter("parent is not null and fork_ms is not null").select("session", "parent")
    n = F.expr("row_number() over (partition by session order by ts_ms, event_index)")
    copied = rows.withColumn("n", n).filter("n <= 9").withColumnRenamed("session", "parent").join(children, "parent")
    copied = copied.selectExpr(
        "session", "-1000000 + event_index as event_index", "ts_ms", "case when n % 4 <> 0 then response_id end as response_id", "case when event_index % 5 <> 0 then turn_id end as turn_id",
        "case when event_index % 3 <> 0 then model end as model", "tokens",
        "case when event_index % 16 = 0 then named_struct('input', tokens, 'output', 0L) else usage end as usage",
        "case when event_index % 41 = 0 then 'partial' else precision end as precision",
    )
    own = rows.join(children.select("session"), "session", "left_anti")
    return lineage.replayed_contributions(_sessions(spark, d), own.unionByName(copied))


def _orders(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as id", "o_custkey as customer", "o_orderstatus as status")
    old = rows.filter("id % 10 <> 0")
    new = rows.filter("id % 10 <> 1").selectExpr("id", "case when id % 13 = 0 then customer + 1 else customer end as customer", "case when id % 17 = 0 then null else status end as status")
    return old, new


def _upserted(spark, d):
    old, new = _orders(spark, d)
    twice = new.filter("id % 5 = 0").selectExpr("*", "1 as seq").unionByName(new.filter("id % 5 = 0").selectExpr("id", "customer + 100 as customer", "status", "2 as seq"))
    return matching.upserted(old.withColumn("seq", F.lit(0)), twice, "id", ["seq"])


def _projection(spark, d):
    rows = _contributions(spark, d).filter("tokens > 0")
    numbered = counters.slots(rows, ["session", "response_id"], ["event_index"])
    record = F.concat(F.lit("codex:v5:"), F.col("session"), F.lit(":"), F.col("response_id"), F.lit(":"), F.col("slot").cast("string"))
    return numbered.select(record.alias("id"), "session", "tokens", F.coalesce("model", F.lit("unknown")).alias("model"))


def _suppressed(spark, d):
    rows = counter_events(spark, d).selectExpr("concat(session, ':', cast(event_index div 8 as string)) as usage_key", "event_index", "k div 20 as usage")
    kept = counters.changed_only(rows, ["usage_key"], ["event_index"], "usage")
    return counters.last_by(kept, "usage_key", ["event_index"])


def _changed(spark, d):
    rows = counter_events(spark, d).selectExpr("session", "event_index", "case when k % 5 = 0 then null else k div 30 end as usage")
    return counters.changed_only(rows, ["session"], ["event_index"], "usage")


def _taxonomy(spark, d):
    rows = counter_events(spark, d).selectExpr(
        "case when event_type = 'view' then 'event_msg' when event_type = 'error' then '' else event_type end as outer_type",
        "case when event_index % 3 = 0 then 'token_count' when event_index % 3 = 1 then 'item' end as payload_type",
        "case when event_index % 4 = 0 then 'note' end as message_type",
    )
    return audits.taxonomy(rows)


def _mismatch(spark, d):
    rows = usage_records(spark, d).withColumn("a", F.col("input_tokens") * 100)
    return audits.mismatch_histogram(rows.withColumn("b", F.col("output_tokens") * F.col("cached_input_tokens")), "a", "b")


def _gates(spark, d):
    rows = usage_records(spark, d).withColumn("tokens", total_tokens())
    return audits.gates(
        rows,
        {
            "ids_present": F.col("id").isNotNull(),
            "counters_positive": F.col("tokens") > 0,
            "sessions_present": F.col("session_id").isNotNull(),
            "cache_below_input": F.col("cached_input_tokens") <= F.col("input_tokens"),
        },
    )


def _reconciliation(spark, d):
    rows = usage_records(spark, d).withColumn("total_tokens", total_tokens())
    expected = rows.filter("event_id % 19 <> 0")
    actual = rows.filter("event_id % 23 <> 0").withColumn("total_tokens", F.expr("case when event_id % 29 = 0 then total_tokens + 5 else total_tokens end"))
    return audits.reconciliation(expected, actual, ["source", "model", "total_tokens"])


def _usage_sources(spark, d):
    rows = counter_events(spark, d)
    n = F.col("event_index")
    found = audits.usage_source(n % 3 == 0, F.col("total").isNotNull() & (n % 7 == 0), n % 5 == 0, F.col("last").isNotNull() | (n % 2 == 0))
    return rows.groupBy(found.alias("usage_source")).agg(F.count("*").alias("n"))


def _moved_files(spark, d):
    """Each user's log, of which some share a session, with cursors of which some are of other paths or sessions."""
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    files = users.selectExpr("'codex' as source", "concat('/new/', cast(user_id as string)) as path", "case when user_id % 7 <> 0 then concat('s', cast(user_id div 2 as string)) end as logical_id")
    cursors = users.selectExpr(
        "'codex' as source", "concat(case when user_id % 3 = 0 then '/new/' else '/old/' end, cast(user_id as string)) as path",
        "case when user_id % 9 = 0 then 'other' else concat('s', cast(user_id div 2 as string)) end as logical_id",
    )
    return matching.moved_files(files, cursors)


def _fork_history_sides(spark, d):
    """Each user's session as a fork of the one before, some of themselves, with figures by the user's number."""
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u")).distinct()

    def pair(a, b):
        return f"named_struct('input', cast({a} as bigint), 'output', cast({b} as bigint))"

    session, made = "concat('s', cast(u as string)) as session", pair("case when u % 14 = 3 then 0 else greatest(u % 17 - u % 11, 0) end", "case when u % 14 = 3 then 0 else greatest(u % 9 - u % 5, 0) end")
    cursors = users.filter("u % 3 <> 0").selectExpr(
        session, "concat('s', cast(u - if(u % 7 = 0, 0, 1) as string)) as parent", f"case when u % 4 <> 0 then {pair('u % 11', 'u % 5')} end as baseline"
    )
    traces = users.filter("u % 5 <> 0").selectExpr(
        session, "concat('s', cast(u - if(u % 13 = 0, 0, 1) as string)) as parent", f"case when u % 6 <> 0 then {pair('u % 11', 'u % 5 + if(u % 8 = 1, 1, 0)')} end as baseline",
        f"{pair('u % 17', 'u % 9')} as first_total", f"case when u % 9 <> 4 then {made} end as contribution", "case when u % 10 <> 1 then concat('e', cast(u as string)) end as first_id",
    )
    named = users.selectExpr("concat('e', cast(u as string)) as id", "concat('s', cast(u as string)) as session", "u", f"case when u % 16 = 2 then {pair('1', '1')} else {made} end as usage")
    return cursors, traces, named.filter("u % 12 <> 0").select("id", "session", "usage"), named.filter("u % 4 < 2").select("id"), named.filter("u % 4 = 2").select("id")


QUERIES = {
    "usage_sources": _usage_sources,
    "event_context": lambda s, d: audits.event_context(counter_events(s, d)),
    "largest_differences": lambda s, d: audits.largest_differences(audits.methods_side_by_side(_contributions(s, d)), "session", "segmented_delta", "terminal"),
    "moved_files": _moved_files,
    "cumulative_delta": _delta,
    "seeded_delta": _seeded,
    "counter_segments": _segments,
    "transition_index": _transitions,
    "carry_forward": _carried,
    "raw_dedup": _raw_unique,
    "duplicate_groups": _duplicate_groups,
    "semantic_duplicates": lambda s, d: lineage.semantic_duplicates(_doubled(s, d)),
    "evidence_summary": lambda s, d: lineage.evidence_summary(lineage.semantic_duplicates(_doubled(s, d))),
    "survivor_contributions": _survivors,
    "fork_baseline_asof": _baselines,
    "fork_replay_prefix": _replays,
    "fork_cycles": _cycles,
    "logical_session_reconcile": _reconciled,
    "preferred_file": _preferred,
    "payload_fallback": lambda s, d: matching.payload_fallback(*_sides(s, d)),
    "payload_overlap_interval": _overlap,
    "payload_overlap_audit": lambda s, d: matching.overlap_audit(*_audited_sides(s, d)),
    "payload_overlap_classes": _overlap_classes,
    "payload_overlap_dimensions": _overlap_dimensions,
    "payload_overlap_models": _overlap_models,
    "payload_overlap_days": lambda s, d: matching.overlap_by_day(*_overlap_report(s, d)),
    "payload_overlap_summary": lambda s, d: matching.overlap_summary(*_overlap_report(s, d)),
    "fork_replay_contributions": _replayed,
    "snapshot_diff": lambda s, d: matching.snapshot_diff(*_orders(s, d)),
    "snapshot_diff_summary": lambda s, d: matching.diff_summary(matching.snapshot_diff(*_orders(s, d))),
    "upsert": _upserted,
    "record_projection": _projection,
    "claude_change_suppression": _suppressed,
    "changed_only": _changed,
    "taxonomy_histogram": _taxonomy,
    "mismatch_histogram": _mismatch,
    "gates": _gates,
    "fork_history": lambda s, d: audits.fork_history(*_fork_history_sides(s, d)),
    "fork_history_summary": lambda s, d: audits.fork_history_summary(*_fork_history_sides(s, d)),
    "record_reconciliation": _reconciliation,
    "methods_side_by_side": lambda s, d: audits.methods_side_by_side(_contributions(s, d)),
}


def _contributed(rows: str, seed: str = "NULL") -> str:
    """Common tables c (with previous and relation) and x (with method and tokens) over rows."""
    return f"""c AS (SELECT *, CASE WHEN total IS NULL THEN 'none' WHEN previous IS NULL THEN 'initial' WHEN total = previous THEN 'same' WHEN total > previous THEN 'increased' ELSE 'reset' END AS relation
  FROM (SELECT *, coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {seed}) AS previous FROM {rows})),
x AS (SELECT *, CASE WHEN last IS NOT NULL THEN 'last' ELSE CASE relation WHEN 'none' THEN 'unresolved' WHEN 'initial' THEN 'total-initial' WHEN 'same' THEN 'duplicate-zero'
    WHEN 'increased' THEN 'total-delta' ELSE 'total-reset' END END AS method,
  CASE WHEN last IS NOT NULL THEN last WHEN relation IN ('initial', 'reset') THEN total WHEN relation = 'increased' THEN total - previous ELSE 0 END AS tokens FROM c)"""


_DOUBLED = f"""WITH {COUNTERS_SQL}, doubled AS (
  SELECT session, ts_ms, total, last, response_id, model, 2 * event_index AS event_index, 'f' || event_index AS fingerprint FROM counters
  UNION ALL SELECT session, ts_ms, total, last, CASE WHEN event_index % 55 = 0 THEN 'other' WHEN event_index % 33 = 0 OR event_index % 22 = 0 THEN response_id END, model,
    2 * event_index + 1, (CASE WHEN event_index % 22 = 0 THEN 'f' ELSE 'g' END) || event_index FROM counters WHERE event_index % 11 = 0)"""
_SEMANTIC = f"""{_DOUBLED}, hubs AS (SELECT *, min(event_index) OVER w AS hub_index, count(*) OVER w AS group_size,
    first_value(fingerprint) OVER (w ORDER BY event_index) AS hf, first_value(response_id) OVER (w ORDER BY event_index) AS hr, first_value(model) OVER (w ORDER BY event_index) AS hm
  FROM doubled WHERE total IS NOT NULL AND ts_ms IS NOT NULL WINDOW w AS (PARTITION BY session, ts_ms, total)),
duplicates AS (SELECT *, evidence IN ('confirmed', 'strong') AS suppressed FROM (SELECT session, event_index, hub_index, group_size,
  CASE WHEN response_id <> hr OR model <> hm THEN 'conflict' WHEN fingerprint = hf THEN 'confirmed' WHEN response_id = hr THEN 'strong' ELSE 'probable' END AS evidence
  FROM hubs WHERE event_index > hub_index))"""
_SESSIONS_SQL = f"""sessions AS (SELECT DISTINCT 's' || user_id AS session, CASE WHEN user_id % 5 = 0 AND user_id % 15 <> 0 THEN 's' || (user_id - 1) WHEN user_id % 45 = 0 THEN 'gone' END AS parent,
  CASE WHEN user_id % 20 <> 0 THEN {FORK_MS} END AS fork_ms FROM events)"""
_FILES_SQL = """files AS (SELECT DISTINCT 'f' || user_id AS path, CASE WHEN user_id = 140 THEN NULL ELSE 's' || (user_id // 3) END AS session,
  CASE WHEN user_id // 3 % 7 = 0 AND user_id % 3 = 1 THEN 'x' END AS parent, user_id % 2 = 1 AS archived, user_id % 4 * 100 AS size, user_id % 3 * 10 AS modified_ms, user_id FROM events)"""
_SIDES_SQL = f"""WITH {COUNTERS_SQL},
p AS (SELECT 'p' || event_index AS id, session, event_index AS key, response_id, model, CASE WHEN event_index % 9 = 0 THEN 0 WHEN event_index % 4 = 0 THEN k + 1 ELSE k END AS tokens,
  ts_ms + event_index % 5 * 700 AS ts_ms FROM counters WHERE event_index % 3 = 0),
t AS (SELECT 't' || event_index AS id, session, event_index AS key, response_id, model, k AS tokens, ts_ms FROM counters WHERE event_index % 2 = 0 OR event_index % 7 = 0)"""


def _unique(pairs: str) -> str:
    return f"SELECT * EXCLUDE (l, r) FROM (SELECT *, count(*) OVER (PARTITION BY p_id) AS l, count(*) OVER (PARTITION BY t_id) AS r FROM ({pairs})) WHERE l = 1 AND r = 1"


def _usage(parts: str, tokens: str) -> str:
    return f"CASE WHEN {parts} IN (0, 2, 4) THEN [{tokens} - {tokens} // 4, {tokens} // 4] ELSE [{tokens} - {tokens} // 5, {tokens} // 5] END"


def _audit_sql(which: str = "") -> str:
    sql = f"""WITH {COUNTERS_SQL}, e AS (SELECT *, 'u' || (event_index // 400) AS turn, CASE WHEN event_index % 9 = 0 THEN k + 1 ELSE k END AS k2 FROM counters),
p AS (SELECT 'p' || event_index AS id, session, ts_ms + event_index % 5 * 700 AS ts_ms, CASE WHEN event_index % 4 = 0 THEN response_id END AS response_id,
  CASE WHEN event_index % 5 = 0 THEN turn END AS turn_id, k2 AS tokens, {_usage('event_index % 7', 'k2')} AS usage FROM e WHERE event_index % 3 = 0{which}),
t AS (SELECT 't' || event_index AS id, session, ts_ms, response_id, turn AS turn_id, k AS tokens, {_usage('0', 'k')} AS usage, k > 0 AS counted FROM e WHERE event_index % 2 = 0 OR event_index % 7 = 0),
d0 AS (SELECT '' AS p_id, '' AS t_id WHERE false), m0 AS (SELECT '' AS p_id, '' AS t_id, '' AS evidence, '' AS confidence WHERE false)"""
    near = "t.counted AND p.usage = t.usage AND abs(p.ts_ms - t.ts_ms)"
    passes = [
        ("same-response-id", "exact", "p.response_id = t.response_id"), ("same-turn-id", "probable", "p.turn_id = t.turn_id"),
        ("exact-usage-near-time", "probable", f"{near} <= 1000"), ("exact-usage-wide-time", "possible", f"{near} > 1000 AND abs(p.ts_ms - t.ts_ms) <= 10000"),
        ("same-total-near-time", "weak", "t.counted AND p.usage <> t.usage AND p.tokens = t.tokens AND abs(p.ts_ms - t.ts_ms) <= 10000"),
    ]
    for i, (evidence, confidence, condition) in enumerate(passes):
        narrow = "WHERE n_equal <> 1 OR equal" if i < 2 else ""
        sql += f""", c{i + 1} AS (SELECT p_id, t_id FROM (SELECT p.id AS p_id, t.id AS t_id, p.usage = t.usage AS equal, count(*) FILTER (p.usage = t.usage) OVER (PARTITION BY p.id) AS n_equal
  FROM p JOIN t ON p.session = t.session AND {condition} LEFT JOIN d{i} d ON d.p_id = p.id AND d.t_id = t.id
  WHERE p.id NOT IN (SELECT p_id FROM m{i}) AND t.id NOT IN (SELECT t_id FROM m{i}) AND (d.p_id IS NOT NULL OR p.id NOT IN (SELECT p_id FROM d{i}))) {narrow}),
m{i + 1} AS (SELECT * FROM m{i} UNION ALL SELECT p_id, t_id, '{evidence}', '{confidence}' FROM ({_unique(f'SELECT * FROM c{i + 1}')})),
f{i + 1} AS (SELECT p_id, {i} AS pass, '{evidence}' AS tried FROM c{i + 1} WHERE p_id NOT IN (SELECT p_id FROM m{i + 1})),
d{i + 1} AS (SELECT * FROM c{i + 1} UNION ALL SELECT * FROM d{i} WHERE p_id NOT IN (SELECT p_id FROM c{i + 1}))"""
    return sql + """, f AS (SELECT p_id, arg_min(tried, pass) AS tried FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5) GROUP BY p_id),
r AS (SELECT p.id, p.tokens, m.t_id AS matched_id, coalesce(m.evidence, f.tried, 'none') AS evidence, coalesce(m.confidence, CASE WHEN f.p_id IS NULL THEN 'unmatched' ELSE 'ambiguous' END) AS confidence,
  CASE WHEN t.id IS NULL THEN 'unknown' WHEN p.usage = t.usage THEN 'same-components' WHEN p.tokens = t.tokens THEN 'same-total-different-components' ELSE 'different' END AS relation,
  abs(p.ts_ms - t.ts_ms) AS gap_ms FROM p LEFT JOIN m5 m ON m.p_id = p.id LEFT JOIN t ON t.id = m.t_id LEFT JOIN f ON f.p_id = p.id),
a AS (SELECT *, CASE WHEN confidence IN ('ambiguous', 'unmatched') THEN confidence WHEN confidence = 'weak' THEN 'weak-candidate' WHEN relation <> 'same-components' THEN 'linked-different-usage'
  WHEN confidence = 'exact' THEN 'confirmed' ELSE confidence END AS duplicate_class FROM r) """


_HISTORY_SQL = """WITH u AS (SELECT DISTINCT user_id AS u FROM events),
m AS (SELECT u, CASE WHEN u % 14 = 3 THEN [0, 0] ELSE [greatest(u % 17 - u % 11, 0), greatest(u % 9 - u % 5, 0)] END AS made FROM u),
c AS (SELECT u, 's' || (u - 1) AS parent, CASE WHEN u % 4 <> 0 THEN [u % 11, u % 5] END AS b FROM u WHERE u % 3 <> 0 AND u % 7 <> 0),
t AS (SELECT u, 's' || (u - 1) AS parent, CASE WHEN u % 6 <> 0 THEN [u % 11, u % 5 + CASE WHEN u % 8 = 1 THEN 1 ELSE 0 END] END AS b, [u % 17, u % 9] AS f,
  CASE WHEN u % 9 <> 4 THEN made END AS k, u % 10 <> 1 AND u % 12 <> 0 AS has, CASE WHEN u % 16 = 2 THEN [1, 1] ELSE made END AS r FROM m WHERE u % 5 <> 0 AND u % 13 <> 0),
j AS (SELECT coalesce(c.u, t.u) AS u, coalesce(c.parent, t.parent) AS parent, c.b AS sb, t.b AS rb, k, coalesce(has, false) AS has, r,
  CASE WHEN f IS NOT NULL AND c.b IS NOT NULL THEN [greatest(f[1] - c.b[1], 0), greatest(f[2] - c.b[2], 0)] END AS l FROM c FULL JOIN t ON c.u = t.u),
e AS (SELECT *, coalesce(l[1] + l[2] > 0, false) AS se, coalesce(k[1] + k[2] > 0, false) AS re FROM j)"""
_REPORT_SQL = f"""{_audit_sql(' AND event_index % 13 <> 0')}, s AS (
  SELECT 'p' || event_index AS id, ts_ms + event_index % 5 * 700 AS ts_ms, k2 AS tokens, event_index % 13 <> 0 AS eligible, CASE event_index % 4 WHEN 0 THEN NULL WHEN 1 THEN 'response_item' ELSE 'turn_context' END AS semantic_type,
    CASE WHEN event_index % 5 = 0 THEN NULL ELSE 'm' || (event_index % 2) END AS model FROM e WHERE event_index % 3 = 0)"""
_REPORT_SQL = _REPORT_SQL.replace("a AS (SELECT *, CASE WHEN confidence", "a AS (SELECT * EXCLUDE (tokens), CASE WHEN confidence")


def _total(where: str, name: str) -> str:
    return f"CAST(coalesce(sum(tokens) FILTER ({where}), 0) AS BIGINT) AS {name}"


_BY_CLASS = ", ".join(_total(f"duplicate_class = '{c}'", f"{c.replace('-', '_')}_tokens") for c in matching.CLASSES)
_KINDS = {
    "observed": "true", "eligible": "eligible", "shadowed": "NOT eligible", "classified": "c IS NOT NULL", "confirmed": "c = 'confirmed'", "linked": "f IN ('exact', 'probable', 'possible')",
    "candidate": "f IN ('exact', 'probable', 'possible', 'weak', 'ambiguous')",
}
_ORDERS_SQL = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status FROM orders), old AS (SELECT * FROM o WHERE id % 10 <> 0),
new AS (SELECT id, CASE WHEN id % 13 = 0 THEN customer + 1 ELSE customer END AS customer, CASE WHEN id % 17 = 0 THEN NULL ELSE status END AS status FROM o WHERE id % 10 <> 1),
diff AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete'
  WHEN a.customer IS NOT DISTINCT FROM b.customer AND a.status IS NOT DISTINCT FROM b.status THEN 'same' ELSE 'update' END AS change FROM old a FULL JOIN new b ON a.id = b.id)"""

ORACLES = {
    "usage_sources": f"""WITH {COUNTERS_SQL} SELECT CASE WHEN event_index % 3 = 0 THEN 'token-count' WHEN total IS NOT NULL AND event_index % 7 = 0 THEN 'nested-info-non-token-count'
  WHEN event_index % 5 = 0 THEN 'payload-usage' WHEN last IS NOT NULL OR event_index % 2 = 0 THEN 'flat-payload' END AS usage_source, count(*) AS n FROM counters GROUP BY 1""",
    "event_context": f"""WITH {COUNTERS_SQL} SELECT session, event_index, lag(event_type) OVER o AS previous_type, ts_ms - lag(ts_ms) OVER o AS gap_ms,
  last_value(model IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS model_before,
  row_number() OVER o = 1 AS is_first FROM counters WINDOW o AS (PARTITION BY session ORDER BY event_index)""",
    "largest_differences": f"""WITH {COUNTERS_SQL}, {_contributed('counters')}, m AS (SELECT session,
  CAST(coalesce(sum(CASE WHEN relation = 'increased' THEN total - previous WHEN relation IN ('initial', 'reset') THEN total END), 0) AS BIGINT) AS segmented_delta,
  CAST(coalesce(arg_max(total, CASE WHEN total IS NOT NULL THEN event_index END), 0) AS BIGINT) AS terminal FROM x GROUP BY session)
SELECT session, segmented_delta, terminal, segmented_delta - terminal AS difference FROM m ORDER BY abs(segmented_delta - terminal) DESC, session LIMIT 20""",
    "moved_files": """WITH u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT '/new/' || user_id AS path, CASE WHEN user_id % 7 <> 0 THEN 's' || (user_id // 2) END AS logical_id FROM u),
c AS (SELECT CASE WHEN user_id % 3 = 0 THEN '/new/' ELSE '/old/' END || user_id AS path, CASE WHEN user_id % 9 = 0 THEN 'other' ELSE 's' || (user_id // 2) END AS logical_id FROM u),
p AS (SELECT f.path, f.logical_id, c.path IS NOT NULL AS own, c.logical_id AS own_id, (SELECT min(e.path) FROM c e WHERE e.logical_id = f.logical_id) AS elsewhere
  FROM f LEFT JOIN c ON c.path = f.path),
q AS (SELECT *, NOT own AND elsewhere IS NOT NULL AND elsewhere <> path AS may FROM p),
r AS (SELECT *, may AND row_number() OVER (PARTITION BY logical_id, may ORDER BY path) = 1 AS takes FROM q)
SELECT path, logical_id, CASE WHEN own THEN path WHEN takes THEN elsewhere END AS cursor_path,
  CASE WHEN own AND own_id <> logical_id THEN 'changed' WHEN own THEN 'known' WHEN takes THEN 'moved' ELSE 'new' END AS state FROM r""",
    "cumulative_delta": f"WITH {COUNTERS_SQL}, {_contributed('counters')} SELECT session, event_index, total, last, previous, relation, method, tokens FROM x",
    "seeded_delta": f"WITH {COUNTERS_SQL}, {_contributed('counters', '40')} SELECT session, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (method = 'total-initial') AS initial FROM x GROUP BY session",
    "counter_segments": f"""WITH {COUNTERS_SQL}, {_contributed('counters')} SELECT session, event_index,
  CAST(sum(CASE WHEN relation = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY event_index) AS BIGINT) AS segment FROM x""",
    "transition_index": f"""WITH {COUNTERS_SQL}, g AS (SELECT *, lag(total) OVER (PARTITION BY session ORDER BY event_index) AS b FROM counters WHERE total IS NOT NULL)
SELECT session, event_index, total, last_value(CASE WHEN b <> total THEN b END IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous_distinct FROM g""",
    "carry_forward": f"""WITH {COUNTERS_SQL} SELECT session, event_index,
  last_value(model IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_model FROM counters""",
    "raw_dedup": f"{_DOUBLED} SELECT session, fingerprint, event_index, total FROM (SELECT *, row_number() OVER (PARTITION BY session, fingerprint ORDER BY event_index) AS rn FROM doubled) WHERE rn = 1",
    "duplicate_groups": f"{_DOUBLED} SELECT session, fingerprint, count(*) AS n, min(event_index) AS first_index, max(event_index) AS last_index FROM doubled GROUP BY ALL HAVING count(*) > 1",
    "semantic_duplicates": f"{_SEMANTIC} SELECT * FROM duplicates",
    "evidence_summary": f"{_SEMANTIC} SELECT evidence, count(*) AS n, count(*) FILTER (suppressed) AS n_suppressed FROM duplicates GROUP BY evidence",
    "survivor_contributions": f"""{_SEMANTIC}, kept AS (SELECT * FROM doubled d WHERE NOT EXISTS (SELECT 1 FROM duplicates u WHERE u.suppressed AND u.session = d.session AND u.event_index = d.event_index)),
{_contributed('kept')} SELECT session, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY session""",
    "fork_baseline_asof": f"""WITH {COUNTERS_SQL}, {_SESSIONS_SQL}, e AS (SELECT * FROM counters WHERE ts_ms >= {FORK_MS} OR CAST(substr(session, 2) AS BIGINT) % 10 <> 0),
b AS (SELECT * FROM (SELECT s.session, e.event_index, e.total, row_number() OVER (PARTITION BY s.session ORDER BY e.ts_ms DESC, e.event_index DESC) AS rn
  FROM sessions s JOIN e ON e.session = s.parent AND e.ts_ms < s.fork_ms AND e.total IS NOT NULL) WHERE rn = 1),
f AS (SELECT session, arg_min(total, event_index) AS first_total FROM e WHERE total IS NOT NULL GROUP BY session),
early AS (SELECT DISTINCT s.session FROM sessions s JOIN e USING (session) WHERE e.ts_ms < s.fork_ms AND (e.total IS NOT NULL OR e.last IS NOT NULL))
SELECT s.session, s.parent, CASE WHEN s.parent NOT IN (SELECT session FROM sessions) THEN 'missing-parent' WHEN fork_ms IS NULL THEN 'missing-fork-timestamp'
  WHEN s.session IN (SELECT session FROM early) THEN 'explicit-replay' WHEN b.session IS NULL THEN 'missing-parent-checkpoint' WHEN first_total IS NULL THEN 'not-needed'
  WHEN first_total < b.total THEN 'child-counter-reset' ELSE 'resolved' END AS status, b.event_index AS checkpoint_index, b.total AS checkpoint_total
FROM sessions s LEFT JOIN b USING (session) LEFT JOIN f USING (session) WHERE s.parent IS NOT NULL""",
    "fork_replay_prefix": f"""WITH {COUNTERS_SQL}, {_SESSIONS_SQL}, kids AS (SELECT * FROM sessions WHERE parent IS NOT NULL AND fork_ms IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_index) AS n FROM counters),
everything AS (SELECT session, event_index, ts_ms, response_id, k AS tokens FROM counters WHERE session NOT IN (SELECT session FROM kids)
  UNION ALL SELECT kids.session, -1000000 + event_index, ts_ms, response_id, CASE WHEN n = 4 THEN k + 1 ELSE k END FROM r JOIN kids ON r.session = kids.parent WHERE n <= 8),
child AS (SELECT e.*, parent, row_number() OVER (PARTITION BY e.session ORDER BY ts_ms, event_index) AS n FROM everything e JOIN kids USING (session) WHERE ts_ms < fork_ms),
par AS (SELECT kids.session AS child, e.*, row_number() OVER (PARTITION BY kids.session ORDER BY ts_ms, event_index) AS n FROM everything e JOIN kids ON e.session = kids.parent WHERE ts_ms < fork_ms)
SELECT c.session, c.event_index, c.n, min(CASE WHEN c.ts_ms = p.ts_ms AND c.response_id = p.response_id AND c.tokens = p.tokens THEN 1 ELSE 0 END) OVER (PARTITION BY c.session ORDER BY c.n) = 1 AS suppressed
FROM child c LEFT JOIN par p ON p.child = c.session AND p.n = c.n""",
    "fork_cycles": """WITH RECURSIVE s AS (SELECT DISTINCT user_id AS u, CASE WHEN user_id % 10 < 4 THEN user_id - user_id % 10 + (user_id % 10 + 1) % 4 WHEN user_id % 30 > 25 THEN user_id - 1 END AS p FROM events),
walk(start, pos, depth) AS (SELECT u, p, 1 FROM s WHERE p IS NOT NULL UNION SELECT w.start, s.p, w.depth + 1 FROM walk w JOIN s ON s.u = w.pos WHERE s.p IS NOT NULL AND w.depth < 12 AND w.pos <> w.start)
SELECT DISTINCT CAST(start AS VARCHAR) AS session FROM walk WHERE pos = start""",
    "logical_session_reconcile": f"""WITH {_FILES_SQL}, r AS (SELECT user_id AS base, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
e AS (SELECT path, list('e' || event_id || CASE WHEN user_id % 3 = 2 AND user_id // 3 % 4 = 0 AND n = 5 THEN 'x' ELSE '' END ORDER BY n) AS ids
  FROM files f JOIN r ON r.base = f.user_id - f.user_id % 3 WHERE user_id % 3 <> 1 OR 2 * r.n <= total GROUP BY path),
f AS (SELECT files.*, coalesce(ids, []) AS ids, len(coalesce(ids, [])) AS n FROM files LEFT JOIN e USING (path)),
o AS (SELECT session, arg_min(path, (CASE WHEN archived THEN 'b' ELSE 'a' END) || path) AS first, max(n) AS most, min(n) AS least, count(DISTINCT coalesce(parent, '')) > 1 AS differ FROM f GROUP BY session),
l AS (SELECT session, path AS longest, ids AS lids FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, archived, path) AS rn FROM f) WHERE rn = 1),
v AS (SELECT f.*, o.* EXCLUDE (session), l.longest, l.lids[1:f.n] = f.ids AS prefix FROM f LEFT JOIN o ON o.session = f.session LEFT JOIN l ON l.session = f.session),
a AS (SELECT session, bool_and(prefix) AS prefixes FROM v GROUP BY session)
SELECT path, v.session, CAST(n AS BIGINT) AS n_events, CASE WHEN v.session IS NULL THEN 'orphan' WHEN differ THEN 'metadata-conflict' WHEN NOT prefixes THEN 'divergent-events'
  WHEN least = most THEN CASE WHEN path = first THEN 'kept' ELSE 'exact-duplicate' END WHEN path = longest THEN 'kept' ELSE 'prefix-shadowed' END AS status
FROM v LEFT JOIN a ON a.session = v.session""",
    "preferred_file": f"""WITH {_FILES_SQL} SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY size DESC, modified_ms DESC, archived DESC, path) = 1 AS preferred FROM files WHERE session IS NOT NULL""",
    "payload_fallback": f"""{_SIDES_SQL}, one AS ({_unique("SELECT p.id AS p_id, t.id AS t_id FROM p JOIN t USING (session, key, tokens) WHERE p.model IS NULL OR t.model IS NULL OR p.model = t.model")}),
two AS ({_unique("SELECT p.id AS p_id, t.id AS t_id FROM p JOIN t USING (session, response_id, tokens) WHERE p.id NOT IN (SELECT p_id FROM one) AND t.id NOT IN (SELECT t_id FROM one)")}),
m AS (SELECT *, 'same-event' AS o FROM one UNION ALL SELECT *, 'same-response' FROM two)
SELECT p.id, m.t_id AS matched_id, coalesce(o, CASE WHEN tokens = 0 THEN 'ignored-zero' ELSE 'fallback' END) AS outcome, tokens, o IS NULL AND tokens <> 0 AS counted FROM p LEFT JOIN m ON m.p_id = p.id""",
    "payload_overlap_interval": f"""{_SIDES_SQL}, pairs AS (SELECT p.id AS p_id, t.id AS t_id, session, tokens, abs(p.ts_ms - t.ts_ms) AS gap_ms FROM p JOIN t USING (session, tokens)),
near AS ({_unique("SELECT * FROM pairs WHERE gap_ms <= 1000")}),
wide AS ({_unique("SELECT * FROM pairs WHERE gap_ms > 1000 AND gap_ms <= 10000 AND p_id NOT IN (SELECT p_id FROM near) AND t_id NOT IN (SELECT t_id FROM near)")})
SELECT *, 'near' AS evidence FROM near UNION ALL SELECT *, 'wide' FROM wide""",
    "payload_overlap_audit": _audit_sql() + "SELECT * EXCLUDE (tokens) FROM a",
    "payload_overlap_dimensions": f"""{_REPORT_SQL}, x AS (SELECT unnest([('duplicate_class', duplicate_class), ('confidence', confidence), ('evidence', evidence), ('relation', relation), ('semantic_type', coalesce(semantic_type, 'unknown'))]) AS p, tokens FROM s JOIN a USING (id))
SELECT p[1] AS dimension, p[2] AS value, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY ALL""",
    "payload_overlap_models": f"{_REPORT_SQL} SELECT coalesce(model, 'unknown') AS model, count(*) AS payloads, CAST(sum(tokens) AS BIGINT) AS payload_tokens, {_BY_CLASS} FROM s JOIN a USING (id) GROUP BY 1",
    "payload_overlap_days": f"""{_REPORT_SQL}, x AS (
  SELECT ts_ms, s.tokens, eligible, duplicate_class, true AS payload FROM s LEFT JOIN a USING (id) UNION ALL SELECT ts_ms, tokens, false, NULL, false FROM t)
SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, {_total('NOT payload', 'token_count_tokens')}, {_total('payload', 'observed_tokens')}, {_total('eligible', 'eligible_tokens')}, {_BY_CLASS} FROM x GROUP BY 1""",
    "payload_overlap_summary": f"""{_REPORT_SQL}, x AS (SELECT s.*, duplicate_class AS c, coalesce(confidence, '') AS f FROM s LEFT JOIN a USING (id)), y AS (
  SELECT {', '.join(f"count(*) FILTER ({w}) AS {n}_events, {_total(w, f'{n}_tokens')}" for n, w in _KINDS.items())}, (SELECT count(*) FROM t) AS token_count_events, (SELECT CAST(sum(tokens) AS BIGINT) FROM t) AS token_count_tokens FROM x)
SELECT *, eligible_tokens - confirmed_tokens AS not_confirmed_tokens, observed_events = eligible_events + shadowed_events AS universe_events_hold, observed_tokens = eligible_tokens + shadowed_tokens AS universe_tokens_hold,
  eligible_events = classified_events AS classified_events_hold, eligible_tokens = classified_tokens AS classified_tokens_hold,
  eligible_events = classified_events AND eligible_tokens = classified_tokens AS classification_holds FROM y""",
    "payload_overlap_classes": _audit_sql() + "SELECT duplicate_class, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM a GROUP BY 1",
    "fork_replay_contributions": f"""WITH {COUNTERS_SQL}, {_SESSIONS_SQL}, kids AS (SELECT * FROM sessions WHERE parent IS NOT NULL AND fork_ms IS NOT NULL),
r AS (SELECT session, event_index, ts_ms, CASE WHEN event_index % 6 <> 1 THEN response_id END AS response_id, 'u' || (event_index // 9) AS turn_id, model, k AS tokens, [k - k // 4, k // 4] AS usage,
  CASE WHEN event_index % 8 = 0 THEN 'aggregate-exact' ELSE 'components-exact' END AS precision FROM counters),
g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_index) AS n FROM r),
everything AS (SELECT * FROM r WHERE session NOT IN (SELECT session FROM kids)
  UNION ALL SELECT kids.session, -1000000 + event_index, ts_ms, CASE WHEN n % 4 <> 0 THEN response_id END, CASE WHEN event_index % 5 <> 0 THEN turn_id END, CASE WHEN event_index % 3 <> 0 THEN model END,
    tokens, CASE WHEN event_index % 16 = 0 THEN [tokens, 0] ELSE usage END, CASE WHEN event_index % 41 = 0 THEN 'partial' ELSE precision END FROM g JOIN kids ON g.session = kids.parent WHERE n <= 9),
child AS (SELECT e.*, row_number() OVER (PARTITION BY e.session ORDER BY ts_ms, event_index) AS n FROM everything e JOIN kids USING (session) WHERE ts_ms < fork_ms),
par AS (SELECT kids.session AS child, e.*, row_number() OVER (PARTITION BY kids.session ORDER BY ts_ms, event_index) AS n FROM everything e JOIN kids ON e.session = kids.parent WHERE ts_ms < fork_ms)
SELECT c.session, c.event_index, c.n, min(CASE WHEN c.ts_ms = p.ts_ms AND (coalesce(c.response_id = p.response_id, false) OR coalesce(c.turn_id = p.turn_id, false))
    AND coalesce(c.response_id = p.response_id, true) AND coalesce(c.turn_id = p.turn_id, true) AND coalesce(c.model = p.model, true) AND c.precision <> 'partial' AND p.precision <> 'partial'
    AND CASE WHEN c.precision = 'components-exact' AND p.precision = 'components-exact' THEN c.usage = p.usage ELSE c.tokens = p.tokens END
  THEN 1 ELSE 0 END) OVER (PARTITION BY c.session ORDER BY c.n) = 1 AS suppressed
FROM child c LEFT JOIN par p ON p.child = c.session AND p.n = c.n""",
    "snapshot_diff": f"{_ORDERS_SQL} SELECT * FROM diff",
    "snapshot_diff_summary": f"{_ORDERS_SQL} SELECT change, count(*) AS n FROM diff GROUP BY change",
    "upsert": f"""{_ORDERS_SQL} SELECT *, 0 AS seq FROM old WHERE id NOT IN (SELECT id FROM new WHERE id % 5 = 0)
UNION ALL SELECT id, customer + 100, status, 2 FROM new WHERE id % 5 = 0""",
    "record_projection": f"""WITH {COUNTERS_SQL}, {_contributed('counters')} SELECT 'codex:v5:' || session || ':' || response_id || ':' ||
  (row_number() OVER (PARTITION BY session, response_id ORDER BY event_index) - 1) AS id, session, tokens, coalesce(model, 'unknown') AS model FROM x WHERE tokens > 0""",
    "claude_change_suppression": f"""WITH {COUNTERS_SQL}, u AS (SELECT session || ':' || (event_index // 8) AS usage_key, event_index, k // 20 AS usage FROM counters),
c AS (SELECT *, lag(usage) OVER w AS b, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY usage_key ORDER BY event_index))
SELECT usage_key, max(event_index) AS event_index, arg_max(usage, event_index) AS usage FROM c WHERE n = 1 OR usage IS DISTINCT FROM b GROUP BY usage_key""",
    "changed_only": f"""WITH {COUNTERS_SQL}, u AS (SELECT session, event_index, CASE WHEN k % 5 = 0 THEN NULL ELSE k // 30 END AS usage FROM counters),
c AS (SELECT *, lag(usage) OVER w AS b, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY session ORDER BY event_index))
SELECT session, event_index, usage FROM c WHERE n = 1 OR usage IS DISTINCT FROM b""",
    "taxonomy_histogram": f"""WITH {COUNTERS_SQL}, e AS (SELECT CASE WHEN event_type = 'view' THEN 'event_msg' WHEN event_type = 'error' THEN '' ELSE event_type END AS o,
  CASE WHEN event_index % 3 = 0 THEN 'token_count' WHEN event_index % 3 = 1 THEN 'item' END AS p, CASE WHEN event_index % 4 = 0 THEN 'note' END AS m FROM counters),
s AS (SELECT *, CASE WHEN o = 'token_count' OR p = 'token_count' OR m = 'token_count' THEN 'token_count' WHEN o = 'event_msg' THEN coalesce(m, p, o) ELSE coalesce(o, p, m) END AS v FROM e),
a AS (SELECT 'outer' AS dimension, o AS value FROM s UNION ALL SELECT 'payload', p FROM s UNION ALL SELECT 'message', m FROM s UNION ALL SELECT 'semantic', v FROM s)
SELECT dimension, value, count(*) AS n FROM a WHERE value <> '' GROUP BY ALL""",
    "mismatch_histogram": f"""WITH {RECORDS_SQL}, g AS (SELECT abs(input_tokens * 100 - output_tokens * cached_input_tokens) AS gap FROM records)
SELECT CASE WHEN gap <= 0 THEN '0' WHEN gap <= 1000 THEN '1-1K' WHEN gap <= 10000 THEN '1K-10K' WHEN gap <= 100000 THEN '10K-100K' WHEN gap <= 1000000 THEN '100K-1M' ELSE '>1M' END AS size_class,
  count(*) AS n, CAST(sum(gap) AS BIGINT) AS gap FROM g GROUP BY 1""",
    "gates": f"""WITH {RECORDS_SQL}, g AS (SELECT 'ids_present' AS gate, count(*) FILTER (id IS NULL) AS n_broken FROM records UNION ALL SELECT 'counters_positive', count(*) FILTER (total_tokens <= 0) FROM records
UNION ALL SELECT 'sessions_present', count(*) FILTER (session_id IS NULL) FROM records UNION ALL SELECT 'cache_below_input', count(*) FILTER (cached_input_tokens > input_tokens) FROM records)
SELECT *, n_broken = 0 AS holds FROM g""",
    "fork_history": _HISTORY_SQL + """
SELECT 's' || u AS session, parent, CASE WHEN NOT has OR (l IS NULL AND k IS NULL) THEN 'unresolved' WHEN re AND NOT se AND u % 4 = 2 THEN 'database-state-inconsistent'
  WHEN re AND NOT se THEN 'full-replay-only' WHEN se AND NOT re THEN 'persisted-only' WHEN re AND se THEN CASE WHEN l = k THEN 'both-same' ELSE 'both-different' END ELSE 'neither' END AS outcome,
  coalesce(sb = rb, false) AS baseline_matched, CAST(coalesce(rb[1] - sb[1] + rb[2] - sb[2], 0) AS BIGINT) AS baseline_difference,
  CAST(coalesce(abs(rb[1] - sb[1]) + abs(rb[2] - sb[2]), 0) AS BIGINT) AS baseline_magnitude, CAST(coalesce(k[1] + k[2] - l[1] - l[2], 0) AS BIGINT) AS contribution_difference,
  coalesce(has AND u % 4 < 2 AND re AND NOT se AND r = k, false) AS explained FROM e""",
    "fork_history_summary": _HISTORY_SQL + """, x AS (SELECT *, coalesce(has AND u % 4 < 2 AND re AND NOT se AND r = k, false) AS explained FROM e), g AS (
  SELECT count(*) AS forks, count(sb) AS stored_baselines, count(rb) AS replayed_baselines, count(*) FILTER (sb = rb) AS baselines_matched, count(*) FILTER (sb <> rb) AS baselines_different,
    count(*) FILTER (explained) AS explained_records, CAST(coalesce(sum(r[1] + r[2]) FILTER (explained), 0) AS BIGINT) AS explained_tokens, count(*) FILTER (u % 12 <> 0 AND u % 4 < 2) AS fork_extra_records,
    count(*) FILTER (u % 12 <> 0 AND u % 4 < 2 AND NOT explained) AS unexplained_fork_extra_records FROM x),
h AS (SELECT *, (SELECT count(*) FROM u WHERE u % 3 <> 0 AND u % 7 = 0) AS self_parent_cursors, (SELECT count(*) FROM u WHERE u % 5 <> 0 AND u % 13 = 0) AS self_parent_traces, (SELECT count(*) FROM u WHERE u % 4 < 2) AS extra_records FROM g)
SELECT *, explained_records + unexplained_fork_extra_records = fork_extra_records AS fork_extra_adds_up, CASE WHEN fork_extra_records > 0 THEN explained_records / fork_extra_records * 100 ELSE 100.0 END AS fork_extra_explained_percent,
  CASE WHEN extra_records > 0 THEN explained_records / extra_records * 100 ELSE 100.0 END AS extra_explained_percent, extra_records = explained_records AS all_extra_explained FROM h""",
    "record_reconciliation": f"""WITH {RECORDS_SQL}, a AS (SELECT * FROM records WHERE event_id % 19 <> 0),
b AS (SELECT id, source, model, CASE WHEN event_id % 29 = 0 THEN total_tokens + 5 ELSE total_tokens END AS total_tokens FROM records WHERE event_id % 23 <> 0)
SELECT CASE WHEN b.id IS NULL THEN 'expected-only' WHEN a.id IS NULL THEN 'actual-only' WHEN a.total_tokens = b.total_tokens THEN 'matched' ELSE 'mismatched' END AS status,
  count(*) AS n, CAST(coalesce(sum(a.total_tokens), 0) AS BIGINT) AS expected_tokens, CAST(coalesce(sum(b.total_tokens), 0) AS BIGINT) AS actual_tokens FROM a FULL JOIN b USING (id) GROUP BY 1""",
    "methods_side_by_side": f"""WITH {COUNTERS_SQL}, {_contributed('counters')} SELECT session, CAST(coalesce(sum(last), 0) AS BIGINT) AS last_sum,
  CAST(coalesce(sum(CASE WHEN relation = 'increased' THEN total - previous WHEN relation IN ('initial', 'reset') THEN total END), 0) AS BIGINT) AS segmented_delta,
  CAST(coalesce(arg_max(total, event_index) FILTER (total IS NOT NULL), 0) AS BIGINT) AS terminal, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS contributed,
  count(*) FILTER (relation = 'reset') AS resets, count(*) FILTER (method = 'duplicate-zero') AS repeats FROM x GROUP BY session""",
}
