"""Queries of the audit of raw logs (operators/raw_audit.py), on logs made of the table of events.

A user's events are one file; totals start anew every 40 events and repeat themselves, increments now and then aren't what totals grew by, some
events have neither. Every fourth user has a shorter copy in the archive, every eleventh file names no session, and some have no times at first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import raw_audit
from ..sources.tables import COUNTERS_SQL, counter_events
from .accounting import _SESSIONS_SQL, FORK_MS, _sessions

_FIELDS = ("input", "cached", "creation", "output", "reasoning", "total")
_ARCHIVED = 10


def _counters(n: str) -> str:
    """Counters of which a quarter is output; null where there are none."""
    parts = {"input": f"{n} - {n} div 4", "output": f"{n} div 4", "total": n}
    return "case when {0} > 0 then named_struct({1}) end".format(n, ", ".join(f"'{f}', cast({parts.get(f, '0L')} as bigint)" for f in _FIELDS))


def _audit(spark, d):
    rows = counter_events(spark, d).select("session", "event_index", "ts_ms", "k", "model")
    rows = rows.selectExpr("*", "cast(substr(session, 2) as bigint) as u", "row_number() over (partition by session order by event_index) - 1 as n")
    rows = rows.selectExpr("*", "sum(k) over (partition by session, n div 40 order by event_index) as t")
    order = "over (partition by session order by event_index)"
    rows = rows.selectExpr("*", f"lag(t) {order} as t1", f"lag(t, 4) {order} as t4").join(_sessions(spark, d).select("session", "parent"), "session")
    rows = rows.selectExpr(
        "u", "n", "event_index", "model", "if(n = 0 and u % 11 <> 0, session, null) as meta_session", "n = 0 as is_meta", "if(n = 0, parent, null) as forked_from",
        "if(n % 7 = 6 or n = 0 and u % 6 = 0, null, ts_ms) as ts_ms", "'event_msg' as outer_type",
        "case when n % 40 <> 0 then 'token_count' when n div 40 % 4 = 1 then 'response_item' when n div 40 % 4 = 2 then 'session_resume' else 'token_count' end as semantic_type",
        "case when n % 5 = 4 then if(n % 2 = 0, 'flat-payload', 'payload-usage') when n % 5 = 2 and n % 3 = 0 then 'nested-info-non-token-count' else 'token-count' end as source_kind",
        "case when n % 5 in (0, 3) then k when n % 80 = 41 then t when n % 10 = 1 and n % 40 <> 1 then t - t4 when n % 5 = 1 then k end as l",
        "case when n % 5 in (1, 2) then t when n % 5 = 3 then t1 end as tt", "if(n % 5 = 4, k, null) as f", "cast(null as string) as own_id", "cast(n div 3 as string) as content",
    )
    rows = rows.selectExpr("*", *[f"{_counters(c)} as {name}" for c, name in (("l", "last"), ("tt", "total"), ("f", "flat"))])
    live = rows.withColumn("path", F.expr("concat('f', cast(u as string))"))
    copies = rows.filter(f"u % 4 = 0 and n < {_ARCHIVED}").withColumn("path", F.expr("concat('a', cast(u as string))"))
    # read three times: as files, for their heads and for their state
    events = stored(live.unionByName(copies))
    files = events.groupBy("path").agg(
        (F.count("*") * 100).alias("size"), F.max(F.expr(f"if(u % 12 = 0, null, {FORK_MS}L + u)")).alias("modified_ms"), F.max(F.col("path").startswith("a")).alias("archived")
    )
    return raw_audit.audit(files, events.drop("u", "n", "l", "tt", "f"))


def _events(spark, d):
    tokens = [f"{n}_tokens" for n in ("last", "delta", "current", "older", "hybrid", "fork_delta")]
    return _audit(spark, d).rows.select("path", "event_index", "session", "event_class", "source_kind", "timestamp_source", "at_ms", "segment", "adjusted", *tokens)


def _methods(spark, d):
    found = _audit(spark, d)
    return raw_audit.methods(found.rows, found.sessions)


def _classes(spark, d):
    found = _audit(spark, d)
    return raw_audit.classes(found.rows, found.sessions)


def _sources(spark, d):
    return raw_audit.sources(_audit(spark, d).rows)


def _resets(spark, d):
    return raw_audit.resets(_audit(spark, d).rows)


def _by_session(spark, d):
    found = _audit(spark, d)
    return raw_audit.by_session(found.rows, found.sessions)


def _gaps(spark, d):
    return raw_audit.largest_gaps(_by_session(spark, d))


def _days(spark, d):
    return raw_audit.by_day(_audit(spark, d).rows)


def _peaks(spark, d):
    return raw_audit.peak_days(_days(spark, d))


def _figures(spark, d):
    found = _audit(spark, d)
    return raw_audit.figures(found.files, found.events, found.rows, found.sessions)


def _sizes(spark, d):
    return raw_audit.mismatch_sizes(_audit(spark, d).rows)


QUERIES = {
    "raw_events": _events,
    "raw_methods": _methods,
    "raw_classes": _classes,
    "raw_sources": _sources,
    "raw_resets": _resets,
    "raw_sessions": _by_session,
    "raw_largest_gaps": _gaps,
    "raw_days": _days,
    "raw_peak_days": _peaks,
    "raw_figures": _figures,
    "raw_mismatch_sizes": _sizes,
}

# x is a number of tokens, xo the quarter of it that is output; so counters fall and grow together
_SQL = f"""WITH {COUNTERS_SQL},
{_SESSIONS_SQL},
x0 AS (SELECT session, event_index, ts_ms, k, model, CAST(substr(session, 2) AS BIGINT) AS u, row_number() OVER (PARTITION BY session ORDER BY event_index) - 1 AS n FROM counters),
x1 AS (SELECT *, CAST(sum(k) OVER (PARTITION BY session, n // 40 ORDER BY event_index) AS BIGINT) AS t FROM x0),
x2 AS (SELECT *, lag(t) OVER w AS t1, lag(t, 4) OVER w AS t4 FROM x1 WINDOW w AS (PARTITION BY session ORDER BY event_index)),
x3 AS (
  SELECT u, n, event_index, model, session AS s, parent, CASE WHEN n % 7 = 6 OR (n = 0 AND u % 6 = 0) THEN NULL ELSE ts_ms END AS ts,
    CASE WHEN n % 40 <> 0 THEN 'token_count' WHEN n // 40 % 4 = 1 THEN 'response_item' WHEN n // 40 % 4 = 2 THEN 'session_resume' ELSE 'token_count' END AS semantic_type,
    CASE WHEN n % 5 = 4 THEN CASE WHEN n % 2 = 0 THEN 'flat-payload' ELSE 'payload-usage' END WHEN n % 5 = 2 AND n % 3 = 0 THEN 'nested-info-non-token-count' ELSE 'token-count' END AS source_kind,
    nullif(CASE WHEN n % 5 IN (0, 3) THEN k WHEN n % 80 = 41 THEN t WHEN n % 10 = 1 AND n % 40 <> 1 THEN t - t4 WHEN n % 5 = 1 THEN k END, 0) AS l,
    nullif(CASE WHEN n % 5 IN (1, 2) THEN t WHEN n % 5 = 3 THEN t1 END, 0) AS t, nullif(CASE WHEN n % 5 = 4 THEN k END, 0) AS f,
    CASE WHEN u % 12 = 0 THEN NULL ELSE {FORK_MS} + u END AS modified_ms
  FROM x2 JOIN sessions USING (session)),
every AS (SELECT 'f' || u AS path, 1 AS live, * FROM x3 UNION ALL SELECT 'a' || u, 0, * FROM x3 WHERE u % 4 = 0 AND n < {_ARCHIVED}),
files AS (
  SELECT path, any_value(CASE WHEN u % 11 = 0 THEN 'file:' || path ELSE s END) AS session, any_value(parent) AS parent, min(live) AS live, count(*) AS size, max(ts) FILTER (n = 0) AS session_ms FROM every GROUP BY path),
chosen AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY size DESC, live, path) = 1 AS preferred FROM files),
y0 AS (
  SELECT e.* EXCLUDE (parent, model), c.session, c.parent, c.session_ms, e.model AS own_model, last_value(e.model IGNORE NULLS) OVER now_ AS model, last_value(e.model IGNORE NULLS) OVER before_ AS model_before,
    last_value(ts IGNORE NULLS) OVER now_ AS inherited, last_value(ts IGNORE NULLS) OVER before_ AS ts_before, lag(semantic_type) OVER (PARTITION BY e.path ORDER BY event_index) AS previous_type,
    last_value(t IGNORE NULLS) OVER before_ AS p
  FROM every e JOIN chosen c ON e.path = c.path AND preferred
  WINDOW now_ AS (PARTITION BY e.path ORDER BY event_index ROWS UNBOUNDED PRECEDING), before_ AS (PARTITION BY e.path ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y1 AS (
  SELECT *, coalesce(inherited, modified_ms) AS at_ms, coalesce(t < p, false) AS is_reset, coalesce(t = p, false) AS is_repeat,
    CASE WHEN ts IS NOT NULL THEN 'explicit' WHEN inherited IS NOT NULL THEN 'inherited' WHEN modified_ms IS NOT NULL THEN 'file-modified' ELSE 'unresolved' END AS timestamp_source,
    CASE WHEN p IS NULL OR t < p THEN t ELSE t - p END AS d, CASE WHEN p IS NULL OR t < p THEN t // 4 ELSE t // 4 - p // 4 END AS d_o FROM y0),
y2 AS (
  SELECT *, sum(CAST(is_reset AS INT)) OVER (PARTITION BY path ORDER BY event_index) AS segment, coalesce(l, d, f) AS cu, CASE WHEN l IS NOT NULL THEN l // 4 WHEN d IS NOT NULL THEN d_o ELSE f // 4 END AS cuo,
    CASE WHEN is_repeat THEN 0 WHEN t IS NULL THEN coalesce(l, f) WHEN is_reset OR p IS NULL THEN coalesce(l, d) ELSE d END AS h,
    CASE WHEN is_repeat THEN 0 WHEN t IS NULL THEN coalesce(l, f) // 4 WHEN is_reset OR p IS NULL THEN coalesce(l // 4, d_o) ELSE d_o END AS ho,
    CASE WHEN is_reset THEN 'counter-reset' WHEN is_repeat THEN 'duplicate-snapshot' WHEN t IS NOT NULL AND l IS NULL THEN 'normal-delta' WHEN t IS NOT NULL AND l = d THEN 'last-delta-match'
      WHEN t IS NOT NULL THEN 'last-delta-mismatch' WHEN l IS NOT NULL THEN 'last-only' WHEN f IS NOT NULL THEN 'total-only' END AS event_class
  FROM y1),
ends AS (
  SELECT path, session, any_value(parent) AS parent, any_value(session_ms) AS session_ms, min(event_index) FILTER (t IS NOT NULL) AS i1, min(event_index) FILTER (t IS NOT NULL AND l IS NOT NULL) AS i2,
    arg_min(t, event_index) FILTER (t IS NOT NULL) AS t1, arg_min(coalesce(l, -1), event_index) FILTER (t IS NOT NULL) AS l1, arg_min(coalesce(at_ms, -1), event_index) FILTER (t IS NOT NULL) AS at1,
    arg_max(t, event_index) FILTER (t IS NOT NULL) AS terminal
  FROM y2 GROUP BY path, session),
asof_ AS (
  SELECT c.path, arg_max(o.t, o.event_index) AS b FROM ends c JOIN y2 o ON o.session = c.parent AND o.t IS NOT NULL AND o.at_ms <= coalesce(c.session_ms, nullif(at1, -1)) GROUP BY c.path),
held AS (
  SELECT e.*, q.terminal AS pt, CASE WHEN e.parent IS NULL THEN NULL WHEN e.l1 > 0 AND e.t1 >= e.l1 THEN 'child-first' WHEN b IS NOT NULL THEN 'parent-at-fork' ELSE 'missing' END AS how,
    CASE WHEN e.l1 > 0 AND e.t1 >= e.l1 THEN e.t1 - e.l1 ELSE b END AS b, CASE WHEN e.l1 > 0 AND e.t1 >= e.l1 THEN e.t1 // 4 - e.l1 // 4 ELSE b // 4 END AS bo
  FROM ends e LEFT JOIN asof_ USING (path) LEFT JOIN ends q ON q.session = e.parent),
z AS (
  SELECT y2.*, coalesce(event_index = i2 AND h2.parent IS NOT NULL AND pt IS NOT NULL, false) AS adjusted, pt,
    CASE WHEN event_index = i1 AND h2.parent IS NOT NULL AND b IS NOT NULL THEN greatest((d - d_o) - (b - bo), 0) + greatest(d_o - bo, 0) ELSE d END AS fd,
    CASE WHEN event_index = i1 AND h2.parent IS NOT NULL AND b IS NOT NULL THEN greatest(d_o - bo, 0) ELSE d_o END AS fdo
  FROM y2 JOIN held h2 USING (path)),
r AS (
  SELECT *, CASE WHEN adjusted THEN greatest(t - pt, 0) ELSE cu END AS ca, CASE WHEN adjusted THEN greatest(t // 4 - pt // 4, 0) ELSE cuo END AS cao, CASE WHEN model IS NOT NULL THEN cu END AS old FROM z)"""

_TOKENS = "coalesce(l, 0) AS last_tokens, coalesce(d, 0) AS delta_tokens, coalesce(cu, 0) AS current_tokens, coalesce(old, 0) AS older_tokens, coalesce(h, 0) AS hybrid_tokens, coalesce(fd, 0) AS fork_delta_tokens"
_BY_SESSION = """SELECT h2.session, coalesce(terminal, 0) AS terminal_tokens, count(event_class) AS events, count(*) FILTER (is_reset) AS resets, count(*) FILTER (is_repeat) AS repeats,
  CAST(coalesce(sum(l), 0) AS BIGINT) AS last_tokens, CAST(coalesce(sum(d), 0) AS BIGINT) AS delta_tokens, CAST(coalesce(sum(old), 0) AS BIGINT) AS older_tokens, CAST(coalesce(sum(h), 0) AS BIGINT) AS hybrid_tokens
  FROM held h2 JOIN r USING (path) GROUP BY h2.session, terminal"""
_BY_DAY = """SELECT strftime(epoch_ms(at_ms), '%Y-%m-%d') AS day, CAST(coalesce(sum(cu), 0) AS BIGINT) AS current_tokens, CAST(coalesce(sum(l), 0) AS BIGINT) AS last_tokens, CAST(coalesce(sum(d), 0) AS BIGINT) AS delta_tokens,
  CAST(coalesce(sum(fd), 0) AS BIGINT) AS fork_delta_tokens, CAST(coalesce(sum(old), 0) AS BIGINT) AS older_tokens, CAST(coalesce(sum(h), 0) AS BIGINT) AS hybrid_tokens
  FROM r WHERE event_class IS NOT NULL AND at_ms IS NOT NULL GROUP BY day"""
_FIGURES = {
    "r": {
        "usage_events": "count(*)", "token_count_events": "count(*) FILTER (source_kind = 'token-count')", "with_last": "count(l)", "with_total": "count(t)", "with_both": "count(t + l)",
        "total_decreases": "count(*) FILTER (is_reset)", "component_decreases": "count(*) FILTER (is_reset)", "repeats": "count(*) FILTER (is_repeat)", "repeats_with_last": "count(l) FILTER (is_repeat)",
        "repeated_last_tokens": "sum(l) FILTER (is_repeat)", "mismatches": "count(*) FILTER (l <> CASE WHEN is_repeat THEN 0 ELSE d END)", "mismatch_tokens": "sum(abs(l - d))", "last_greater_tokens": "sum(greatest(l - d, 0)) FILTER (l IS NOT NULL AND d IS NOT NULL)",
        "delta_greater_tokens": "sum(greatest(d - l, 0)) FILTER (l IS NOT NULL AND d IS NOT NULL)", "last_minus_delta_tokens": "sum(coalesce(l, 0) - coalesce(d, 0))",
        "older_minus_hybrid_tokens": "sum(CASE WHEN old IS NULL THEN 0 ELSE ca END - coalesce(h, 0))", "delta_minus_hybrid_tokens": "sum(coalesce(d, 0) - coalesce(h, 0))",
        "first_equals_last": "count(*) FILTER (p IS NULL AND t = l)", "first_above_last": "count(*) FILTER (p IS NULL AND t > l)", "first_above_last_tokens": "sum(greatest(t - l, 0)) FILTER (p IS NULL AND t IS NOT NULL AND l IS NOT NULL)",
        **{f"time_{n.replace('-', '_')}": f"count(event_class) FILTER (timestamp_source = '{n}')" for n in ("explicit", "inherited", "file-modified", "unresolved")},
    },
    "chosen": {"files": "count(*)", "canonical_files": "count(*) FILTER (preferred)", "duplicate_files": "count(*) FILTER (NOT preferred)"},
    "every": {"events": "count(*)"},
    "held": {"forks": "count(parent)", **{f"baseline_{n.replace('-', '_')}": f"count(*) FILTER (how = '{n}')" for n in ("child-first", "parent-at-fork", "missing")}},
}


def _method(name: str, of: str, out: str, rows: str = "r WHERE event_class IS NOT NULL") -> str:
    return (
        f"SELECT '{name}' AS method, count({of}) AS n, CAST(sum({of} - {out}) AS BIGINT) AS input, 0 AS cached, 0 AS creation, CAST(sum({out}) AS BIGINT) AS output, 0 AS reasoning, "
        f"CAST(sum({of}) AS BIGINT) AS tokens FROM {rows}"
    )


ORACLES = {
    "raw_events": f"{_SQL} SELECT path, event_index, session, event_class, source_kind, timestamp_source, at_ms, CAST(segment AS BIGINT) AS segment, adjusted, {_TOKENS} FROM r",
    "raw_methods": f"{_SQL} "
    + " UNION ALL ".join([
        _method("last_usage_sum", "l", "(l // 4)"), _method("segmented_total_delta", "d", "d_o"), _method("current_equivalent", "ca", "cao"), _method("older_all_events", "ca", "cao", "r WHERE old IS NOT NULL"),
        _method("fork_aware_total_delta", "fd", "fdo"), _method("hybrid_canonical", "h", "ho"), _method("session_terminal_total", "terminal", "(terminal // 4)", "held WHERE terminal IS NOT NULL"),
        _method("older_unique", "ca", "cao", "(SELECT *, row_number() OVER (PARTITION BY session, n // 3 ORDER BY adjusted DESC, event_index DESC) AS place FROM r WHERE old IS NOT NULL) WHERE place = 1"),
    ]),
    "raw_classes": f"""{_SQL} SELECT event_class, count(*) AS n FROM (
  SELECT event_class FROM r UNION ALL SELECT 'fork-first' FROM held WHERE parent IS NOT NULL AND i1 IS NOT NULL UNION ALL SELECT 'fork-baseline-unresolved' FROM held WHERE how = 'missing' AND i1 IS NOT NULL)
WHERE event_class IS NOT NULL GROUP BY event_class""",
    "raw_sources": f"""{_SQL} SELECT source_kind, count(*) AS events, count(*) FILTER (event_class IS NULL) AS zero_events, CAST(sum(coalesce(t, l, f, 0)) AS BIGINT) AS raw_tokens,
  CAST(sum(a) AS BIGINT) AS older_tokens, CAST(sum(b) AS BIGINT) AS hybrid_tokens FROM (
  SELECT source_kind, event_class, t, l, f, coalesce(old, 0) AS a, coalesce(h, 0) AS b FROM r UNION ALL SELECT 'ignored-no-model', event_class, t, l, f, 0, 0 FROM r WHERE model IS NULL) GROUP BY source_kind""",
    "raw_resets": f"""{_SQL} SELECT session, n AS sequence, at_ms, CAST(segment AS BIGINT) AS segment,
  concat_ws(',', CASE WHEN t - t // 4 < p - p // 4 THEN 'input' END, CASE WHEN t // 4 < p // 4 THEN 'output' END) AS fell, p AS previous_tokens, t AS current_tokens, coalesce(l, 0) AS last_tokens,
  coalesce(l = t, false) AS equals_last, coalesce(t >= l, false) AS contains_last, coalesce(previous_type, 'unknown') AS previous_type,
  CASE WHEN previous_type = 'response_item' THEN 'response-boundary' WHEN model_before <> model THEN 'model-change' WHEN previous_type = 'session_resume' THEN 'resume' ELSE 'unknown' END AS cause,
  model_before, model AS model_after, ts - coalesce(ts_before, CASE WHEN n > 0 THEN modified_ms END) AS gap_ms FROM r WHERE is_reset""",
    "raw_sessions": f"{_SQL} {_BY_SESSION}",
    "raw_largest_gaps": f"""{_SQL}, s AS ({_BY_SESSION}), g AS (
  SELECT 'segment-terminal' AS ranking, session, delta_tokens - terminal_tokens AS difference FROM s UNION ALL SELECT 'older-hybrid', session, older_tokens - hybrid_tokens FROM s)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ranking ORDER BY abs(difference) DESC, session) <= {raw_audit.REPORTED}""",
    "raw_days": f"{_SQL} {_BY_DAY}",
    "raw_peak_days": f"{_SQL}, s AS ({_BY_DAY}) SELECT * FROM s ORDER BY older_tokens DESC, day LIMIT {raw_audit.REPORTED}",
    "raw_figures": f"{_SQL} "
    + " UNION ALL ".join(f"SELECT '{n}' AS figure, CAST(coalesce({c}, 0) AS BIGINT) AS n FROM {table}" for table, wanted in _FIGURES.items() for n, c in wanted.items()),
    "raw_mismatch_sizes": f"""{_SQL} SELECT CASE WHEN g = 0 THEN '0' WHEN g <= 1000 THEN '1-1K' WHEN g <= 10000 THEN '1K-10K' WHEN g <= 100000 THEN '10K-100K' WHEN g <= 1000000 THEN '100K-1M' ELSE '>1M' END AS size_class,
  count(*) AS n, CAST(sum(g) AS BIGINT) AS gap FROM (SELECT abs(l - d) AS g FROM r WHERE l IS NOT NULL AND d IS NOT NULL) GROUP BY size_class""",
}
