"""Queries of the accounting of logs: the whole flow, duplicates with evidence of two kinds, payloads over components and precision.

Logs are made of the table of events: a user's events are one session's log, their numbers are its counters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import dealt, stored
from ..operators import duplicates, flow, older, payloads
from ..sources.tables import COUNTERS_SQL, counter_events
from .accounting import FORK_MS, _sessions, _SESSIONS_SQL

_COUNTER = "struct<input: bigint, cached: bigint, creation: bigint, output: bigint, reasoning: bigint, total: bigint>"


def _counters(n: str, total: str = "null") -> str:
    """Counters of which a quarter is output."""
    parts = f"'input', {n} - {n} div 4, 'cached', null, 'creation', null, 'output', {n} div 4, 'reasoning', null, 'total', {total}"
    return f"cast(case when {n} is not null then named_struct({parts}) end as {_COUNTER})"


def _log(spark, d):
    """Of three events of a session one has an increment, one a total, one a payload, which repeats the increment now and then; some forks have
    events from after the fork only."""
    rows = counter_events(spark, d).select("session", "event_index", "ts_ms", "k", "model")
    rows = rows.selectExpr(
        "*", "row_number() over (partition by session order by event_index) - 1 as n", "sum(k) over (partition by session order by event_index) as t"
    ).withColumn("kk", F.expr("case when n % 4 = 0 then lag(k, 2) over (partition by session order by event_index) else k end"))
    rows = rows.filter(f"ts_ms >= {FORK_MS} or cast(substr(session, 2) as bigint) % 10 <> 0")
    return rows.selectExpr(
        "concat('f', substr(session, 2)) as path", "session", "event_index", "ts_ms", "model", "concat('p', cast(event_index % 3 as string)) as project_key",
        "concat('r', cast(n div 3 as string)) as response_id", "cast(null as string) as turn_id", "'token_count' as semantic_type", "n % 3 <> 2 as is_token_count",
        _counters("case when n % 3 = 0 then k end") + " as last", _counters("case when n % 3 = 1 then t end", "t") + " as total",
        _counters("case when n % 3 = 2 then kk end", "kk") + " as payload_usage",
        "concat('e', cast(event_index as string), ':h', cast(event_index as string)) as raw_identity",
        "cast(event_index as string) as raw_fingerprint", "cast(event_index as string) as semantic_fingerprint", "false as is_meta", "false as nested_usage", "false as legacy_flat",
    )


def _flow(spark, d, log=None):
    files = _sessions(spark, d).selectExpr(
        "concat('f', substr(session, 2)) as path", "session", "parent", "fork_ms", "false as archived", "0L as session_conflicts", "0L as parent_conflicts"
    )
    rows = stored(_log(spark, d)) if log is None else log
    return flow.run(files, rows.withColumns({"parent": F.lit(None).cast("string"), "fork_ms": F.lit(None).cast("long")}))


def _flow_records(spark, d):
    return _flow(spark, d).records.drop("source_path")


def _flow_sessions(spark, d):
    return _flow(spark, d).sessions.select("session", "parent", "fork_status", "tokens", "final_tokens", "replay_prefix")


def _flow_gates(spark, d):
    return _flow(spark, d).gates


def _twice(spark, d):
    """Counter events and copies of every eleventh: of the same content, of the same response with another increment, of another response, or
    without one."""
    rows = counter_events(spark, d).selectExpr(
        "session", "2 * event_index as event_index", "ts_ms", "response_id", "model", "last as l", "total as t", "cast(event_index as string) as f", "cast(event_index as string) as s"
    )
    copies = rows.filter("event_index % 22 = 0").selectExpr(
        "session", "event_index + 1 as event_index", "ts_ms",
        "case when event_index % 110 = 0 then 'other' when event_index % 44 = 0 or event_index % 66 = 0 then response_id end as response_id",
        "model", "case when event_index % 66 = 0 then l + 1 else l end as l", "t",
        "case when event_index % 44 = 0 then f else concat('c', f) end as f", "case when event_index % 4 = 2 then s else concat('c', s) end as s",
    )
    return rows.unionByName(copies).filter("l is not null or t is not null").selectExpr(
        "session", "'log' as path", "event_index", "concat('e', cast(event_index as string), ':h', f) as raw_identity", "f as raw_fingerprint", "s as semantic_fingerprint",
        "ts_ms", "response_id", "cast(null as string) as turn_id", "model", _counters("l") + " as last", _counters("t", "t") + " as total",
    )


def _resolved(spark, d):
    rows = _twice(spark, d)
    with dealt(spark, rows.count()):
        gone, told = duplicates.resolved(duplicates.evidence(stored(rows)))
        return gone, stored(told)


def _evidence(spark, d):
    _, told = _resolved(spark, d)
    return told.select(
        "session", F.col("primary_event_index").alias("primary_index"), F.col("candidate_event_index").alias("candidate_index"), "kind", "confidence", "transition", "state",
        "primary_tokens", "candidate_tokens",
    )


def _suppressions(spark, d):
    gone, _ = _resolved(spark, d)
    return gone.select("session", F.col("name.event_index").alias("event_index"), F.col("representative.event_index").alias("representative_index"), "kind", "confidence", "tokens")


def _payload_sides(spark, d):
    """Payloads and token counts of a session that share events and responses, with other parts, totals, models and precisions now and then."""
    rows = counter_events(spark, d).withColumn("response_id", F.expr("concat('r', cast(event_index div 600 as string))")).withColumn("v", F.expr("k % 6 + 1"))
    columns = ["id", "session", "raw_identity", "response_id", "model", "usage", "tokens", "precision"]
    parts = "case when odd then named_struct('input', v - 1, 'output', 1L) else named_struct('input', v, 'output', 0L) end"
    precision = "case when event_index % {a} = 0 then 'aggregate-only' when event_index % {b} = 0 then 'partial' else 'components-exact' end"
    given = rows.filter("event_index % 3 = 0").selectExpr(
        "concat('p', cast(event_index as string)) as id", "session", "concat('e', cast(event_index as string)) as raw_identity", "case when event_index % 5 <> 0 then response_id end as response_id",
        "case when event_index % 2 = 0 then model end as model", "case when event_index % 21 = 0 then 0 else v end as v", "event_index % 4 = 0 as odd", precision.format(a=12, b=33) + " as precision",
    )
    counted = rows.filter("event_index % 2 = 0 or event_index % 7 = 0").selectExpr(
        "concat('t', cast(event_index as string)) as id", "session", "concat('e', cast(event_index as string)) as raw_identity", "response_id",
        "case when event_index % 6 <> 0 then model end as model", "v", "event_index % 8 = 0 as odd", precision.format(a=10, b=22) + " as precision",
    )
    return tuple(x.selectExpr("*", f"{parts} as usage", "v as tokens").select(*columns) for x in (given, counted))


def _payloads(spark, d):
    given, counted = _payload_sides(spark, d)
    found = payloads.payload_resolution(given, counted)
    return found.select("id", "matched_id", "disposition", "evidence", "reason", "tokens")


def _older_events(spark, d):
    """A user's events as a file: the first names session, folder and fork, now and then one names the model, and some share an id."""
    rows = counter_events(spark, d).selectExpr(
        "cast(substr(session, 2) as bigint) as u", "session as own", "event_index", "ts_ms", "k", "row_number() over (partition by session order by event_index) - 1 as n",
        "sum(k) over (partition by session order by event_index) as t",
    )
    return rows.selectExpr(
        "concat('f', cast(u as string)) as path", "event_index", "case when n = 0 then own end as session",
        "case when n = 0 and u % 5 = 0 then concat('s', cast(u - 1 as string)) end as forked_from", "case when n % 7 = 0 and (u % 11 > 0 or n > 0) then concat('m', cast(n % 2 as string)) end as model",
        "case when n = 0 then concat('p', cast(u % 4 as string)) end as project_key", "ts_ms", _counters("case when n % 3 = 0 then k end") + " as last",
        _counters("case when n % 4 in (1, 2) then t end", "t") + " as total", _counters("case when n % 3 = 2 then k end") + " as flat",
        "case when n % 3 = 0 or n % 4 in (1, 2) then 'token-count' else 'payload-usage' end as source_kind",
        "case when event_index % 3 > 0 then concat('x', cast(event_index div 3 as string)) end as own_id", "cast(event_index as string) as content",
    )


def _older_contributions(spark, d):
    found = older.contributions(_older_events(spark, d))
    return found.select("path", "event_index", "session", "model", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), "tokens", F.col("baseline").isNotNull().alias("has_baseline"))


def _older_totals(spark, d):
    return older.totals(older.records(older.contributions(_older_events(spark, d))))


def _older_forks(spark, d):
    found = older.fork_traces(older.contributions(_older_events(spark, d)))
    return found.select("session", "parent", *[F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in ("baseline", "first_total", "contribution") for f in ("input", "output")])


QUERIES = {
    "older_contributions": _older_contributions,
    "older_totals": _older_totals,
    "older_forks": _older_forks,
    "v5_records": _flow_records,
    "v5_sessions": _flow_sessions,
    "v5_gates": _flow_gates,
    "duplicate_evidence": _evidence,
    "duplicate_suppression": _suppressions,
    "payload_resolution": _payloads,
}

_FLOW_SQL = f"""WITH {COUNTERS_SQL}, {_SESSIONS_SQL},
numbered AS (
  SELECT session, event_index, ts_ms, k, model, row_number() OVER w - 1 AS n, CAST(sum(k) OVER w AS BIGINT) AS t, lag(k, 2) OVER w AS k2
  FROM counters WINDOW w AS (PARTITION BY session ORDER BY event_index)),
e AS (
  SELECT *, n // 3 AS r, CASE WHEN n % 4 = 0 THEN k2 ELSE k END AS kk FROM numbered
  WHERE ts_ms >= {FORK_MS} OR CAST(substr(session, 2) AS BIGINT) % 10 <> 0),
checkpoint AS (
  SELECT s.session, arg_max(e.t, (e.ts_ms, e.event_index)) AS c FROM sessions s JOIN e ON e.session = s.parent AND e.ts_ms < s.fork_ms AND n % 3 = 1 GROUP BY s.session),
firsts AS (SELECT session, arg_min(t, event_index) AS f FROM e WHERE n % 3 = 1 GROUP BY session),
early AS (SELECT DISTINCT session FROM sessions JOIN e USING (session) WHERE e.ts_ms < fork_ms),
status AS (
  SELECT session, parent, fork_ms, c, CASE WHEN parent IS NULL THEN 'not-fork' WHEN parent NOT IN (SELECT session FROM sessions) THEN 'missing-parent'
    WHEN fork_ms IS NULL THEN 'missing-fork-timestamp' WHEN session IN (SELECT session FROM early) THEN 'explicit-replay' WHEN c IS NULL THEN 'missing-parent-checkpoint'
    WHEN f IS NULL THEN 'not-needed' WHEN f < c THEN 'child-counter-reset' ELSE 'resolved' END AS fork_status
  FROM sessions LEFT JOIN checkpoint USING (session) LEFT JOIN firsts USING (session)),
totals AS (
  SELECT e.*, coalesce(lag(t) OVER (PARTITION BY session ORDER BY event_index), CASE WHEN fork_status = 'resolved' THEN c END, 0) AS b
  FROM e JOIN status USING (session) WHERE n % 3 = 1),
tokens AS (
  SELECT session, event_index, ts_ms, model, r, k - k // 4 AS i, k // 4 AS o FROM e WHERE n % 3 = 0 AND k > 0
  UNION ALL
  SELECT session, event_index, ts_ms, model, r, (t - t // 4) - (b - b // 4), t // 4 - b // 4 FROM totals WHERE t > b),
fallback AS (
  SELECT session, event_index, ts_ms, model, r, kk - kk // 4 AS i, kk // 4 AS o FROM e p
  WHERE n % 3 = 2 AND kk > 0 AND 1 <> (
    SELECT count(*) FROM tokens t WHERE t.session = p.session AND t.r = p.r AND t.i = p.kk - p.kk // 4 AND t.o = p.kk // 4
      AND coalesce(t.model = p.model, true))),
kept AS (SELECT * FROM tokens UNION ALL SELECT * FROM fallback)"""

_TWICE_SQL = f"""WITH {COUNTERS_SQL},
base AS (SELECT session, 2 * event_index AS x, ts_ms, response_id, model, last AS l, total AS t, CAST(event_index AS VARCHAR) AS f, CAST(event_index AS VARCHAR) AS s FROM counters),
d AS (
  SELECT *, coalesce(l - l // 4, t - t // 4) AS i, coalesce(l // 4, t // 4) AS o FROM (
    SELECT * FROM base UNION ALL
    SELECT session, x + 1, ts_ms, CASE WHEN x % 110 = 0 THEN 'other' WHEN x % 44 = 0 OR x % 66 = 0 THEN response_id END, model, CASE WHEN x % 66 = 0 THEN l + 1 ELSE l END, t,
           CASE WHEN x % 44 = 0 THEN f ELSE 'c' || f END, CASE WHEN x % 4 = 2 THEN s ELSE 'c' || s END FROM base WHERE x % 22 = 0)
  WHERE l IS NOT NULL OR t IS NOT NULL),
lagged AS (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY x) AS g FROM d WHERE t IS NOT NULL),
turned AS (SELECT *, sum(CASE WHEN g IS DISTINCT FROM t THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY x) AS run FROM lagged),
begun AS (SELECT session, run, arg_min(g, x) AS b FROM turned GROUP BY session, run),
step AS (
  SELECT session, x, CASE WHEN b IS NULL THEN 'insufficient' WHEN t < b THEN 'reset' ELSE 'neither' END AS class,
         CASE WHEN t > b THEN (t - t // 4) - (b - b // 4) END AS di, CASE WHEN t > b THEN t // 4 - b // 4 END AS dd
  FROM turned JOIN begun USING (session, run)),
v AS (SELECT d.*, coalesce(class, 'insufficient') AS class, di, dd, coalesce(i = di AND o = dd, false) AS fits FROM d LEFT JOIN step USING (session, x)),
by_key AS (
  SELECT session, x, min(x) OVER (PARTITION BY session, f) AS h, true AS by_raw FROM v
  UNION ALL
  SELECT session, x, min(x) OVER (PARTITION BY session, ts_ms, t) AS h, false AS by_raw FROM v WHERE t IS NOT NULL),
p AS (SELECT session, h, x AS c, bool_or(by_raw) AS by_raw FROM by_key WHERE x <> h GROUP BY session, h, x),
told AS (
  SELECT p.session, h, c, by_raw, coalesce(a.response_id <> z.response_id, false) OR coalesce(a.model <> z.model, false) AS clash, a.f = z.f AS same_raw,
    coalesce(a.ts_ms = z.ts_ms AND a.t = z.t, false) AS same_snapshot, coalesce(a.response_id = z.response_id, false) AS shared, a.s = z.s AS same_semantic,
    a.i = z.i AND a.o = z.o AS same_usage, a.l IS NOT DISTINCT FROM z.l AND a.t IS NOT DISTINCT FROM z.t AS same_counters, coalesce(a.l, a.t) AS primary_tokens, coalesce(z.l, z.t) AS candidate_tokens,
    CASE WHEN 'reset' IN (a.class, z.class) THEN 'reset' WHEN a.di IS NULL OR z.di IS NULL THEN 'insufficient' WHEN a.fits AND z.fits THEN 'both'
      WHEN a.fits THEN 'primary-only' WHEN z.fits THEN 'candidate-only' ELSE 'neither' END AS transition
  FROM p JOIN v a ON a.session = p.session AND a.x = p.h JOIN v z ON z.session = p.session AND z.x = p.c),
judged AS (
  SELECT *, transition IN ('both', 'primary-only', 'candidate-only') AS settled,
    CASE WHEN clash THEN 'conflict' WHEN same_raw THEN 'confirmed' WHEN NOT same_snapshot THEN 'insufficient'
      WHEN shared OR transition IN ('both', 'primary-only', 'candidate-only') THEN 'strong' ELSE 'probable' END AS confidence,
    CASE WHEN clash THEN 'explicit-conflict' WHEN same_raw THEN 'exact-raw-content' WHEN NOT same_snapshot THEN 'insufficient' WHEN same_semantic THEN 'same-semantic-content'
      ELSE 'same-cumulative-snapshot' END AS kind,
    by_raw AND same_raw AND same_counters AS exact FROM told),
gone AS (SELECT session, c FROM judged WHERE exact),
able AS (
  SELECT * FROM judged j WHERE confidence = 'strong' AND settled AND (transition <> 'both' OR same_usage)
    AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.session = j.session AND g.c IN (j.h, j.c))),
grouped AS (
  SELECT session, h, count(*) FILTER (transition = 'candidate-only') + max(CASE WHEN transition = 'primary-only' THEN 1 ELSE 0 END) AS n_chosen,
    coalesce(min(c) FILTER (transition = 'candidate-only'), h) AS stays, min(primary_tokens) AS hub_tokens FROM able GROUP BY session, h),
stated AS (
  SELECT j.*, CASE WHEN confidence = 'conflict' OR by_raw AND NOT exact THEN 'conflict' WHEN confidence = 'confirmed' THEN 'confirmed' WHEN n_chosen <= 1 THEN 'resolved' ELSE 'unresolved' END AS state
  FROM judged j LEFT JOIN (SELECT a.session, a.h, a.c, n_chosen FROM able a JOIN grouped USING (session, h)) USING (session, h, c))"""

_PAYLOAD_SQL = f"""WITH {COUNTERS_SQL},
rows_ AS (SELECT *, 'r' || (event_index // 600) AS rr, k % 6 + 1 AS v FROM counters),
p AS (
  SELECT 'p' || event_index AS id, session, event_index AS e, CASE WHEN event_index % 5 <> 0 THEN rr END AS r, CASE WHEN event_index % 2 = 0 THEN model END AS m,
    CASE WHEN event_index % 21 = 0 THEN 0 ELSE v END AS v, CASE WHEN event_index % 4 = 0 THEN 1 ELSE 0 END AS o,
    CASE WHEN event_index % 12 = 0 THEN 'a' WHEN event_index % 33 = 0 THEN 'p' ELSE 'c' END AS q FROM rows_ WHERE event_index % 3 = 0),
t AS (
  SELECT 't' || event_index AS id, session, event_index AS e, rr AS r, CASE WHEN event_index % 6 <> 0 THEN model END AS m, v, CASE WHEN event_index % 8 = 0 THEN 1 ELSE 0 END AS o,
    CASE WHEN event_index % 10 = 0 THEN 'a' WHEN event_index % 22 = 0 THEN 'p' ELSE 'c' END AS q FROM rows_ WHERE event_index % 2 = 0 OR event_index % 7 = 0),
one AS (
  SELECT p.id, t.id AS tid, CASE WHEN p.q = 'c' AND t.q = 'c' THEN 'same-raw-event-components' ELSE 'same-raw-event-aggregate' END AS evidence
  FROM p JOIN t ON p.session = t.session AND p.e = t.e
  WHERE p.v > 0 AND p.q <> 'p' AND t.q <> 'p' AND coalesce(p.m = t.m, true) AND p.v = t.v AND (p.o = t.o OR p.q <> 'c' OR t.q <> 'c')),
p1 AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM one)),
t1 AS (SELECT * FROM t WHERE id NOT IN (SELECT tid FROM one)),
cand AS (
  SELECT p1.id, t1.id AS tid FROM p1 JOIN t1 ON p1.session = t1.session AND p1.r = t1.r AND p1.v = t1.v AND p1.o = t1.o
  WHERE p1.q = 'c' AND t1.q = 'c' AND coalesce(p1.m = t1.m, true)),
two AS (
  SELECT id, tid, 'same-response-id-components' AS evidence FROM (SELECT *, count(*) OVER (PARTITION BY id) AS a, count(*) OVER (PARTITION BY tid) AS b FROM cand) WHERE a = 1 AND b = 1),
matched AS (SELECT * FROM one UNION ALL SELECT * FROM two),
t2 AS (SELECT * FROM t1 WHERE id NOT IN (SELECT tid FROM two)),
rest AS (
  SELECT p1.id, count(t2.id) AS n_any, count(*) FILTER (t2.id IS NOT NULL AND coalesce(p1.m = t2.m, true)) AS n_fit, count(*) FILTER (t2.q = 'c' AND coalesce(p1.m = t2.m, true)) AS n_exact,
    count(*) FILTER (t2.q = 'c' AND coalesce(p1.m = t2.m, true) AND p1.v = t2.v AND p1.o = t2.o) AS n_same, count(*) FILTER (t2.q = 'c' AND coalesce(p1.m = t2.m, true) AND p1.v = t2.v) AS n_total
  FROM p1 LEFT JOIN t2 ON p1.session = t2.session AND p1.r = t2.r GROUP BY p1.id),
why AS (
  SELECT p.id, CASE WHEN p.id IN (SELECT id FROM matched) OR p.v = 0 THEN NULL WHEN p.r IS NULL THEN 'no-response-id' WHEN p.id IN (SELECT id FROM cand) THEN 'multiple-candidates'
    WHEN n_any = 0 THEN 'no-token-candidate' WHEN n_fit = 0 THEN 'model-conflict' WHEN p.q <> 'c' OR n_exact = 0 THEN 'insufficient-precision' WHEN n_same > 0 THEN 'multiple-candidates'
    WHEN n_total > 0 THEN 'same-total-different-components' ELSE 'different-components' END AS reason
  FROM p LEFT JOIN rest USING (id))"""

_OLDER_SQL = f"""WITH {COUNTERS_SQL},
b AS (
  SELECT CAST(substr(session, 2) AS BIGINT) AS u, session, event_index, ts_ms, k, row_number() OVER w - 1 AS n, CAST(sum(k) OVER w AS BIGINT) AS t
  FROM counters WINDOW w AS (PARTITION BY session ORDER BY event_index)),
m AS (
  SELECT *, last_value(CASE WHEN n % 7 = 0 AND (u % 11 > 0 OR n > 0) THEN 'm' || (n % 2) END IGNORE NULLS) OVER (PARTITION BY u ORDER BY event_index) AS model,
    n % 4 IN (1, 2) AS has_total FROM b),
v AS (SELECT * FROM m WHERE model IS NOT NULL AND (n % 3 <> 1 OR has_total)),
ends AS (SELECT u, arg_max(t, event_index) AS t FROM v WHERE has_total GROUP BY u),
s AS (
  SELECT v.*, last_value(CASE WHEN has_total THEN v.t END IGNORE NULLS) OVER (PARTITION BY v.u ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    CASE WHEN v.u % 5 = 0 AND 'f' || (v.u - 1) < 'f' || v.u AND n > 0 THEN ends.t END AS g FROM v LEFT JOIN ends ON ends.u = v.u - 1),
c AS (
  SELECT *, CASE WHEN n % 3 = 0 AND NOT (has_total AND g IS NOT NULL AND p IS NULL) THEN k - k // 4 WHEN has_total THEN greatest(t - t // 4 - coalesce(coalesce(p, g) - coalesce(p, g) // 4, 0), 0) ELSE k - k // 4 END AS i,
    CASE WHEN n % 3 = 0 AND NOT (has_total AND g IS NOT NULL AND p IS NULL) THEN k // 4 WHEN has_total THEN greatest(t // 4 - coalesce(coalesce(p, g) // 4, 0), 0) ELSE k // 4 END AS o FROM s)"""

ORACLES = {
    "older_contributions": f"""{_OLDER_SQL}
SELECT 'f' || u AS path, event_index, session, model, i AS input, o AS output, i + o AS tokens, g IS NOT NULL AS has_baseline FROM c""",
    "older_totals": f"""{_OLDER_SQL},
r AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_index % 3 > 0 THEN 'x' || (event_index // 3) ELSE 'e' || event_index END ORDER BY 'f' || u DESC, event_index DESC) AS rn FROM c WHERE i + o > 0),
q AS (SELECT * FROM r WHERE rn = 1),
d AS (
  SELECT 'session' AS dimension, session AS value, i + o AS tokens FROM q
  UNION ALL SELECT 'day', strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d'), i + o FROM q
  UNION ALL SELECT 'source', CASE WHEN n % 3 = 0 OR has_total THEN 'token-count' ELSE 'payload-usage' END, i + o FROM q)
SELECT dimension, value, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL""",
    "older_forks": f"""{_OLDER_SQL}
SELECT session, 's' || (u - 1) AS parent, g - g // 4 AS baseline_input, g // 4 AS baseline_output, CASE WHEN has_total THEN t - t // 4 END AS first_total_input, CASE WHEN has_total THEN t // 4 END AS first_total_output,
  CASE WHEN i + o > 0 THEN i END AS contribution_input, CASE WHEN i + o > 0 THEN o END AS contribution_output
FROM c WHERE u % 5 = 0 AND (n % 3 = 0 OR has_total) QUALIFY row_number() OVER (PARTITION BY u ORDER BY event_index) = 1""",
    "v5_records": f"""{_FLOW_SQL}
SELECT 'codex:v5:' || session || ':e' || event_index || ':h' || event_index || ':0' AS id, 'codex' AS source, session AS session_id, ts_ms, coalesce(model, 'unknown') AS model,
  'p' || (event_index % 3) AS project_key, i AS input_tokens, 0::BIGINT AS cached_input_tokens, 0::BIGINT AS cache_creation_input_tokens, o AS output_tokens, 0::BIGINT AS reasoning_output_tokens
FROM kept""",
    "v5_sessions": f"""{_FLOW_SQL}
SELECT session, parent, fork_status, CAST(coalesce(n, 0) AS BIGINT) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS final_tokens, 0::BIGINT AS replay_prefix
FROM status LEFT JOIN (SELECT session, sum(i + o) AS n FROM kept GROUP BY session) USING (session)""",
    "v5_gates": f"""{_FLOW_SQL},
broken AS (
  SELECT (SELECT count(*) FROM status WHERE fork_status IN ('missing-parent', 'missing-fork-timestamp', 'missing-parent-checkpoint'))
    + (SELECT count(DISTINCT k.session) FROM kept k JOIN status s USING (session) WHERE s.parent IN (SELECT session FROM sessions) AND k.ts_ms < s.fork_ms) AS n)
SELECT gate, CASE WHEN gate = 'forkResolution' THEN n ELSE 0 END AS n_broken, NOT (gate = 'forkResolution' AND n > 0) AS holds
FROM (SELECT unnest([{", ".join(f"'{g}'" for g in flow.GATES)}]) AS gate), broken""",
    "duplicate_evidence": f"""{_TWICE_SQL}
SELECT session, h AS primary_index, c AS candidate_index, kind, confidence, transition, state, primary_tokens, candidate_tokens FROM stated""",
    "duplicate_suppression": f"""{_TWICE_SQL}
SELECT session, c AS event_index, h AS representative_index, 'exact-raw-content' AS kind, 'confirmed' AS confidence, candidate_tokens AS tokens FROM judged WHERE exact
UNION ALL
SELECT session, x, stays, 'semantic-snapshot', 'strong', tokens FROM (
  SELECT session, c AS x, stays, candidate_tokens AS tokens FROM able JOIN grouped USING (session, h) WHERE n_chosen <= 1
  UNION ALL SELECT session, h, stays, hub_tokens FROM grouped WHERE n_chosen <= 1) WHERE x <> stays""",
    "payload_resolution": f"""{_PAYLOAD_SQL}
SELECT p.id, tid AS matched_id, CASE WHEN tid IS NOT NULL THEN 'suppress-confirmed' WHEN p.v = 0 THEN 'ignore-zero' WHEN reason IN ('no-response-id', 'no-token-candidate') THEN 'fallback-unmatched'
  WHEN reason = 'multiple-candidates' THEN 'fallback-ambiguous' ELSE 'fallback-conflict' END AS disposition, evidence, reason, p.v AS tokens
FROM p LEFT JOIN matched USING (id) LEFT JOIN why USING (id)""",
}
