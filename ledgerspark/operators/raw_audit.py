"""The audit of raw logs: eight ways of counting the same events side by side, and what tells them apart.

One decoded table of events (decoders.audit_events) is read by all of it. Of the files of a session only the preferred one counts. Each
event with usage is classed by its total beside the one before in its file; that state is windows by file. A fork's baseline is its own first
total less its first increment, or else its parent's total at the time of the fork, which is a running maximum over the parent's events and
the questions of its forks together, so a parent with many forks isn't multiplied by them. All reports are sums over the rows of
`accounted`.

Events without a time take the last one of their file, then the file's. An absent model leaves an event out of what the older accounting counts. Where
records of several files share an id, the one of the last path and place stands, and one adjusted to a parent before all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from ..sources import decoders, incremental
from . import audits, sync
from .contributions import USAGE, normalized, usage_total
from .counters import last_by
from .lineage import preferred_files
from .older import record_id

REPORTED = 20
#: The ways of counting, each with the column that it sums; the terminal totals are a session's, unique records are picked first.
METHODS = {
    "last_usage_sum": "last", "segmented_total_delta": "delta", "current_equivalent": "current_adjusted", "older_all_events": "older_adjusted", "fork_aware_total_delta": "fork_delta",
    "hybrid_canonical": "hybrid",
}


def _tokens(u: Column) -> Column:
    return F.coalesce(usage_total(normalized(u)), F.lit(0))


def _whole(u: Column) -> Column:
    return F.when(u["total"] > 0, u["total"]).otherwise(u["input"] + u["output"])


def _growth(now: Column, before: Column) -> Column:
    return F.struct(*[F.greatest(now[f] - F.coalesce(before[f], F.lit(0)), F.lit(0)).cast("long").alias(f) for f in decoders.FIELDS])


def _fell(now: Column, before: Column) -> list[Column]:
    return [F.coalesce(now[f] < before[f], F.lit(False)) for f in USAGE]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _alike(a: Column, b: Column) -> Column:
    return ~_any([F.coalesce(a[f] != b[f], F.lit(True)) for f in USAGE])


def canonical_files(files: DataFrame, events: DataFrame) -> DataFrame:
    """files (path, size, modified_ms, archived) with session, parent, session_ms and preferred; a file that names no session is one of its own."""

    def first(value: str, of: Column) -> Column:
        return F.min_by(value, F.when(of & F.col(value).isNotNull(), F.col("event_index")))

    heads = events.groupBy("path").agg(
        first("meta_session", F.col("is_meta")).alias("named"), first("forked_from", F.lit(True)).alias("parent"), first("ts_ms", F.col("is_meta")).alias("session_ms")
    )
    rows = files.join(heads, "path", "left").withColumn("session", F.coalesce("named", F.concat(F.lit("file:"), "path"))).drop("named")
    return rows.join(preferred_files(rows).select("path", "preferred"), "path")


def classified(files: DataFrame, events: DataFrame) -> DataFrame:
    """Events with usage of preferred files: the state before them, their class, and what each way counts of them. Those whose counters are all 0 have no
    class."""
    order = Window.partitionBy("path").orderBy("event_index")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.join(files.filter("preferred").select("path", "session", "parent", "modified_ms"), "path")

    def last(column: str, frame=before) -> Column:
        return F.last(column, ignorenulls=True).over(frame)

    rows = rows.withColumns({
        "inherited": last("ts_ms", now), "model_before": last("model"), "model": last("model", now), "previous_type": last("semantic_type"), "previous_outer": last("outer_type"),
        "_before_ms": last("ts_ms"), "_used_before": F.max(F.col("source_kind").isNotNull()).over(before), "previous": last("total"),
    }).filter("source_kind is not null")
    at = F.coalesce("inherited", "modified_ms")
    provenance = F.when(F.col("ts_ms").isNotNull(), "explicit").when(F.col("inherited").isNotNull(), "inherited").when(at.isNotNull(), "file-modified").otherwise("unresolved")
    total, last_, flat, previous = (F.col(c) for c in ("total", "last", "flat", "previous"))
    reset = total.isNotNull() & _any(_fell(total, previous))
    repeat = total.isNotNull() & previous.isNotNull() & _alike(total, previous)
    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in decoders.FIELDS])
    rows = rows.withColumns({
        "at_ms": at, "timestamp_source": provenance, "gap_ms": F.col("ts_ms") - F.coalesce("_before_ms", F.when(F.col("_used_before"), F.col("modified_ms"))),
        "sequence": (F.row_number().over(order) - 1).cast("long"), "is_reset": reset, "is_repeat": repeat,
        "delta": F.when(total.isNull(), None).when(reset, total).when(repeat, zero).otherwise(_growth(total, previous)),
    })
    delta = F.col("delta")
    hybrid = F.when(repeat, zero).when(total.isNotNull() & (reset | previous.isNull()), F.coalesce(last_, delta)).when(total.isNotNull(), delta).otherwise(F.coalesce(last_, flat))
    rows = rows.withColumns({"hybrid": hybrid, "current": F.coalesce(last_, delta, flat)})
    kind = (
        F.when(reset, "counter-reset").when(repeat, "duplicate-snapshot").when(total.isNotNull() & last_.isNull(), "normal-delta")
        .when(total.isNotNull(), F.when(_tokens(last_) == _tokens(delta), "last-delta-match").otherwise("last-delta-mismatch"))
        .when(last_.isNotNull(), "last-only").when(flat.isNotNull(), "total-only")
    )
    return rows.withColumns({
        "event_class": kind, "older": F.when(F.col("model").isNotNull(), F.col("current")),
        "segment": F.sum(F.col("is_reset").cast("long")).over(now),
    }).drop("_before_ms", "_used_before", "inherited")


def sessions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a preferred file: session, parent, the first event with a total, the first that has an increment too, its last total, and of forks the
    baseline and how it was found (child-first, parent-at-fork, missing)."""
    has = F.when(F.col("total").isNotNull(), F.col("event_index"))
    both = F.when(F.col("total").isNotNull() & F.col("last").isNotNull(), F.col("event_index"))
    own = rows.groupBy("path").agg(
        F.min_by(F.struct("total", "last", "at_ms", "event_index"), has).alias("first"), F.min(both).alias("first_both"), F.max_by("total", has).alias("terminal")
    )
    held = stored(files.filter("preferred").select("path", "session", "parent", "session_ms").join(own, "path", "left"))
    forks = held.filter("parent is not null")
    first, last = F.col("first.total"), F.col("first.last")
    from_first = F.when(F.coalesce(_whole(first) >= _whole(last), F.lit(False)), _growth(first, last))
    asks = forks.withColumn("child_first", from_first).filter("child_first is null").select(
        F.col("parent").alias("key"), F.coalesce("session_ms", "first.at_ms").alias("ms"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("i"), F.lit(None).cast(rows.schema["total"].dataType).alias("t"), "path"
    )
    told = rows.filter("total is not null").select(F.col("session").alias("key"), F.col("at_ms").alias("ms"), F.lit(0).alias("asks"), F.col("event_index").alias("i"), F.col("total").alias("t"), "path")
    line = asks.unionByName(told.join(asks.select("key").distinct(), "key", "left_semi")).filter("ms is not null")
    so_far = Window.partitionBy("key").orderBy("ms", "asks").rowsBetween(Window.unboundedPreceding, 0)
    answers = line.withColumn("at_fork", F.max_by("t", "i").over(so_far)).filter("asks = 1").select("path", "at_fork")
    ends = held.select(F.col("session").alias("parent"), F.col("terminal").alias("parent_terminal"))
    found = forks.join(answers, "path", "left").join(ends, "parent", "left")
    how = F.when(from_first.isNotNull(), "child-first").when(F.col("at_fork").isNotNull(), "parent-at-fork").otherwise("missing")
    found = found.select("path", F.coalesce(from_first, F.col("at_fork")).alias("baseline"), how.alias("baseline_from"), "parent_terminal")
    return held.join(found, "path", "left")


def accounted(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows with what forks change: the increment of a fork's first event with both counters is what its total adds to its parent's last one, and
    its first total counts less its baseline."""
    forks = held.filter("parent is not null").select("path", F.col("first.event_index").alias("_first"), F.col("first_both").alias("_both"), "baseline", "parent_terminal")
    rows = rows.join(forks, "path", "left")
    is_both = F.coalesce((F.col("event_index") == F.col("_both")) & F.col("parent_terminal").isNotNull(), F.lit(False))
    adjusted = F.when(is_both, _growth(F.col("total"), F.col("parent_terminal")))
    based = F.coalesce((F.col("event_index") == F.col("_first")) & F.col("baseline").isNotNull(), F.lit(False))
    rows = rows.withColumns({
        "adjusted": is_both, "current_adjusted": F.coalesce(adjusted, F.col("current")), "older_adjusted": F.when(F.col("older").isNotNull(), F.coalesce(adjusted, F.col("older"))),
        "fork_delta": F.when(based, _growth(F.col("delta"), F.col("baseline"))).otherwise(F.col("delta")),
    })
    return rows.withColumns({f"{n}_tokens": _tokens(F.col(n)) for n in ("last", "delta", "current", "older", "hybrid", "fork_delta")}).drop("_first", "_both", "baseline", "parent_terminal")


def _sums(rows: DataFrame, key: str) -> DataFrame:
    parts = [F.coalesce(F.sum(f"u.{f}"), F.lit(0)).cast("long").alias(f) for f in USAGE]
    return rows.groupBy(key).agg(F.count("u").alias("n"), *parts).withColumn("tokens", sum((F.col(f) for f in USAGE[1:]), F.col(USAGE[0])))


def methods(rows: DataFrame, held: DataFrame) -> DataFrame:
    """method, n (what is summed: events, sessions, records), the five counters and their tokens."""
    pairs = F.array(*[F.struct(F.lit(n).alias("method"), normalized(F.col(c)).alias("u"), F.col(c).isNotNull().alias("some")) for n, c in METHODS.items()])
    by_event = rows.filter("event_class is not null").select(F.explode(pairs).alias("p")).filter("p.some").select("p.method", "p.u")
    ends = held.filter("terminal is not null").select(F.lit("session_terminal_total").alias("method"), normalized(F.col("terminal")).alias("u"))
    records = rows.filter("older is not null").select(record_id().alias("id"), "adjusted", "path", "event_index", normalized(F.col("older_adjusted")).alias("u"))
    unique = last_by(records, "id", ["adjusted", "path", "event_index"]).select(F.lit("older_unique").alias("method"), "u")
    return _sums(by_event.unionByName(ends).unionByName(unique), "method")


def classes(rows: DataFrame, held: DataFrame) -> DataFrame:
    """event_class, n; forks whose first total counts are classed once more, by whether their baseline was found."""
    forks = held.filter("parent is not null and first is not null")
    more = forks.select(F.explode(F.array(F.lit("fork-first"), F.when(F.col("baseline").isNull(), "fork-baseline-unresolved"))).alias("event_class"))
    return rows.select("event_class").unionByName(more).filter("event_class is not null").groupBy("event_class").agg(F.count("*").alias("n"))


def sources(rows: DataFrame) -> DataFrame:
    """source_kind, events, those without counters, tokens as they stand, by the older accounting, by the hybrid. Events without a model are counted
    once more as ignored-no-model."""
    names = F.explode(F.array_compact(F.array("source_kind", F.when(F.col("model").isNull(), "ignored-no-model")))).alias("kind")
    rows = rows.withColumn("raw", _tokens(F.coalesce("total", "last", "flat"))).select(names, "raw", F.col("event_class").isNull().alias("zero"), "older_tokens", "hybrid_tokens")
    none = F.col("kind") == "ignored-no-model"
    return rows.groupBy(F.col("kind").alias("source_kind")).agg(
        F.count("*").alias("events"), F.count_if("zero").alias("zero_events"), F.sum("raw").alias("raw_tokens"), F.sum(F.when(~none, F.col("older_tokens")).otherwise(0)).alias("older_tokens"),
        F.sum(F.when(~none, F.col("hybrid_tokens")).otherwise(0)).alias("hybrid_tokens"),
    )


def resets(rows: DataFrame) -> DataFrame:
    """A row a reset: which counters fell, the totals on both sides, what came before it, and what it may come from."""
    before, outer = (F.coalesce(c, F.lit("")) for c in ("previous_type", "previous_outer"))
    cause = (
        F.when((before == "response_item") | (outer == "response_item"), "response-boundary")
        .when(F.coalesce(F.col("model_before") != F.col("model"), F.lit(False)), "model-change")
        .when(F.lower(before).contains("resume") | F.lower(outer).contains("resume"), "resume").otherwise("unknown")
    )
    total, last, previous = (F.col(c) for c in ("total", "last", "previous"))
    fell = F.array_compact(F.array(*[F.when(c, n) for n, c in zip(USAGE, _fell(total, previous), strict=True)]))
    return rows.filter("event_class = 'counter-reset'").select(
        "session", "sequence", "at_ms", "segment", F.concat_ws(",", fell).alias("fell"), _tokens(previous).alias("previous_tokens"), _tokens(total).alias("current_tokens"), "last_tokens",
        (last.isNotNull() & _alike(total, last)).alias("equals_last"), (last.isNotNull() & ~_any(_fell(total, last))).alias("contains_last"),
        F.coalesce("previous_type", F.lit("unknown")).alias("previous_type"), cause.alias("cause"), "model_before", F.col("model").alias("model_after"), "gap_ms",
    )


def by_session(rows: DataFrame, held: DataFrame) -> DataFrame:
    """A row a session: its events, resets and repeats, and tokens by five ways. Sessions without usage have zeros."""
    own = rows.groupBy("path").agg(
        F.count("event_class").alias("events"), F.count_if("is_reset").alias("resets"), F.count_if("is_repeat").alias("repeats"),
        *[F.sum(f"{n}_tokens").alias(f"{n}_tokens") for n in ("last", "delta", "older", "hybrid")],
    )
    rest = [c for c in own.columns if c != "path"]
    return held.select("path", "session", _tokens(F.col("terminal")).alias("terminal_tokens")).join(own, "path", "left").fillna(0, rest).drop("path")


def largest_gaps(found: DataFrame, n: int = REPORTED) -> DataFrame:
    """Of by_session: the n sessions in which the increments of totals and the last total are furthest apart, and those by the older accounting and the hybrid."""
    pairs = {"segment-terminal": ("delta_tokens", "terminal_tokens"), "older-hybrid": ("older_tokens", "hybrid_tokens")}
    parts = [audits.largest_differences(found, "session", a, b, n).select(F.lit(k).alias("ranking"), "session", "difference") for k, (a, b) in pairs.items()]
    return parts[0].unionByName(parts[1])


def by_day(rows: DataFrame) -> DataFrame:
    """A row a day (UTC): tokens by six ways. Events without any time have no day."""
    day = F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd").alias("day")
    return rows.filter("event_class is not null and at_ms is not null").groupBy(day).agg(*[F.sum(f"{n}_tokens").alias(f"{n}_tokens") for n in ("current", "last", "delta", "fork_delta", "older", "hybrid")])


def peak_days(found: DataFrame, n: int = REPORTED) -> DataFrame:
    """The n days with most tokens by the older accounting: a bounded report."""
    return found.orderBy(F.col("older_tokens").desc(), "day").limit(n)


def figures(files: DataFrame, events: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """(figure, n): what is counted of files, events, totals beside increments, times, first totals and baselines."""
    counts = F.col("event_class").isNotNull()
    last, total = F.col("last").isNotNull() & counts, F.col("total").isNotNull() & counts
    gap = F.when(F.col("last").isNotNull() & F.col("delta").isNotNull(), F.col("last_tokens") - F.col("delta_tokens"))
    opens = total & last & F.col("previous").isNull()
    more = _tokens(F.col("total")) - F.col("last_tokens")
    wanted = {
        "usage_events": F.count("*"), "token_count_events": F.count_if(F.col("source_kind") == "token-count"), "with_last": F.count_if(last), "with_total": F.count_if(total), "with_both": F.count_if(last & total),
        "total_decreases": F.count_if(F.col("is_reset") & (_whole(F.col("total")) < _whole(F.col("previous")))), "component_decreases": F.count_if("is_reset"),
        "repeats": F.count_if("is_repeat"), "repeats_with_last": F.count_if(F.col("is_repeat") & last), "repeated_last_tokens": F.sum(F.when(F.col("is_repeat"), F.col("last_tokens"))),
        "mismatches": F.count_if(gap != 0), "mismatch_tokens": F.sum(F.abs(gap)), "last_greater_tokens": F.sum(F.greatest(gap, F.lit(0))), "delta_greater_tokens": F.sum(F.greatest(-gap, F.lit(0))),
        "last_minus_delta_tokens": F.sum(F.col("last_tokens") - F.col("delta_tokens")), "older_minus_hybrid_tokens": F.sum(_tokens(F.col("older_adjusted")) - F.col("hybrid_tokens")),
        "delta_minus_hybrid_tokens": F.sum(F.col("delta_tokens") - F.col("hybrid_tokens")), "first_equals_last": F.count_if(opens & (more == 0)), "first_above_last": F.count_if(opens & (more > 0)),
        "first_above_last_tokens": F.sum(F.when(opens, F.greatest(more, F.lit(0)))),
        **{f"time_{n.replace('-', '_')}": F.count_if(counts & (F.col("timestamp_source") == n)) for n in ("explicit", "inherited", "file-modified", "unresolved")},
    }
    parts = [
        _long(rows, wanted),
        _long(files, {"files": F.count("*"), "canonical_files": F.count_if("preferred"), "duplicate_files": F.count_if(~F.col("preferred"))}),
        _long(events, {"events": F.count("*")}),
        _long(held, {"forks": F.count("parent"), **{f"baseline_{n.replace('-', '_')}": F.count_if(F.col("baseline_from") == n) for n in ("child-first", "parent-at-fork", "missing")}}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _long(rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in wanted.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias("n")) for n in wanted])).alias("p")).select("p.*")


def mismatch_sizes(rows: DataFrame) -> DataFrame:
    """How far increments and differences of totals are apart, by size."""
    return audits.mismatch_histogram(rows.filter("last is not null and delta is not null"), "last_tokens", "delta_tokens")


def overlap_sides(files: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads and tokens of preferred files as matching.overlap_audit takes them, payloads with eligible, false where last or total go before them or no
    model is known. A token count gives its increment, or else what its total adds to the one before in its file. Only usage with tokens is taken."""
    order = Window.partitionBy("path").orderBy("event_index")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.join(files.filter("preferred").select("path", "session"), "path").withColumn("model", F.last("model", ignorenulls=True).over(now))
    row = F.concat_ws(":", "path", "event_index").alias("id")
    own = ["session", F.col("ts_ms"), "response_id", "turn_id", "model", "semantic_type"]

    def side(found: DataFrame, usage: Column, *more: Column) -> DataFrame:
        counted = found.withColumn("usage", normalized(usage)).withColumn("tokens", usage_total(F.col("usage")))
        return counted.filter("tokens > 0").select(row, *own, "usage", "tokens", (F.col("tokens") > 0).alias("counted"), *more)

    shadowed = F.col("last").isNotNull() | F.col("total").isNotNull() | F.col("is_token_count")
    payloads = side(rows.filter("payload_usage is not null"), F.col("payload_usage"), (~shadowed & F.col("model").isNotNull()).alias("eligible"))
    tokens = rows.filter("is_token_count").withColumn("previous", F.last("total", ignorenulls=True).over(before))
    total, previous = F.col("total"), F.col("previous")
    adds = F.when(total.isNotNull(), F.when(_any(_fell(total, previous)), total).otherwise(_growth(total, previous)))
    tokens = tokens.withColumn("adds", F.coalesce(F.col("last"), adds)).filter("adds is not null")
    return payloads, side(tokens, F.col("adds"))


@dataclass
class RawAudit:
    files: DataFrame  # of canonical_files
    events: DataFrame
    rows: DataFrame  # of accounted
    sessions: DataFrame


def audit(files: DataFrame, events: DataFrame) -> RawAudit:
    """files (path, size, modified_ms, archived) and their events, of decoders.audit_events."""
    found = stored(canonical_files(files, events))
    rows = stored(classified(found, events))
    held = stored(sessions(found, rows))
    # not stored once more: a report needs few of its columns, and Spark leaves the others out
    return RawAudit(found, events, accounted(rows, held), held)


def audit_logs(spark: SparkSession, roots: list[str]) -> RawAudit:
    """The audit of all logs below the roots, unfinished last lines included. Empty files aren't listed."""
    listed = stored(incremental.listing(spark, roots))
    lines = incremental.read_lines(incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), sync.VERSIONS["codex"]))
    archived = F.array_contains(F.split(F.lower(F.translate("path", "\\", "/")), "/"), "archived_sessions")
    return audit(listed.withColumn("archived", archived), stored(decoders.audit_events(sync.codex_lines(lines, tail=True))))
