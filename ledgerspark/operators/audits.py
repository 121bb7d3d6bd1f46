"""Audits: taxonomies, invariants, mismatches and gates over events and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import redacted, total_tokens

HISTOGRAM = ((0, "0"), (1_000, "1-1K"), (10_000, "1K-10K"), (100_000, "10K-100K"), (1_000_000, "100K-1M"))


def size_class(value: Column) -> Column:
    out = F.lit(">1M")
    for most, name in reversed(HISTOGRAM):
        out = F.when(value <= most, name).otherwise(out)
    return out


def mismatch_histogram(rows: DataFrame, a: str, b: str) -> DataFrame:
    gap = F.abs(F.col(a) - F.col(b))
    return rows.groupBy(size_class(gap).alias("size_class")).agg(F.count("*").alias("n"), F.sum(gap).cast("long").alias("gap"))


def event_types(outer: Column, payload: Column, message: Column) -> dict[str, Column]:
    """What kind of event it is by the three types it may carry."""
    token = F.coalesce(outer == "token_count", F.lit(False)) | F.coalesce(payload == "token_count", F.lit(False)) | F.coalesce(message == "token_count", F.lit(False))
    inner = F.when(outer == "event_msg", F.coalesce(message, payload, outer)).otherwise(F.coalesce(outer, payload, message))
    return {"is_token_count": token, "semantic_type": F.when(token, "token_count").otherwise(inner)}


def taxonomy(events: DataFrame) -> DataFrame:
    """From events (outer_type, payload_type, message_type): dimension, value, n, in one pass."""
    typed = events.withColumns(event_types(F.col("outer_type"), F.col("payload_type"), F.col("message_type")))
    names = ("outer_type", "payload_type", "message_type", "semantic_type")
    pairs = F.array(*[F.struct(F.lit(n.removesuffix("_type")).alias("dimension"), F.col(n).alias("value")) for n in names])
    return typed.select(F.explode(pairs).alias("p")).filter("p.value <> ''").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def gates(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """A row a gate: how many rows break it; and whether none does. One pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("n_broken")) for n in conditions])
    return counted.select(F.explode(pairs).alias("g")).select("g.*").withColumn("holds", F.col("n_broken") == 0)


def safe(found: DataFrame) -> bool:
    return found.agg(F.bool_and("holds")).first()[0] is not False


def reconciliation(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Two versions of records by id: matched, mismatched, expected-only, actual-only, with tokens of either."""
    a = expected.select("id", F.struct(*columns).alias("a"), F.col("total_tokens").alias("a_tokens"))
    b = actual.select("id", F.struct(*columns).alias("b"), F.col("total_tokens").alias("b_tokens"))
    joined = a.join(b, "id", "full")
    status = (
        F.when(F.col("b").isNull(), "expected-only")
        .when(F.col("a").isNull(), "actual-only")
        .when(F.col("a").eqNullSafe(F.col("b")), "matched")
        .otherwise("mismatched")
    )
    return joined.groupBy(status.alias("status")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("a_tokens"), F.lit(0)).cast("long").alias("expected_tokens"),
        F.coalesce(F.sum("b_tokens"), F.lit(0)).cast("long").alias("actual_tokens"),
    )


def methods_side_by_side(contributions: DataFrame) -> DataFrame:
    """By session, what each way of counting gives: increments, differences of totals, the last total."""
    return contributions.groupBy("session").agg(
        F.coalesce(F.sum("last"), F.lit(0)).cast("long").alias("last_sum"),
        F.coalesce(F.sum(F.when(F.col("relation") == "increased", F.col("total") - F.col("previous")).when(F.col("relation").isin("initial", "reset"), F.col("total"))), F.lit(0)).cast("long").alias("segmented_delta"),
        F.coalesce(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("event_index"))), F.lit(0)).cast("long").alias("terminal"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("contributed"),
        F.count_if(F.col("relation") == "reset").alias("resets"),
        F.count_if(F.col("method") == "duplicate-zero").alias("repeats"),
    )


def usage_source(is_token_count: Column, nested: Column, payload_usage: Column, flat: Column) -> Column:
    """What an event's usage was read from, the first that applies; null if there is none."""
    return (
        F.when(is_token_count, "token-count")
        .when(nested, "nested-info-non-token-count")
        .when(payload_usage, "payload-usage")
        .when(flat, "flat-payload")
    )


def event_context(events: DataFrame) -> DataFrame:
    """events (session, event_index, ts_ms, event_type, model) with the type and time gap of the session's previous event, the last
    model named before, and whether it is the session's first."""
    order = Window.partitionBy("session").orderBy("event_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return events.select(
        "session",
        "event_index",
        F.lag("event_type").over(order).alias("previous_type"),
        (F.col("ts_ms") - F.lag("ts_ms").over(order)).alias("gap_ms"),
        F.last("model", ignorenulls=True).over(before).alias("model_before"),
        (F.row_number().over(order) == 1).alias("is_first"),
    )


def largest_differences(rows: DataFrame, key: str, one: str, other: str, n: int = 20) -> DataFrame:
    """The n rows in which one and other are furthest apart, with the difference; ties by key."""
    difference = (F.col(one) - F.col(other)).alias("difference")
    return rows.select(key, one, other, difference).orderBy(F.abs("difference").desc(), key).limit(n)


def rebuild_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records and tokens of two record tables (before and after a rebuild), the difference, and its percentage of before."""
    sides = []
    for name, df in (("before", before), ("after", after)):
        sides.append(df.agg(F.count("*").alias(f"{name}_records"), F.coalesce(F.sum(total_tokens()), F.lit(0)).alias(f"{name}_tokens")))
    joined = sides[0].join(F.broadcast(sides[1]))  # one row each
    found = joined.withColumns({f"{x}_difference": F.col(f"after_{x}") - F.col(f"before_{x}") for x in ("records", "tokens")})
    return found.withColumn("tokens_percent", F.when(F.col("before_tokens") > 0, 100 * F.col("tokens_difference") / F.col("before_tokens")))


def recent_diagnostics(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The newest diagnostics (ts_ms, level, message, source), with user folders redacted: a bounded report."""
    return rows.orderBy(F.col("ts_ms").desc(), "message").limit(limit).withColumn("message", redacted(F.col("message")))


def fork_history(cursors: DataFrame, traces: DataFrame, records: DataFrame, extra: DataFrame, differing: DataFrame, *more: Column | str) -> DataFrame:
    """What a stored baseline of each fork gives beside that of a full replay.

    cursors (session, parent, baseline), traces (session, parent, baseline, first_total, contribution, first_id), one each a session; records
    (id, usage); extra and differing (id): records that only the replay has, or with other content. Baselines and the like are
    structs of counters. Forks of themselves are left out. A replay's record is explained if only it has the record, the stored
    baseline leaves no tokens, and the record's usage is the replay's contribution."""
    names = records.schema["usage"].dataType.names

    def total(c: str) -> Column:
        return sum((F.col(f"{c}.{n}") for n in names[1:]), F.col(f"{c}.{names[0]}"))

    own = cursors.filter("session <> parent").select("session", F.col("parent").alias("stored_parent"), F.col("baseline").alias("stored"))
    replay = traces.filter("session <> parent").withColumnsRenamed({"baseline": "replayed"})
    rows = own.join(replay, "session", "full")
    rows = rows.join(records.select(F.col("id").alias("first_id"), F.col("usage").alias("record")), "first_id", "left")
    for name, ids in (("is_extra", extra), ("is_differing", differing)):
        rows = rows.join(ids.select(F.col("id").alias("first_id")).distinct().withColumn(name, F.lit(True)), "first_id", "left")
    left = F.struct(*[F.greatest(F.col(f"first_total.{n}") - F.col(f"stored.{n}"), F.lit(0)).alias(n) for n in names])
    rows = rows.withColumn("left", F.when(F.col("first_total").isNotNull() & F.col("stored").isNotNull(), left))
    stored_emits, replay_emits = (F.coalesce(total(c) > 0, F.lit(False)) for c in ("left", "contribution"))
    outcome = (
        F.when(F.col("record").isNull() | (F.col("left").isNull() & F.col("contribution").isNull()), "unresolved")
        .when(replay_emits & ~stored_emits & F.col("is_differing").isNotNull(), "database-state-inconsistent")
        .when(replay_emits & ~stored_emits, "full-replay-only")
        .when(~replay_emits & stored_emits, "persisted-only")
        .when(replay_emits & stored_emits, F.when(F.col("left") == F.col("contribution"), "both-same").otherwise("both-different"))
        .otherwise("neither")
    )
    gaps = [F.col(f"replayed.{n}") - F.col(f"stored.{n}") for n in names]
    explained = F.col("record").isNotNull() & F.col("is_extra").isNotNull() & replay_emits & ~stored_emits & (F.col("record") == F.col("contribution"))
    return rows.select(
        "session",
        F.coalesce("stored_parent", "parent").alias("parent"),
        outcome.alias("outcome"),
        F.coalesce(F.col("stored") == F.col("replayed"), F.lit(False)).alias("baseline_matched"),
        F.coalesce(sum(gaps[1:], gaps[0]), F.lit(0)).alias("baseline_difference"),
        F.coalesce(sum(map(F.abs, gaps[1:]), F.abs(gaps[0])), F.lit(0)).alias("baseline_magnitude"),
        F.coalesce(total("contribution") - total("left"), F.lit(0)).alias("contribution_difference"),
        F.coalesce(explained, F.lit(False)).alias("explained"),
        *more,
    )


def fork_history_summary(cursors: DataFrame, traces: DataFrame, records: DataFrame, extra: DataFrame, differing: DataFrame) -> DataFrame:
    """One row over fork_history: forks, those of themselves, baselines that are there and that agree, and how many of the records that only the replay
    has (of forks, and in all) are explained. Records have session too; an id is in records once."""
    self_parent = F.count_if(F.col("session") == F.col("parent"))
    names = records.schema["usage"].dataType.names
    total = sum((F.col(f"record.{n}") for n in names[1:]), F.col(f"record.{names[0]}"))
    rows = fork_history(cursors, traces, records, extra, differing, F.col("stored").isNotNull().alias("has_stored"), F.col("replayed").isNotNull().alias("has_replayed"), total.alias("tokens"), "first_id")
    explained = rows.filter("explained").select(F.col("first_id").alias("id")).distinct().withColumn("is_explained", F.lit(True))
    of_forks = records.select("id", "session").join(rows.select("session").distinct(), "session", "left_semi").join(extra.select("id").distinct(), "id", "left_semi")
    parts = [
        rows.agg(
            F.count("*").alias("forks"), F.count_if("has_stored").alias("stored_baselines"), F.count_if("has_replayed").alias("replayed_baselines"), F.count_if("baseline_matched").alias("baselines_matched"),
            F.count_if(F.col("has_stored") & F.col("has_replayed") & ~F.col("baseline_matched")).alias("baselines_different"), F.count_if("explained").alias("explained_records"),
            F.coalesce(F.sum(F.when(F.col("explained"), F.col("tokens"))), F.lit(0)).cast("long").alias("explained_tokens"),
        ),
        cursors.agg(self_parent.alias("self_parent_cursors")), traces.agg(self_parent.alias("self_parent_traces")), extra.agg(F.count_distinct("id").alias("extra_records")),
        of_forks.join(explained, "id", "left").agg(F.count("*").alias("fork_extra_records"), F.count_if(F.col("is_explained").isNull()).alias("unexplained_fork_extra_records")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(F.broadcast(p))  # one row each

    def percent(of: str) -> Column:
        return F.when(F.col(of) > 0, F.col("explained_records") / F.col(of) * 100).otherwise(100.0)

    return one.withColumns({
        "fork_extra_adds_up": F.col("explained_records") + F.col("unexplained_fork_extra_records") == F.col("fork_extra_records"), "fork_extra_explained_percent": percent("fork_extra_records"),
        "extra_explained_percent": percent("extra_records"), "all_extra_explained": F.col("extra_records") == F.col("explained_records"),
    })
