"""The older accounting of logs, file by file, kept to be set beside the present one.

A file's model, session, folder and fork are carried from event to event, and a total counts what it adds to the total before it in the
file. A fork starts from the last total of its parent that files before it, by path, have told; as totals are read and never
derived, no fork waits for another, and all files are taken at once: the carried state is windows, the parent's total an as-of join.

Events: path, event_index, session, forked_from, model, project_key (as the event itself names them, else null), ts_ms, last, total, flat
(counters), source_kind, own_id, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import small, stored
from .contributions import USAGE, normalized, usage_total
from .counters import last_by


def _difference(now: Column, before: Column) -> Column:
    return F.struct(*[F.greatest(now[f] - F.coalesce(before[f], F.lit(0)), F.lit(0)).cast("long").alias(f) for f in USAGE])


def carried_events(events: DataFrame) -> DataFrame:
    """events with the state that holds at each: carried session, fork, model and folder; valid, whether its usage is read; the file's
    total before it and after it."""
    order = Window.partitionBy("path").orderBy("event_index")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumns({c: F.last(c, ignorenulls=True).over(now) for c in ("session", "forked_from", "model", "project_key")})
    some = F.col("last").isNotNull() | F.col("total").isNotNull() | F.col("flat").isNotNull()
    rows = rows.withColumn("valid", some & F.col("model").isNotNull())
    rows = rows.withColumn("_total", F.when(F.col("valid") & F.col("total").isNotNull(), normalized(F.col("total"))))
    return rows.withColumns({"total_before": F.last("_total", ignorenulls=True).over(before), "total_after": F.last("_total", ignorenulls=True).over(now)})


def fork_baselines(rows: DataFrame) -> DataFrame:
    """(path, forked_from, baseline, known_after): the total that a file's fork starts from, and the event after which it is known.

    That is the last total of the parent before the event that names it, in this file or one that comes before; or else the first that this file
    has for the parent later."""
    told = rows.filter("session is not null and total_after is not null")
    asked = rows.filter("forked_from is not null").groupBy("path", "forked_from").agg(F.min("event_index").alias("i"))
    last = told.groupBy("session", "path").agg(F.max_by("total_after", "event_index").alias("t"))
    last = last.select(F.col("session").alias("forked_from"), F.col("path").alias("other"), "t")
    earlier = asked.join(last, "forked_from").filter("other < path").groupBy("path", "forked_from").agg(F.max_by("t", "other").alias("from_earlier"))
    own = told.select("path", F.col("session").alias("forked_from"), "event_index", "total_after").join(asked, ["path", "forked_from"])
    own = own.groupBy("path", "forked_from").agg(
        F.max_by("total_after", F.when(F.col("event_index") < F.col("i"), F.col("event_index"))).alias("from_own"),
        F.min_by(F.struct("total_after", "event_index"), F.when(F.col("event_index") >= F.col("i"), F.col("event_index"))).alias("later"),
    )
    found = asked.join(earlier, ["path", "forked_from"], "left").join(own, ["path", "forked_from"], "left")
    at_once = F.coalesce("from_own", "from_earlier")
    found = found.select(
        "path", "forked_from", F.coalesce(at_once, F.col("later.total_after")).alias("baseline"), F.when(at_once.isNotNull(), F.col("i")).otherwise(F.col("later.event_index")).alias("known_after")
    ).filter("baseline is not null")
    # the first that is known stays, whatever the file says later
    return found.groupBy("path").agg(F.min_by(F.struct("forked_from", "baseline", "known_after"), "known_after").alias("b")).select("path", "b.*")


def contributions(events: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Events with usage: what each adds, with the state carried to it and its baseline (null where it has none). carried: their
    carried_events, where these are at hand."""
    rows = stored(carried_events(events)) if carried is None else carried
    baselines = fork_baselines(rows).select("path", F.col("baseline").alias("_baseline"), "known_after")
    rows = rows.join(small(stored(baselines)), "path", "left").withColumn("baseline", F.when(F.col("event_index") > F.col("known_after"), F.col("_baseline")))
    first = F.col("_total").isNotNull() & F.col("baseline").isNotNull() & F.col("total_before").isNull()
    usage = (
        F.when(F.col("last").isNotNull(), F.when(first, _difference(F.col("_total"), F.col("baseline"))).otherwise(normalized(F.col("last"))))
        .when(F.col("_total").isNotNull(), _difference(F.col("_total"), F.coalesce("total_before", "baseline")))
        .otherwise(normalized(F.col("flat")))
    )
    return rows.filter("valid").withColumn("usage", usage).withColumn("tokens", usage_total(F.col("usage"))).drop("_baseline", "known_after")


def record_id() -> Column:
    """The id of a row of carried_events: its own, or else one by its session and content."""
    by_content = F.concat(F.lit("codex:h"), F.substring(F.sha2(F.concat_ws("\n", F.coalesce("session", "path"), "content"), 256), 1, 16))
    return F.coalesce(F.concat(F.lit("codex:"), F.col("own_id")), by_content)


def records(rows: DataFrame) -> DataFrame:
    """Records of contributions that have tokens: of several with one id the last by file and place stands."""
    found = rows.filter("tokens > 0").select(
        record_id().alias("id"), "path", "event_index", F.col("session").alias("session_id"), "ts_ms", "model", F.coalesce("project_key", F.lit("unknown")).alias("project_key"),
        "source_kind", "usage", "tokens",
    )
    return last_by(found, "id", ["path", "event_index"])


def totals(found: DataFrame) -> DataFrame:
    """(dimension, value, records, tokens) of records by session, day (UTC) and source, in one pass."""
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in (("session", F.col("session_id")), ("day", day), ("source", F.col("source_kind")))])
    rows = found.select(F.explode(pairs).alias("p"), "tokens").filter("p.value is not null")
    return rows.groupBy("p.dimension", "p.value").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))


def fork_traces(rows: DataFrame) -> DataFrame:
    """(session, parent, baseline, first_total, contribution): of each session that forks, its first event with a last or a total."""
    counted = rows.filter("session is not null and forked_from is not null and (last is not null or total is not null)")
    first = F.struct(F.col("forked_from").alias("parent"), "baseline", F.col("_total").alias("first_total"), F.when(F.col("tokens") > 0, F.col("usage")).alias("contribution"))
    return counted.groupBy("session").agg(F.min_by(first, F.struct("path", "event_index")).alias("t")).select("session", "t.*")
