"""Sessions and projects: summaries, lists, timelines and insights from records."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.usage import (
    COUNTERS,
    QUARTER_HOUR_MS,
    bucket_start,
    cached_share,
    in_range,
    input_context,
    is_unassigned,
    local_day,
    percent_change,
    ratio,
    sums,
    total_tokens,
)
from .pricing import dollars, priced


def _ranked(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """By keys: values of column in the order of their tokens, largest first. Tokens are summed before lists are made,
    so a list is as long as a session has models or projects."""
    each = rows.groupBy(*keys, column).agg(F.sum("tokens").alias("tokens"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("t"), F.col(column).alias("v"))))
    return each.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def summaries(records: DataFrame, prices: DataFrame) -> DataFrame:
    """A row a source and session."""
    keys = ["source", "session_id"]
    rows = priced(records.filter(~is_unassigned(F.col("session_id"))), prices).withColumn("tokens", total_tokens())
    base = rows.groupBy(*keys).agg(
        F.min("ts_ms").alias("started_ms"),
        F.max("ts_ms").alias("last_active_ms"),
        F.count("*").alias("record_count"),
        *sums(),
        F.sum("tokens").cast("long").alias("total_tokens"),
        dollars(F.sum(F.col("cost_units").cast("decimal(38,0)"))).alias("cost_usd"),
    )
    joined = base.join(_ranked(rows, keys, "model", "models"), keys).join(_ranked(rows, keys, "project_key", "projects"), keys)
    return joined.withColumns(
        {
            "span_ms": F.col("last_active_ms") - F.col("started_ms"),
            "primary_model": F.coalesce(F.get("models", F.lit(0)), F.lit("unknown")),
            "primary_project": F.coalesce(F.get("projects", F.lit(0)), F.lit("unknown")),
            "input_context": input_context(),
            "cached_share": cached_share(),
        }
    )


def unassigned(records: DataFrame) -> DataFrame:
    return records.filter(is_unassigned(F.col("session_id"))).agg(
        F.count("*").alias("record_count"), F.coalesce(F.sum(total_tokens()), F.lit(0)).cast("long").alias("total_tokens")
    )


ORDERS = {
    "recent": ["last_active_ms", "total_tokens"],
    "tokens": ["total_tokens", "last_active_ms"],
    "span": ["span_ms", "last_active_ms"],
}


def listed(found: DataFrame, order: str = "recent", page: int = 1, size: int = 50) -> DataFrame:
    """A page of summaries; ties end by source and session."""
    by = [F.desc(c) for c in ORDERS[order]]
    return found.orderBy(*by, "source", "session_id").offset((max(1, page) - 1) * size).limit(max(1, size))


def top_of_project(records: DataFrame, prices: DataFrame, project: str, n: int = 5) -> DataFrame:
    return listed(summaries(records.filter(F.col("project_key") == project), prices), "tokens", 1, max(1, n))


def timeline(records: DataFrame, source: str, session: str) -> DataFrame:
    """One session's records in quarters of an hour."""
    own = records.filter((F.col("source") == source) & (F.col("session_id") == session))
    return own.groupBy(bucket_start(F.col("ts_ms"), QUARTER_HOUR_MS).alias("start_ms")).agg(
        F.count("*").alias("record_count"), F.sum(total_tokens()).cast("long").alias("total_tokens")
    )


def breakdown(records: DataFrame, project: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """A project's tokens by source and by model with their shares, in one pass."""
    own = records.filter((F.col("project_key") == project) & in_range(F.col("ts_ms"), begin, end))
    grouped = own.groupingSets([["source"], ["model"]], "source", "model").agg(
        F.count("*").alias("record_count"), F.sum(total_tokens()).cast("long").alias("total_tokens"), F.grouping_id().alias("g")
    )
    dimension = F.when(F.col("g") == 1, "source").otherwise("model")
    each = grouped.select(dimension.alias("dimension"), F.coalesce("source", "model").alias("key"), "record_count", "total_tokens")
    whole = F.sum("total_tokens").over(Window.partitionBy("dimension"))
    return each.withColumn("share", ratio(F.col("total_tokens"), whole))


def trend(records: DataFrame, prices: DataFrame, project: str, today: date, days: int = 30, zone: str = "UTC") -> DataFrame:
    """A project's counters and cost for each of the last days, days without records included."""
    first = today - timedelta(days=days - 1)
    own = priced(records.filter(F.col("project_key") == project), prices).withColumn("day", local_day("ts_ms", zone))
    own = own.filter((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(today)))
    by_day = own.groupBy("day").agg(*sums(), F.sum(F.col("cost_units").cast("decimal(38,0)")).alias("units"))
    spark: SparkSession = records.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(today), F.expr("interval 1 day"))).alias("day"))
    filled = spine.join(by_day, "day", "left")
    return filled.select("day", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS], dollars(F.col("units")).alias("cost_usd"))


def insight(records: DataFrame, project: str, begin: int, end: int) -> DataFrame:
    """A project's figures of all time, of a range, and of the span of the same length before it."""
    at, tokens = F.col("ts_ms"), total_tokens()
    now, before = in_range(at, begin, end), in_range(at, begin - (end - begin), begin)
    session = F.when(~is_unassigned(F.col("session_id")), F.concat_ws(":", "source", "session_id"))

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, tokens)), F.lit(0)).cast("long")

    one = records.filter(F.col("project_key") == project).agg(
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("all_tokens"),
        total(now).alias("range_tokens"),
        total(before).alias("previous_tokens"),
        F.count_if(now).alias("range_records"),
        F.count_distinct(F.when(now, session)).alias("range_sessions"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    )
    return one.withColumn("change_percent", percent_change(F.col("range_tokens"), F.col("previous_tokens")))


def visible(records: DataFrame, projects: DataFrame) -> DataFrame:
    """Records of projects that aren't hidden; projects (project_key, alias, hidden) is a dimension."""
    hidden = projects.filter("hidden").select("project_key")
    return records.join(hidden, "project_key", "left_anti")


def named(records: DataFrame, projects: DataFrame) -> DataFrame:
    """Records with their project's alias, or else the last part of its path."""
    from ..functions.usage import project_display_name

    alias = projects.select("project_key", "alias").dropDuplicates(["project_key"])
    return records.join(alias, "project_key", "left").withColumn("project_name", F.coalesce(F.nullif("alias", F.lit("")), project_display_name(F.col("project_key"))))
