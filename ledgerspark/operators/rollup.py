"""Rollups of usage records: buckets, dashboard figures, groups, days, agents, reports and audits.

Records are aggregated once to half-hour buckets; all figures that don't need single records read those.
Grouped sums are partial before the shuffle, and the several groupings of a report are one pass
(GROUPING SETS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.usage import (
    COUNTERS,
    bucket_start,
    cached_share,
    in_range,
    input_context,
    local_day,
    ratio,
    sums,
    token_metrics,
    total_tokens,
)
from .pricing import dollars, label, priced


def buckets(records: DataFrame) -> DataFrame:
    """A row a source, model, project and half hour: counters, record_count, and session_count, distinct in the bucket;
    a record without a session counts as a session of its own."""
    return records.groupBy("source", "model", "project_key", bucket_start(F.col("ts_ms")).alias("bucket_start")).agg(
        *sums(),
        F.count("*").alias("record_count"),
        F.count_distinct(F.coalesce("session_id", "id")).alias("session_count"),
    )


def filtered(records: DataFrame, begin=None, end=None, source="", model="", project="", session="", ts: str = "ts_ms") -> DataFrame:
    """Half-open in time; empty texts are no condition. All of it can be pushed to the scan."""
    found = records.filter(in_range(F.col(ts), begin, end))
    for name, value in (("source", source), ("model", model), ("project_key", project), ("session_id", session)):
        if value:
            found = found.filter(F.col(name) == value)
    return found


def totals(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The dashboard's one row, from buckets."""
    summed = priced(rows, prices).agg(
        F.sum("record_count").cast("long").alias("record_count"), *sums(), F.sum(F.col("cost_units").cast("decimal(38,0)")).alias("units")
    )
    return summed.select(
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce(total_tokens(), F.lit(0)).alias("total_tokens"),
        *COUNTERS,
        dollars(F.col("units")).alias("cost_usd"),
        cached_share().alias("cached_share"),
    )


def by_key(rows: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """key, record_count, total_tokens, cost_usd of buckets."""
    return (
        priced(rows, prices)
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.sum("record_count").cast("long").alias("record_count"),
            F.sum(total_tokens()).cast("long").alias("total_tokens"),
            dollars(F.sum(F.col("cost_units").cast("decimal(38,0)"))).alias("cost_usd"),
        )
    )


def daily(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """day, total_tokens, record_count, session_count of buckets by the day on which they begin; sessions are summed."""
    return rows.groupBy(local_day("bucket_start", zone).alias("day")).agg(
        F.sum(total_tokens()).cast("long").alias("total_tokens"),
        F.sum("record_count").cast("long").alias("record_count"),
        F.sum("session_count").cast("long").alias("session_count"),
    )


def _real(session: str = "session_id") -> Column:
    return F.when(F.col(session) != "", F.col(session))


def agents(records: DataFrame, prices: DataFrame) -> DataFrame:
    """A row a source with its share of all tokens; the total is summed over sources, so few rows meet."""
    each = (
        priced(records, prices)
        .groupBy("source")
        .agg(
            F.count("*").alias("record_count"),
            F.count_distinct(_real()).alias("session_count"),
            F.count_distinct("project_key").alias("project_count"),
            F.count_distinct("model").alias("model_count"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
            F.sum(total_tokens()).cast("long").alias("total_tokens"),
            dollars(F.sum(F.col("cost_units").cast("decimal(38,0)"))).alias("cost_usd"),
        )
    )
    everything = each.agg(F.sum("total_tokens").alias("_all"))
    return each.crossJoin(F.broadcast(everything)).withColumn("share", ratio(F.col("total_tokens"), F.col("_all"))).drop("_all")


def report(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals, models and projects of filtered records in one pass: level, key, record_count, total_tokens, cost_usd."""
    rows = priced(records, prices).select("model", "project_key", total_tokens().alias("tokens"), "cost_units")
    grouped = rows.groupingSets([[], ["model"], ["project_key"]], "model", "project_key").agg(
        F.count("*").alias("record_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        dollars(F.sum(F.col("cost_units").cast("decimal(38,0)"))).alias("cost_usd"),
        F.grouping_id().alias("g"),
    )
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "model").otherwise("project")
    return grouped.select(level.alias("level"), F.coalesce("model", "project_key", F.lit("")).alias("key"), "record_count", "total_tokens", "cost_usd")


def source_summary(records: DataFrame, source: str) -> DataFrame:
    return records.filter(F.col("source") == source).agg(
        F.count("*").alias("record_count"),
        F.count_distinct(_real()).alias("session_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
        F.coalesce(F.sum(total_tokens()), F.lit(0)).cast("long").alias("total_tokens"),
    )


def usage_audit(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """The seven totals overall, by source, by model and by day, in one pass over the records."""
    metrics = token_metrics()
    rows = records.select(
        "source", "model", local_day("ts_ms", zone).cast("string").alias("day"), *[c.alias(n) for n, c in metrics.items()],
        "ts_ms", F.when(_real().isNotNull(), F.concat_ws(":", "source", "session_id")).alias("session"),
    )
    grouped = rows.groupingSets([[], ["source"], ["model"], ["day"]], "source", "model", "day").agg(
        F.count("*").alias("record_count"),
        F.count_distinct("session").alias("session_count"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        *sums(*metrics),
        F.grouping_id().alias("g"),
    )
    level = F.element_at(F.create_map(*[F.lit(x) for x in (7, "total", 3, "source", 5, "model", 6, "day")]), F.col("g").cast("int"))
    return grouped.select(level.alias("level"), F.coalesce("source", "model", "day", F.lit("")).alias("key"), "record_count", "session_count", "first_ms", "last_ms", *metrics)


def peak_days(records: DataFrame, n: int = 20, zone: str = "UTC") -> DataFrame:
    by_day = records.groupBy(local_day("ts_ms", zone).alias("day")).agg(
        F.sum(total_tokens()).cast("long").alias("total_tokens"), F.count("*").alias("record_count")
    )
    return by_day.orderBy(F.desc("total_tokens"), "day").limit(n)


def options(records: DataFrame, column: str) -> DataFrame:
    return records.select(F.col(column).alias("option")).distinct()


def with_metrics(records: DataFrame) -> DataFrame:
    return records.select(
        "id", *[c.cast("long").alias(n) for n, c in token_metrics().items()], input_context().alias("input_context"), cached_share().alias("cached_share")
    )


def page(records: DataFrame, number: int = 1, size: int = 50, newest_first: bool = True) -> tuple[DataFrame, dict]:
    """One page by (ts_ms, id) and its place: page and size are brought into range, and there is always a page."""
    size = max(1, size)
    total = records.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    order = [F.desc("ts_ms"), F.desc("id")] if newest_first else [F.asc("ts_ms"), F.asc("id")]
    rows = records.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows, {"page": number, "page_size": size, "total": total, "total_pages": pages}


def coverage(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """How far buckets have prices, by kind of match."""
    matched = priced(rows, prices).withColumn("tokens", total_tokens())

    def of(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("match_kind").isin(*kinds), F.col("tokens"))), F.lit(0)).cast("long")

    summed = matched.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        of("exact").alias("exact_tokens"),
        of("alias").alias("alias_tokens"),
        of("family-fallback").alias("fallback_tokens"),
        of("unmatched").alias("unmatched_tokens"),
        dollars(F.sum(F.col("cost_units").cast("decimal(38,0)"))).alias("cost_usd"),
    )
    whole = F.col("total_tokens")
    return summed.withColumns(
        {
            "priced_tokens": whole - F.col("unmatched_tokens"),
            "coverage_ratio": ratio(whole - F.col("unmatched_tokens"), whole),
            "exact_coverage": ratio(F.col("exact_tokens") + F.col("alias_tokens"), whole),
        }
    )


def coverage_by_model(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """By model: how it is matched, the price entry, tokens, and their cost, null without a price."""
    matched = priced(rows, prices).withColumn("tokens", total_tokens())
    units = F.sum(F.col("cost_units").cast("decimal(38,0)"))
    return matched.groupBy("model", "match_kind", "price_id").agg(F.sum("tokens").cast("long").alias("total_tokens"), F.when(units.isNotNull(), dollars(units)).alias("cost_usd"))


def export_rows(records: DataFrame, prices: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """The fourteen columns of the export, texts made safe for spreadsheets. projects (project_key, name), one row a key, gives names of projects; others
    keep their key. Cost and label are null without a price."""
    from ..functions.usage import csv_safe, iso_utc

    rows = priced(records, prices)
    if projects is not None:
        rows = rows.join(projects.select("project_key", "name"), "project_key", "left")
    project = F.col("project_key") if projects is None else F.coalesce("name", "project_key")
    texts = {"agent": F.col("source"), "session_id": F.col("session_id"), "model": F.col("model"), "project": project}
    cost = F.when(F.col("cost_units").isNotNull(), F.col("cost_units").cast("double") / 1e9)
    return rows.select(
        iso_utc(F.col("ts_ms")).alias("time"), *[csv_safe(F.coalesce(c, F.lit(""))).alias(n) for n, c in texts.items()], *COUNTERS, total_tokens().alias("total_tokens"),
        cost.alias("estimated_cost_usd"), F.col("match_kind").alias("pricing_status"), label().alias("pricing_label"),
    )


def csv_rows(records: DataFrame, prices: DataFrame) -> DataFrame:
    """The columns of the CSV export, texts made safe for spreadsheets; the cost is null without a price."""
    from ..functions.usage import csv_safe, iso_utc

    rows = priced(records, prices)
    texts = [csv_safe(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("id", "source", "session_id", "model", "project_key")]
    cost = F.when(F.col("cost_units").isNotNull(), F.col("cost_units").cast("double") / 1e9)
    return rows.select(iso_utc(F.col("ts_ms")).alias("time"), *texts, *COUNTERS, total_tokens().alias("total_tokens"), cost.alias("cost_usd"))


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """With bom each file begins with a byte order mark, by which spreadsheets know UTF-8."""
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    writer = rows.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)
