"""Comparable periods and what drove a change, by conditional sums over one pass of the buckets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.usage import percent_change, total_tokens

PERIODS = ("today", "week", "month")


@dataclass(frozen=True)
class Windows:
    current_from: int
    current_to: int
    previous_from: int
    previous_to: int


def _ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def comparable(period: str, now_ms: int, zone: str = "UTC") -> Windows:
    """The period up to now and as much of the one before it."""
    now = datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone))
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "today":
        begin, before = day, day - timedelta(days=1)
    elif period == "week":
        begin = day - timedelta(days=day.weekday())
        before = begin - timedelta(days=7)
    else:
        begin = day.replace(day=1)
        before = (begin - timedelta(days=1)).replace(day=1)
    end = now_ms + 1
    elapsed = max(1, end - _ms(begin))
    return Windows(_ms(begin), end, _ms(before), min(_ms(begin), _ms(before) + elapsed))


def preset_range(preset: str, now_ms: int, zone: str = "UTC", custom: tuple[int, int] | None = None) -> tuple[int | None, int | None]:
    """Half-open epoch milliseconds of a named range; (None, None) is all time."""
    day = datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0)
    month = day.replace(day=1)
    monday = day - timedelta(days=day.weekday())
    tomorrow = day + timedelta(days=1)
    ranges = {
        "today": (day, tomorrow),
        "yesterday": (day - timedelta(days=1), day),
        "thisWeek": (monday, monday + timedelta(days=7)),
        "last7": (day - timedelta(days=6), tomorrow),
        "last30": (day - timedelta(days=29), tomorrow),
        "thisMonth": (month, (month + timedelta(days=32)).replace(day=1)),
        "lastMonth": ((month - timedelta(days=1)).replace(day=1), month),
    }
    if preset in ranges:
        return tuple(map(_ms, ranges[preset]))
    if preset == "custom" and custom and custom[0] < custom[1]:
        return custom
    return None, None


def _window_sums(w: Windows) -> tuple:
    at, tokens = F.col("bucket_start"), total_tokens()
    now = F.coalesce(F.sum(F.when((at >= w.current_from) & (at < w.current_to), tokens)), F.lit(0)).cast("long")
    before = F.coalesce(F.sum(F.when((at >= w.previous_from) & (at < w.previous_to), tokens)), F.lit(0)).cast("long")
    return now, before


def comparison(buckets: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """A row a period: current, previous, delta and change in percent."""
    sums = []
    for p in PERIODS:
        now, before = _window_sums(comparable(p, now_ms, zone))
        sums += [now.alias(f"{p}_now"), before.alias(f"{p}_before")]
    one = buckets.agg(*sums)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"{p}_now").alias("now"), F.col(f"{p}_before").alias("before")) for p in PERIODS])
    each = one.select(F.explode(rows).alias("r")).select("r.*")
    return each.select(
        "period",
        F.col("now").alias("current_tokens"),
        F.col("before").alias("previous_tokens"),
        (F.col("now") - F.col("before")).alias("delta_tokens"),
        percent_change(F.col("now"), F.col("before")).alias("change_percent"),
    )


def drivers(buckets: DataFrame, period: str, now_ms: int, zone: str = "UTC") -> DataFrame:
    """By source, model and project in one pass: what each key had before and has now, its share of the net change and state."""
    w = comparable(period, now_ms, zone)
    seen = buckets.filter((F.col("bucket_start") >= w.previous_from) & (F.col("bucket_start") < w.current_to))
    now, before = _window_sums(w)
    grouped = seen.groupingSets([["source"], ["model"], ["project_key"]], "source", "model", "project_key").agg(
        now.alias("current_tokens"), before.alias("previous_tokens"), F.grouping_id().alias("g")
    )
    dimension = F.element_at(F.create_map(*[F.lit(x) for x in (3, "source", 5, "model", 6, "project")]), F.col("g").cast("int"))
    each = grouped.select(dimension.alias("dimension"), F.coalesce("source", "model", "project_key").alias("key"), "current_tokens", "previous_tokens")
    each = each.withColumn("delta_tokens", F.col("current_tokens") - F.col("previous_tokens"))
    # Each dimension splits the same net change; its sum is over keys, which are few next to the buckets.
    net = each.groupBy("dimension").agg(F.sum("delta_tokens").alias("net"))
    state = (
        F.when((F.col("previous_tokens") == 0) & (F.col("current_tokens") > 0), "new")
        .when((F.col("current_tokens") == 0) & (F.col("previous_tokens") > 0), "inactive")
        .when(F.col("delta_tokens") > 0, "increased")
        .otherwise("decreased")
    )
    return each.join(F.broadcast(net), "dimension").select(
        "dimension",
        "key",
        "current_tokens",
        "previous_tokens",
        "delta_tokens",
        percent_change(F.col("current_tokens"), F.col("previous_tokens")).alias("change_percent"),
        F.when(F.col("net") != 0, F.col("delta_tokens").cast("double") / F.col("net").cast("double")).alias("share_of_net_change"),
        state.alias("state"),
    )
