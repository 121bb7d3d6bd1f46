"""Calendar grids, intensities and streaks from daily figures.

Daily figures have a row a day, so a window over all of them is small however large the records are.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def spine(daily: DataFrame, first: date, end: date) -> DataFrame:
    """A row a day from first to before end; days without figures have zeros."""
    days = daily.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(end - timedelta(days=1)), F.expr("interval 1 day"))).alias("day")
    )
    figures = ("total_tokens", "record_count", "session_count")
    return days.join(daily, "day", "left").select("day", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in figures])


def _intensity(cells: DataFrame) -> DataFrame:
    """0 without tokens, else 1 to 4 by rank among the cells that have some; ties take the first rank."""
    active = F.col("total_tokens") > 0
    rank = F.rank().over(Window.partitionBy(active).orderBy("total_tokens")) - 1
    n = F.count("*").over(Window.partitionBy(active))
    level = F.least(F.lit(LEVELS), F.floor(rank / F.greatest(n - 1, F.lit(1)) * LEVELS) + 1)
    return cells.withColumn("intensity", F.when(active, level).otherwise(0).cast("int"))


def daily_grid(daily: DataFrame, today: date, columns: int = 53) -> DataFrame:
    """Seven rows by `columns` weeks that end with the current one."""
    end = monday(today) + timedelta(days=7)
    return _intensity(spine(daily, end - timedelta(days=7 * columns), end))


def _summed(days: DataFrame, start) -> DataFrame:
    cells = days.groupBy(start.alias("day")).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("total_tokens", "record_count", "session_count")],
        F.count_if(F.col("total_tokens") > 0).alias("active_days"),
    )
    return _intensity(cells)


def weekly_grid(daily: DataFrame, today: date, weeks: int = 52) -> DataFrame:
    end = monday(today) + timedelta(days=7)
    first = end - timedelta(days=7 * weeks)
    week = F.date_add(F.lit(first), (F.floor(F.datediff("day", F.lit(first)) / 7) * 7).cast("int"))
    return _summed(spine(daily, first, end), week)


def monthly_grid(daily: DataFrame, today: date, months: int = 12) -> DataFrame:
    end = (today.replace(day=1) + timedelta(days=32)).replace(day=1)
    at = end.year * 12 + end.month - 1 - months
    return _summed(spine(daily, date(at // 12, at % 12 + 1, 1), end), F.trunc("day", "month"))


def cumulative(daily: DataFrame, today: date) -> DataFrame:
    """From the first active day to today, with the running total; its intensity is by the largest day."""
    first = daily.filter("total_tokens > 0").agg(F.min("day")).first()[0] or today
    days = spine(daily, min(first, today), today + timedelta(days=1))
    running = F.sum("total_tokens").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    largest = F.max("total_tokens").over(Window.partitionBy())
    days = days.withColumn("cumulative_tokens", running.cast("long")).withColumn("_most", largest)
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.ceil(F.col("cumulative_tokens") / F.col("_most") * LEVELS)))
    return days.withColumn("intensity", F.when(F.col("cumulative_tokens") > 0, level).otherwise(0).cast("int")).drop("_most")


def streaks(daily: DataFrame, today: date) -> DataFrame:
    """current_streak (must reach today) and longest_streak, in days in a row with tokens."""
    active = daily.filter("total_tokens > 0").select("day")
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = active.withColumn("island", island).groupBy("island").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    now = F.lit(today)
    reach = F.when((F.col("first") <= now) & (F.col("last") >= now), F.datediff(now, "first") + 1)
    return runs.agg(
        F.coalesce(F.max(reach), F.lit(0)).cast("long").alias("current_streak"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("longest_streak"),
    )


def grid_summary(cells: DataFrame) -> DataFrame:
    """The grid's tokens, its peak and the label of the first cell that has it."""
    return cells.agg(
        F.sum("total_tokens").cast("long").alias("range_tokens"),
        F.max("total_tokens").cast("long").alias("peak_tokens"),
        F.max_by("day", F.struct("total_tokens", -F.datediff("day", F.lit(date(1970, 1, 1))))).alias("peak_day"),
    )


def month_labels(cells: DataFrame, rows: int) -> DataFrame:
    """Columns of a grid, filled column by column, whose first cell begins another month than the column before."""
    place = F.row_number().over(Window.orderBy("day")) - 1
    columns = cells.withColumn("_at", place).filter(F.col("_at") % rows == 0)
    columns = columns.select(F.date_format("day", "yyyy-MM").alias("label"), F.floor(F.col("_at") / rows).cast("long").alias("column"))
    before = F.lag("label").over(Window.orderBy("column"))
    return columns.withColumn("_before", before).filter("_before is null or _before <> label").drop("_before")
