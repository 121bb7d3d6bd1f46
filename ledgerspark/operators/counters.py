"""Ordered counters: what each event adds, given counters that only grow until they are reset.

Every state is a window over the events of a session, so sessions are processed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def carried(column: str, partition: list[str], order: list[str]) -> Column:
    """The last value that isn't null, this row's included."""
    return F.last(column, ignorenulls=True).over(_so_far(partition, order))


def contributions(events: DataFrame, partition: list[str], order: list[str], seed: Column | None = None) -> DataFrame:
    """From events with a nullable cumulative `total` and a nullable increment `last`: previous, relation, method, tokens.

    An increment that is given counts as it is. Else the total is compared with the last one known before (or the
    seed): more counts the difference, the same nothing, less is a reset and counts whole."""
    known = F.last("total", ignorenulls=True).over(_before(partition, order))
    previous = F.coalesce(known, seed) if seed is not None else known
    rows = events.withColumn("previous", previous)
    total, last, previous = F.col("total"), F.col("last"), F.col("previous")
    relation = (
        F.when(total.isNull(), "none")
        .when(previous.isNull(), "initial")
        .when(total == previous, "same")
        .when(total > previous, "increased")
        .otherwise("reset")
    )
    rows = rows.withColumn("relation", relation)
    by_relation = F.element_at(
        F.create_map(*[F.lit(x) for x in ("none", "unresolved", "initial", "total-initial", "same", "duplicate-zero", "increased", "total-delta", "reset", "total-reset")]),
        F.col("relation"),
    )
    tokens = (
        F.when(last.isNotNull(), last)
        .when(F.col("relation").isin("initial", "reset"), total)
        .when(F.col("relation") == "increased", total - previous)
        .otherwise(0)
    )
    return rows.withColumn("method", F.when(last.isNotNull(), "last").otherwise(by_relation)).withColumn("tokens", tokens)


def segments(events: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """The number of resets so far."""
    known = F.last("total", ignorenulls=True).over(_before(partition, order))
    rows = events.withColumn("_reset", F.coalesce((F.col("total") < known).cast("long"), F.lit(0).cast("long")))
    return rows.withColumn("segment", F.sum("_reset").over(_so_far(partition, order))).drop("_reset")


def transitions(events: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Events with a total: the one before it that differs."""
    window = Window.partitionBy(*partition).orderBy(*order)
    rows = events.filter("total is not null").withColumn("_lag", F.lag("total").over(window))
    changed = F.when(F.col("_lag").isNotNull() & (F.col("_lag") != F.col("total")), F.col("_lag"))
    return rows.withColumn("_change", changed).withColumn("previous_distinct", F.last("_change", ignorenulls=True).over(_so_far(partition, order))).drop("_lag", "_change")


def changed_only(events: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't that of the row before, nulls being equal."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*partition).orderBy(*order))
    rows = events.withColumn("_before", before)
    return rows.filter(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")


def last_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. A grouped maximum of the row, so nothing but one row a key and task is shuffled."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def slots(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Numbers the rows of a key from 0."""
    return rows.withColumn("slot", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
