"""Contributions of counter structs in which a field may be absent, which is not the same as 0.

Rows have `last` and `total`, structs of input, cached, creation, output, reasoning and total, each nullable. State is
carried by windows over a session; the comparison of a total with the one before is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of counters, and below those of bases, relations, methods and precisions.
SECONDARY = ("cached", "creation", "reasoning")
USAGE = ("input", "cached", "creation", "output", "reasoning")


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def normalized(u: Column) -> Column:
    """Disjoint counters: input without what was cached, output without reasoning; a bare total counts as input."""
    i, c, n, o, r, t = (_or0(u[f]) for f in (*USAGE, "total"))
    bare = (t > 0) & (i == 0) & (o == 0) & (r == 0) & (c == 0)
    parts = (F.when(bare, t).otherwise(F.greatest(i - c, F.lit(0))), c, n, F.greatest(o - r, F.lit(0)), r)
    return F.struct(*[p.cast("long").alias(f) for f, p in zip(USAGE, parts, strict=True)])


def usage_total(u: Column) -> Column:
    total = u[USAGE[0]]
    for f in USAGE[1:]:
        total = total + u[f]
    return total


def aggregate_total(u: Column) -> Column:
    """The total if it is there, else input and output together if both are."""
    return F.coalesce(u["total"], u["input"] + u["output"])


def all_input(tokens: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(F.greatest(tokens, zero).alias("input"), *[zero.alias(f) for f in USAGE[1:]])


def _same_presence(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for f in SECONDARY:
        out = out & (a[f].isNull() == b[f].isNull())
    return out


def _none_decreased(now: Column, before: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(now[f] >= before[f], F.lit(True))
    return out


def _difference(now: Column, before: Column) -> Column:
    parts = [F.when(now[f].isNotNull(), F.greatest(now[f] - _or0(before[f]), F.lit(0))).alias(f) for f in USAGE]
    both = now["total"].isNotNull() & before["total"].isNotNull()
    return F.struct(*parts, F.when(both, F.greatest(now["total"] - before["total"], F.lit(0))).alias("total"))


def compared(rows: DataFrame, now: str, was: str, earlier: Column) -> DataFrame:
    """rows with how the counters `now` relate to `was`: basis and relation, component_exact (the parts that grew add up to what the
    total grew by), _delta (the parts by which they grew), and _now and _was, the figures that were compared.

    earlier: the aggregate to set against one of another schema."""
    c, p = F.col(now), F.col(was)
    explicit = c["total"].isNotNull() & p["total"].isNotNull()
    parts = c["input"].isNotNull() & p["input"].isNotNull() & c["output"].isNotNull() & p["output"].isNotNull()
    a = F.when(explicit, c["total"]).when(parts, c["input"] + c["output"]).otherwise(aggregate_total(c))
    b = F.when(explicit, p["total"]).when(parts, p["input"] + p["output"]).otherwise(F.coalesce(earlier, aggregate_total(p)))
    basis = (
        F.when(p.isNull(), F.when(c["total"].isNotNull(), "explicit-total").when(c["input"].isNotNull() & c["output"].isNotNull(), "input-output").otherwise("none"))
        .when(explicit, "explicit-total")
        .when(parts, "input-output")
        .when(a.isNotNull() & b.isNotNull(), "aggregate-cross-schema")
        .otherwise("none")
    )
    rows = rows.withColumns({"basis": F.when(c.isNotNull(), basis), "_now": a, "_was": b})
    dropped = (F.col("basis") == "input-output") & ((c["input"] < p["input"]) | (c["output"] < p["output"]))
    relation = (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(p.isNull(), "initial")
        .when(F.col("_now").isNull() | F.col("_was").isNull(), "incomparable")
        .when(F.coalesce(dropped, F.lit(False)) | (F.col("_now") < F.col("_was")), "reset")
        .when(F.col("_now") == F.col("_was"), "same")
        .otherwise("increased")
    )
    rows = rows.withColumn("relation", relation).withColumn("_delta", normalized(_difference(c, p)))
    exact = (F.col("relation") == "increased") & parts & _none_decreased(c, p, ("input", "output", *SECONDARY)) & _same_presence(c, p)
    return rows.withColumn("component_exact", F.coalesce(exact & (usage_total(F.col("_delta")) == F.col("_now") - F.col("_was")), F.lit(False)))


def contributions(events: DataFrame, keys: list[str], order: list[str], seed: tuple[Column, Column] | None = None) -> DataFrame:
    """events with relation, basis, method and usage (a struct of five counters).

    seed: a fork's starting total and its aggregate, for rows before the first total of a session."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_aggregate", aggregate_total(F.col("total")))
    previous, aggregate = F.last("total", ignorenulls=True).over(before), F.last("_aggregate", ignorenulls=True).over(before)
    if seed is not None:
        previous, aggregate = F.coalesce(previous, seed[0]), F.coalesce(aggregate, seed[1])
    rows = rows.withColumn("_previous", previous).withColumn("_previous_aggregate", aggregate)
    rows = compared(rows, "total", "_previous", F.col("_previous_aggregate"))
    now = F.col("total")
    whole = normalized(now)
    complete = now["input"].isNotNull() & now["output"].isNotNull() & (usage_total(whole) == F.col("_aggregate"))
    snapshot = F.when(F.col("_aggregate").isNull() | F.coalesce(complete, F.lit(False)), whole).otherwise(all_input(F.col("_aggregate")))
    given = F.col("last").isNotNull()
    method = (
        F.when(given, "last")
        .when(F.col("relation") == "initial", "total-initial")
        .when(F.col("relation") == "same", "duplicate-zero")
        .when((F.col("relation") == "increased") & F.col("component_exact"), "total-delta")
        .when(F.col("relation") == "increased", "total-aggregate-delta")
        .when(F.col("relation") == "reset", "total-reset")
        .otherwise("unresolved")
    )
    rows = rows.withColumns({"method": method, "snapshot_exact": F.coalesce(F.col("_aggregate").isNotNull() & complete, F.lit(False))})
    usage = (
        F.when(given, normalized(F.col("last")))
        .when(F.col("method").isin("total-initial", "total-reset"), snapshot)
        .when(F.col("method") == "total-delta", F.col("_delta"))
        .when(F.col("method") == "total-aggregate-delta", all_input(F.col("_now") - F.col("_was")))
        .otherwise(all_input(F.lit(0).cast("long")))
    )
    return rows.withColumn("usage", usage).withColumn("tokens", usage_total(F.col("usage"))).drop("_aggregate", "_previous", "_previous_aggregate", "_now", "_was", "_delta")


def precision(u: Column) -> Column:
    """components-exact, aggregate-only or partial."""
    parts = u["input"].isNotNull() & u["output"].isNotNull()
    agrees = u["total"].isNull() | (u["total"] == usage_total(normalized(u)))
    return F.when(parts & agrees, "components-exact").when(~parts & u["total"].isNotNull(), "aggregate-only").otherwise("partial")


def contributed_precision() -> Column:
    """The precision of rows of contributions: of a last by its own parts, of a total by how it was compared."""
    last, method = F.col("last"), F.col("method")
    parts = last["input"].isNotNull() & last["output"].isNotNull()
    agrees = last["total"].isNull() | (last["total"] == usage_total(normalized(last)))
    of_last = F.when(parts, F.when(agrees, "components-exact").otherwise("partial")).when(last["total"].isNotNull(), "aggregate-only").otherwise("partial")
    return (
        F.when(method == "total-delta", "components-exact")
        .when(method == "total-aggregate-delta", "aggregate-only")
        .when(method.isin("total-initial", "total-reset"), F.when(F.col("snapshot_exact"), "components-exact").otherwise("aggregate-only"))
        .when(method == "last", of_last)
        .otherwise("partial")
    )


def records(rows: DataFrame) -> DataFrame:
    """Usage records of contributions (session, raw_identity, event_index, ts_ms, model, project_key, usage, tokens), with
    how many lack a time left out. Several of one identity get numbers from 0."""
    from ..functions.usage import url_component
    from .counters import slots

    counted = slots(rows.filter("tokens > 0 and ts_ms is not null"), ["session", "raw_identity"], ["event_index"])
    record = F.concat(F.lit("codex:v5:"), url_component(F.coalesce("session", F.lit(""))), F.lit(":"), F.col("raw_identity"), F.lit(":"), F.col("slot").cast("string"))
    unknown = F.lit("unknown")
    names = dict(zip(USAGE, ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens"), strict=True))
    return counted.select(
        record.alias("id"), F.lit("codex").alias("source"), F.col("session").alias("session_id"), "ts_ms", F.coalesce("model", unknown).alias("model"),
        F.coalesce("project_key", unknown).alias("project_key"), *[F.col(f"usage.{f}").alias(n) for f, n in names.items()],
    )
