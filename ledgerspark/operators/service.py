"""An audit of a store: what its logs give now, by both accountings, beside the records that it holds.

The logs are listed before and after, and so is the store, so that a difference is told only where neither moved meanwhile. Records
meet by id in one full join, from which all figures are taken; sets of records are compared by sums of hashes, which need no order and no list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import dealt, stored
from ..functions.usage import COUNTERS
from ..sources import decoders, incremental
from . import audits, comparator, flow, older, sync
from .store import Store

#: Columns that make two records of one id equal.
CONTENT = ("session_id", "model", "project_key", *COUNTERS)
ATTEMPTS = 2


def _joined(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both sides of each id, a and b, and its status. Ids are unique in either."""
    a, b = (x.select("id", F.struct("id", *CONTENT).alias(n)) for x, n in ((expected, "a"), (actual, "b")))
    status = F.when(F.col("b").isNull(), "expected-only").when(F.col("a").isNull(), "actual-only").when(F.col("a") != F.col("b"), "content-mismatch").otherwise("matched")
    # structs with absent fields are told apart by <=> alone
    return a.join(b, "id", "full").withColumn("status", F.when(F.col("a").eqNullSafe(F.col("b")), "matched").otherwise(status))


def _off(name: str) -> Column:
    return (F.coalesce(F.col(f"a.{name}"), F.lit(0)) - F.coalesce(F.col(f"b.{name}"), F.lit(0))).cast("long")


def record_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id, status (expected-only, actual-only, content-mismatch) and by how much each counter is off, of records that aren't equal."""
    return _joined(expected, actual).filter("status <> 'matched'").select("id", "status", *[_off(t).alias(t) for t in COUNTERS])


def _summary(side: str, name: str) -> dict[str, Column]:
    """How many records and sessions a side has, its counters, and fingerprints of its ids and contents."""

    def fingerprint(*columns: str) -> Column:
        # as JSON, so that neither an absent field nor a separator in one makes two records alike
        held = F.to_json(F.struct(*[F.col(f"{side}.{c}") for c in columns]), {"ignoreNullFields": "false"})
        halves = [F.sum(F.when(F.col(side).isNotNull(), F.xxhash64(F.lit(seed), held).cast("decimal(38,0)"))).cast("string") for seed in (1, 2)]
        return F.concat_ws(":", F.count(side).cast("string"), *halves)

    return {
        f"{name}_records": F.count(side), f"{name}_sessions": F.count_distinct(f"{side}.session_id"), **{f"{name}_{t}": F.coalesce(F.sum(f"{side}.{t}"), F.lit(0)).cast("long") for t in COUNTERS},
        f"{name}_identity": fingerprint("id", "session_id"), f"{name}_content": fingerprint("id", *CONTENT),
    }


def reconciled(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: counts of both, differences by counter and in all, the ids that one side lacks or that differ, and what matches.

    Sets of ids or contents match where their counts and two sums of 64-bit hashes are equal."""
    kinds = {"expected_only": "expected-only", "actual_only": "actual-only", "content_mismatch": "content-mismatch"}
    wanted = {**_summary("a", "expected"), **_summary("b", "actual"), **{n: F.count_if(F.col("status") == s) for n, s in kinds.items()}}
    one = _joined(expected, actual).agg(*[c.alias(n) for n, c in wanted.items()])
    gaps = {t: F.col(f"expected_{t}") - F.col(f"actual_{t}") for t in COUNTERS}
    total, held, components = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True)
    for t, gap in gaps.items():
        total, held, components = total + gap, held + F.col(f"actual_{t}"), components & (gap == 0)
    one = one.withColumns({
        **{f"difference_{t}": gap for t, gap in gaps.items()}, "difference_tokens": total, "difference_percent": F.when(held != 0, total * 100.0 / held).otherwise(0.0),
        "tokens_matched": total == 0, "components_matched": components,
        **{f"{n}_matched": F.col(f"expected_{n}") == F.col(f"actual_{n}") for n in ("records", "sessions", "identity", "content")},
    })
    every = F.lit(True)
    for name in ("tokens", "components", "records", "sessions", "identity", "content"):
        every = every & F.col(f"{name}_matched")
    return one.withColumn("matched", every)


@dataclass
class Comparison:
    flow: flow.Flow
    records: DataFrame  # of the older accounting
    entries: DataFrame
    mapping: DataFrame
    gates: DataFrame

    def ready(self) -> bool:
        """Whether the present accounting may take the place of the older one."""
        return audits.safe(self.gates)


def codex_comparison(found: DataFrame, lines: DataFrame) -> Comparison:
    """Both accountings over all lines of a listing."""
    good = stored(sync.codex_lines(lines))
    events = stored(decoders.codex_events(good))
    whole = sync.codex_flow(found, lines, events)
    old = stored(decoders.older_events(good))
    with dealt(lines.sparkSession, whole.n_events):
        carried = stored(older.carried_events(old))
        records = stored(older.records(older.contributions(old, carried)))
        entries, mapping = comparator.compared(whole, records, comparator.candidates(events, carried))
        return Comparison(whole, records, entries, mapping, stored(comparator.gates(whole, entries, mapping, records)))


@dataclass
class Audit:
    comparison: Comparison
    reconciliation: DataFrame
    source_stable: bool
    store_stable: bool
    taxonomy: DataFrame

    def matched(self) -> bool:
        return self.source_stable and self.store_stable and bool(self.reconciliation.first()["matched"])

    def ready(self) -> bool:
        return self.source_stable and self.comparison.ready()


def audit_codex(spark: SparkSession, store: Store, roots: list[str], sync_first=None, list_again=None) -> Audit:
    """The audit of one source. sync_first, where given, brings the store up to date; it runs again, at most ATTEMPTS times in all, if the logs
    changed while it ran. list_again gives the last listing; by default the same roots are listed."""
    listed = stored(incremental.listing(spark, roots))
    for _ in range(ATTEMPTS if sync_first else 0):
        before = listed
        sync_first()
        listed = stored(incremental.listing(spark, roots))
        if incremental.same_listing(before, listed):
            break
    folder = store.versions().get("records")
    lines = stored(incremental.read_lines(incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), sync.VERSIONS["codex"])))
    found = codex_comparison(listed, lines)
    after = list_again() if list_again else incremental.listing(spark, roots)
    held = store.table("records")
    held = found.flow.records.limit(0) if held is None else held.filter("source = 'codex'")
    typed = sync.codex_lines(lines).select(*[decoders.text_at(p).alias(n) for n, p in (("outer_type", "$.type"), ("payload_type", "$.payload.type"), ("message_type", "$.payload.msg.type"))])
    # a version's tables are never written again, so the same folder is the same rows
    return Audit(found, stored(reconciled(found.flow.records, held)), incremental.same_listing(listed, after), folder == store.versions().get("records"), stored(audits.taxonomy(typed)))
