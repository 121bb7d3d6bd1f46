"""Bringing a store up to date with the logs of the agents: what is unchanged is skipped, what has grown is read on, and nothing that was
read while it changed, or that doesn't add up, is published.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from ..sources import decoders, discovery, incremental, jsonl
from . import flow, matching
from .store import Store

#: Versions of parsers, and what is reported of a source that changed while it was read.
VERSIONS = {"claude": 1, "codex": 5}
REVISIONS = {"claude": 0, "codex": 1}
CHANGED = "CODEX_V5_SOURCE_CHANGED_DURING_SCAN"


@dataclass
class Synced:
    """What a sync did; sums of several add up."""

    files: int = 0
    changed_records: int = 0
    skipped_files: int = 0
    diagnostics: list[str] = field(default_factory=list)

    def __add__(self, other: Synced) -> Synced:
        return Synced(
            self.files + other.files, self.changed_records + other.changed_records, self.skipped_files + other.skipped_files, self.diagnostics + other.diagnostics
        )


def _cursors(store: Store, spark: SparkSession, source: str) -> DataFrame:
    held = store.table("cursors")
    held = spark.createDataFrame([], incremental.CURSOR) if held is None else held
    return held.filter(F.col("source") == source)


def source_needs_scan(listed: DataFrame, cursors: DataFrame, version: int, revision: int) -> bool:
    """From listed (path, size, modified_ms, logical_id): whether any file is new, gone, changed, unread to its end, or was read by another
    version or under another session."""
    known = cursors.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "modified_ms", "logical_id", "offset", "pending", "version", "revision")])
    same = F.lit(True)
    for a, b in (("_size", "size"), ("_modified_ms", "modified_ms"), ("_logical_id", "logical_id"), ("_offset", "size")):
        same = same & F.col(a).eqNullSafe(F.col(b))
    same = same & (F.col("_pending") == 0) & (F.col("_version") == version) & (F.col("_revision") == revision)
    return not listed.join(known, "path", "full").filter(~F.coalesce(same, F.lit(False))).isEmpty()


def sync_claude(spark: SparkSession, store: Store, roots: list[str], ingest_ms: int) -> Synced:
    """Files one by one, all in one publish: each is read on from its cursor."""
    source = "claude"
    listed = stored(incremental.listing(spark, roots))
    cursors = stored(_cursors(store, spark, source))
    new = listed.join(cursors.select("path"), "path", "left_anti")
    heads = discovery.claude_heads(jsonl.files(spark, roots).join(new.select("path"), "path", "left_semi"))
    logical = stored(cursors.select("path", "logical_id").unionByName(heads))
    # a file that is gone and whose session has a new path was moved
    gone = cursors.join(listed.select("path"), "path", "left_anti")
    named = listed.join(logical, "path").select(F.lit(source).alias("source"), "path", "logical_id")
    moved = matching.moved_files(named, gone.select("source", "path", "logical_id")).filter("state = 'moved'").join(listed.select("path", "size"), "path").collect()
    for r in moved:
        store.move_file(r["cursor_path"], r["path"], r["size"])
    if moved:
        cursors = stored(_cursors(store, spark, source))
    planned = stored(incremental.plan(listed, cursors, VERSIONS[source]))
    counted = planned.agg(F.count("*").alias("n"), F.count_if(F.col("start").isNull()).alias("skipped")).first()
    lines = stored(incremental.read_lines(planned))
    state = store.table("claude_state")
    state = spark.createDataFrame([], incremental.STATE) if state is None else state
    for r in moved:
        state = state.withColumn("path", F.when(F.col("path") == r["cursor_path"], r["path"]).otherwise(F.col("path")))
    state = stored(state)
    records, after = incremental.scan_claude(planned, state, ingest_ms, lines)
    read = planned.filter("start is not null").select("path")
    kept = state.join(read, "path", "left_anti").unionByName(after.select(*state.columns))
    advanced = incremental.advanced(planned, lines, source, VERSIONS[source], logical, REVISIONS[source])
    replaced = planned.filter("replaces").select("path")
    changed = store.commit_scans(source, stored(records), stored(advanced), replaced, claude_state=stored(kept))
    told = incremental.diagnostics(lines).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return Synced(counted["n"], changed, counted["skipped"], [f"{r['code']}:{r['n']}" for r in told])


def codex_lines(lines: DataFrame, tail: bool = False) -> DataFrame:
    """Complete lines as codex_flow reads them, with tail unfinished ones too: an event is numbered by the events before it in its file."""
    number = F.row_number().over(Window.partitionBy("path").orderBy("event_index")) - 1
    return incremental.parsed(lines, tail).filter("value is not null").withColumn("event_index", number.cast("long"))


def codex_flow(found: DataFrame, lines: DataFrame, events: DataFrame | None = None) -> flow.Flow:
    """The accounting of all lines of a listing; events may be given where they have been decoded already."""
    events = stored(decoders.codex_events(codex_lines(lines))) if events is None else events
    files = stored(decoders.codex_files(found, events))
    parsed = incremental.parsed(lines)
    broken = parsed.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").isNull()).alias("n_malformed"))
    tail = F.octet_length("line")
    pending = lines.filter(~F.col("ended")).groupBy("path").agg(F.max(tail).alias("n"))
    status = found.select("path").join(broken, "path", "left").join(pending, "path", "left").fillna(0, ["n_lines", "n_malformed", "n"])
    status = status.select("path", "n_lines", "n_malformed", ((F.col("n") > 0) & (F.col("n") <= jsonl.MAX_PENDING)).alias("has_pending"), (F.col("n") > jsonl.MAX_PENDING).alias("pending_overflow"))
    return flow.run(files, events, stored(status))


def sync_codex(spark: SparkSession, store: Store, roots: list[str], list_again=None) -> Synced:
    """The whole source or nothing: it is read as one snapshot, listed again, and published if it hasn't changed and all gates hold.

    list_again gives the second listing; by default the same roots are listed."""
    source = "codex"
    listed = stored(incremental.listing(spark, roots))
    heads = discovery.session_heads(jsonl.files(spark, roots)).select("path", F.col("session_id").alias("logical_id"))
    named = stored(listed.join(heads, "path", "left"))
    n = named.count()
    if not source_needs_scan(named, _cursors(store, spark, source), VERSIONS[source], REVISIONS[source]):
        return Synced(n, 0, n)
    whole = incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), VERSIONS[source])
    lines = stored(incremental.read_lines(whole))
    found = codex_flow(listed, lines)
    told = [f"{r['code']}:{r['n']}" for r in found.codes().orderBy("code").collect()]
    after = list_again() if list_again else incremental.listing(spark, roots)
    if not incremental.same_listing(listed, after):
        return Synced(n, 0, 0, [*told, CHANGED])
    if not found.safe():
        return Synced(n, 0, 0, told or ["CODEX_V5_UNSAFE_UNMAPPED"])
    cursors = named.select(
        F.lit(source).alias("source"), "path", "logical_id", F.col("size").alias("offset"), F.lit(0).cast("long").alias("pending"), "size", "modified_ms",
        F.lit(VERSIONS[source]).alias("version"), F.lit(REVISIONS[source]).alias("revision"),
    )
    changes = store.replace_source(source, found.records, cursors)
    return Synced(n, changes["record_changes"], 0, told)


def sync(spark: SparkSession, store: Store, home: str, ingest_ms: int) -> Synced:
    """Both agents, one after the other."""
    return sync_claude(spark, store, discovery.roots(home, "claude"), ingest_ms) + sync_codex(spark, store, discovery.roots(home, "codex"))
