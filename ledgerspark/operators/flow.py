"""From decoded events of logs to records: sessions, duplicates, forks, payloads and replays one after the other, with counts of each step
and the gates that decide whether the result may be published.

Every step is joins, windows and grouped aggregates over all sessions at once; tables between steps are written to the shared
folder. Events: what decoders.codex_events gives. Files: path, session, parent, fork_ms, archived and the conflicts of
decoders.codex_files; status: what jsonl.status gives.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import dealt, small, stored
from ..functions.usage import url_component
from . import contributions, counters, duplicates, lineage, payloads

NAMES = dict(zip(contributions.USAGE, ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens"), strict=True))
#: Gates, and the counts that each wants to be zero.
GATES = {
    "sourceIntegrity": ["source.parse_errors", "source.files_with_pending_text"],
    "sessionIdentity": ["decode.session_conflicts", "decode.parent_conflicts"],
    "timestampCompleteness": ["projection.missing_timestamps"],
    "tokenCountCompleteness": ["tokens.unresolved"],
    "tokenCountDuplicateSemantics": ["duplicates.conflicts", "duplicates.unresolved_pairs"],
    "forkResolution": [
        "forks.missing-parent", "forks.missing-fork-timestamp", "forks.missing-parent-checkpoint", "forks.missing-child-total-timestamp",
        "forks.incomparable", "forks.cycle", "forks.conflicting-parent", "replays.prefix_mismatches",
    ],
    "logicalSessionReconciliation": ["reconcile.conflicts", "reconcile.orphans"],
    "tokenCountDuplicateEvent": ["invariants.token_events"],
    "payloadEvent": ["invariants.payload_events"],
    "payloadToken": ["invariants.payload_tokens"],
    "forkContribution": ["invariants.fork_contributions"],
    "forkToken": ["invariants.fork_tokens"],
    "projectionContribution": ["invariants.projected_contributions"],
    "projectionToken": ["invariants.projected_tokens"],
    "uniqueRecordIds": ["projection.duplicate_ids"],
}
#: Codes of what is reported of an unsafe scan, by the count that they tell.
CODES = {
    "source.parse_errors": "CODEX_V5_PARSE_ERRORS",
    "source.files_with_pending_text": "CODEX_V5_PENDING_FILES",
    "reconcile.conflicts": "CODEX_V5_LOGICAL_CONFLICTS",
    "reconcile.orphans": "CODEX_V5_ORPHAN_FILES",
    "tokens.unresolved": "CODEX_V5_UNRESOLVED_TOKEN_COUNTS",
    "decode.session_conflicts": "CODEX_V5_SESSION_IDENTITY_CONFLICTS",
    "decode.parent_conflicts": "CODEX_V5_PARENT_IDENTITY_CONFLICTS",
    "duplicates.unresolved_pairs": "CODEX_V5_UNRESOLVED_SEMANTIC_DUPLICATES",
    "duplicates.conflicts": "CODEX_V5_DUPLICATE_CONFLICTS",
    "forks.missing-parent": "CODEX_V5_FORK_MISSING_PARENT",
    "forks.missing-fork-timestamp": "CODEX_V5_FORK_MISSING_TIMESTAMP",
    "forks.missing-parent-checkpoint": "CODEX_V5_FORK_MISSING_PARENT_CHECKPOINT",
    "forks.missing-child-total-timestamp": "CODEX_V5_FORK_MISSING_CHILD_TOTAL_TIMESTAMP",
    "forks.incomparable": "CODEX_V5_FORK_INCOMPARABLE",
    "forks.cycle": "CODEX_V5_FORK_CYCLE",
    "forks.conflicting-parent": "CODEX_V5_FORK_CONFLICTING_PARENT",
    "replays.prefix_mismatches": "CODEX_V5_FORK_REPLAY_PREFIX_MISMATCH",
    "projection.missing_timestamps": "CODEX_V5_MISSING_TIMESTAMPS",
}


@dataclass
class Flow:
    records: DataFrame
    sessions: DataFrame  # session, path, parent, fork_ms, fork_status, replay_prefix, tokens, final_tokens
    evidence: DataFrame
    suppressed: DataFrame
    payloads: DataFrame
    canonical: DataFrame
    counts: list[DataFrame]  # name (step and count), n: of each step
    steps: dict[str, DataFrame]  # own (events of kept files), tokens, counted, canonical (before replays), replays, statuses
    n_events: int

    @cached_property
    def diagnostics(self) -> DataFrame:
        """name (step and count), n: counted once it is asked for."""
        counts = self.counts[0]
        for one in self.counts[1:]:
            counts = counts.unionByName(one)
        with dealt(counts.sparkSession, self.n_events):
            counts = stored(counts)
            return stored(counts.unionByName(invariants(counts)))

    @cached_property
    def gates(self) -> DataFrame:
        """gate, n_broken, holds."""
        return gates(self.diagnostics)

    def safe(self) -> bool:
        return self.gates.agg(F.bool_and("holds")).first()[0] is not False

    def codes(self) -> DataFrame:
        """code and n of all counts that are reported and not zero."""
        told = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
        return self.diagnostics.filter("n > 0").select(told[F.col("name")].alias("code"), "n").filter("code is not null")


def tally(rows: DataFrame, step: str, named: dict[str, Column]) -> DataFrame:
    """(name, n): named counts over rows in one pass."""
    one = rows.agg(*[c.cast("long").alias(n) for n, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(f"{step}.{n}").alias("name"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n")) for n in named])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def _n(condition: Column | str) -> Column:
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.count_if(F.coalesce(condition, F.lit(False)))


def fork_statuses(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """From sessions (session, parent, fork_ms) and their events: session, status, and for forks the parent's last total strictly before
    the fork: checkpoint (counters) and checkpoint_aggregate.

    Sessions with several parents conflict, those on cycles of parents aren't forks of anything; a fork whose own events begin before it
    is a replay; where its first total can't be set against the checkpoint it starts anew or is incomparable."""
    graph = lineage.fork_graph(sessions)
    children = graph.filter("parent is not null")
    totals = events.filter("total is not null and ts_ms is not null").withColumn("_aggregate", contributions.aggregate_total(F.col("total"))).filter("_aggregate is not null")
    totals = totals.select(F.col("session").alias("parent"), F.struct("ts_ms", "event_index", "raw_identity").alias("_at"), F.struct("total", "_aggregate").alias("_c"))
    met = children.filter("state = 'fork'").select("session", "parent", "fork_ms").join(totals, "parent").filter("_at.ts_ms < fork_ms")
    best = met.groupBy("session").agg(F.max_by("_c", "_at").alias("c"))
    usage = F.col("total").isNotNull() | F.col("last").isNotNull() | F.col("payload_usage").isNotNull()
    early = events.filter(usage).join(children.select("session", "fork_ms"), "session").filter("ts_ms < fork_ms").select("session").distinct()
    own = events.filter("total is not null").groupBy("session").agg(F.min_by(F.struct("total", "ts_ms"), F.struct("event_index", "raw_identity")).alias("own"))
    rows = graph.join(best, "session", "left").join(own, "session", "left").join(early.withColumn("_early", F.lit(True)), "session", "left")
    rows = rows.withColumns({"_first": F.col("own.total"), "_checkpoint": F.col("c.total"), "_aggregate": F.col("c._aggregate")})
    rows = contributions.compared(rows, "_first", "_checkpoint", F.col("_aggregate"))
    status = (
        F.when(F.col("state") != "fork", F.col("state"))
        .when(F.col("fork_ms").isNull(), "missing-fork-timestamp")
        .when(F.col("_early").isNotNull(), "explicit-replay")
        .when(F.col("c").isNull(), "missing-parent-checkpoint")
        .when(F.col("own").isNull(), "not-needed")
        .when(F.col("own.ts_ms").isNull(), "missing-child-total-timestamp")
        .when(F.col("relation") == "reset", "child-counter-reset")
        .when(F.col("relation") == "incomparable", "incomparable")
        .otherwise("resolved")
    )
    return rows.select("session", status.alias("status"), F.col("_checkpoint").alias("checkpoint"), F.col("_aggregate").alias("checkpoint_aggregate"))


def accounted(tokens: DataFrame, statuses: DataFrame) -> DataFrame:
    """Contributions of token counts that survive, forks seeded with their parents' checkpoints, with their precision."""
    seeds = statuses.filter("status = 'resolved'").select("session", F.col("checkpoint").alias("_seed"), F.col("checkpoint_aggregate").alias("_seed_aggregate"))
    rows = tokens.join(seeds, "session", "left")
    found = contributions.contributions(rows, ["session"], ["event_index", "raw_identity"], (F.col("_seed"), F.col("_seed_aggregate")))
    return found.withColumn("precision", contributions.contributed_precision()).drop("_seed", "_seed_aggregate")


_EVENT = ["session", "path", "event_index", "raw_identity", "ts_ms", "response_id", "turn_id", "model", "project_key"]


def canonical_contributions(tokens: DataFrame, resolved: DataFrame) -> DataFrame:
    """Token counts that count, and payloads that count in their place, in one table; place numbers those of a session in the order of replays."""
    both = tokens.filter("tokens > 0").select(*_EVENT, "usage", "tokens", "precision", F.lit(0).alias("kind"))
    fallbacks = resolved.filter("disposition like 'fallback%'").select(*_EVENT, "usage", "tokens", "precision", F.lit(1).alias("kind"))
    order = Window.partitionBy("session").orderBy(F.asc_nulls_last("ts_ms"), "path", "event_index", "raw_identity", "kind")
    return both.unionByName(fallbacks).withColumn("place", F.row_number().over(order).cast("long"))


def project(kept: DataFrame) -> DataFrame:
    """Records of contributions that have a time; several of one event get numbers from 0."""
    timed = counters.slots(kept.filter("ts_ms is not null"), ["session", "raw_identity"], ["event_index", "kind"])
    record = F.concat(F.lit("codex:v5:"), url_component(F.col("session")), F.lit(":"), F.col("raw_identity"), F.lit(":"), F.col("slot").cast("string"))
    return timed.select(
        record.alias("id"), F.lit("codex").alias("source"), F.col("path").alias("source_path"), F.col("session").alias("session_id"), "ts_ms",
        F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("project_key", F.lit("unknown")).alias("project_key"),
        *[F.col(f"usage.{f}").alias(n) for f, n in NAMES.items()],
    )


def run(files: DataFrame, events: DataFrame, status: DataFrame | None = None) -> Flow:
    """All steps over the events of files."""
    n_events = events.count()
    with dealt(events.sparkSession, n_events):
        return _run(files, events, status, n_events)


def _run(files: DataFrame, events: DataFrame, status: DataFrame | None, n_events: int) -> Flow:
    verdict = stored(lineage.reconcile(files, events.select("path", "event_index", F.col("raw_identity").alias("identity"))))
    kept_files = verdict.filter("status = 'kept'").select("path", "session")
    sessions = stored(files.drop("session").join(kept_files, "path").select("session", "path", "parent", "fork_ms"))
    own = stored(events.drop("session", "parent", "fork_ms").join(small(kept_files), "path"))

    statuses = stored(fork_statuses(sessions.select("session", "parent", "fork_ms"), own))
    observed = own.filter("is_token_count and (last is not null or total is not null)")
    tokens = stored(duplicates.raw_unique(observed.select(*_EVENT, "raw_fingerprint", "semantic_fingerprint", "last", "total")))
    evidence = stored(duplicates.evidence(tokens))
    suppressed, told = duplicates.resolved(evidence)
    told = stored(told)
    counted = stored(accounted(duplicates.survivors(tokens, suppressed), statuses))

    name = F.concat_ws("\n", "path", F.col("event_index").cast("string"), "raw_identity")
    given = payloads.payload_candidates(own.drop("last", "total"))
    first = F.row_number().over(Window.partitionBy("session", "raw_identity").orderBy(F.asc_nulls_last("ts_ms"), "path", "event_index"))
    given = stored(given.withColumn("_n", first).withColumn("id", name))
    resolved = stored(payloads.payload_resolution(given.filter("_n = 1").drop("_n"), counted.filter("tokens > 0").withColumn("id", name)))

    canonical = stored(canonical_contributions(counted, resolved))
    forks = lineage.fork_graph(sessions.select("session", "parent", "fork_ms")).filter("state = 'fork' and fork_ms is not null")
    replayed = lineage.replayed_contributions(forks.select("session", "parent", "fork_ms"), canonical.drop("event_index").withColumnRenamed("place", "event_index"))
    replayed = stored(replayed.select("session", F.col("event_index").alias("place"), "suppressed"))
    kept = stored(canonical.join(replayed.filter("suppressed").select("session", "place"), ["session", "place"], "left_anti"))
    records = stored(project(kept))

    before = canonical.groupBy("session").agg(F.sum("tokens").alias("tokens"))
    after = kept.groupBy("session").agg(F.sum("tokens").alias("final_tokens"))
    prefix = replayed.groupBy("session").agg(F.count_if("suppressed").alias("replay_prefix"))
    of_session = sessions.join(statuses.select("session", F.col("status").alias("fork_status")), "session", "left").join(before, "session", "left").join(after, "session", "left").join(prefix, "session", "left")
    of_session = stored(of_session.fillna(0, ["tokens", "final_tokens", "replay_prefix"]))

    model, project_key, late = F.col("model"), F.col("project_key"), F.col("ts_ms").isNull()
    own_tokens = F.col("tokens")

    def tokens_of(condition: Column) -> Column:
        return F.sum(F.when(condition, own_tokens))

    found = [
        tally(events, "decode", {
            "token_count_events": _n("is_token_count"), "payload_usage_events": F.count("payload_usage"), "legacy_flat_usage_events": _n("legacy_flat"),
            "nested_usage_on_other_events": _n("nested_usage"), "missing_timestamp_events": _n("ts_ms is null"), "session_meta_events": _n("is_meta"),
        }),
        tally(files, "decode", {"session_conflicts": F.sum("session_conflicts"), "parent_conflicts": F.sum("parent_conflicts")}),
        tally(verdict, "reconcile", {
            "files": F.count("*"), "sessions": _n("status = 'kept'"), "exact_duplicates": _n("status = 'exact-duplicate'"), "prefix_shadowed": _n("status = 'prefix-shadowed'"),
            "conflicts": F.count_distinct(F.when(F.col("status").isin("metadata-conflict", "divergent-events"), F.col("session"))), "orphans": _n("status = 'orphan'"),
        }),
        tally(told, "duplicates", {
            "pairs": F.count("*"), **{c: _n(F.col("confidence") == c) for c in duplicates.CONFIDENCES},
            **{f"transition_{x}": _n(F.col("transition") == x) for x in duplicates.TRANSITIONS},
            "resolved_pairs": _n("state = 'resolved'"), "unresolved_pairs": _n("confidence <> 'confirmed' and state <> 'resolved'"),
            "conflicts": _n("confidence = 'conflict'") + _n("by_raw and not exact") + duplicates.n_group_conflicts(told),
        }),
        tally(suppressed, "duplicates", {
            "exact_events": _n("kind = 'exact-raw-content'"), "semantic_events": _n("kind = 'semantic-snapshot'"), "suppressed_events": F.count("*"), "suppressed_tokens": F.sum("tokens"),
        }),
        tally(observed, "tokens", {"observed": F.count("*")}),
        tally(tokens, "tokens", {"unique": F.count("*")}),
        tally(counted, "tokens", {
            "canonical": F.count("*"), "canonical_tokens": F.sum("tokens"), "counter_resets": _n("relation = 'reset'"), "incomparable": _n("relation = 'incomparable'"),
            "repeated_total_with_last": _n("method = 'last' and relation = 'same' and tokens > 0"),
            **{m: _n(F.col("method") == m) for m in ("last", "total-initial", "total-delta", "total-aggregate-delta", "total-reset", "duplicate-zero", "unresolved")},
        }),
        tally(given, "payloads", {"observed": F.count("*"), "observed_tokens": F.sum("tokens"), "exact_raw_duplicates": _n("_n > 1")}),
        tally(resolved, "payloads", payloads.counts()),
        tally(statuses, "forks", {s: _n(F.col("status") == s) for s in lineage.FORK_STATUSES}),
        tally(replayed, "replays", {"suppressed": _n("suppressed"), "prefix_mismatches": F.count_distinct(F.when(~F.col("suppressed"), F.col("session")))}),
        tally(canonical, "canonical", {"contributions": F.count("*"), "tokens": F.sum("tokens")}),
        tally(canonical.join(replayed.filter("suppressed"), ["session", "place"]), "replays", {"suppressed_tokens": F.sum("tokens")}),
        tally(kept, "projection", {
            "kept": F.count("*"), "kept_tokens": F.sum("tokens"), "missing_timestamps": _n(late), "missing_timestamp_tokens": tokens_of(late),
            "unknown_models": _n(~late & model.isNull()), "unknown_model_tokens": tokens_of(~late & model.isNull()),
            "unknown_projects": _n(~late & project_key.isNull()), "unknown_project_tokens": tokens_of(~late & project_key.isNull()),
            "emitted_tokens": tokens_of(~late),
        }),
        tally(records, "projection", {"emitted": F.count("*"), "duplicate_ids": F.count("*") - F.count_distinct("id")}),
    ]
    if status is not None:
        found.append(tally(status, "source", {
            "files": F.count("*"), "files_with_errors": _n("n_malformed > 0"), "parse_errors": F.sum("n_malformed"), "files_with_pending_text": _n("has_pending or pending_overflow"),
        }))
    steps = {"own": own, "tokens": tokens, "counted": counted, "canonical": canonical, "replays": replayed, "statuses": statuses}
    return Flow(records, of_session, told, suppressed, resolved, kept, found, steps, n_events)


#: What must be equal: a count and those that it is the sum of.
SUMS = {
    "token_events": ("tokens.observed", ["tokens.canonical", "duplicates.suppressed_events"], ["tokens.observed", "tokens.unique"]),
    "payload_events": ("payloads.candidates", ["payloads.suppressed", "payloads.fallbacks", "payloads.zeros"], None),
    "payload_tokens": ("payloads.candidate_tokens", ["payloads.suppressed_tokens", "payloads.fallback_tokens"], None),
    "fork_contributions": ("canonical.contributions", ["projection.kept", "replays.suppressed"], None),
    "fork_tokens": ("canonical.tokens", ["projection.kept_tokens", "replays.suppressed_tokens"], None),
    "projected_contributions": ("projection.kept", ["projection.emitted", "projection.missing_timestamps"], None),
    "projected_tokens": ("projection.kept_tokens", ["projection.emitted_tokens", "projection.missing_timestamp_tokens"], None),
}


def invariants(counts: DataFrame) -> DataFrame:
    """(name, n): how far each sum is off."""

    def named(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0))

    off = {}
    for name, (whole, parts, repeats) in SUMS.items():
        gap = named(whole)
        for part in parts:
            gap = gap - named(part)
        off[name] = F.abs(gap - (named(repeats[0]) - named(repeats[1])) if repeats else gap)
    return tally(counts, "invariants", off)


def gates(diagnostics: DataFrame) -> DataFrame:
    """gate, n_broken, holds."""
    wanted = [(gate, name) for gate, names in GATES.items() for name in names]
    asked = diagnostics.sparkSession.createDataFrame(wanted, "gate string, name string")
    joined = F.broadcast(asked).join(diagnostics, "name", "left")
    return joined.groupBy("gate").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_broken")).withColumn("holds", F.col("n_broken") == 0)
