"""The older accounting set beside the present one, event by event: which event an older record belongs to, and why their tokens differ.

An older id is a text that several events may share, so a record has candidates. They are narrowed by session, time and source in
turn, each only where it leaves some. That is the same as keeping those whose (session, time, source) fit is the greatest, so it takes
grouped aggregates alone: no candidates of one id are gathered, however many there are.

Records: what older.records gives. Candidates: id, session, raw_identity, path, event_index, ts_ms, source_kind, semantic_type, raw_fingerprint,
semantic_fingerprint. An event is named by session and raw_identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import small, stored
from . import contributions, flow, older
from .contributions import USAGE

KEY = ["session", "raw_identity"]
#: How a record was mapped, the signals, and the reasons where none or several are given.
KINDS = (
    "unique", "resolved-metadata", "equivalent-collision", "equivalent-usage-collision", "resolved-usage", "resolved-semantic-suppression", "ambiguous", "unmapped",
)
#: Of these kinds the candidates that weren't chosen are told apart from events that the older accounting never saw.
COLLIDING = ("equivalent-collision", "equivalent-usage-collision", "resolved-usage", "resolved-semantic-suppression")
SIGNALS = (
    "fork-baseline", "fork-replay", "token-reset", "token-aggregate", "payload-suppression", "payload-fallback", "taxonomy-non-token-usage",
    "v4-candidate-collision", "token-duplicate-representative", "v4-missing-model",
)


def _summed(usage: str) -> Column:
    return F.struct(*[F.sum(F.col(f"{usage}.{f}")).alias(f) for f in USAGE])


def _one(name: str) -> Column:
    """Whether all rows of a group have one value, absent ones being equal."""
    return F.min(name).eqNullSafe(F.max(name)) & F.count(name).isin(0, F.count("*"))


def candidates(events: DataFrame | None, older_rows: DataFrame) -> DataFrame:
    """Candidates: events as decoders.codex_events gives them, with the ids that older.carried_events lead to. Without events the older rows have
    their columns themselves, their session as own_session."""
    if events is None:
        return older_rows.select(older.record_id().alias("id"), F.col("own_session").alias("session"), "raw_identity", "path", "event_index", "ts_ms", "source_kind", "semantic_type", "raw_fingerprint", "semantic_fingerprint")
    ids = older_rows.select("path", "event_index", older.record_id().alias("id"), "source_kind")
    named = events.select("path", "event_index", *KEY, "ts_ms", "semantic_type", "raw_fingerprint", "semantic_fingerprint")
    return ids.join(named, ["path", "event_index"])


def mapped(records: DataFrame, found: DataFrame, kept: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapping (id, kind, n_candidates, n_usage_matches, session, raw_identity; the last two are null where none is chosen), a row a record;
    and collisions: (session, raw_identity, id, kind, chosen) of candidates that weren't chosen.

    kept: session, raw_identity and the usage that the present accounting keeps of an event; gone: the same of duplicates left out. n_candidates
    counts what an id has for the first two kinds, else what narrowing left."""
    mapping, collisions = _mapped(records, found, kept, gone)
    return mapping.drop("r"), collisions


def _mapped(records: DataFrame, found: DataFrame, kept: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As mapped, the mapping with the record itself, r."""
    rest = ["path", "event_index", "ts_ms", "source_kind", "semantic_type", "raw_fingerprint", "semantic_fingerprint"]
    # dealt by id, which serves the grouping and the join with records
    single = found.repartition("id").groupBy("id", *KEY).agg(F.min_by(F.struct(*rest), F.struct("path", "event_index")).alias("e")).select("id", *KEY, "e.*")
    record = records.select("id", F.struct("session_id", "ts_ms", "source_kind", "usage").alias("r"))
    rows = single.join(record, "id")
    rows = rows.join(kept.select(*KEY, F.col("usage").alias("kept_usage")), KEY, "left").join(gone.select(*KEY, F.col("usage").alias("gone_usage")), KEY, "left")
    fits = {"session": F.col("session") == F.col("r.session_id"), "ts_ms": F.col("ts_ms") == F.col("r.ts_ms"), "source_kind": F.col("source_kind") == F.col("r.source_kind")}
    rows = rows.withColumn("fit", F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in fits.items()]))
    rows = rows.withColumns({
        "matches": F.coalesce(F.col("kept_usage") == F.col("r.usage"), F.lit(False)), "gone_matches": F.coalesce(F.col("gone_usage") == F.col("r.usage"), F.lit(False)),
        "e": F.struct("event_index", "raw_identity", "session"),
    })
    rows = stored(rows.select("id", *KEY, "fit", "e", "matches", "gone_matches", "kept_usage", "ts_ms", "source_kind", "semantic_type", "raw_fingerprint", "semantic_fingerprint"))
    alike = _one("session") & _one("ts_ms") & _one("source_kind") & _one("semantic_type")
    groups = rows.groupBy("id", "fit").agg(
        F.count("*").alias("n"), F.count_if("matches").alias("n_match"), F.count_if("gone_matches").alias("n_gone"),
        (alike & _one("raw_fingerprint") & _one("kept_usage") & (F.count("kept_usage") == F.count("*"))).alias("same_event"), (alike & _one("semantic_fingerprint")).alias("same_meaning"),
        F.min("e").alias("first"), F.min(F.when(F.col("matches"), F.col("e"))).alias("match"), F.min(F.when(F.col("gone_matches"), F.col("e"))).alias("gone"),
    )
    best = groups.groupBy("id").agg(F.sum("n").alias("n_all"), F.max_by(F.struct(*groups.columns[1:]), "fit").alias("b"))
    n, n_match = F.col("b.n"), F.col("b.n_match")
    kind = (
        F.when(n.isNull(), "unmapped")
        .when((n == 1) & (F.col("n_all") == 1), "unique")
        .when(n == 1, "resolved-metadata")
        .when(F.col("b.same_event"), "equivalent-collision")
        .when((n_match == n) & F.col("b.same_meaning"), "equivalent-usage-collision")
        .when(n_match == 1, "resolved-usage")
        .when(F.col("b.n_gone") == 1, "resolved-semantic-suppression")
        .otherwise("ambiguous")
    )
    told = record.join(best, "id", "left").withColumn("kind", kind)
    chosen = F.when(F.col("kind") == "resolved-usage", F.col("b.match")).when(F.col("kind") == "resolved-semantic-suppression", F.col("b.gone")).when(~F.col("kind").isin("ambiguous", "unmapped"), F.col("b.first"))
    told = stored(told.select(
        "id", "kind", F.coalesce(F.when(n == 1, F.col("n_all")).otherwise(n), F.lit(0)).alias("n_candidates"), F.coalesce(n_match, F.lit(0)).alias("n_usage_matches"),
        F.col("b.fit").alias("fit"), chosen.alias("chosen"), "r",
    ))
    others = rows.join(told.filter(F.col("kind").isin(*COLLIDING)).select("id", "fit", "kind", "chosen"), ["id", "fit"])
    others = others.filter((F.col("raw_identity") != F.col("chosen.raw_identity")) | (F.col("session") != F.col("chosen.session")))
    others = others.groupBy(*KEY).agg(F.max_by(F.struct("id", "kind", F.col("chosen.raw_identity").alias("chosen")), "id").alias("c"))
    mapping = told.select("id", "kind", "n_candidates", "n_usage_matches", "chosen.session", "chosen.raw_identity", "r")
    return mapping, others.select(*KEY, "c.*")


def _moved_by_baseline(found: flow.Flow) -> DataFrame:
    """Events that are the first total of a fork and would count otherwise without its parent's."""
    first = F.min_by(F.struct("raw_identity", "event_index", "last", "total"), F.struct("event_index", "raw_identity"))
    rows = found.steps["own"].filter("total is not null").groupBy("session").agg(first.alias("e")).select("session", "e.*")
    seeds = found.steps["statuses"].filter("status = 'resolved'").select("session", "checkpoint", "checkpoint_aggregate")
    rows = rows.join(seeds, "session")
    seeded = contributions.contributions(rows, ["session"], ["event_index"], (F.col("checkpoint"), F.col("checkpoint_aggregate"))).select(*KEY, F.col("usage").alias("seeded"))
    alone = contributions.contributions(rows, ["session"], ["event_index"]).select(*KEY, F.col("usage").alias("alone"))
    return seeded.join(alone, KEY).filter("seeded <> alone").select(*KEY)


def _bare_last(last: str) -> Column:
    """A last that tells its total alone."""
    parts = F.lit(True)
    for f in USAGE:
        parts = parts & (F.coalesce(F.col(f"{last}.{f}"), F.lit(0)) == 0)
    return F.coalesce((F.col(f"{last}.total") > 0) & parts, F.lit(False))


def compared(found: flow.Flow, records: DataFrame, of_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries and mapping. A row of entries is an event that either accounting knows, or a record that no event was found for: session, raw_identity,
    record_ids, source_kind, kind (of mapping), older_usage, usage, older_tokens, tokens, delta, signals, reason, explained.

    Records are of the older accounting, of_records their candidates. An entry differs where any of the five counters does; the reason is
    its one signal, mixed for several, and without any says which side has it."""
    tokens, counted, before = (found.steps[s] for s in ("tokens", "counted", "canonical"))
    kept = stored(found.canonical.groupBy(*KEY).agg(
        _summed("usage").alias("usage"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_kept"), F.bool_or(F.col("kind") == 0).alias("of_count"), F.bool_or(F.col("kind") == 1).alias("of_payload"),
        F.bool_or(F.col("model").isNull()).alias("no_model"),
    ))
    lost = found.suppressed.select("session", "name.*", F.col("representative.raw_identity").alias("stays"))
    raw = tokens.select("session", "event_index", "path", "raw_identity", contributions.normalized(F.coalesce("last", "total")).alias("usage"))
    gone = stored(small(lost).join(raw, ["session", "event_index", "path", "raw_identity"]).dropDuplicates(KEY).select(*KEY, "usage", "stays"))
    mapping, collisions = _mapped(records, of_records, kept, gone)
    mine = mapping.select("id", "kind", "session", "raw_identity", "r.session_id", "r.source_kind", F.col("r.usage").alias("u"))
    mapping = mapping.drop("r")
    alone = F.when(F.col("raw_identity").isNull(), F.col("id"))
    old = mine.groupBy(F.coalesce("session", "session_id", F.lit("unknown")).alias("session"), "raw_identity", alone.alias("_alone")).agg(
        F.array_sort(F.collect_set("id")).alias("record_ids"), F.count("*").alias("n_records"), F.min("source_kind").alias("source_kind"), F.max("kind").alias("kind"), _summed("u").alias("older_usage"))
    # all that the present accounting knows of events, a row an event
    methods = counted.select(*KEY, "method", _bare_last("last").alias("bare"))
    replays = before.join(found.steps["replays"].filter("suppressed").select("session", "place"), ["session", "place"]).select(*KEY).distinct()
    payloads = found.payloads.filter("disposition = 'suppress-confirmed'").select(*KEY).distinct()
    flags = {"replayed": replays, "unpaid": payloads, "based": _moved_by_baseline(found)}
    flags |= {"left_out": gone, "paid": found.payloads.filter("disposition like 'fallback%'")}
    sides = methods.withColumn("known", F.lit(True))
    more = [kept.select(*KEY, F.struct(*[c for c in kept.columns if c not in KEY]).alias("k"), F.lit(True).alias("known"))]
    # what only a fork's baseline names is no event of the accounting
    more += [rows.select(*KEY, F.lit(name).alias("flag"), F.lit(name != "based").alias("known")) for name, rows in flags.items()]
    for one in more:
        sides = sides.unionByName(one, allowMissingColumns=True)
    # one grouping, and so one shuffle, where a join for each would be two
    new = sides.groupBy(*KEY).agg(
        F.max("method").alias("method"), F.bool_or("bare").alias("bare"), F.first("k", ignorenulls=True).alias("k"), *[F.bool_or(F.col("flag") == n).alias(n) for n in flags], F.bool_or("known").alias("known")
    )
    new = new.filter("known").select(*KEY, "method", "bare", *flags, "k.*")
    other = collisions.withColumnRenamed("kind", "collision").select(*KEY, "collision", "chosen")
    by_chosen = gone.select("session", F.col("raw_identity").alias("chosen"), F.lit(True).alias("chosen_gone"))
    other = stored(other.join(small(by_chosen), ["session", "chosen"], "left"))
    new = new.join(small(other), KEY, "left")

    rows = old.join(new, KEY, "full")
    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in USAGE])
    rows = rows.withColumns({"older_usage": F.coalesce("older_usage", zero), "usage": F.coalesce("usage", zero), "n_records": F.coalesce("n_records", F.lit(0)), "n_kept": F.coalesce("n_kept", F.lit(0))})
    seen, holds = F.col("n_records") > 0, F.col("n_kept") > 0
    stands_for = F.coalesce((F.col("collision") == "resolved-semantic-suppression") & F.col("chosen_gone"), F.lit(False))
    unseen = F.col("collision").isNotNull() & ~seen & holds
    counts = F.col("of_count") & ~stands_for
    told = {
        "v4-candidate-collision": unseen & ~stands_for,
        "token-duplicate-representative": (unseen & stands_for) | (F.col("left_out") & seen & ~holds),
        "fork-replay": F.col("replayed"),
        "fork-baseline": F.col("based"),
        "payload-suppression": F.col("unpaid"),
        "payload-fallback": F.col("of_payload"),
        "taxonomy-non-token-usage": (F.col("source_kind") == "nested-info-non-token-count") & seen & ~holds,
        "v4-missing-model": F.col("collision").isNull() & ~seen & holds & F.col("no_model") & F.col("bare"),
        "token-reset": counts & (F.col("method") == "total-reset"),
        "token-aggregate": counts & (F.col("method") == "total-aggregate-delta"),
    }
    rows = rows.withColumn("signals", F.array_compact(F.array(*[F.when(told[s], F.lit(s)) for s in SIGNALS])))
    rows = rows.withColumns({"older_tokens": contributions.usage_total(F.col("older_usage")), "tokens": contributions.usage_total(F.col("usage"))})
    n_signals = F.size("signals")
    reason = (
        F.when(F.col("older_usage") == F.col("usage"), "same")
        .when(n_signals == 1, F.get("signals", F.lit(0)))
        .when(n_signals > 1, "mixed")
        .when(~seen, "v5-only")
        .when(~holds, "v4-only")
        .when(F.col("older_tokens") != F.col("tokens"), "usage-changed")
        .otherwise("unexplained")
    )
    explained = (F.col("older_usage") == F.col("usage")) | (n_signals == 1)
    entries = rows.select(
        *KEY, "record_ids", "source_kind", "kind", "n_records", "n_kept", "older_usage", "usage", "older_tokens", "tokens", (F.col("tokens") - F.col("older_tokens")).alias("delta"),
        "signals", reason.alias("reason"), explained.alias("explained"),
    )
    return stored(entries), mapping


def by_reason(entries: DataFrame) -> DataFrame:
    told = F.when(F.col("explained"), F.col("delta")).otherwise(F.lit(0))
    return entries.groupBy("reason").agg(F.count("*").alias("events"), *[F.sum(c).alias(c) for c in ("older_tokens", "tokens", "delta")], F.sum(told).alias("explained_delta"))


def by_session(entries: DataFrame) -> DataFrame:
    changed = F.col("older_usage") != F.col("usage")
    return entries.groupBy("session").agg(
        F.sum((F.col("n_records") > 0).cast("long")).alias("older_records"), F.sum("n_kept").alias("contributions"), *[F.sum(c).alias(c) for c in ("older_tokens", "tokens", "delta")],
        F.count_if(changed).alias("changed"), F.count_if(changed & ~F.col("explained")).alias("unexplained"),
    )


def gates(found: flow.Flow, entries: DataFrame, mapping: DataFrame, records: DataFrame) -> DataFrame:
    """gate, n_broken, holds: whether the present accounting may take the place of the older one.

    Both universes are comparable, every record is mapped, every difference explained, and the differences add up to that of the totals."""
    unmapped = F.count_if(F.col("kind").isin("unmapped", "ambiguous"))
    sums = [
        flow.tally(mapping, "mapping", {"open": unmapped}),
        flow.tally(entries, "entries", {"open": F.count_if(~F.col("explained")), "delta": F.sum("delta")}),
        flow.tally(records, "older", {"tokens": F.sum("tokens")}),
        flow.tally(found.canonical, "kept", {"tokens": F.sum("tokens")}),
        found.gates.select(F.concat(F.lit("gate."), "gate").alias("name"), F.col("n_broken").alias("n")),
        found.diagnostics.filter("name in ('reconcile.conflicts', 'reconcile.orphans') or name like 'invariants.%'"),
    ]
    counts = sums[0]
    for one in sums[1:]:
        counts = counts.unionByName(one)

    def n(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0))

    asked = {
        "sourceIntegrity": n("name = 'gate.sourceIntegrity'"),
        "universeComparable": n("name in ('reconcile.conflicts', 'reconcile.orphans', 'mapping.open')"),
        "v5ParserInvariants": n("name like 'invariants.%'"),
        "v5Activation": n("name like 'gate.%'"),
        "v4MappingComplete": n("name = 'mapping.open'"),
        "attributionComplete": n("name = 'entries.open'"),
        "accountingBalanced": F.abs(n("name = 'kept.tokens'") - n("name = 'older.tokens'") - n("name = 'entries.delta'")),
    }
    one = counts.agg(*[c.cast("long").alias(g) for g, c in asked.items()])
    pairs = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("n_broken")) for g in asked])
    return one.select(F.explode(pairs).alias("g")).select("g.*").withColumn("holds", F.col("n_broken") == 0)
