"""The two accountings of logs side by side, and the audit of a store: mapping of records, reasons, gates, stability."""

import json

from pyspark.sql import functions as F

from ledgerspark.operators import comparator, service, store, sync
from ledgerspark.sources import incremental

from .test_flow import meta, token, usage, write

USAGE = "struct<input:long, cached:long, creation:long, output:long, reasoning:long>"


def used(n):
    return (n, 0, 0, 0, 0)


def test_each_kind_of_mapping(spark):
    """Candidates are narrowed by session, then time, then source, each only where it leaves some; absent times equal nothing."""
    schema = "id string, session string, raw_identity string, path string, event_index long, ts_ms long, source_kind string, semantic_type string, raw_fingerprint string, semantic_fingerprint string"
    found, kept, gone, records = [], [], [], []

    def candidate(record, event, session="s", at=5, source="token-count", raw=None, meaning=None, n=None, lost=None):
        found.append((record, session, event, "f", int(event[1:]), at, source, "t", raw or event, meaning or event))
        if n is not None:
            kept.append((session, event, used(n)))
        if lost is not None:
            gone.append((session, event, used(lost)))

    def record(name, n, session="s", at=5, source="token-count"):
        records.append((name, session, at, source, used(n)))

    record("only", 1)
    candidate("only", "e1", session="other", at=9)
    # the same event in two files is one candidate
    candidate("only", "e1", session="other", at=9)
    record("by-session", 1)
    candidate("by-session", "e2")
    candidate("by-session", "e3", session="other")
    # no session fits, so time decides among all; then source
    record("by-source", 1, session="nowhere")
    candidate("by-source", "e4", session="x", source="payload-usage")
    candidate("by-source", "e5", session="y")
    candidate("by-source", "e6", session="z", at=6)
    record("no-time", 7, at=None)
    candidate("no-time", "e7", at=None, n=7)
    candidate("no-time", "e8", at=3, n=6)
    record("same-event", 1)
    for e in ("e10", "e9"):
        candidate("same-event", e, raw="r", n=50)
    record("same-usage", 4)
    for e in ("e12", "e11"):
        candidate("same-usage", e, meaning="m", n=4)
    record("usage", 8)
    candidate("usage", "e13", n=3)
    candidate("usage", "e14", n=8)
    record("gone", 9)
    candidate("gone", "e15", n=3)
    candidate("gone", "e16", lost=9)
    record("open", 2)
    candidate("open", "e17", n=2)
    candidate("open", "e18", n=2)
    record("lost", 2)
    usages = f"session string, raw_identity string, usage {USAGE}"
    mapping, collisions = comparator.mapped(
        spark.createDataFrame(records, f"id string, session_id string, ts_ms long, source_kind string, usage {USAGE}"), spark.createDataFrame(found, schema),
        spark.createDataFrame(kept, usages), spark.createDataFrame(gone, usages),
    )
    got = {r["id"]: (r["kind"], r["n_candidates"], r["raw_identity"]) for r in mapping.collect()}
    assert got == {
        "only": ("unique", 1, "e1"), "by-session": ("resolved-metadata", 2, "e2"), "by-source": ("resolved-metadata", 3, "e5"), "no-time": ("resolved-usage", 2, "e7"),
        "same-event": ("equivalent-collision", 2, "e9"), "same-usage": ("equivalent-usage-collision", 2, "e11"), "usage": ("resolved-usage", 2, "e14"),
        "gone": ("resolved-semantic-suppression", 2, "e16"), "open": ("ambiguous", 2, None), "lost": ("unmapped", 0, None),
    }
    assert {k for k, _, _ in got.values()} == set(comparator.KINDS)
    told = {(r["raw_identity"], r["id"], r["kind"], r["chosen"]) for r in collisions.collect()}
    assert told == {
        ("e8", "no-time", "resolved-usage", "e7"), ("e10", "same-event", "equivalent-collision", "e9"), ("e12", "same-usage", "equivalent-usage-collision", "e11"),
        ("e13", "usage", "resolved-usage", "e14"), ("e15", "gone", "resolved-semantic-suppression", "e16"),
    }
    # without records or candidates
    empty = mapping.sparkSession.createDataFrame([], schema)
    none, _ = comparator.mapped(spark.createDataFrame(records, f"id string, session_id string, ts_ms long, source_kind string, usage {USAGE}"), empty, spark.createDataFrame([], usages), spark.createDataFrame([], usages))
    assert {r["kind"] for r in none.collect()} == {"unmapped"}


def compare(spark, root):
    listed = incremental.listing(spark, [str(root)])
    lines = incremental.read_lines(incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), 5), 50)
    return service.codex_comparison(listed, lines)


def reasons(found):
    return {(r["session"], r["reason"], r["older_tokens"], r["tokens"]) for r in found.entries.filter("reason <> 'same'").collect()}


def broken(found):
    return {r["gate"] for r in found.gates.filter("not holds").collect()}


def test_logs_that_both_read_alike(spark, tmp_path):
    """One log is read alike. In the other, events that share an id are one record in the older accounting: the second is a collision, not a loss."""
    write(tmp_path / "a.jsonl", meta("a"), token(20, usage(40, 4), usage(40, 4, 44)), token(30, None, usage(70, 10, 80)), token(31, usage(5, 1), usage(75, 11, 86)))
    write(tmp_path / "b.jsonl", meta("b"), token(20, usage(6, 2)) | {"id": "x"}, token(20, usage(9, 2)) | {"id": "x"})
    found = compare(spark, tmp_path)
    assert reasons(found) == {("b", "v4-candidate-collision", 0, 8)} and broken(found) == set() and found.ready()
    kinds = {(r["session"], r["id"] == "codex:x", r["kind"]) for r in found.mapping.collect()}
    assert kinds == {("a", False, "unique"), ("b", True, "resolved-usage")}
    assert {tuple(r) for r in comparator.by_session(found.entries).collect()} == {("a", 3, 3, 86, 86, 0, 0, 0), ("b", 1, 2, 11, 19, 8, 1, 0)}
    assert {(r["reason"], r["events"], r["older_tokens"], r["tokens"]) for r in comparator.by_reason(found.entries).collect()} == {("same", 4, 97, 97), ("v4-candidate-collision", 1, 0, 8)}


def test_reasons_of_differences(spark, tmp_path):
    """A payload that repeats a count; a counter that is set back; usage on an event that is no count; a count before any model; a fork that repeats its
    parent's events; and one that goes on from a parent whose file comes later, which the older accounting can't know."""
    write(
        tmp_path / "a.jsonl",
        meta("a"),
        token(20, usage(6, 2), None, response_id="r1"),
        {"type": "response.completed", "timestamp": 21, "payload": {"response_id": "r1", "usage": usage(6, 2)}},
        token(22, None, usage(50, 10, 60)),
        token(23, None, usage(7, 3, 10)),
        {"type": "turn", "timestamp": 24, "payload": {"info": {"last_token_usage": usage(11, 2)}}},
    )
    write(tmp_path / "b.jsonl", {"type": "session_meta", "timestamp": 10, "payload": {"id": "b"}}, token(40, {"total_tokens": 9}), token(41, usage(3, 1)))
    write(tmp_path / "c.jsonl", meta("c", 60, "a"), token(20, usage(6, 2), None, response_id="r1"), token(70, usage(1, 1), None, response_id="r9"))
    write(tmp_path / "d.jsonl", meta("d", 60, "z"), token(70, None, usage(108, 22, 130)))
    write(tmp_path / "z.jsonl", meta("z"), token(50, None, usage(100, 20, 120)))
    found = compare(spark, tmp_path)
    assert reasons(found) == {
        ("a", "payload-suppression", 8, 0), ("a", "token-reset", 0, 10), ("a", "taxonomy-non-token-usage", 13, 0), ("b", "v4-missing-model", 0, 9), ("b", "v5-only", 0, 4),
        ("c", "fork-replay", 8, 0), ("d", "fork-baseline", 130, 10),
    }
    assert broken(found) == {"attributionComplete"} and not found.ready()
    told = {r["reason"]: (r["delta"], r["explained_delta"]) for r in comparator.by_reason(found.entries).collect()}
    assert told["fork-baseline"] == (-120, -120) and told["v5-only"] == (4, 0)


def test_audit_of_a_store(spark, tmp_path):
    logs, held = tmp_path / "logs", store.Store(spark, str(tmp_path / "store"))
    write(logs / "a.jsonl", meta("a"), token(20, usage(40, 4), usage(40, 4, 44)), token(30, None, usage(70, 10, 80)))
    roots, runs, times = [str(logs)], [], iter(range(41, 50))

    def grow():
        runs.append(1)
        with open(logs / "a.jsonl", "a") as f:
            f.write(json.dumps(token(next(times), usage(1, 1))) + "\n")

    def sync_then():
        """The log grows while the first run lasts, so there is a second."""
        grow() if not runs else sync.sync_codex(spark, held, roots)

    done = service.audit_codex(spark, held, roots, sync_then)
    row = done.reconciliation.first()
    assert done.matched() and done.ready() and (row["expected_records"], row["actual_records"], row["difference_tokens"], row["difference_percent"]) == (3, 3, 0, 0.0)
    assert {(r["value"], r["n"]) for r in done.taxonomy.filter("dimension = 'semantic'").collect()} == {("session_meta", 1), ("token_count", 3)}

    # a log that never stops growing is synced no more than ATTEMPTS times, and one that changes while it is read is told
    runs.clear()
    late = service.audit_codex(spark, held, roots, grow, lambda: incremental.listing(spark, roots).withColumn("size", F.col("size") + 1))
    row = late.reconciliation.first()
    assert len(runs) == service.ATTEMPTS and (row["expected_records"], row["actual_records"], row["expected_only"], row["content_mismatch"], row["difference_tokens"]) == (5, 3, 2, 0, 4)
    assert not late.source_stable and late.store_stable and not late.matched() and not late.ready()


def test_reconciliation(spark, tmp_path):
    """Nothing held, another model, a session that is gone, and no rows at all."""
    schema = "id string, session_id string, model string, project_key string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long, reasoning_output_tokens long"
    records = spark.createDataFrame([("x", "s", "m", None, 5, 0, 0, 1, 0), ("y", None, "m", "p", 2, 1, 0, 1, 0)], schema)
    none = records.limit(0)
    row = service.reconciled(records, none).first()
    assert (row["expected_only"], row["difference_tokens"], row["difference_percent"], row["identity_matched"], row["matched"]) == (2, 10, 0.0, False, False)
    assert service.reconciled(none, none).first()["matched"] and service.reconciled(records, records).first()["matched"]
    row = service.reconciled(records, records.withColumn("model", F.lit("x"))).first()
    assert (row["identity_matched"], row["content_matched"], row["content_mismatch"], row["components_matched"]) == (True, False, 2, True)
    row = service.reconciled(records, records.withColumn("session_id", F.lit(None).cast("string"))).first()
    assert (row["sessions_matched"], row["identity_matched"], row["content_mismatch"], row["components_matched"]) == (False, False, 1, True)
    assert [tuple(r) for r in service.record_differences(records.limit(1), none).collect()] == [("x", "expected-only", 5, 0, 0, 1, 0)]
    # figures that differ while their sum doesn't
    row = service.reconciled(records, records.withColumns({"input_tokens": F.col("input_tokens") + 1, "output_tokens": F.col("output_tokens") - 1})).first()
    assert (row["tokens_matched"], row["components_matched"]) == (True, False)
