"""Logs from their lines to published records: accounting scenarios, incremental scans and syncs."""

import json
import random

from pyspark.sql import functions as F

from ledgerspark.operators import duplicates, flow, lineage, payloads, store, sync
from ledgerspark.sources import decoders, incremental, jsonl
from ledgerspark.streaming import rollup as streaming

COUNTER = "struct<input:long, cached:long, creation:long, output:long, reasoning:long, total:long>"


def write(path, *events, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in events) + tail)


def meta(session, at=10, parent=None, **more):
    return {"type": "session_meta", "timestamp": at, "payload": {"id": session, "cwd": "/w/demo", "model": "gpt-5", **({"forked_from_id": parent} if parent else {}), **more}}


def usage(i, o=0, t=None, **more):
    return {"input_tokens": i, "output_tokens": o, **({} if t is None else {"total_tokens": t}), **more}


def token(at, last=None, total=None, **more):
    info = {**({"last_token_usage": last} if last else {}), **({"total_token_usage": total} if total else {})}
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": info, **more}}


def account(spark, root):
    found = jsonl.files(spark, [str(root)])
    listed = found.select("path", "size", "modified_ms")
    lines = incremental.read_lines(incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), 5), 50)
    return sync.codex_flow(listed, lines)


def counts(found):
    return {r["name"]: r["n"] for r in found.diagnostics.collect()}


def figures(found):
    return sorted((r["session_id"], r["ts_ms"], r["input_tokens"], r["cached_input_tokens"], r["output_tokens"], r["reasoning_output_tokens"]) for r in found.records.collect())


def test_whole_flow(spark, tmp_path):
    """A parent, a fork that goes on from the parent's total, a fork that repeats its parent's events, payloads beside and instead of token counts."""
    write(
        tmp_path / "sessions" / "parent.jsonl",
        meta("parent"),
        token(20, usage(40, 4), usage(40, 4, 44), turn_id="t1"),
        token(30, None, usage(70, 10, 80), turn_id="t2"),
        {"type": "response.completed", "timestamp": 31, "payload": {"response_id": "r1", "usage": usage(9, 3, reasoning_output_tokens=1)}},
    )
    write(tmp_path / "sessions" / "child.jsonl", meta("child", 40, "parent"), token(50, None, usage(95, 15, 110)))
    write(
        tmp_path / "sessions" / "replay.jsonl",
        meta("replay", 60, "parent"),
        token(20, usage(40, 4), usage(40, 4, 44), turn_id="t1"),
        token(30, None, usage(70, 10, 80), turn_id="t2"),
        {"type": "response.completed", "timestamp": 31, "payload": {"response_id": "r1", "usage": usage(9, 3, reasoning_output_tokens=1)}},
        token(70, usage(5, 1), usage(75, 11, 86), turn_id="t3"),
    )
    write(
        tmp_path / "sessions" / "both.jsonl",
        meta("both"),
        {"type": "token_count", "timestamp": 80, "payload": {"type": "token_count", "info": {"last_token_usage": usage(6, 2)}, "usage": usage(6, 2, 8)}},
        {"type": "token_count", "timestamp": 81, "payload": {"type": "token_count", "info": {"last_token_usage": usage(7, 2)}, "usage": usage(16, 2)}},
    )
    found = account(spark, tmp_path)
    assert figures(found) == [
        ("both", 80000, 6, 0, 2, 0),
        ("both", 81000, 7, 0, 2, 0),
        ("both", 81000, 16, 0, 2, 0),
        ("child", 50000, 25, 0, 5, 0),
        ("parent", 20000, 40, 0, 4, 0),
        ("parent", 30000, 30, 0, 6, 0),
        ("parent", 31000, 9, 0, 2, 1),
        ("replay", 70000, 5, 0, 1, 0),
    ]
    n = counts(found)
    assert (n["replays.suppressed"], n["replays.suppressed_tokens"], n["replays.prefix_mismatches"]) == (3, 44 + 36 + 12, 0)
    assert (n["payloads.same_raw_event"], n["payloads.unmatched"], n["forks.resolved"], n["forks.explicit-replay"]) == (1, 3, 1, 1)
    assert {r["session"]: (r["fork_status"], r["final_tokens"]) for r in found.sessions.collect()} == {
        "parent": ("not-fork", 92), "child": ("resolved", 30), "replay": ("explicit-replay", 6), "both": ("not-fork", 35),
    }
    assert found.safe() and found.codes().count() == 0
    ids = [r["id"] for r in found.records.collect() if r["session_id"] == "both"]
    assert sorted(x.rsplit(":", 1)[1] for x in ids) == ["0", "0", "1"] and all(x.startswith("codex:v5:both:e") for x in ids)


def gates_that_fail(found):
    return {r["gate"] for r in found.gates.filter("not holds").collect()}


def test_gates_say_what_is_wrong(spark, tmp_path):
    files = [
        [meta("a"), meta("b", 11), token(20, usage(1, 1))],
        [meta("c"), {"type": "token_count", "info": {"last_token_usage": usage(1, 1)}}],
        [meta("d"), token(20, None, {"reasoning_output_tokens": 4}), token(21, None, {"reasoning_output_tokens": 5})],
        [meta("e"), token(20, usage(1, 1))],
        [meta("e"), token(21, usage(2, 1))],
        [meta("f"), token(20, usage(70), usage(80, t=80)), token(20, usage(60), usage(80, t=80))],
        [meta("g", parent="gone"), token(20, usage(1, 1))],
    ]
    for k, events in enumerate(files):
        write(tmp_path / "all" / f"{k}.jsonl", *events)
    found = account(spark, tmp_path / "all")
    assert gates_that_fail(found) == {
        "sessionIdentity", "timestampCompleteness", "tokenCountCompleteness", "logicalSessionReconciliation", "tokenCountDuplicateSemantics", "forkResolution",
    }
    assert not found.safe() and {r["code"]: r["n"] for r in found.codes().collect()} == {
        "CODEX_V5_SESSION_IDENTITY_CONFLICTS": 1, "CODEX_V5_MISSING_TIMESTAMPS": 1, "CODEX_V5_UNRESOLVED_TOKEN_COUNTS": 1, "CODEX_V5_LOGICAL_CONFLICTS": 1,
        "CODEX_V5_UNRESOLVED_SEMANTIC_DUPLICATES": 1, "CODEX_V5_FORK_MISSING_PARENT": 1,
    }
    write(tmp_path / "one" / "x.jsonl", meta("a"), "not json\n", token(20, usage(1, 1)))
    assert gates_that_fail(account(spark, tmp_path / "one")) == {"sourceIntegrity"}


def tokens(spark, rows):
    schema = f"session string, path string, event_index long, raw_identity string, raw_fingerprint string, semantic_fingerprint string, ts_ms long, response_id string, turn_id string, model string, last {COUNTER}, total {COUNTER}"
    return spark.createDataFrame(rows, schema)


def event(k, ts, last=None, total=None, raw=None, response=None, turn=None, model="m", semantic=None, session="s"):
    full = [None if x is None else (x, None, None, 0, None, x) for x in (last, total)]
    return (session, "f", k, f"e{k}:h{raw or k}", raw or f"raw{k}", semantic or f"sem{k}", ts, response, turn, model, *full)


def test_duplicate_evidence_and_suppression(spark):
    rows = [
        event(0, 100, 100, 100),
        event(1, 110, 80, 180),
        event(2, 110, 70, 180),  # the step is 80: the first agrees with it
        event(3, 120, 20, 200),
        event(4, 130, 30, 230, raw="same"),
        event(5, 130, 30, 230, raw="same"),  # one content
        event(6, 140, 5, 240, response="r"),
        event(7, 140, 10, 240, response="r"),  # the second agrees with the step
        event(8, 150, 4, 250),
        event(9, 150, 6, 250),  # neither agrees, no identity: probable
        event(10, 160, 10, 260, model="a"),
        event(11, 160, 10, 260, model="b"),  # models differ
        event(12, 170, 7, 270),
        event(13, 170, 10, 270),
        event(14, 170, 10, 270, turn="t"),  # two would have to stay
        event(15, 180, 1, 271, semantic="x"),
        event(16, 180, 1, 271, semantic="x"),  # both agree
        event(17, 190, None, 5),
        event(18, 190, 5, 5),  # after a reset
        event(0, 100, 100, 100, session="other"),
    ]
    suppressed, told = duplicates.resolved(duplicates.evidence(tokens(spark, rows)))
    pairs = {(r["primary_event_index"], r["candidate_event_index"]): (r["kind"], r["confidence"], r["transition"], r["state"]) for r in told.collect()}
    assert pairs == {
        (1, 2): ("same-cumulative-snapshot", "strong", "primary-only", "resolved"),
        (4, 5): ("exact-raw-content", "confirmed", "both", "confirmed"),
        (6, 7): ("same-cumulative-snapshot", "strong", "candidate-only", "resolved"),
        (8, 9): ("same-cumulative-snapshot", "probable", "neither", "unresolved"),
        (10, 11): ("explicit-conflict", "conflict", "both", "conflict"),
        (12, 13): ("same-cumulative-snapshot", "strong", "candidate-only", "unresolved"),
        (12, 14): ("same-cumulative-snapshot", "strong", "candidate-only", "unresolved"),
        (15, 16): ("same-semantic-content", "strong", "both", "resolved"),
        (17, 18): ("same-cumulative-snapshot", "probable", "reset", "unresolved"),
    }
    gone = {(r["name"]["event_index"], r["representative"]["event_index"], r["kind"], r["tokens"]) for r in suppressed.collect()}
    assert gone == {(2, 1, "semantic-snapshot", 70), (5, 4, "exact-raw-content", 30), (6, 7, "semantic-snapshot", 5), (16, 15, "semantic-snapshot", 1)}
    assert told.agg(duplicates.n_group_conflicts(told).alias("n")).first()["n"] == 1
    left = duplicates.survivors(tokens(spark, rows), suppressed)
    assert sorted(r["event_index"] for r in left.filter("session = 's'").collect()) == [0, 1, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18]


def test_payloads_over_components_and_precision(spark):
    side = "id string, session string, raw_identity string, response_id string, model string, usage struct<i:long,o:long>, tokens long, precision string, inconsistent boolean"
    exact, total = "components-exact", "aggregate-only"
    given = [
        ("same event", "s", "e1", None, "m", (3, 1), 4, exact, False),
        ("same event, other model", "s", "e2", None, "n", (3, 1), 4, exact, False),
        ("same event by total", "s", "e3", None, None, (4, 0), 4, total, True),
        ("same event, partial", "s", "e4", None, None, (4, 0), 4, "partial", False),
        ("response", "s", "p5", "r5", None, (5, 5), 10, exact, False),
        ("two of a response", "s", "p6", "r6", None, (6, 6), 12, exact, False),
        ("two for one, a", "s", "p7a", "r7", None, (7, 7), 14, exact, False),
        ("two for one, b", "s", "p7b", "r7", None, (7, 7), 14, exact, False),
        ("by model", "s", "p8", "r8", "m8", (8, 8), 16, exact, False),
        ("no token", "s", "p9", "r9", None, (1, 1), 2, exact, False),
        ("model conflict", "s", "p10", "r10", "x", (1, 1), 2, exact, False),
        ("precision", "s", "p11", "r11", None, (1, 1), 2, total, False),
        ("tokens' precision", "s", "p12", "r12", None, (1, 1), 2, exact, False),
        ("same total", "s", "p13", "r13", None, (1, 1), 2, exact, False),
        ("different", "s", "p14", "r14", None, (1, 1), 2, exact, False),
        ("zero", "s", "p15", None, None, (0, 0), 0, exact, False),
        ("other session", "z", "p5", "r5", None, (5, 5), 10, exact, False),
    ]
    counted = [
        ("t1", "s", "e1", None, "m", (3, 1), 4, exact, False),
        ("t2", "s", "e2", None, "m", (3, 1), 4, exact, False),
        ("t3", "s", "e3", None, "m", (2, 2), 4, exact, False),
        ("t4", "s", "e4", None, "m", (4, 0), 4, exact, False),
        ("t5", "s", "e5", "r5", "m", (5, 5), 10, exact, False),
        ("t6a", "s", "e6a", "r6", "m", (6, 6), 12, exact, False),
        ("t6b", "s", "e6b", "r6", None, (6, 6), 12, exact, False),
        ("t7", "s", "e7", "r7", "m", (7, 7), 14, exact, False),
        ("t8a", "s", "e8a", "r8", "m8", (8, 8), 16, exact, False),
        ("t8b", "s", "e8b", "r8", "other", (8, 8), 16, exact, False),
        ("t10", "s", "e10", "r10", "y", (1, 1), 2, exact, False),
        ("t11", "s", "e11", "r11", None, (1, 1), 2, exact, False),
        ("t12", "s", "e12", "r12", None, (2, 0), 2, total, False),
        ("t13", "s", "e13", "r13", None, (2, 0), 2, exact, False),
        ("t14", "s", "e14", "r14", None, (2, 2), 4, exact, False),
    ]
    found = payloads.payload_resolution(spark.createDataFrame(given, side), spark.createDataFrame(counted, side).drop("inconsistent")).collect()
    assert {r["id"]: (r["matched_id"], r["evidence"] or r["reason"] or r["disposition"]) for r in found} == {
        "same event": ("t1", "same-raw-event-components"),
        "same event, other model": (None, "no-response-id"),
        "same event by total": ("t3", "same-raw-event-aggregate"),
        "same event, partial": (None, "no-response-id"),
        "response": ("t5", "same-response-id-components"),
        "two of a response": (None, "multiple-candidates"),
        "two for one, a": (None, "multiple-candidates"),
        "two for one, b": (None, "multiple-candidates"),
        "by model": ("t8a", "same-response-id-components"),
        "no token": (None, "no-token-candidate"),
        "model conflict": (None, "model-conflict"),
        "precision": (None, "insufficient-precision"),
        "tokens' precision": (None, "insufficient-precision"),
        "same total": (None, "same-total-different-components"),
        "different": (None, "different-components"),
        "zero": (None, "ignore-zero"),
        "other session": (None, "no-token-candidate"),
    }


def test_fork_graph_and_cycles(spark):
    rows = [("a", None, 1), ("b", "a", 2), ("c", "gone", 3), ("d", "e", 4), ("e", "f", 5), ("f", "d", 6), ("g", "d", 7), ("h", "a", 8), ("h", "b", 9), ("i", "i", 1)]
    sessions = spark.createDataFrame(rows, "session string, parent string, fork_ms long")
    state = {r["session"]: r["state"] for r in lineage.fork_graph(sessions).collect()}
    assert state == {"a": "not-fork", "b": "fork", "c": "missing-parent", "d": "cycle", "e": "cycle", "f": "cycle", "g": "fork", "h": "conflicting-parent", "i": "cycle"}
    found = {r["first"]: r["members"] for r in lineage.canonical_cycles(sessions.filter("session <> 'h'")).collect()}
    assert found == {"d": ["d", "e", "f"], "i": ["i"]}


def test_fork_statuses(spark):
    counter = lambda t: None if t is None else (None, None, None, None, None, t)
    rows = [
        ("p", 1, 100, counter(50)), ("p", 2, 200, counter(90)), ("early", 1, 150, counter(60)), ("fine", 1, 400, counter(120)), ("anew", 1, 400, counter(20)),
        ("untimed", 1, None, counter(120)), ("odd", 1, 400, (None, None, None, None, 3, None)), ("none", 1, 400, None), ("root", 5, 900, counter(7)), ("of root", 1, 950, counter(9)),
    ]
    events = spark.createDataFrame(rows, f"session string, event_index long, ts_ms long, total {COUNTER}")
    events = events.withColumns({"last": F.lit(None).cast(COUNTER), "payload_usage": F.lit(None).cast(COUNTER), "raw_identity": F.lit("x")})
    sessions = [("p", None, None), ("root", None, None), ("of root", "root", 800)] + [(s, "p", 300) for s in ("early", "fine", "anew", "untimed", "odd", "none")] + [("late", "p", None)]
    found = flow.fork_statuses(spark.createDataFrame(sessions, "session string, parent string, fork_ms long"), events).collect()
    assert {r["session"]: (r["status"], r["checkpoint_aggregate"]) for r in found} == {
        "p": ("not-fork", None), "root": ("not-fork", None), "of root": ("missing-parent-checkpoint", None), "early": ("explicit-replay", 90), "fine": ("resolved", 90),
        "anew": ("child-counter-reset", 90), "untimed": ("missing-child-total-timestamp", 90), "odd": ("incomparable", 90), "none": ("not-needed", 90), "late": ("missing-fork-timestamp", None),
    }


def claude(k, i, o, **more):
    return {"timestamp": 1700000000 + k, "requestId": f"r{k}", "message": {"id": f"m{k}", "usage": {"input_tokens": i, "output_tokens": o}}, **more}


def log(n):
    """Lines of which only the first names session, model and folder; messages come again with the same or other usage."""
    events = [{"sessionId": "s", "cwd": "/w/proj", "message": {"model": "opus"}}]
    for k in range(n):
        events.append(claude(k, k + 1, 2))
        if k % 3 == 0:
            events.append(claude(k, k + 1 + k % 2, 2, text="é" * (k % 5)))
    return "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in events).encode()


def records(df):
    return sorted(map(repr, df.drop("source_path").collect()))


def test_lines_by_blocks(spark, tmp_path):
    text = b"one\n\ntwo two\r\nthree\n" + "é日本".encode() * 9 + b"\n" + b"x" * 70 + b"\nlast"
    (tmp_path / "a.jsonl").write_bytes(text)
    listed = incremental.listing(spark, [str(tmp_path)])
    planned = incremental.plan(listed, spark.createDataFrame([], incremental.CURSOR), 1)
    for block in (1, 2, 7, 20, 1000):
        rows = sorted(incremental.read_lines(planned, block).collect(), key=lambda r: r["begin"])
        assert [r["line"].encode() for r in rows] == [x.strip() for x in text.split(b"\n")]
        assert [r["begin"] for r in rows] == [0, 4, 5, 14, 20, 93, 164] and [r["ended"] for r in rows] == [True] * 6 + [False]


def test_appending_in_any_cuts_gives_one_scan(spark, tmp_path):
    whole = log(14)
    (tmp_path / "once" / "f").mkdir(parents=True)
    (tmp_path / "once" / "f" / "a.jsonl").write_bytes(whole)
    at_once = store.Store(spark, str(tmp_path / "store-once"))
    done = sync.sync_claude(spark, at_once, [str(tmp_path / "once")], 5)
    want = records(at_once.table("records"))
    assert done.changed_records == len(want) == 14 and "'proj'" in want[0]
    rng = random.Random(2)
    path = tmp_path / "cuts" / "f" / "a.jsonl"
    path.parent.mkdir(parents=True)
    kept = store.Store(spark, str(tmp_path / "store-cuts"))
    for end in sorted(rng.sample(range(1, len(whole)), 4)) + [len(whole)]:
        path.write_bytes(whole[:end])
        sync.sync_claude(spark, kept, [str(tmp_path / "cuts")], 5)
        cursor = kept.table("cursors").first()
        assert cursor["offset"] == end and cursor["pending"] == end - (whole[:end].rfind(b"\n") + 1)
    assert records(kept.table("records")) == want
    again = sync.sync_claude(spark, kept, [str(tmp_path / "cuts")], 5)
    assert (again.skipped_files, again.changed_records) == (1, 0)
    # moved, then written anew and shorter: its rows are replaced
    path.rename(path.with_name("b.jsonl"))
    assert sync.sync_claude(spark, kept, [str(tmp_path / "cuts")], 5).changed_records == 0
    assert {r["source_path"][-7:] for r in kept.table("records").collect()} == {"b.jsonl"}
    path.with_name("b.jsonl").write_bytes(log(2) + b"broken\n")
    shorter = sync.sync_claude(spark, kept, [str(tmp_path / "cuts")], 5)
    assert shorter.diagnostics == ["MALFORMED_JSONL:1"] and kept.table("records").count() == 2


def test_sync_of_a_source(spark, tmp_path):
    """Unsafe and changed sources leave the store as it was; appended, moved and deleted files change it."""
    root, kept = tmp_path / "home" / ".codex" / "sessions", store.Store(spark, str(tmp_path / "store"))
    roots = [str(root), str(root.parent / "archived_sessions")]
    write(root / "a.jsonl", meta("a"), token(20, usage(4, 1), usage(4, 1, 5)))
    first = sync.sync_codex(spark, kept, roots)
    assert (first.files, first.changed_records, first.diagnostics) == (1, 1, [])
    same = sync.sync_codex(spark, kept, roots)
    assert (same.changed_records, same.skipped_files) == (0, 1)
    write(root / "a.jsonl", meta("a"), token(20, usage(4, 1), usage(4, 1, 5)), tail='{"type": "tok')
    half = sync.sync_codex(spark, kept, roots)
    assert half.diagnostics == ["CODEX_V5_PENDING_FILES:1"] and kept.table("records").count() == 1
    write(root / "a.jsonl", meta("a"), token(20, usage(4, 1), usage(4, 1, 5)), token(30, usage(2, 1), usage(6, 2, 8)))
    grown = spark.createDataFrame([("other", 1, 1)], "path string, size long, modified_ms long")
    changed = sync.sync_codex(spark, kept, roots, lambda: grown)
    assert changed.diagnostics == [sync.CHANGED] and kept.table("records").count() == 1
    more = sync.sync_codex(spark, kept, roots)
    assert more.changed_records == 1 and kept.table("records").count() == 2
    ids = {r["id"] for r in kept.table("records").collect()}
    (root.parent / "archived_sessions").mkdir()
    (root / "a.jsonl").rename(root.parent / "archived_sessions" / "a.jsonl")
    sync.sync_codex(spark, kept, roots)
    rows = kept.table("records").collect()
    assert {r["id"] for r in rows} == ids and all("archived_sessions" in r["source_path"] for r in rows)
    (root.parent / "archived_sessions" / "a.jsonl").unlink()
    assert sync.sync_codex(spark, kept, roots).changed_records == 2 and kept.table("records").count() == 0
    both = sync.sync(spark, kept, str(tmp_path / "home"), 5) + sync.Synced(1, 2, 3, ["x"])
    assert (both.files, both.changed_records, both.skipped_files, both.diagnostics) == (1, 2, 3, ["x"])


def test_moving_in_an_empty_store(spark, tmp_path):
    store.Store(spark, str(tmp_path)).move_file("a", "b", 3)


def test_stream_keeps_buckets_without_project_or_model(spark, tmp_path):
    from ledgerspark.operators import rollup

    kept = store.Store(spark, str(tmp_path))
    rows = [("1", "codex", "f", "s", 5, "m", None, 1, 0, 0, 0, 0), ("2", "codex", "f", "s", 5, "m", "k", 2, 0, 0, 0, 0), ("3", "codex", "f", "s", 5, None, "k", 4, 0, 0, 0, 0)]
    for n, r in enumerate([rows[:1], rows[1:2], rows[2:], rows[:1]]):
        streaming.apply_batch(kept, spark.createDataFrame(r, streaming.RECORDS), n)
    every = rollup.buckets(spark.createDataFrame(rows, streaming.RECORDS))
    assert sorted(map(repr, kept.table("buckets").select(*every.columns).collect())) == sorted(map(repr, every.collect())) and every.count() == 3


def test_semantic_fingerprint_leaves_rate_limits_out(spark):
    one = {"type": "event_msg", "payload": {"type": "token_count", "rate_limits": {"a": 1}, "info": {"b": [1, {"rate_limits": 2}]}}}
    events = [one, {**one, "payload": {**one["payload"], "rate_limits": None}}, {**one, "payload": {**one["payload"], "info": {}}}, {"type": "x", "rate_limits": 1}, {"type": "x", "rate_limits": 2}]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(events)], "k int, line string").withColumn("value", F.try_parse_json("line"))
    found = [r["f"] for r in rows.select("k", decoders.without_rate_limits().alias("f")).orderBy("k").collect()]
    assert found[0] == found[1] and len({*found}) == 4 and None not in found
