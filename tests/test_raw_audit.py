"""The audit of raw logs on log files, the tables of the payload overlap audit, the summary of fork histories, the export."""

import json

from pyspark.sql import functions as F

from ledgerspark.functions.store import stored
from ledgerspark.operators import audits, matching, pricing, raw_audit, rollup

from .test_flow import meta, token, usage, write


def table(df, key="figure", value="n"):
    return {r[key]: r[value] for r in df.collect()}


def methods(found):
    return table(raw_audit.methods(found.rows, found.sessions), "method", "tokens")


def test_audit_of_logs(spark, tmp_path):
    """A parent with a repeat and a reset, a fork seeded from it, a fork that tells its own baseline, a shorter copy, a file without a session, an
    unfinished last line."""
    live, archive = tmp_path / "sessions", tmp_path / "archived_sessions"
    # the second token count repeats the first one's total but has an increment; the third is 30 on, its increment says 25; then a reset after a response
    events = [
        meta("parent", 10),
        token(20, usage(100), usage(100)),
        token(30, usage(7), usage(100)),
        token(40, usage(25), usage(120, 10)),
        {"type": "response_item", "timestamp": 45, "payload": {"type": "message"}},
        token(50, usage(40), usage(40)),
        {"type": "turn_context", "timestamp": 60, "payload": {"usage": usage(9)}},
    ]
    write(live / "a.jsonl", *events)
    write(archive / "copy.jsonl", *events[:3])
    # no increment, so the baseline is the parent's total when it forked: at 42 that is 130
    write(live / "b.jsonl", meta("child", 42, parent="parent"), token(70, None, usage(150, 20)))
    # its own first total less its first increment
    write(live / "c.jsonl", meta("own", 80, parent="parent"), token(90, usage(5), usage(55)))
    # neither session nor model nor time; the last line isn't ended
    write(live / "d.jsonl", {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage(3)}}}, {"type": "event_msg", "payload": {"type": "token_count"}}, tail=json.dumps({"type": "other", "payload": {"input_tokens": 2}}))
    found = raw_audit.audit_logs(spark, [str(tmp_path)])
    assert methods(found) == {
        "last_usage_sum": 100 + 7 + 25 + 40 + 5 + 3, "segmented_total_delta": 100 + 0 + 30 + 40 + 170 + 55,
        # the first event of `own` with both counts what its total adds to the parent's last one, 40
        "current_equivalent": 100 + 7 + 25 + 40 + 9 + 170 + 15 + 3 + 2, "older_all_events": 100 + 7 + 25 + 40 + 9 + 170 + 15, "older_unique": 100 + 7 + 25 + 40 + 9 + 170 + 15,
        "session_terminal_total": 40 + 170 + 55, "fork_aware_total_delta": 100 + 0 + 30 + 40 + (150 - 120 + 20 - 10) + 5, "hybrid_canonical": 100 + 0 + 30 + 40 + 9 + 170 + 5 + 3 + 2,
    }
    assert table(raw_audit.classes(found.rows, found.sessions), "event_class") == {
        "last-delta-match": 1, "duplicate-snapshot": 1, "last-delta-mismatch": 2, "counter-reset": 1, "total-only": 2, "normal-delta": 1, "last-only": 1, "fork-first": 2,
    }
    reset = raw_audit.resets(found.rows).first()
    assert (reset["session"], reset["fell"], reset["cause"], reset["equals_last"], reset["previous_tokens"], reset["gap_ms"], reset["segment"]) == ("parent", "input,output", "response-boundary", True, 130, 5000, 1)
    n = table(raw_audit.figures(found.files, found.events, found.rows, found.sessions))
    assert (n["files"], n["canonical_files"], n["duplicate_files"], n["forks"]) == (5, 4, 1, 2)
    assert (n["baseline_child_first"], n["baseline_parent_at_fork"], n["baseline_missing"]) == (1, 1, 0)
    # five of the parent, one each of the forks, two of the last file; its empty token count has no class
    assert (n["usage_events"], n["time_explicit"], n["time_inherited"], n["time_file_modified"]) == (10, 7, 0, 2)
    assert (n["repeats_with_last"], n["repeated_last_tokens"], n["first_above_last_tokens"]) == (1, 7, 50)
    kinds = {r["source_kind"]: (r["events"], r["zero_events"], r["raw_tokens"]) for r in raw_audit.sources(found.rows).collect()}
    assert kinds == {"token-count": (8, 1, 100 + 100 + 130 + 40 + 170 + 55 + 3), "payload-usage": (1, 0, 9), "flat-payload": (1, 0, 2), "ignored-no-model": (3, 1, 5)}
    by_session = raw_audit.by_session(found.rows, found.sessions)
    assert table(by_session, "session", "delta_tokens")["parent"] == 170 and by_session.count() == 4
    assert raw_audit.largest_gaps(by_session, 1).orderBy("ranking").collect()[1]["session"] == "parent"
    assert raw_audit.by_day(found.rows).filter("day like '1970%'").first()["fork_delta_tokens"] == 215
    assert sum(table(raw_audit.mismatch_sizes(found.rows), "size_class").values()) == 5


def test_empty_and_odd_logs(spark, tmp_path):
    """Empty files aren't listed, blank and broken lines are no events; a table without files gives reports without rows or with zeros. A fork of a session that
    isn't there has no baseline, one of itself its own."""
    write(tmp_path / "x" / "empty.jsonl")
    write(tmp_path / "x" / "broken.jsonl", "\n", "{no json\n", "[1]\n")
    found = raw_audit.audit_logs(spark, [str(tmp_path / "x")])
    assert methods(found) == {} and raw_audit.resets(found.rows).count() == 0
    n = table(raw_audit.figures(found.files, found.events, found.rows, found.sessions))
    assert (n["files"], n["events"], n["usage_events"], n["mismatch_tokens"]) == (1, 1, 0, 0)
    write(tmp_path / "y" / "a.jsonl", meta("a", 5, parent="gone"), token(6, None, usage(10)))
    write(tmp_path / "y" / "b.jsonl", meta("b", 5, parent="b"), token(4, None, usage(10)), token(7, None, usage(12)))
    found = raw_audit.audit_logs(spark, [str(tmp_path / "y")])
    assert {r["session"]: r["baseline_from"] for r in found.sessions.collect()} == {"a": "missing", "b": "parent-at-fork"}
    assert table(raw_audit.classes(found.rows, found.sessions), "event_class") == {"normal-delta": 3, "fork-first": 2, "fork-baseline-unresolved": 1}


def test_overlap_of_logs(spark, tmp_path):
    """Payloads from logs: one repeats a token count by its response, one by its turn with other figures, one is shadowed by an increment in its own
    event, one has no partner."""
    write(
        tmp_path / "a.jsonl",
        meta("s", 10),
        token(20, None, usage(50), response_id="r1"),
        {"type": "response_item", "timestamp": 21, "payload": {"type": "message", "response_id": "r1", "usage": usage(50)}},
        token(30, None, usage(80), turn_id="t1"),
        {"type": "turn_context", "timestamp": 31, "payload": {"turn_id": "t1", "usage": usage(31)}},
        {"type": "response_item", "timestamp": 5000, "payload": {"usage": usage(4)}},
        {"type": "response_item", "timestamp": 6000, "payload": {"usage": usage(8), "info": {"last_token_usage": usage(8)}}},
    )
    found = raw_audit.audit_logs(spark, [str(tmp_path)])
    payloads, tokens = (stored(x) for x in raw_audit.overlap_sides(found.files, found.events))
    assert sorted(r["tokens"] for r in tokens.collect()) == [30, 50]
    audit = stored(matching.overlap_audit(payloads.filter("eligible"), tokens))
    one = matching.overlap_summary(payloads, tokens, audit).first()
    assert (one["observed_tokens"], one["eligible_tokens"], one["shadowed_tokens"], one["confirmed_tokens"], one["linked_tokens"]) == (93, 85, 8, 50, 81)
    assert one["universe_tokens_hold"] and one["classification_holds"]
    kinds = {(r["dimension"], r["value"]): r["n"] for r in matching.overlap_dimensions(payloads, audit).collect()}
    assert kinds["evidence", "none"] == 1 and kinds["duplicate_class", "linked-different-usage"] == 1 and kinds["semantic_type", "response_item"] == 2
    model = matching.overlap_by_model(payloads, audit).first()
    assert (model["model"], model["payloads"], model["unmatched_tokens"]) == ("gpt-5", 3, 4)
    day = matching.overlap_by_day(payloads, tokens, audit).first()
    assert (day["token_count_tokens"], day["observed_tokens"], day["eligible_tokens"], day["confirmed_tokens"]) == (80, 93, 85, 50)


def test_summary_of_fork_histories(spark):
    pair = "struct<input:long, output:long>"
    cursors = spark.createDataFrame([("a", "p", (9, 1)), ("b", "b", (1, 1)), ("c", "p", None)], f"session string, parent string, baseline {pair}")
    traces = spark.createDataFrame(
        [("a", "p", (4, 1), (9, 1), (5, 0), "e1"), ("c", "p", (2, 0), (3, 0), (1, 0), "e2"), ("d", "d", None, None, None, None)],
        f"session string, parent string, baseline {pair}, first_total {pair}, contribution {pair}, first_id string",
    )
    records = spark.createDataFrame([("e1", "a", (5, 0)), ("e2", "c", (7, 0)), ("e3", "z", (1, 0))], f"id string, session string, usage {pair}")
    extra, none = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string"), spark.createDataFrame([], "id string")
    one = audits.fork_history_summary(cursors, traces, records, extra, none).first().asDict()
    # e2's record isn't what the replay gives, e3 belongs to no fork
    assert (one["forks"], one["self_parent_cursors"], one["self_parent_traces"], one["explained_records"], one["explained_tokens"]) == (2, 1, 1, 1, 5)
    assert (one["fork_extra_records"], one["fork_extra_explained_percent"], one["fork_extra_adds_up"], one["all_extra_explained"]) == (2, 50.0, True, False)
    empty = audits.fork_history_summary(cursors.limit(0), traces.limit(0), records.limit(0), none, none).first()
    assert empty["forks"] == 0 and empty["extra_explained_percent"] == 100.0


def test_export(spark, tmp_path):
    """Fourteen columns; each file begins with a byte order mark; what a spreadsheet would run is quoted; cost and label only with a price."""
    rows = spark.createDataFrame(
        [("x", "codex", None, 1_700_000_000_123, "gpt-5", "p", 1_000_000, 0, 0, 0, 0), ("y", "claude", "=s", 0, "odd, model", "q", 1, 2, 3, 4, 5)],
        "id string, source string, session_id string, ts_ms long, model string, project_key string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long, reasoning_output_tokens long",
    )
    names = spark.createDataFrame([("p", "Plan \"B\"")], "project_key string, name string")
    out = rollup.export_rows(rows, pricing.catalogue(spark), names).coalesce(1).sortWithinPartitions(F.desc("time"))
    rollup.write_csv(out, str(tmp_path / "out"), bom=True)
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    head, first, second, end = text.decode("utf-8-sig").split("\r\n")
    assert text.startswith(b"\xef\xbb\xbftime,agent") and head.count(",") == 13 and end == ""
    assert first == '2023-11-14T22:13:20.123Z,codex,,gpt-5,"Plan ""B""",1000000,0,0,0,0,1000000,1.25,exact,GPT-5'
    assert second == "1970-01-01T00:00:00.000Z,claude,'=s,\"odd, model\",q,1,2,3,4,5,15,,unmatched,"
