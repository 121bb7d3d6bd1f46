"""Log ingestion, accounting, store and streaming on small scenarios with known results."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import lineage
from ledgerspark import catalogue
from ledgerspark.functions import usage as fn
from ledgerspark.operators import audits, contributions, counters, periods, pricing, rollup, store
from ledgerspark.sources import decoders, discovery, jsonl
from ledgerspark.streaming import rollup as streaming

SF = "/root/testdata/sf0.001"
COUNTER = "struct<input long, cached long, creation long, output long, reasoning long, total long>".replace(" long", ":long")


def write(path, *events, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in events) + tail)


def test_jsonl_lines(spark, tmp_path):
    write(tmp_path / "a" / "x.jsonl", {"n": 1}, "\n", "not json\n", {"n": "é"}, tail='{"n": 3')
    write(tmp_path / "a" / "b" / "y.JSONL", {"n": 4})
    write(tmp_path / "a" / "z.txt", {"n": 5})
    found = jsonl.files(spark, [str(tmp_path / "a"), str(tmp_path / "missing")])
    rows = jsonl.lines(found).orderBy("path", "line_index").collect()
    assert [(r["path"][-7:], r["event_index"], r["value"] is None) for r in rows] == [
        ("y.JSONL", 0, False),
        ("x.jsonl", 0, False),
        ("x.jsonl", 1, True),
        ("x.jsonl", 1, False),
    ]
    status = {r["path"][-7:]: r for r in jsonl.status(found).collect()}
    assert (status["x.jsonl"]["n_malformed"], status["x.jsonl"]["has_pending"]) == (1, True)
    assert not status["y.JSONL"]["has_pending"]
    before = jsonl.snapshot(found).first()
    write(tmp_path / "a" / "x.jsonl", {"n": 1})
    assert jsonl.snapshot(jsonl.files(spark, [str(tmp_path / "a")])).first() != before
    assert jsonl.files(spark, [str(tmp_path / "none")]).count() == 0


def claude(message, request, inp, out, **more):
    usage = {"input_tokens": inp, "output_tokens": out, **more}
    return {"sessionId": "s1", "cwd": "/work/demo/", "requestId": request, "timestamp": "2024-01-02T03:04:05.006Z", "message": {"id": message, "model": "m", "usage": usage}}


def test_claude_records(spark, tmp_path):
    write(
        tmp_path / "c.jsonl",
        claude("m1", "r1", 100, 10),
        claude("m1", "r1", 180, 20),
        claude("m1", "r1", 180, 20),
        claude("m2", "r2", 5, 1, cache_creation_input_tokens=3, cache_creation={"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 2}),
        {"type": "user", "message": {"content": "text"}},
        {"uuid": "u1", "usage": {"output_tokens": "7", "input_tokens": 2}, "timestamp": 1700000000},
    )
    lines = jsonl.lines(jsonl.files(spark, [str(tmp_path)]))
    found = sorted(decoders.claude_records(lines, 0).collect(), key=lambda r: r["input_tokens"])
    assert [(r["input_tokens"], r["output_tokens"], r["cache_creation_input_tokens"]) for r in found] == [(2, 0, 0), (5, 1, 6), (180, 20, 0)]
    assert {r["project_key"] for r in found} == {"demo"} and found[0]["id"] == "claude:u1"
    assert [r["ts_ms"] for r in found] == [1700000000000, 1704164645006, 1704164645006]


def test_codex_events(spark, tmp_path):
    write(
        tmp_path / "x.jsonl",
        {"type": "session_meta", "timestamp": 10, "payload": {"id": "child", "forked_from_id": "parent", "cwd": "/w"}},
        {"type": "session_meta", "timestamp": 11, "payload": {"id": "parent"}},
        {"type": "turn_context", "payload": {"model": "gpt-5-codex"}},
        {"type": "response.completed", "timestamp": "2024-01-01", "payload": {"responseId": "r7", "usage": {"inputTokens": 90, "cacheCreationInputTokens": 11, "outputTokens": 8, "totalTokens": 98}}},
        {"type": "event_msg", "timestamp": 12, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": -1, "total_tokens": 9}, "last_token_usage": {"totalTokens": "8"}}}},
        {"type": "token_count", "timestamp": 13, "info": {"last_token_usage": {"input_tokens": 3, "output_tokens": 1}}},
    )
    rows = decoders.codex_events(jsonl.lines(jsonl.files(spark, [str(tmp_path)]))).orderBy("event_index").collect()
    assert {(r["session"], r["fork_ms"]) for r in rows} == {("child", 10000)}
    assert [r["model"] for r in rows] == [None, None] + ["gpt-5-codex"] * 4
    assert [r["semantic_type"] for r in rows][3:] == ["response.completed", "token_count", "token_count"]
    assert tuple(rows[3]["payload_usage"]) == (90, None, 11, 8, None, 98)
    assert rows[3]["ts_ms"] == 1704067200000 and rows[3]["response_id"] == "r7"
    assert rows[4]["total"].asDict() == {"input": 0, "cached": None, "creation": None, "output": None, "reasoning": None, "total": 9}
    assert rows[4]["last"] is None and rows[5]["last"]["output"] == 1
    one = spark.createDataFrame([((70, 25, 4, 31, 40, None),)], f"u {COUNTER}").select(contributions.normalized(F.col("u")).alias("n")).first()["n"]
    assert tuple(one) == (45, 25, 4, 0, 40)


def events(spark, rows):
    return spark.createDataFrame(rows, f"session string, event_index long, last {COUNTER}, total {COUNTER}")


def counter(i=None, o=None, t=None, c=None, r=None):
    return (i, c, None, o, r, t)


def test_contributions_of_structs(spark):
    rows = [
        ("a", 1, None, counter(100, 0, 100)),
        ("a", 2, None, counter(180, 20, 200)),
        ("a", 3, None, counter(180, 20, 200)),
        ("a", 4, counter(5, 1), counter(186, 20, 206)),
        ("a", 5, None, counter(t=306)),
        ("a", 6, None, counter(30, 10, 40)),
        ("a", 7, None, None),
        ("b", 1, None, counter(10, 5, 99)),
        ("b", 2, None, counter(r=3)),
    ]
    found = contributions.contributions(events(spark, rows), ["session"], ["event_index"]).orderBy("session", "event_index").collect()
    assert [(r["relation"], r["method"], r["tokens"]) for r in found] == [
        ("initial", "total-initial", 100),
        ("increased", "total-delta", 100),
        ("same", "duplicate-zero", 0),
        ("increased", "last", 6),
        ("increased", "total-aggregate-delta", 100),
        ("reset", "total-reset", 40),
        (None, "unresolved", 0),
        ("initial", "total-initial", 99),
        ("incomparable", "unresolved", 0),
    ]
    assert tuple(found[7]["usage"]) == (99, 0, 0, 0, 0)  # the parts don't add up to the total


def test_seeded_child(spark):
    child = events(spark, [("child", 1, None, counter(t=180))])
    seed = (F.lit(None).cast(COUNTER), F.lit(None).cast("long"))
    assert contributions.contributions(child, ["session"], ["event_index"], seed).first()["tokens"] == 180
    known = F.struct(*[F.lit(150 if f == "total" else None).cast("long").alias(f) for f in ("input", "cached", "creation", "output", "reasoning", "total")])
    found = contributions.contributions(child, ["session"], ["event_index"], (known, F.lit(150).cast("long"))).first()
    assert (found["tokens"], found["method"]) == (30, "total-aggregate-delta")


def test_records_have_slots(spark):
    rows = [("s 1", "e0:h1", 0, 5, None, None), ("s 1", "e0:h1", 1, 5, "m", "p"), ("s 1", "e1:h2", 2, None, "m", "p")]
    base = spark.createDataFrame(rows, "session string, raw_identity string, event_index long, ts_ms long, model string, project_key string")
    usage = F.struct(*[F.lit(2).cast("long").alias(f) for f in contributions.USAGE])
    found = contributions.records(base.withColumn("usage", usage).withColumn("tokens", F.lit(10))).orderBy("id").collect()
    assert [(r["id"], r["model"]) for r in found] == [("codex:v5:s%201:e0:h1:0", "unknown"), ("codex:v5:s%201:e0:h1:1", "m")]


def test_precision(spark):
    rows = [(counter(1, 2, 3),), (counter(1, 2),), (counter(1, 2, 9),), (counter(t=4),), (counter(1),)]
    found = spark.createDataFrame(rows, f"u {COUNTER}").select(contributions.precision(F.col("u")).alias("p")).collect()
    assert [r["p"] for r in found] == ["components-exact", "components-exact", "partial", "aggregate-only", "partial"]


def test_prices(spark):
    rows = [("gpt-5-codex",), ("gpt-5.4",), (" GPT_5.4  codex ",), ("my-claude-opus-4-x",), ("other",), ("gpt-5.41",)]
    found = {r["model"]: (r["match_kind"], r["price_id"]) for r in pricing.resolve(spark.createDataFrame(rows, "model string"), pricing.catalogue(spark)).collect()}
    assert found["gpt-5-codex"] == ("family-fallback", "openai-gpt-5")
    assert found[" GPT_5.4  codex "] == ("alias", "openai-gpt-5.4")
    assert found["my-claude-opus-4-x"][1] == "anthropic-claude-opus-4"
    assert found["other"] == found["gpt-5.41"] == ("unmatched", None)
    million = spark.createDataFrame([("gpt-5-codex", 1_000_000, 1_000_000, 0, 1_000_000, 0)], "model string, " + ", ".join(f"{c} long" for c in fn.COUNTERS))
    assert pricing.priced(million, pricing.catalogue(spark)).select((F.col("cost_units") / 1e9).alias("c")).first()["c"] == 11.375


def test_periods_and_presets():
    now = 1_705_752_000_000
    w = periods.comparable("month", now)
    assert (w.current_from, w.previous_from) == (1704067200000, 1701388800000) and w.previous_to - w.previous_from == now + 1 - w.current_from
    assert periods.preset_range("last7", now) == (1705190400000, 1705795200000)
    assert periods.preset_range("custom", now, custom=(5, 4)) == (None, None)
    # the day on which clocks go back has 25 hours
    begin, end = periods.preset_range("today", 1_699_200_000_000, "America/New_York")
    assert end - begin == 25 * 3_600_000


def test_pages_stay_in_range(spark):
    records = spark.createDataFrame([(str(i), i) for i in range(5)], "id string, ts_ms long")
    rows, place = rollup.page(records, 9, 2)
    assert [r["id"] for r in rows.collect()] == ["0"] and place == {"page": 3, "page_size": 2, "total": 5, "total_pages": 3}
    assert rollup.page(records.limit(0), 3, 0)[1] == {"page": 1, "page_size": 1, "total": 0, "total_pages": 1}


def records(spark, *rows):
    base = [(f"{i}", s, f"/{s}/{p}", "x", t, "gpt-5", "p", n, 0, 0, 0, 0) for i, s, p, t, n in rows]
    return spark.createDataFrame(base, streaming.RECORDS)


def cursors(spark, *rows):
    return spark.createDataFrame([(p, s, 1, 1, 5) for p, s in rows], "path string, source string, size long, modified_ms long, version int")


def test_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    first = records(spark, (1, "codex", "a", 0, 10), (2, "codex", "a", 1000, 20))
    assert kept.replace_source("codex", first, cursors(spark, ("/codex/a", "codex"))) == {"record_changes": 2, "cursor_changes": 1}
    assert kept.replace_source("codex", first, cursors(spark, ("/codex/a", "codex"))) == {"record_changes": 0, "cursor_changes": 0}
    other = records(spark, (3, "claude", "b", 0, 5))
    kept.replace_source("claude", other, cursors(spark, ("/claude/b", "claude")))
    assert kept.table("records").count() == 3 and kept.table("buckets").count() == 2
    changed = records(spark, (1, "codex", "a", 0, 11))
    assert kept.replace_source("codex", changed, cursors(spark, ("/codex/a", "codex")), safe=False)["record_changes"] == 0
    assert kept.table("records").count() == 3
    assert kept.replace_source("codex", changed, cursors(spark, ("/codex/a", "codex")))["record_changes"] == 2
    kept.move_file("/codex/a", "/codex/archive/a")
    assert kept.table("records").filter("source_path = '/codex/archive/a'").count() == 1
    with pytest.raises(ValueError, match="RECORD_MISMATCH"):
        kept.replace_source("codex", other, cursors(spark))
    with pytest.raises(ValueError, match="CURSOR_MISMATCH"):
        kept.replace_source("codex", changed, cursors(spark, ("/claude/b", "claude")))
    kept.publish(projects=spark.range(1))
    kept.reset()
    assert kept.table("records") is None and kept.table("projects").count() == 1


def test_needs_scan(spark):
    schema = "path string, size long, modified_ms long, version int"
    known = spark.createDataFrame([("a", 1, 1, 5), ("b", 1, 1, 5), ("c", 1, 1, 4), ("d", 1, 1, 5), ("g", 2, 1, 5)], schema)
    listing = spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 1, 0), ("c", 1, 1, 0), ("e", 1, 1, 0), ("g", 2, 3, 0)], schema)
    assert {r["path"]: r["change"] for r in store.needs_scan(listing, known, 5).collect()} == {"b": "grown", "c": "version", "d": "gone", "e": "new", "g": "changed"}


def test_stream_equals_batch(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    batches = [
        records(spark, (1, "codex", "a", 0, 10), (2, "codex", "a", 1_900_000, 20)),
        records(spark, (3, "claude", "b", 0, 5), (1, "codex", "a", 4_000_000, 11)),
        records(spark, (4, "codex", "a", 5, 7)),
    ]
    for batch in batches:
        batch.write.mode("append").json(str(tmp_path / "in"))
        streaming.run(spark, str(tmp_path / "in"), kept, str(tmp_path / "checkpoint")).awaitTermination()
    want = sorted(map(tuple, rollup.buckets(kept.table("records")).select(*sorted(kept.table("buckets").columns)).collect()))
    assert sorted(map(tuple, kept.table("buckets").select(*sorted(kept.table("buckets").columns)).collect())) == want and len(want) == 4
    assert kept.table("records").count() == 4


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    """A publish fails after its tables are written; the batch comes again, and once more after it was published."""
    kept = store.Store(spark, str(tmp_path / "store"))
    streaming.apply_batch(kept, records(spark, (1, "codex", "a", 0, 10), (2, "codex", "a", 5, 20)), 0)
    before = kept.versions()
    moved = records(spark, (1, "codex", "a", 4_000_000, 11))
    with monkeypatch.context() as m:
        m.setattr(store.json, "dumps", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            streaming.apply_batch(kept, moved, 1)
    assert kept.versions() == before
    for _ in range(2):
        streaming.apply_batch(kept, moved, 1)
        found = {(r["bucket_start"], r["record_count"], r["input_tokens"]) for r in kept.table("buckets").withColumn("bucket_start", F.col("bucket_start").cast("string")).collect()}
        assert sorted(x[1:] for x in found) == [(1, 11), (1, 20)]
    assert kept.marks() == {"records": 1} and kept.table("records").count() == 2
    streaming.apply_batch(kept, records(spark, (2, "codex", "a", 5, 99)), 1)  # a number that has been applied
    assert kept.table("records").agg(F.sum("input_tokens")).first()[0] == 31


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 'a "b", c', None), ("-x", "", "é")], "a string, b string, c string")
    rollup.write_csv(rows.select(*[fn.csv_safe(F.col(c)).alias(c) for c in rows.columns]).coalesce(1), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*")).decode()
    assert text == 'a,b,c\r\n\'=1+1,"a ""b"", c",\r\n\'-x,,é\r\n'


def test_formats(spark):
    one = spark.range(1).select(
        fn.compact_number(F.lit(1_250_000)).alias("a"), fn.compact_number(F.lit(-2000)).alias("b"), fn.redacted(F.lit("/home/jo/x C:\\Users\\jo\\y")).alias("c"),
        fn.fnv1a32(F.lit("")).alias("d"), fn.fnv1a32(F.lit("a")).alias("e"), fn.iso_utc(F.lit(-1)).alias("f"), fn.project_display_name(F.lit("/")).alias("g"),
    ).first()
    assert tuple(one) == ("1.3M", "-2K", "~/x ~\\y", "811c9dc5", "e40c292c", "1969-12-31T23:59:59.999Z", "Unknown project")


def test_counters(spark):
    rows = spark.createDataFrame([("s", 1, 100, None), ("s", 2, 180, 80), ("s", 3, 60, None), ("s", 4, 60, None)], "session string, event_index long, total long, last long")
    found = counters.contributions(rows, ["session"], ["event_index"]).orderBy("event_index").collect()
    assert [(r["method"], r["tokens"]) for r in found] == [("total-initial", 100), ("last", 80), ("total-reset", 60), ("duplicate-zero", 0)]


@pytest.mark.parametrize("name", ["bucket_rollup", "session_summaries", "fork_cycles", "activity_streaks"])
def test_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_reconcile_gathers_no_file_in_a_row(spark):
    files = spark.createDataFrame([("a", "s", None, False), ("b", "s", None, False), ("c", "t", None, False), ("d", "t", None, True)], "path string, session string, parent string, archived boolean")
    rows = [(p, i, f"e{i}" if (p, i) != ("b", 480) else "x") for p, n in (("a", 500), ("b", 490), ("c", 300), ("d", 200)) for i in range(n)]
    found = lineage.reconcile(files, spark.createDataFrame(rows, "path string, event_index long, identity string"))
    assert {r["path"]: r["status"] for r in found.collect()} == {"a": "divergent-events", "b": "divergent-events", "c": "kept", "d": "prefix-shadowed"}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_discovery(spark, tmp_path):
    (tmp_path / ".codex" / "sessions" / "deep").mkdir(parents=True)
    (tmp_path / ".claude").mkdir()
    found = {r["source"]: (r["status"], r["installed"], r["data_available"]) for r in discovery.detected(spark, str(tmp_path)).collect()}
    assert found == {"claude": ("Ready", True, False), "codex": ("Ready", True, False)}
    head = {"type": "session_meta", "payload": {"id": " one ", "forked_from_id": "zero"}}
    lines = [{"type": "other"}, head, {"type": "session_meta", "payload": {"id": "two"}}]
    (tmp_path / ".codex" / "sessions" / "deep" / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    (tmp_path / ".codex" / "sessions" / "b.JSONL").write_text(json.dumps({"type": "session_meta", "sessionId": "flat"}) + "\n")
    (tmp_path / ".codex" / "sessions" / "c.jsonl").write_text(json.dumps(head))  # a line that isn't ended
    found = {r["source"]: r["status"] for r in discovery.detected(spark, str(tmp_path)).collect()}
    assert found == {"claude": "Ready", "codex": "Active"}
    heads = discovery.session_heads(jsonl.files(spark, discovery.roots(str(tmp_path), "codex"))).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["session_id"], r["parent_id"]) for r in heads} == {
        "a.jsonl": ("one", "zero"), "b.JSONL": ("flat", None), "c.jsonl": (None, None),
    }


def test_one_files_scan_is_committed(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    cursor = spark.createDataFrame([("codex", "/codex/a", 7)], "source string, path string, size long")
    assert kept.commit_scan("codex", "/codex/a", records(spark, (1, "codex", "a", 0, 10), (2, "codex", "a", 5, 20)), cursor) == 2
    assert kept.commit_scan("codex", "/codex/a", records(spark, (2, "codex", "a", 5, 20), (3, "codex", "a", 6, 1)), cursor) == 1
    assert kept.commit_scan("codex", "/codex/a", records(spark, (9, "codex", "a", 6, 4)), cursor, replace=True) == 4
    assert [r["id"] for r in kept.table("records").collect()] == ["9"] and kept.table("cursors").count() == 1
    assert kept.table("buckets").agg(F.sum("input_tokens")).first()[0] == 4


def test_rebuild_and_diagnostics(spark):
    found = audits.rebuild_difference(records(spark, (1, "codex", "a", 0, 10)), records(spark, (1, "codex", "a", 0, 10), (2, "codex", "a", 0, 5))).first()
    assert (found["records_difference"], found["tokens_difference"], found["tokens_percent"]) == (1, 5, 50.0)
    rows = spark.createDataFrame([(i, "warn", f"/home/jo/{i}", None) for i in range(6)], "ts_ms long, level string, message string, source string")
    assert [r["message"] for r in audits.recent_diagnostics(rows, 2).collect()] == ["~/5", "~/4"]


def test_replays_share_an_identity_and_contradict_none(spark):
    from pyspark.sql import functions as F

    from ledgerspark.operators import lineage

    event = "ts_ms long, response_id string, turn_id string, model string, precision string, usage struct<a:long,b:long>, tokens long"
    base = (7, "r", "u", "m", "components-exact", (1, 2), 3)

    def changed(**values):
        names = [x.split()[0] for x in event.replace("struct<a:long,b:long>", "x").split(", ")]
        return tuple(values.get(n, v) for n, v in zip(names, base, strict=True))

    cases = [
        (changed(), True),
        (changed(response_id=None), True),
        (changed(response_id=""), True),
        (changed(response_id=None, turn_id=None), False),
        (changed(turn_id="other"), False),
        (changed(model=None), True),
        (changed(model="n"), False),
        (changed(usage=(2, 1)), False),
        (changed(usage=(2, 1), precision="aggregate-exact"), True),
        (changed(precision="partial"), False),
        (changed(ts_ms=8), False),
        (changed(ts_ms=None), False),
    ]
    held = "struct<" + ", ".join(x.replace(" ", ":", 1) for x in event.split(", ")) + ">"
    rows = spark.createDataFrame([(i, c, base) for i, (c, _) in enumerate(cases)], f"i int, c {held}, p {held}")
    got = {r["i"]: r["same"] for r in rows.select("i", lineage.same_contribution("c", "p").alias("same")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_overlap_passes(spark):
    from ledgerspark.operators import matching

    side = "id string, session string, ts_ms long, response_id string, turn_id string, usage struct<a:long,b:long>, tokens long, counted boolean"
    payloads = [
        ("by response", "s", 0, "r1", None, (1, 2), 3, True),
        ("other figures", "s", 0, "r2", None, (5, 5), 10, True),
        ("narrowed", "s", 0, "r3", None, (4, 4), 8, True),
        ("near", "n", 1000, None, None, (7, 1), 8, True),
        ("wide", "w", 9000, None, None, (7, 1), 8, True),
        ("weak", "k", 0, None, None, (7, 1), 8, True),
        ("twin a", "t", 0, None, "u", (1, 1), 2, True),
        ("twin b", "t", 0, None, "u", (1, 1), 2, True),
        ("no time", "n", None, None, "", (7, 1), 8, True),
    ]
    tokens = [
        ("1", "s", 99_999, "r1", None, (1, 2), 3, True),
        ("2", "s", None, "r2", None, (5, 6), 11, True),
        ("3", "s", None, "r3", None, (4, 4), 8, True),
        ("4", "s", None, "r3", None, (4, 5), 9, True),
        ("5", "n", 0, None, "", (7, 1), 8, True),
        ("6", "w", 0, None, None, (7, 1), 8, True),
        ("7", "k", 0, None, None, (1, 7), 8, True),
        ("8", "t", 0, None, "u", (1, 1), 2, True),
    ]
    found = matching.overlap_audit(spark.createDataFrame(payloads, side), spark.createDataFrame(tokens, side)).collect()
    assert {r["id"]: (r["matched_id"], r["duplicate_class"]) for r in found} == {
        "by response": ("1", "confirmed"),
        "other figures": ("2", "linked-different-usage"),
        "narrowed": ("3", "confirmed"),
        "near": ("5", "probable"),
        "wide": ("6", "possible"),
        "weak": ("7", "weak-candidate"),
        "twin a": (None, "ambiguous"),
        "twin b": (None, "ambiguous"),
        "no time": (None, "unmatched"),
    }
