"""What a step moves and keeps: wide rows only where they are asked for, partitions in proportion to rows."""

from pyspark.sql import functions as F

from ledgerspark.functions import store
from ledgerspark.operators import duplicates, flow, lineage

_COUNTER = "struct<input: bigint, cached: bigint, creation: bigint, output: bigint, reasoning: bigint, total: bigint>"


def _counters(n):
    return f"cast(named_struct('input', {n}, 'cached', null, 'creation', null, 'output', 0, 'reasoning', null, 'total', {n}) as {_COUNTER})"


def test_only_events_of_pairs_are_carried_whole(spark, monkeypatch):
    """1,000 events of which two are copies of others."""
    tokens = spark.range(1000).selectExpr(
        "'s' as session", "'log' as path", "id as event_index", "concat('e', id) as raw_identity", "if(id in (500, 501), 'f7', concat('f', id)) as raw_fingerprint",
        "'x' as semantic_fingerprint", "1000 * id as ts_ms", "cast(null as string) as response_id", "cast(null as string) as turn_id", "'m' as model",
        _counters("id") + " as last", _counters("id") + " as total",
    )
    whole = []

    def spied(df):
        out = store.stored(df)
        if "e" in df.columns:
            whole.append(out.count())
        return out

    monkeypatch.setattr(duplicates, "stored", spied)
    found = duplicates.evidence(tokens).select("primary_event_index", "candidate_event_index").collect()
    assert sorted(map(tuple, found)) == [(7, 500), (7, 501)]
    assert whole == [3]


def test_partitions_follow_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with store.dealt(spark, 100 * store.TASK_ROWS):
        assert int(spark.conf.get(name)) == 100
    with store.dealt(spark, 1):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before


def test_partitions_follow_rows_where_nobody_has_set_them(spark):
    """F3 to F10: a session without a number of partitions of its own has Spark's default."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        default = int(spark.conf.get(name))
        with store.dealt(spark, (default + 1) * store.TASK_ROWS):
            assert int(spark.conf.get(name)) == default + 1
        with store.dealt(spark, 1):
            assert int(spark.conf.get(name)) == default
        assert spark.conf.get(name, None) is None
    finally:
        spark.conf.set(name, before)


def test_files_that_are_alone_are_not_numbered(spark, monkeypatch):
    """F7 to F9: only sessions with several files have their events set beside each other; nothing of the others is shuffled for it."""
    files = spark.createDataFrame([("a", "s", None, False), ("b", "t", None, False), ("c", "t", None, False)], "path string, session string, parent string, archived boolean")
    events = spark.createDataFrame([(p, i, f"e{i}") for p, n in (("a", 50), ("b", 3), ("c", 2)) for i in range(n)], "path string, event_index long, identity string")
    asked = []
    monkeypatch.setattr(lineage, "small", lambda df, *_: asked.append(sorted(r["path"] for r in df.collect())) or df)
    got = {r["path"]: (r["n_events"], r["status"]) for r in lineage.reconcile(files, events).collect()}
    assert got == {"a": (50, "kept"), "b": (3, "kept"), "c": (2, "prefix-shadowed")}
    assert asked == [["b", "c"]]


def test_counts_wait_until_they_are_asked_for(spark):
    counts = spark.createDataFrame([("tokens.unresolved", 2)], "name string, n long")
    found = flow.Flow(None, None, None, None, None, None, [counts], {}, 1)
    assert "diagnostics" not in found.__dict__
    assert {r["gate"]: r["n_broken"] for r in found.gates.filter(F.col("n_broken") > 0).collect()} == {"tokenCountCompleteness": 2}
