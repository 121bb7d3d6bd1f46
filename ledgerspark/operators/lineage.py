"""Duplicates, forks and replays of ordered events, as joins and windows over sets of sessions.

Nothing depends on the order in which sessions are looked at, so no step walks a graph but the search for
cycles, which follows one parent a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import small, stored
from .counters import first_by


def raw_unique(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each raw identity."""
    return first_by(events, keys, order)


def duplicate_groups(events: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Identities that occur more than once: how often, first and last place."""
    grouped = events.groupBy(*keys).agg(F.count("*").alias("n"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    return grouped.filter("n > 1")


def semantic_duplicates(events: DataFrame) -> DataFrame:
    """From events (session, event_index, ts_ms, total, last, fingerprint, response_id, model): which are suppressed.

    Events of one session, time and total are one group with its first event as hub. A row with the hub's fingerprint
    is a confirmed duplicate; else it is strong if it shares the hub's response, and conflicting if responses
    or models differ; the rest are probable. Confirmed and strong ones are suppressed."""
    known = events.filter("total is not null and ts_ms is not null")
    group = ["session", "ts_ms", "total"]
    hub = known.groupBy(*group).agg(
        F.min("event_index").alias("hub_index"),
        F.min_by(F.struct("fingerprint", "response_id", "model"), "event_index").alias("hub"),
        F.count("*").alias("group_size"),
    )
    rows = known.join(hub, group).filter("event_index > hub_index")

    def differ(name: str) -> Column:
        own, other = F.col(name), F.col(f"hub.{name}")
        return own.isNotNull() & other.isNotNull() & (own != other)

    shared = F.col("response_id").isNotNull() & (F.col("response_id") == F.col("hub.response_id"))
    evidence = (
        F.when(differ("response_id") | differ("model"), "conflict")
        .when(F.col("fingerprint") == F.col("hub.fingerprint"), "confirmed")
        .when(shared, "strong")
        .otherwise("probable")
    )
    return rows.select("session", "event_index", "hub_index", "group_size", evidence.alias("evidence")).withColumn(
        "suppressed", F.col("evidence").isin("confirmed", "strong")
    )


def evidence_summary(duplicates: DataFrame) -> DataFrame:
    return duplicates.groupBy("evidence").agg(F.count("*").alias("n"), F.count_if("suppressed").alias("n_suppressed"))


def fork_baselines(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """From sessions (session, parent, fork_ms) and events (session, event_index, ts_ms, total): the parent's last total
    strictly before the fork, and how a child starts from it.

    An as-of join: parents' events meet only the children that fork from them, and the latest is a grouped maximum."""
    children = sessions.filter("parent is not null")
    totals = events.filter("total is not null and ts_ms is not null").select(
        F.col("session").alias("parent"), F.col("ts_ms").alias("_ts"), F.col("event_index").alias("_index"), F.col("total").alias("_total")
    )
    met = children.join(totals, "parent").filter(F.col("_ts") < F.col("fork_ms"))
    best = met.groupBy("session").agg(F.max_by(F.struct("_ts", "_index", "_total"), F.struct("_ts", "_index")).alias("c"))
    own = events.filter("total is not null").groupBy("session").agg(F.min_by("total", "event_index").alias("first_total"))
    early = events.join(children.select("session", "fork_ms"), "session").filter("ts_ms < fork_ms and (total is not null or last is not null)")
    early = early.select("session").distinct().withColumn("_replays", F.lit(True))
    known = sessions.select(F.col("session").alias("parent")).distinct().withColumn("_known", F.lit(True))
    rows = children.join(known, "parent", "left").join(early, "session", "left").join(best, "session", "left").join(own, "session", "left")
    status = (
        F.when(F.col("_known").isNull(), "missing-parent")
        .when(F.col("fork_ms").isNull(), "missing-fork-timestamp")
        .when(F.col("_replays").isNotNull(), "explicit-replay")
        .when(F.col("c").isNull(), "missing-parent-checkpoint")
        .when(F.col("first_total").isNull(), "not-needed")
        .when(F.col("first_total") < F.col("c._total"), "child-counter-reset")
        .otherwise("resolved")
    )
    return rows.select(
        "session", "parent", status.alias("status"), F.col("c._index").alias("checkpoint_index"), F.col("c._total").alias("checkpoint_total")
    )


def replay_prefix(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """From sessions (session, parent, fork_ms) and rows (session, event_index, ts_ms, response_id, tokens): the rows of a
    child from before its fork that repeat its parent's, one by one, up to the first that doesn't."""
    children = sessions.filter("parent is not null and fork_ms is not null").select("session", "parent", "fork_ms")
    number = F.row_number().over(Window.partitionBy("session").orderBy("ts_ms", "event_index"))
    child = rows.join(children, "session").filter("ts_ms < fork_ms").withColumn("n", number)
    per_child = F.row_number().over(Window.partitionBy("child").orderBy("p_ts", "p_index"))
    parent = children.select(F.col("session").alias("child"), "parent", "fork_ms").join(
        rows.select(
            F.col("session").alias("parent"), F.col("event_index").alias("p_index"), F.col("ts_ms").alias("p_ts"),
            F.col("response_id").alias("p_response"), F.col("tokens").alias("p_tokens"),
        ),
        "parent",
    )
    parent = parent.filter("p_ts < fork_ms").withColumn("n", per_child).drop("parent", "fork_ms")
    zipped = child.join(parent, (child["session"] == parent["child"]) & (child["n"] == parent["n"]), "left").drop(parent["n"])
    same = (F.col("ts_ms") == F.col("p_ts")) & (F.col("response_id") == F.col("p_response")) & (F.col("tokens") == F.col("p_tokens"))
    matched = F.coalesce(same, F.lit(False)).cast("int")
    so_far = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return zipped.withColumn("suppressed", F.min(matched).over(so_far) == 1).select("session", "event_index", "n", "suppressed")


def compatible_identity(child: str, parent: str) -> Column:
    """Whether two events (structs with response_id, turn_id) share a response or a turn and contradict each other in neither."""
    same, differ = F.lit(False), F.lit(False)
    for name in ("response_id", "turn_id"):
        one, other = (F.nullif(F.col(f"{x}.{name}"), F.lit("")) for x in (child, parent))
        same = same | F.coalesce(one == other, F.lit(False))
        differ = differ | F.coalesce(one != other, F.lit(False))
    return same & ~differ


def same_contribution(child: str, parent: str) -> Column:
    """Whether two contributions (structs with ts_ms, response_id, turn_id, model, precision, usage, tokens) are the same one: of one time,
    of compatible identity, of no two models, neither partial, with equal components if both have them exactly, else equal totals."""
    c, p = (lambda name: F.col(f"{child}.{name}")), (lambda name: F.col(f"{parent}.{name}"))
    models = (F.coalesce(c("model"), F.lit("")) == "") | (F.coalesce(p("model"), F.lit("")) == "") | (c("model") == p("model"))
    exact = (c("precision") == "components-exact") & (p("precision") == "components-exact")
    figures = F.when(exact, c("usage").eqNullSafe(p("usage"))).otherwise(c("tokens") == p("tokens"))
    whole = (c("precision") != "partial") & (p("precision") != "partial")
    return F.coalesce((c("ts_ms") == p("ts_ms")) & compatible_identity(child, parent) & models & whole & figures, F.lit(False))


def replayed_contributions(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """As replay_prefix, on contributions (session, event_index and what same_contribution reads): event_index, n and whether the row and all
    before it are the parent's, one by one."""
    children = sessions.filter("parent is not null and fork_ms is not null").select("session", "parent", "fork_ms")
    content = F.struct(*[c for c in rows.columns if c != "session"])
    held = rows.select("session", content.alias("c"))
    number = F.row_number().over(Window.partitionBy("session").orderBy("c.ts_ms", "c.event_index"))
    child = held.join(children, "session").filter("c.ts_ms < fork_ms").withColumn("n", number).select("session", "c", "n")
    parent = children.join(held.select(F.col("session").alias("parent"), F.col("c").alias("p")), "parent").filter("p.ts_ms < fork_ms")
    number = F.row_number().over(Window.partitionBy("session").orderBy("p.ts_ms", "p.event_index"))
    zipped = child.join(parent.withColumn("n", number).select("session", "n", "p"), ["session", "n"], "left")
    so_far = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suppressed = F.min(same_contribution("c", "p").cast("int")).over(so_far) == 1
    return zipped.select("session", F.col("c.event_index").alias("event_index"), "n", suppressed.alias("suppressed"))


def cycles(sessions: DataFrame) -> DataFrame:
    """Sessions that reach themselves over their parents.

    Each round doubles a jump to an ancestor. Once it is longer than there are sessions, whoever still has an ancestor
    that far up hangs from a cycle, and the ancestors are just the sessions on cycles."""
    jump = sessions.filter("parent is not null").groupBy("session").agg(F.min("parent").alias("up"))
    for _ in range(sessions.count().bit_length()):
        above = jump.select(F.col("session").alias("up"), F.col("up").alias("next"))
        jump = stored(jump.join(above, "up").select("session", F.col("next").alias("up")))
    return jump.select(F.col("up").alias("session")).distinct()


#: What becomes of a session's start, not-fork and the two that only a graph tells among them.
FORK_STATUSES = (
    "not-fork", "conflicting-parent", "cycle", "missing-parent", "missing-fork-timestamp", "explicit-replay", "missing-parent-checkpoint",
    "not-needed", "missing-child-total-timestamp", "child-counter-reset", "incomparable", "resolved",
)


def fork_graph(sessions: DataFrame) -> DataFrame:
    """From sessions (session, parent, fork_ms), of which several may be of one session: a row a session with parent, fork_ms and state: not-fork,
    conflicting-parent (several parents are named), cycle, missing-parent or fork. Of several rows the first by parent and time stands."""
    order = F.struct(F.coalesce("parent", F.lit("")).alias("p"), F.coalesce("fork_ms", F.lit(2**62)).alias("f"))
    one = sessions.groupBy("session").agg(F.min_by(F.struct("parent", "fork_ms"), order).alias("s"), F.count_distinct("parent").alias("n_parents"))
    one = one.select("session", "s.parent", "s.fork_ms", "n_parents")
    known = one.select(F.col("session").alias("parent"), F.lit(True).alias("_known"))
    edges = one.filter("n_parents = 1").join(known, "parent", "left_semi").select("session", "parent")
    on_cycle = cycles(edges).withColumn("_cycle", F.lit(True))
    rows = one.join(known, "parent", "left").join(on_cycle, "session", "left")
    state = (
        F.when(F.col("n_parents") > 1, "conflicting-parent")
        .when(F.col("parent").isNull(), "not-fork")
        .when(F.col("_cycle").isNotNull(), "cycle")
        .when(F.col("_known").isNull(), "missing-parent")
        .otherwise("fork")
    )
    return rows.select("session", "parent", "fork_ms", state.alias("state"))


def canonical_cycles(sessions: DataFrame) -> DataFrame:
    """(first, members): each cycle of parents once, from its smallest session on, parent after child.

    Sessions of a cycle find its smallest one, and how many steps off it is, by jumps that double; a cycle is gathered only as the row it is."""
    on = stored(cycles(sessions))
    step = sessions.join(on, "session", "left_semi").groupBy("session").agg(F.min("parent").alias("up"))
    step = stored(step)
    # over 2**k steps: where they lead, and the smallest session among those passed, the start included, with how many steps it takes to it
    jump = step.select("session", "up", F.struct(F.col("session").alias("s"), F.lit(0).cast("long").alias("n")).alias("least"))
    for k in range(step.count().bit_length()):
        ahead = jump.select(F.col("session").alias("up"), F.col("up").alias("next"), F.col("least").alias("their"))
        later = F.struct(F.col("their.s").alias("s"), (F.col("their.n") + 2**k).alias("n"))
        jump = stored(jump.join(ahead, "up").select("session", F.col("next").alias("up"), F.least("least", later).alias("least")))
    size = jump.groupBy(F.col("least.s").alias("first")).agg(F.count("*").alias("size"))
    placed = jump.select(F.col("least.s").alias("first"), "session", F.col("least.n").alias("to_go")).join(size, "first")
    order = F.struct(F.pmod(F.col("size") - F.col("to_go"), F.col("size")).alias("at"), "session")
    return placed.groupBy("first").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["session"]).alias("members"))


def reconcile(files: DataFrame, events: DataFrame) -> DataFrame:
    """From files (path, session, parent, archived, and fork_ms if there is one) and events (path, event_index, identity): what becomes of each file.

    Files of one session must agree on the parent, and on when it forked where they tell. If all have the same events, the first that isn't archived stays;
    if all are prefixes of the longest, that stays; else the session is in conflict."""
    each = files.join(events.groupBy("path").agg(F.count("*").alias("n")), "path", "left").fillna(0, ["n"])
    if "fork_ms" not in files.columns:
        each = each.withColumn("fork_ms", F.lit(None).cast("long"))
    base = F.min_by(F.struct("fork_ms"), F.struct("archived", "path"))["fork_ms"]
    own = each.groupBy("session").agg(
        (base.isNotNull() & (F.coalesce(F.min("fork_ms") < base, F.lit(False)) | F.coalesce(F.max("fork_ms") > base, F.lit(False)))).alias("forks_differ"),
        F.min_by("path", F.struct("archived", "path")).alias("first"),
        F.min_by("path", F.struct((-F.col("n")).alias("n"), "archived", "path")).alias("longest"),
        (F.count_distinct(F.coalesce("parent", F.lit(""))) > 1).alias("parents_differ"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.count("*").alias("n_files"),
    )
    rows = stored(each.join(own, "session", "left"))
    # only files of sessions that have several are set beside each other; there events meet those of the longest file by number, so no
    # file's events are gathered in one row
    shared = rows.filter(F.col("n_files") > 1).select("path", "longest")
    numbered = events.join(small(shared.select("path")), "path", "left_semi")
    numbered = numbered.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("event_index", "identity")))
    theirs = numbered.select(F.col("path").alias("longest"), "at", F.col("identity").alias("theirs"))
    asked = shared.join(numbered, "path").join(theirs, ["longest", "at"])
    equal = asked.groupBy("path").agg(F.count_if(F.col("identity").eqNullSafe(F.col("theirs"))).alias("n_equal"))
    verdict = rows.join(equal, "path", "left").withColumn("prefix", (F.col("n_files") == 1) | (F.coalesce("n_equal", F.lit(0)) == F.col("n")))
    agreed = verdict.groupBy("session").agg(F.bool_and("prefix").alias("all_prefixes"))
    rows = verdict.join(agreed, "session", "left")
    status = (
        F.when(F.col("session").isNull(), "orphan")
        .when(F.col("parents_differ") | F.col("forks_differ"), "metadata-conflict")
        .when(~F.col("all_prefixes"), "divergent-events")
        .when(F.col("least") == F.col("most"), F.when(F.col("path") == F.col("first"), "kept").otherwise("exact-duplicate"))
        .when(F.col("path") == F.col("longest"), "kept")
        .otherwise("prefix-shadowed")
    )
    return rows.select("path", "session", F.col("n").cast("long").alias("n_events"), status.alias("status"))


def preferred_files(files: DataFrame) -> DataFrame:
    """Of each session the largest file, then the newest, archived before live, then by path."""
    order = F.struct((-F.col("size")).alias("a"), (-F.col("modified_ms")).alias("b"), (~F.col("archived")).alias("c"), F.col("path").alias("d"))
    best = files.groupBy("session").agg(F.min_by("path", order).alias("winner"))
    return files.join(best, "session").select("session", "path", (F.col("path") == F.col("winner")).alias("preferred"))
