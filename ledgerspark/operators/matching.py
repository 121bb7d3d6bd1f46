"""Matching of two streams of usage: by key, by response, by time, and of two snapshots by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored

NEAR_MS = 1000
WIDE_MS = 10_000


def _one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of which neither side occurs in another pair."""
    n_left = F.count("*").over(Window.partitionBy(left))
    n_right = F.count("*").over(Window.partitionBy(right))
    found = pairs.withColumn("_l", n_left).withColumn("_r", n_right).filter("_l = 1 and _r = 1")
    return found.drop("_l", "_r")


def payload_fallback(payloads: DataFrame, tokens: DataFrame) -> DataFrame:
    """From payloads and tokens (id, session, key, response_id, model, tokens): what each payload is.

    First the same key with the same figures and no other model, then the same response with the same figures, where
    both are unique; tokens that the first pass used are out of the second. Of the rest, zeros are ignored and others
    counted."""

    def sided(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "session", "key", "response_id", "model", "tokens")])

    p, t = sided(payloads, "p"), sided(tokens, "t")
    same_session, equal = F.col("p_session") == F.col("t_session"), F.col("p_tokens") == F.col("t_tokens")
    models = F.col("p_model").isNull() | F.col("t_model").isNull() | (F.col("p_model") == F.col("t_model"))
    by_key = p.join(t, same_session & (F.col("p_key") == F.col("t_key")) & equal & models).select("p_id", "t_id")
    by_key = _one_to_one(by_key, "p_id", "t_id").withColumn("outcome", F.lit("same-event"))
    p2 = p.join(by_key.select("p_id"), "p_id", "left_anti")
    t2 = t.join(by_key.select("t_id"), "t_id", "left_anti")
    by_response = p2.join(t2, same_session & (F.col("p_response_id") == F.col("t_response_id")) & equal).select("p_id", "t_id")
    by_response = _one_to_one(by_response, "p_id", "t_id").withColumn("outcome", F.lit("same-response"))
    matched = by_key.unionByName(by_response)
    rest = F.when(F.col("p_tokens") == 0, "ignored-zero").otherwise("fallback")
    joined = p.join(matched, "p_id", "left").select(
        F.col("p_id").alias("id"), F.col("t_id").alias("matched_id"), F.coalesce("outcome", rest).alias("outcome"), F.col("p_tokens").alias("tokens")
    )
    return joined.withColumn("counted", F.col("outcome") == "fallback")


def overlap(payloads: DataFrame, tokens: DataFrame) -> DataFrame:
    """From payloads and tokens (id, session, ts_ms, tokens): pairs of one session and figure, unique on either side, within
    a second ("near"), or else within ten ("wide").

    Times are joined by blocks of the window's width, so a busy session meets its neighbours in time only."""
    found = None
    left, right = payloads, tokens
    for name, least, most in (("near", 0, NEAR_MS), ("wide", NEAR_MS + 1, WIDE_MS)):
        width = most + 1
        p = left.select(F.col("id").alias("p_id"), "session", "tokens", F.col("ts_ms").alias("p_ts"))
        t = right.select(F.col("id").alias("t_id"), "session", "tokens", F.col("ts_ms").alias("t_ts"))
        block = F.floor(F.col("p_ts") / width)
        p = p.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        t = t.withColumn("block", F.floor(F.col("t_ts") / width))
        pairs = p.join(t, ["session", "tokens", "block"]).withColumn("gap_ms", F.abs(F.col("p_ts") - F.col("t_ts")))
        pairs = pairs.filter(F.col("gap_ms").between(least, most)).select("p_id", "t_id", "session", "tokens", "gap_ms")
        pairs = _one_to_one(pairs, "p_id", "t_id").withColumn("evidence", F.lit(name))
        found = pairs if found is None else found.unionByName(pairs)
        left = left.join(pairs.select(F.col("p_id").alias("id")), "id", "left_anti")
        right = right.join(pairs.select(F.col("t_id").alias("id")), "id", "left_anti")
    return found


#: The passes of the overlap audit in their order, each with how sure a link by it is.
PASSES = {
    "same-response-id": "exact",
    "same-turn-id": "probable",
    "exact-usage-near-time": "probable",
    "exact-usage-wide-time": "possible",
    "same-total-near-time": "weak",
}


def _candidates(p: DataFrame, t: DataFrame, evidence: str) -> DataFrame:
    """Pairs of payloads and tokens that may be one by a pass, with whether their usage is equal and how far apart they are."""
    exact = F.col("p_usage").eqNullSafe(F.col("t_usage"))
    keys = {"same-response-id": ["response_id"], "same-turn-id": ["turn_id"], "same-total-near-time": ["tokens"]}.get(evidence, ["usage"])
    on = (F.col("p_session") == F.col("t_session")) & (F.col(f"p_{keys[0]}") == F.col(f"t_{keys[0]}"))
    gap = F.abs(F.col("p_ts_ms") - F.col("t_ts_ms"))
    if keys[0] in ("response_id", "turn_id"):
        pairs = p.filter(F.col(f"p_{keys[0]}") != "").join(t, on)
    else:
        least, most = {"exact-usage-near-time": (0, NEAR_MS), "exact-usage-wide-time": (NEAR_MS + 1, WIDE_MS)}.get(evidence, (0, WIDE_MS))
        block = F.floor(F.col("p_ts_ms") / (most + 1))
        p = p.withColumn("p_block", F.explode(F.array(block - 1, block, block + 1)))
        t = t.filter("t_counted").withColumn("t_block", F.floor(F.col("t_ts_ms") / (most + 1)))
        pairs = p.join(t, on & (F.col("p_block") == F.col("t_block"))).filter(gap.between(least, most))
        if evidence == "same-total-near-time":
            pairs = pairs.filter(~exact)
    relation = F.when(exact, "same-components").when(F.col("p_tokens") == F.col("t_tokens"), "same-total-different-components").otherwise("different")
    return pairs.select("p_id", "t_id", relation.alias("relation"), gap.alias("gap_ms"))


def overlap_audit(payloads: DataFrame, tokens: DataFrame) -> DataFrame:
    """From payloads and tokens (id, session, ts_ms, response_id, turn_id, usage, tokens, counted): what each payload repeats.

    Five passes, the surest first; a pass links a payload and a token of one session where neither has another
    candidate, and takes both out of later passes. By response or turn, the only candidate with equal usage goes before
    others; by time, tokens must have counted. A payload that had candidates has only those in later passes, and
    is ambiguous if none links it. The class follows from how sure the link is and whether the usage is equal.

    Result: id, matched_id, evidence, confidence, relation, gap_ms, duplicate_class. Times meet by blocks. Rows of one response or
    turn of a session meet each other. An empty or null response or turn, or a null time, makes no candidates."""
    names = ("id", "session", "ts_ms", "response_id", "turn_id", "usage", "tokens", "counted")
    p, t = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for x, side in ((payloads, "p"), (tokens, "t")))
    found = domain = unsure = None
    for evidence, confidence in PASSES.items():
        pairs = _candidates(p, t, evidence)
        if domain is not None:
            free = pairs.join(domain.select("p_id").distinct(), "p_id", "left_anti")
            pairs = free.unionByName(pairs.join(domain.select("p_id", "t_id"), ["p_id", "t_id"], "left_semi").select(*free.columns))
        if evidence in ("same-response-id", "same-turn-id"):
            equal = F.col("relation") == "same-components"
            n_equal = F.count_if(equal).over(Window.partitionBy("p_id"))
            pairs = pairs.withColumn("n_equal", n_equal).filter((F.col("n_equal") != 1) | equal).drop("n_equal")
        pairs = stored(pairs)
        links = stored(_one_to_one(pairs, "p_id", "t_id").withColumns({"evidence": F.lit(evidence), "confidence": F.lit(confidence)}))
        left = pairs.join(links.select("p_id"), "p_id", "left_anti").select("p_id", "t_id")
        tried = left.select("p_id").distinct().withColumn("tried", F.lit(evidence))
        if found is None:
            found, domain, unsure = links, left, tried
        else:
            domain = stored(left.unionByName(domain.join(pairs.select("p_id").distinct(), "p_id", "left_anti")))
            unsure = stored(unsure.unionByName(tried.join(unsure, "p_id", "left_anti")))  # the first that fails stands
            found = found.unionByName(links)
        p = p.join(links.select("p_id"), "p_id", "left_anti")
        t = t.join(links.select("t_id"), "t_id", "left_anti")
    rows = payloads.select(F.col("id").alias("p_id")).join(found, "p_id", "left").join(unsure, "p_id", "left")
    confidence = F.coalesce("confidence", F.when(F.col("tried").isNotNull(), "ambiguous").otherwise("unmatched"))
    duplicate = (
        F.when(F.col("confidence").isin("ambiguous", "unmatched"), F.col("confidence"))
        .when(F.col("confidence") == "weak", "weak-candidate")
        .when(F.col("relation") != "same-components", "linked-different-usage")
        .when(F.col("confidence") == "exact", "confirmed")
        .otherwise(F.col("confidence"))
    )
    rows = rows.select(
        F.col("p_id").alias("id"), F.col("t_id").alias("matched_id"), F.coalesce("evidence", "tried", F.lit("none")).alias("evidence"),
        confidence.alias("confidence"), F.coalesce("relation", F.lit("unknown")).alias("relation"), "gap_ms",
    )
    return rows.withColumn("duplicate_class", duplicate)


def overlap_classes(payloads: DataFrame, audit: DataFrame) -> DataFrame:
    """By duplicate class: payloads and their tokens."""
    return audit.join(payloads.select("id", "tokens"), "id").groupBy("duplicate_class").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))


#: The classes of duplicates.
CLASSES = ("confirmed", "probable", "possible", "linked-different-usage", "weak-candidate", "ambiguous", "unmatched")


def overlap_dimensions(payloads: DataFrame, audit: DataFrame) -> DataFrame:
    """(dimension, value, n, tokens) of audited payloads by class, confidence, evidence, relation and semantic type, in one pass; what is absent is `unknown`."""
    rows = audit.join(payloads.select("id", "tokens", "semantic_type"), "id")
    names = ("duplicate_class", "confidence", "evidence", "relation", "semantic_type")
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(n, F.lit("unknown")).alias("value")) for n in names])
    return rows.select(F.explode(pairs).alias("p"), "tokens").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))


def _by_class(name: str = "tokens") -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("duplicate_class") == c, F.col(name))), F.lit(0)).cast("long").alias(f"{c.replace('-', '_')}_tokens") for c in CLASSES]


def overlap_by_model(payloads: DataFrame, audit: DataFrame) -> DataFrame:
    """By model: audited payloads, their tokens, and these by class."""
    rows = audit.join(payloads.select("id", "tokens", F.coalesce("model", F.lit("unknown")).alias("model")), "id")
    return rows.groupBy("model").agg(F.count("*").alias("payloads"), F.sum("tokens").cast("long").alias("payload_tokens"), *_by_class())


def overlap_by_day(payloads: DataFrame, tokens: DataFrame, audit: DataFrame) -> DataFrame:
    """By day (UTC): tokens of token counts, of all payloads (with eligible), of those audited, and these by class. Rows without a time have no day."""
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day")
    seen = payloads.join(audit.select("id", "duplicate_class"), "id", "left").select(day, "tokens", "eligible", "duplicate_class", F.lit(True).alias("payload"))
    counts = tokens.select(day, "tokens", F.lit(False).alias("eligible"), F.lit(None).cast("string").alias("duplicate_class"), F.lit(False).alias("payload"))

    def of(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("tokens"))), F.lit(0)).cast("long").alias(name)

    wanted = [of(~F.col("payload"), "token_count_tokens"), of(F.col("payload"), "observed_tokens"), of(F.col("eligible"), "eligible_tokens")]
    return seen.unionByName(counts).filter("day is not null").groupBy("day").agg(*wanted, *_by_class())


def overlap_summary(payloads: DataFrame, tokens: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: payloads observed, eligible and shadowed, token counts, what links cover, and whether all eligible payloads were classed once."""
    rows = payloads.join(audit.select("id", "duplicate_class", "confidence"), "id", "left")

    def count(condition: Column, name: str) -> list[Column]:
        return [F.count_if(condition).alias(f"{name}_events"), F.coalesce(F.sum(F.when(condition, F.col("tokens"))), F.lit(0)).cast("long").alias(f"{name}_tokens")]

    eligible, classed = F.col("eligible"), F.col("duplicate_class").isin(*CLASSES)
    linked = F.coalesce(F.col("confidence").isin("exact", "probable", "possible"), F.lit(False))
    candidate = linked | F.coalesce(F.col("confidence").isin("weak", "ambiguous"), F.lit(False))
    kinds = {"observed": F.lit(True), "eligible": eligible, "shadowed": ~eligible, "classified": F.coalesce(classed, F.lit(False)), "confirmed": F.coalesce(F.col("duplicate_class") == "confirmed", F.lit(False)), "linked": linked, "candidate": candidate}
    one = rows.agg(*[c for name, condition in kinds.items() for c in count(condition, name)])
    other = tokens.agg(F.count("*").alias("token_count_events"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("token_count_tokens"))
    one = one.join(F.broadcast(other))  # one row each
    whole = {u: F.col(f"observed_{u}") == F.col(f"eligible_{u}") + F.col(f"shadowed_{u}") for u in ("events", "tokens")}
    held = {u: F.col(f"eligible_{u}") == F.col(f"classified_{u}") for u in ("events", "tokens")}
    return one.withColumns({
        "not_confirmed_tokens": F.col("eligible_tokens") - F.col("confirmed_tokens"), "universe_events_hold": whole["events"], "universe_tokens_hold": whole["tokens"],
        "classified_events_hold": held["events"], "classified_tokens_hold": held["tokens"], "classification_holds": held["events"] & held["tokens"],
    })


def _same(columns: list[str], old: str, new: str) -> Column:
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return equal


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key and change (insert, delete, update, same) between two tables of the same columns."""
    columns = [c for c in old.columns if c != key]
    sides = [x.select(F.col(key), F.struct(*columns).alias(n)) for x, n in ((old, "old"), (new, "new"))]
    joined = sides[0].join(sides[1], key, "full")
    change = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .when(_same(columns, "old", "new"), "same")
        .otherwise("update")
    )
    return joined.select(key, change.alias("change"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """old with new's rows in place of those with the same key; of several new ones the last by order."""
    from .counters import last_by

    fresh = last_by(new, key, order) if order else new.dropDuplicates([key])
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def replaced_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """old with all rows of one source replaced."""
    wrong = new.filter(~F.col("source").eqNullSafe(F.lit(source)))
    if not wrong.isEmpty():
        raise ValueError("SOURCE_SNAPSHOT_RECORD_MISMATCH")
    return old.filter(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.select(*old.columns))


def moved_files(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """path, logical_id, cursor_path, state of each file (source, path, logical_id): `known` by its own cursor (source, path,
    logical_id); `changed` if that one names another session; `moved` if only a cursor of another path has its session, which
    one file alone, the first by path, takes over; else `new`."""
    own = cursors.select("source", "path", F.col("logical_id").alias("own_id"), F.lit(True).alias("has_own"))
    placed = files.join(own, ["source", "path"], "left")
    elsewhere = cursors.filter("logical_id is not null").groupBy("source", "logical_id").agg(F.min("path").alias("elsewhere"))
    placed = placed.join(elsewhere, ["source", "logical_id"], "left")
    may_move = F.col("has_own").isNull() & F.col("elsewhere").isNotNull() & (F.col("elsewhere") != F.col("path"))
    first = placed.filter(may_move).groupBy("source", "logical_id").agg(F.min("path").alias("path"), F.lit(True).alias("takes"))
    placed = placed.join(first, ["source", "logical_id", "path"], "left")
    state = (
        F.when(F.col("has_own") & (F.col("own_id") != F.col("logical_id")), "changed")
        .when(F.col("has_own"), "known")
        .when(F.col("takes"), "moved")
        .otherwise("new")
    )
    cursor = F.when(F.col("has_own"), F.col("path")).when(F.col("takes"), F.col("elsewhere"))
    return placed.select("path", "logical_id", cursor.alias("cursor_path"), state.alias("state"))
