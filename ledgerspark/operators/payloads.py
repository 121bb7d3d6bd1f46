"""Usage that payloads give: what repeats a token count and what counts in its place, over components and precision.

Payloads and tokens have id, session, raw_identity, response_id, model, usage (five counters), tokens, precision. Candidates are never
listed pair by pair: both sides are counted by the key they must share and by model, and a link is where either side has one
candidate; so a response or a usage that very many events share costs a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from .contributions import all_input, normalized, usage_total


def payload_candidates(events: DataFrame) -> DataFrame:
    """events that have payload_usage, with usage, tokens, precision, inconsistent: its parts where they are whole and agree with the total that
    is given, else the total as input; without a total its parts."""
    raw = F.col("payload_usage")
    parts = raw["input"].isNotNull() & raw["output"].isNotNull()
    rows = events.filter(raw.isNotNull()).withColumn("_parts", normalized(raw))
    whole = usage_total(F.col("_parts"))
    given = raw["total"].isNotNull()
    agrees = parts & (whole == raw["total"])
    return rows.withColumns(
        {
            "usage": F.when(given & ~F.coalesce(agrees, F.lit(False)), all_input(raw["total"])).otherwise(F.col("_parts")),
            "tokens": F.coalesce(raw["total"], raw["input"] + raw["output"], whole),
            "precision": F.when(given, F.when(agrees, "components-exact").otherwise("aggregate-only")).when(parts, "components-exact").otherwise("partial"),
            "inconsistent": F.coalesce(given & parts & (whole != raw["total"]), F.lit(False)),
        }
    ).drop("_parts")


def _counted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """By key, and by key and model: how many rows there are, and one of them."""
    by_key = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("model").isNull()).alias("n_unnamed"), F.min("id").alias("any_id"), F.min(F.when(F.col("model").isNull(), F.col("id"))).alias("unnamed_id")
    )
    by_model = rows.filter("model is not null").groupBy(*keys, "model").agg(F.count("*").alias("n_named"), F.min("id").alias("named_id"))
    return by_key, by_model


def candidates(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows that have candidates among others with the same keys and no other model: id, n_candidates, candidate (the one, if it is one)."""
    rows = rows.dropna(subset=keys)
    by_key, by_model = _counted(others.dropna(subset=keys), keys)
    joined = rows.join(by_key, keys).join(by_model, [*keys, "model"], "left")
    n = F.when(F.col("model").isNull(), F.col("n")).otherwise(F.col("n_unnamed") + F.coalesce("n_named", F.lit(0)))
    one = F.when(F.col("model").isNull(), F.col("any_id")).otherwise(F.coalesce("named_id", "unnamed_id"))
    return joined.select("id", n.alias("n_candidates"), F.when(n == 1, one).alias("candidate")).filter("n_candidates > 0")


def _linked(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, matched_id) where either is the other's only candidate."""
    back = theirs.filter("n_candidates = 1").select(F.col("id").alias("matched_id"))
    return mine.filter("n_candidates = 1").select("id", F.col("candidate").alias("matched_id")).join(back, "matched_id", "left_semi")


def payload_resolution(payloads: DataFrame, tokens: DataFrame) -> DataFrame:
    """payloads with matched_id, disposition, evidence, reason.

    A payload goes if one token of its raw event has the same figures: parts where both have them exactly, else totals; or if it is the only
    payload of a response, and the token the only one, with equal exact parts. Tokens that have gone with one payload are out of
    what follows. Zeros are ignored; what is left counts, and its reason says what spoke against a match. A model that
    is missing fits any."""
    keep = ["id", "session", "raw_identity", "response_id", "model", "usage", "tokens", "precision"]
    p, t = (x.withColumn("model", F.nullif(F.col("model"), F.lit(""))).withColumn("response_id", F.nullif(F.col("response_id"), F.lit(""))).select(*keep) for x in (payloads, tokens))
    p, t = stored(p), stored(t)
    sides = [x.select("session", "raw_identity", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "model", "usage", "tokens", "precision")]) for k, x in (("p", p), ("t", t))]
    models = F.coalesce(F.col("p_model") == F.col("t_model"), F.lit(True))
    exact = (F.col("p_precision") == "components-exact") & (F.col("t_precision") == "components-exact")
    figures = F.when(exact, F.col("p_usage") == F.col("t_usage")).otherwise(F.col("p_tokens") == F.col("t_tokens"))
    met = sides[0].filter("p_tokens > 0 and p_precision <> 'partial'").join(sides[1].filter("t_precision <> 'partial'"), ["session", "raw_identity"]).filter(models & figures)
    # all pairs of an id are of one event, so these windows need no shuffle after the join
    for side in "pt":
        met = met.withColumn(f"n_{side}", F.count("*").over(Window.partitionBy("session", "raw_identity", f"{side}_id")))
    same_event = met.filter("n_p = 1 and n_t = 1")
    same_event = stored(same_event.select(F.col("p_id").alias("id"), F.col("t_id").alias("matched_id"), F.when(exact, "same-raw-event-components").otherwise("same-raw-event-aggregate").alias("evidence")))

    def whole(rows: DataFrame) -> DataFrame:
        return rows.filter("precision = 'components-exact' and response_id is not null")

    left_p, left_t = p.join(same_event, "id", "left_anti"), t.join(same_event.select(F.col("matched_id").alias("id")), "id", "left_anti")
    keys = ["session", "response_id", "usage"]
    mine, theirs = stored(candidates(whole(left_p), whole(left_t), keys)), stored(candidates(whole(left_t), whole(left_p), keys))
    same_response = stored(_linked(mine, theirs).withColumn("evidence", F.lit("same-response-id-components")))
    matched = same_event.unionByName(same_response.select(same_event.columns))
    ambiguous = mine.join(same_response, "id", "left_anti").select("id", F.lit(True).alias("is_ambiguous"))
    # what the tokens that are left have in common with each payload that is left
    left_t = stored(left_t.join(same_response.select(F.col("matched_id").alias("id")), "id", "left_anti"))
    rest = left_p.join(same_response, "id", "left_anti")
    of_response = left_t.dropna(subset=["response_id"]).groupBy("session", "response_id").agg(F.count("*").alias("n_any"))
    told = rest.join(of_response, ["session", "response_id"], "left").join(ambiguous, "id", "left")
    exact_t = left_t.filter("precision = 'components-exact'")
    for name, others, by in (("n_fit", left_t, keys[:2]), ("n_exact", exact_t, keys[:2]), ("n_same", exact_t, keys), ("n_total", exact_t, [*keys[:2], "tokens"])):
        told = told.join(candidates(rest, others, by).select("id", F.col("n_candidates").alias(name)), "id", "left")
    disposition = F.when(F.col("tokens") <= 0, "ignore-zero")
    reason = F.when(F.col("tokens") <= 0, F.lit(None).cast("string"))
    for condition, name, why in (
        (F.col("response_id").isNull(), "fallback-unmatched", "no-response-id"),
        (F.col("is_ambiguous"), "fallback-ambiguous", "multiple-candidates"),
        (F.col("n_any").isNull(), "fallback-unmatched", "no-token-candidate"),
        (F.col("n_fit").isNull(), "fallback-conflict", "model-conflict"),
        ((F.col("precision") != "components-exact") | F.col("n_exact").isNull(), "fallback-conflict", "insufficient-precision"),
        (F.col("n_same").isNotNull(), "fallback-ambiguous", "multiple-candidates"),
        (F.col("n_total").isNotNull(), "fallback-conflict", "same-total-different-components"),
        (F.lit(True), "fallback-conflict", "different-components"),
    ):
        disposition, reason = disposition.when(condition, name), reason.when(condition, why)
    others = told.select("id", disposition.alias("disposition"), reason.alias("reason"))
    found = payloads.join(matched, "id", "left").join(others, "id", "left")
    return found.withColumn("disposition", F.coalesce("disposition", F.lit("suppress-confirmed")))


def counts() -> dict[str, Column]:
    """Named counts and tokens over rows of payload_resolution."""
    tokens = F.col("tokens")

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, tokens)), F.lit(0))

    gone, counted = F.col("disposition") == "suppress-confirmed", F.col("disposition").startswith("fallback")
    return {
        "candidates": F.count("*"),
        "candidate_tokens": F.coalesce(F.sum(tokens), F.lit(0)),
        "suppressed": n(gone),
        "suppressed_tokens": total(gone),
        "same_raw_event": n(F.col("evidence").startswith("same-raw-event")),
        "same_response": n(F.col("evidence") == "same-response-id-components"),
        "fallbacks": n(counted),
        "fallback_tokens": total(counted),
        "zeros": n(F.col("disposition") == "ignore-zero"),
        "conflicts": n(F.col("disposition") == "fallback-conflict"),
        "ambiguous": n(F.col("disposition") == "fallback-ambiguous"),
        "unmatched": n(F.col("disposition") == "fallback-unmatched"),
        "inconsistent": n(F.col("inconsistent")),
        "different_components": n(F.col("reason") == "different-components"),
        "same_total": n(F.col("reason") == "same-total-different-components"),
        "model_conflicts": n(F.col("reason") == "model-conflict"),
        "insufficient_precision": n(F.col("reason") == "insufficient-precision"),
    }
