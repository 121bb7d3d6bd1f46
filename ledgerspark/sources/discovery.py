"""Where agents keep their logs, whether there are any, and what the head of a log says about its session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decoders, jsonl

# Folders below a user's home, by agent: the agent's own, and those of its logs.
HOMES = {"claude": ".claude", "codex": ".codex"}
ROOTS = {"claude": [".claude/projects"], "codex": [".codex/sessions", ".codex/archived_sessions"]}


def roots(home: str, source: str) -> list[str]:
    return [f"{home.rstrip('/')}/{x}" for x in ROOTS[source]]


def detected(spark: SparkSession, home: str) -> DataFrame:
    """source, status (NotDetected, Ready, Active), installed, data_available, roots: a row an agent. Log contents aren't read."""
    rows = []
    for source in ROOTS:
        own = roots(home, source)
        installed = bool(jsonl.existing(spark, [f"{home.rstrip('/')}/{HOMES[source]}"]))
        some = not jsonl.files(spark, own).select("path").isEmpty()
        rows.append((source, "NotDetected" if not installed else "Active" if some else "Ready", installed, some, own))
    return spark.createDataFrame(rows, "source string, status string, installed boolean, data_available boolean, roots array<string>")


def session_heads(found: DataFrame) -> DataFrame:
    """path, session_id, parent_id by the first session_meta among the complete lines of a file's first 64 KiB; null without one."""
    events = jsonl.lines(jsonl.peeked(found)).filter("value is not null")

    def text(*places: str):
        """The first of the places, in the payload or else in the event itself, that holds a text."""
        own = F.schema_of_variant(F.variant_get("value", "$.payload", "variant"))
        inside = F.coalesce(own.startswith("OBJECT"), F.lit(False))

        def at(path: str):
            value = F.try_variant_get("value", path, "variant")
            return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.btrim(F.try_variant_get("value", path, "string")), F.lit("")))

        return F.when(inside, F.coalesce(*[at(f"$.payload.{x}") for x in places])).otherwise(F.coalesce(*[at(f"$.{x}") for x in places]))

    meta = events.filter(F.try_variant_get("value", "$.type", "string") == "session_meta").select(
        "path",
        "event_index",
        F.struct(text("id", "session_id", "sessionId").alias("session_id"), text("forked_from_id", "forkedFromId").alias("parent_id")).alias("m"),
    )
    first = meta.groupBy("path").agg(F.min_by("m", "event_index").alias("m"))
    return found.select("path").join(first, "path", "left").select("path", "m.session_id", "m.parent_id")


def claude_heads(found: DataFrame) -> DataFrame:
    """path, logical_id: the first session that a complete line of a file's first 64 KiB names; null without one."""
    events = jsonl.lines(jsonl.peeked(found)).filter("value is not null")
    named = events.withColumn("s", decoders.text_at("$.sessionId", "$.session_id", "$.message.sessionId", "$.message.session_id"))
    first = named.filter("s is not null").groupBy("path").agg(F.min_by("s", "event_index").alias("logical_id"))
    return found.select("path").join(first, "path", "left")
