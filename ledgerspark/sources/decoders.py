"""Decoders of log events: fields by their aliases, carried context, usage counters, and records.

A field is looked up in an ordered list of places. Texts that are empty count as absent; only numbers count as numbers.
Nothing but the listed fields is read, so prompts and answers never leave the raw line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.audits import event_types, usage_source
from ..operators.counters import last_by

FIELDS = ("input", "cached", "creation", "output", "reasoning", "total")
# The names of the six counters in logs, the preferred one first.
ALIASES = {
    "input": ("input_tokens", "inputTokens"),
    "cached": ("cached_input_tokens", "cachedInputTokens"),
    "creation": ("cache_write_input_tokens", "cache_creation_input_tokens", "cacheCreationInputTokens"),
    "output": ("output_tokens", "outputTokens"),
    "reasoning": ("reasoning_output_tokens", "reasoningOutputTokens"),
    "total": ("total_tokens", "totalTokens"),
}


def _at(path: str) -> Column:
    return F.try_variant_get("value", path, "variant")


def _kind(path: str) -> Column:
    return F.schema_of_variant(_at(path))


def text_at(*paths: str) -> Column:
    """The first that is a text and not empty."""
    return F.coalesce(*[F.when(_kind(p) == "STRING", F.nullif(F.try_variant_get("value", p, "string"), F.lit(""))) for p in paths])


def number_at(*paths: str) -> Column:
    numeric = [F.when(_kind(p).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get("value", p, "double")) for p in paths]
    return F.coalesce(*numeric)


def is_object(path: str) -> Column:
    return F.coalesce(_kind(path).startswith("OBJECT"), F.lit(False))


def timestamp_ms(*paths: str) -> Column:
    """Numbers are seconds below ten billion, else milliseconds; texts are ISO-8601, in UTC without a zone."""
    out = []
    for p in paths:
        number = number_at(p)
        out.append(F.when(number < 1e10, number * 1000).otherwise(number).cast("long"))
        text = text_at(p)
        zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.when(text.rlike("[T ]"), "Z").otherwise("T00:00:00Z")))
        out.append(F.unix_millis(F.try_to_timestamp(zoned)))
    return F.coalesce(*out)


def usage_at(*bases: str) -> Column:
    """The six counters below the first base that has any, negative ones as 0; null where none is there."""
    found = []
    for base in bases:
        parts = {f: number_at(*[f"{base}.{a}" for a in ALIASES[f]]) for f in FIELDS}
        some = parts["input"].isNotNull()
        for f in FIELDS[1:]:
            some = some | parts[f].isNotNull()
        counters = F.struct(*[F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))).cast("long").alias(f) for f, c in parts.items()])
        found.append(F.when(some, counters))
    return F.coalesce(*found)


def _carry(column: str) -> Column:
    order = Window.partitionBy("path").orderBy("event_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(order)


def codex_events(lines: DataFrame) -> DataFrame:
    """Accounting events of complete lines: identity, context, and the last, total and payload counters as structs."""
    rows = lines.filter("value is not null")
    # Here and below, the names of fields in logs and the order in which they are looked up.
    # where there is no payload, the event is its own
    has_payload = is_object("$.payload")
    own = {n: F.when(has_payload, text_at(f"$.payload.{n}")).otherwise(text_at(f"$.{n}")) for n in ("type", "id", "session_id", "sessionId", "forked_from_id", "forkedFromId", "cwd", "project", "model")}
    types = {"outer_type": text_at("$.type"), "payload_type": own["type"], "message_type": text_at("$.payload.msg.type")}
    rows = rows.withColumns(types)
    rows = rows.withColumns(event_types(F.col("outer_type"), F.col("payload_type"), F.col("message_type")))
    meta = F.col("outer_type") == "session_meta"
    info = ("$.payload.info", "$.payload.msg.info", "$.info")
    fields = {
        "ts_ms": timestamp_ms("$.timestamp", "$.payload.timestamp", "$.payload.msg.timestamp"),
        "_session": F.coalesce(F.when(meta, own["id"]), own["session_id"], own["sessionId"], text_at("$.payload.msg.session_id", "$.payload.msg.sessionId", "$.session_id", "$.sessionId")),
        "_parent": F.coalesce(own["forked_from_id"], own["forkedFromId"], text_at("$.payload.msg.forked_from_id", "$.payload.msg.forkedFromId", "$.forked_from_id", "$.forkedFromId")),
        "_model": F.coalesce(own["model"], text_at(*[f"{i}.model" for i in info], "$.payload.msg.model", "$.model")),
        "_project": F.coalesce(own["cwd"], own["project"], text_at("$.payload.msg.cwd", "$.cwd")),
        "response_id": text_at(*[f"{b}.{n}" for n in ("response_id", "responseId") for b in ("$.payload", "$.payload.msg", "$")]),
        "turn_id": text_at(*[f"{b}.{n}" for n in ("turn_id", "turnId") for b in ("$.payload", "$.payload.msg", "$")]),
        "_last": usage_at(*[f"{i}.{n}" for i in info for n in ("last_token_usage", "lastTokenUsage")]),
        "_total": usage_at(*[f"{i}.{n}" for i in info for n in ("total_token_usage", "totalTokenUsage")]),
        "_payload": usage_at("$.payload.usage"),
        "_own_usage": F.when(~has_payload, usage_at("$.usage")),
        "_flat": F.when(has_payload, usage_at("$.payload")).otherwise(usage_at("$")),
    }
    rows = rows.withColumns(fields)
    token = F.col("is_token_count")
    rows = rows.withColumns(
        {
            "last": F.when(token, F.col("_last")),
            "total": F.when(token, F.col("_total")),
            "payload_usage": F.coalesce("_payload", "_own_usage", F.when(~token, F.col("_flat"))),
            "model": _carry("_model"),
            "project_key": _carry("_project"),
            "raw_fingerprint": F.sha2(F.to_json("value"), 256),
            "semantic_fingerprint": F.sha2(without_rate_limits(), 256),
            "is_meta": meta,
            "nested_usage": ~token & (F.col("_last").isNotNull() | F.col("_total").isNotNull()),
            "legacy_flat": ~token & F.col("_payload").isNull() & F.col("_own_usage").isNull() & F.col("_flat").isNotNull(),
        }
    )
    rows = rows.withColumn("raw_identity", F.concat(F.lit("e"), F.col("event_index").cast("string"), F.lit(":h"), F.substring("raw_fingerprint", 1, 16)))
    heads = session_heads(rows)
    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("event_index")))

    last_context = rows.groupBy("path").agg(latest("_session").alias("_context"), latest("_parent").alias("_file_parent"))
    joined = rows.join(heads, "path", "left").join(last_context, "path", "left")
    return joined.select(
        "path", "event_index", F.coalesce("session", "_context").alias("session"), F.coalesce("parent", "_file_parent").alias("parent"), "fork_ms", "ts_ms",
        F.coalesce("session_conflicts", F.lit(0)).alias("session_conflicts"), F.coalesce("parent_conflicts", F.lit(0)).alias("parent_conflicts"),
        "model", "project_key", "response_id", "turn_id", "semantic_type", "is_token_count", "last", "total", "payload_usage", "raw_identity", "raw_fingerprint",
        "semantic_fingerprint", "is_meta", "nested_usage", "legacy_flat",
    )


def older_events(lines: DataFrame, *more: Column) -> DataFrame:
    """Events as the older accounting reads them (operators/older.py): session, fork, model and folder only where the event itself names them, last and
    total of any event, the flat counters, its own id, and what stands for its content; and more columns, where given."""
    rows = lines.filter("value is not null")
    has_payload = is_object("$.payload")

    def own(*names: str) -> Column:
        return F.when(has_payload, text_at(*[f"$.payload.{n}" for n in names])).otherwise(text_at(*[f"$.{n}" for n in names]))

    # Names of fields in logs and the order in which they are looked up.
    info = ("$.payload.info", "$.payload.msg.info", "$.info")
    ids = ("uuid", "id", "event_id", "eventId", "response_id", "responseId", "turn_id", "turnId", "item_id", "itemId", "request_id", "requestId")
    types = event_types(text_at("$.type"), own("type"), text_at("$.payload.msg.type"))
    nodes = [_at(f"{i}.{n}") for n in ("total_token_usage", "totalTokenUsage", "last_token_usage", "lastTokenUsage") for i in info] + [_at("$.payload.usage"), _at("$.payload"), _at("$")]
    content = F.struct(F.to_json(_at("$.timestamp")).alias("t"), own("turn_id", "turnId").alias("turn"), own("response_id", "responseId").alias("response"), F.to_json(F.coalesce(*nodes)).alias("usage"))
    usage = F.coalesce(usage_at("$.payload.usage"), F.when(~has_payload, usage_at("$.usage")))
    rows = rows.withColumns({
        "last": usage_at(*[f"{i}.{n}" for i in info for n in ("last_token_usage", "lastTokenUsage")]), "total": usage_at(*[f"{i}.{n}" for i in info for n in ("total_token_usage", "totalTokenUsage")]),
        "_usage": usage, "_flat": F.when(has_payload, usage_at("$.payload")).otherwise(usage_at("$")), "_token": types["is_token_count"],
    })
    nested = F.col("last").isNotNull() | F.col("total").isNotNull()
    kind = F.when(nested & F.col("_token"), "token-count").when(nested, "nested-info-non-token-count").when(F.col("_usage").isNotNull(), "payload-usage").otherwise("flat-payload")
    return rows.select(
        "path", "event_index",
        F.coalesce(F.when(text_at("$.type") == "session_meta", own("id")), own("session_id", "sessionId"), text_at("$.payload.msg.session_id", "$.payload.msg.sessionId", "$.session_id", "$.sessionId")).alias("session"),
        F.coalesce(own("forked_from_id", "forkedFromId"), text_at("$.payload.msg.forked_from_id", "$.payload.msg.forkedFromId")).alias("forked_from"),
        F.coalesce(own("model"), text_at(*[f"{i}.model" for i in info], "$.payload.msg.model", "$.model")).alias("model"), own("cwd", "project").alias("project_key"), timestamp_ms("$.timestamp").alias("ts_ms"),
        "last", "total", F.coalesce("_usage", "_flat").alias("flat"), kind.alias("source_kind"), text_at(*[f"$.{n}" for n in ids]).alias("own_id"), F.to_json(content).alias("content"),
        *more,
    )


def counted(u: Column) -> Column:
    """Counters with 0 for what is absent; null where none is above 0."""
    parts = {f: F.coalesce(u[f], F.lit(0)).cast("long") for f in FIELDS}
    return F.when(F.greatest(*parts.values()) > 0, F.struct(*[c.alias(f) for f, c in parts.items()]))


def audit_events(lines: DataFrame) -> DataFrame:
    """Every event of a log as the audits read it: its types, the class of what its usage is read from (null where it has none), its counters,
    the session that a session_meta names, and the fork, model, ids and time that the event itself names. payload_usage is there too where last or
    total go before it. An event without counters above 0 has null ones."""
    payload_type = F.when(is_object("$.payload"), text_at("$.payload.type"))
    types = {"outer_type": text_at("$.type"), "payload_type": payload_type, "message_type": text_at("$.payload.msg.type")}
    more = event_types(*types.values())
    named = F.when(is_object("$.payload"), text_at(*[f"$.payload.{n}" for n in ("id", "session_id", "sessionId")])).otherwise(text_at("$.id", "$.session_id", "$.sessionId"))
    rows = older_events(
        lines, *[c.alias(n) for n, c in {**types, **more}.items()], named.alias("_named"), F.col("_usage"), F.col("_flat"),
        timestamp_ms("$.timestamp", "$.payload.timestamp", "$.payload.msg.timestamp").alias("_ts"),
        *[text_at(*[f"{b}.{n}" for n in names for b in ("$.payload", "$.payload.msg", "$")]).alias(names[0]) for names in (("response_id", "responseId"), ("turn_id", "turnId"))],
    )
    rows = rows.withColumns({n: counted(F.col(n)) for n in ("last", "total", "_usage", "_flat")})
    nested = F.col("last").isNotNull() | F.col("total").isNotNull()
    kind = usage_source(F.col("is_token_count"), nested, F.col("_usage").isNotNull(), F.col("_flat").isNotNull())
    meta = F.coalesce(F.col("semantic_type") == "session_meta", F.lit(False))
    return rows.select(
        "path", "event_index", F.when(meta, F.col("_named")).alias("meta_session"), meta.alias("is_meta"), "forked_from", "model", F.col("_ts").alias("ts_ms"), *types, *more,
        kind.alias("source_kind"), "last", "total", F.when(~F.col("is_token_count") & ~nested, F.coalesce("_usage", "_flat")).alias("flat"), F.col("_usage").alias("payload_usage"),
        "own_id", "content", "response_id", "turn_id",
    )


def without_rate_limits() -> Column:
    """The event as text, its payload's rate limits left out: what they hold changes while nothing else does."""
    payload = F.try_variant_get("value", "$.payload", "map<string, variant>")
    rest = F.map_filter(payload, lambda k, _: k != "rate_limits")
    outer = F.map_filter(F.try_variant_get("value", "$", "map<string, variant>"), lambda k, _: k != "payload")

    def text(m: Column) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(m, lambda _, v: F.to_json(v))))))

    return F.when(is_object("$.payload"), F.concat(text(outer), F.lit("\n"), text(rest))).otherwise(F.to_json("value"))


def codex_files(found: DataFrame, events: DataFrame) -> DataFrame:
    """A row a file: path, session, parent, fork_ms, archived, session_conflicts, parent_conflicts; found has the paths of all files."""
    own = events.groupBy("path").agg(F.max("session").alias("session"), F.max("parent").alias("parent"), F.max("fork_ms").alias("fork_ms"), F.max("session_conflicts").alias("session_conflicts"), F.max("parent_conflicts").alias("parent_conflicts"))
    archived = F.array_contains(F.split(F.lower(F.translate("path", "\\", "/")), "/"), "archived_sessions")
    return found.select("path").join(own, "path", "left").withColumn("archived", archived).fillna(0, ["session_conflicts", "parent_conflicts"])


def session_heads(rows: DataFrame) -> DataFrame:
    """path, session, parent, fork_ms, session_conflicts and parent_conflicts by a fold over the few session_meta events of each file.

    The first that names a session decides. A later one for a known ancestor is a replay and only tells of
    its own parent; any other one that differs is a conflict."""
    metas = rows.filter("outer_type = 'session_meta'").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("event_index", F.col("_session").alias("s"), F.col("_parent").alias("p"), F.col("ts_ms").alias("t")))).alias("m")
    )
    start = F.expr("named_struct('session', cast(null as string), 'parent', cast(null as string), 'fork', cast(null as bigint), 'known', cast(array() as array<string>), 'sessions', 0L, 'parents', 0L)")

    def step(a: Column, m: Column) -> Column:
        primary = a["session"].isNull() & m["s"].isNotNull()
        replay = F.coalesce(a["session"].isNotNull() & m["s"].isNotNull() & (a["session"] != m["s"]) & F.array_contains(a["known"], m["s"]), F.lit(False))
        parent = F.when(replay, a["parent"]).otherwise(F.coalesce(m["p"], a["parent"]))
        fork = F.when(replay | parent.isNull(), a["fork"]).otherwise(F.coalesce(a["fork"], m["t"]))
        odd = ~replay & F.coalesce(a["session"] != m["s"], F.lit(False))
        odd_parent = ~replay & ~primary & F.coalesce(a["parent"] != m["p"], F.lit(False))
        return F.struct(
            F.coalesce(a["session"], m["s"]).alias("session"),
            parent.alias("parent"),
            fork.alias("fork"),
            F.array_compact(F.array_append(a["known"], m["p"])).alias("known"),
            (a["sessions"] + odd.cast("long")).alias("sessions"),
            (a["parents"] + odd_parent.cast("long")).alias("parents"),
        )

    folded = metas.select("path", F.aggregate("m", start, step).alias("a"))
    return folded.select("path", "a.session", "a.parent", F.col("a.fork").alias("fork_ms"), F.col("a.sessions").alias("session_conflicts"), F.col("a.parents").alias("parent_conflicts"))


def _first_usage_number(name: str) -> Column:
    return F.coalesce(number_at(f"$.message.usage.{name}", f"$.usage.{name}"), F.lit(0.0)).cast("long")


CLAUDE_USAGE = ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens")
_CLAUDE = ["path", "event_index", "usage_key", "_model", "_session", "_cwd", *CLAUDE_USAGE]


def _claude_events(lines: DataFrame, ingest_ms: int) -> DataFrame:
    """Complete lines with what is read of them; `counts` marks those that have usage."""
    # The names of usage counters and of ids in logs.
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    ids = ("uuid", "id", "event_id", "eventId", "response_id", "responseId", "turn_id", "turnId", "item_id", "itemId", "request_id", "requestId")
    some = F.lit(False)
    for n in names:
        some = some | _at(f"$.message.usage.{n}").isNotNull() | _at(f"$.usage.{n}").isNotNull()
    ephemeral = _first_usage_number("cache_creation.ephemeral_5m_input_tokens") + _first_usage_number("cache_creation.ephemeral_1h_input_tokens")
    message, request = text_at("$.message.id"), text_at("$.requestId", "$.request_id", "$.message.requestId", "$.message.request_id")
    return lines.filter("value is not null").withColumns(
        {
            "_model": text_at("$.message.model", "$.model"),
            "_session": text_at("$.sessionId", "$.session_id"),
            "_cwd": text_at("$.cwd", "$.message.cwd"),
            "counts": some,
            "usage_key": F.when(message.isNotNull(), F.concat(message, F.lit(":"), F.coalesce(request, F.lit("")))),
            "own_id": text_at(*[f"$.{n}" for n in ids]),
            "ts_ms": F.coalesce(timestamp_ms("$.timestamp"), F.lit(ingest_ms)),
            "input_tokens": _first_usage_number("input_tokens"),
            "cached_input_tokens": _first_usage_number("cache_read_input_tokens"),
            "cache_creation_input_tokens": F.greatest(_first_usage_number("cache_creation_input_tokens"), ephemeral),
            "output_tokens": _first_usage_number("output_tokens"),
        }
    ).drop("value")


def _claude_usage(events: DataFrame) -> DataFrame:
    """From events of _claude_events: those whose usage counts, with the model, session and folder that hold there. A message's usage that
    repeats is none."""
    rows = events.withColumns({"model": _carry("_model"), "session_id": _carry("_session"), "_dir": _carry("_cwd")})
    rows = rows.filter(F.col("counts") & F.col("model").isNotNull())
    usage = F.struct(*CLAUDE_USAGE)
    before = F.lag(usage).over(Window.partitionBy("path", "usage_key").orderBy("event_index"))
    rows = rows.withColumn("_usage", usage).withColumn("_before", F.when(F.col("usage_key").isNotNull(), before))
    return rows.filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_usage")))


def _claude_records(rows: DataFrame) -> DataFrame:
    """Records of usage: of several with one id the last stands."""
    # without a folder in the log, the one that the log lies in
    project = F.coalesce(F.element_at(F.split(F.regexp_replace("_dir", r"[\\/]+$", ""), r"[\\/]"), -1), F.try_element_at(F.split("path", r"[\\/]"), F.lit(-2)), F.lit("unknown"))
    scope = F.coalesce("session_id", "path")
    by_key = F.concat(F.lit("claude:"), F.substring(F.sha2(F.concat_ws("\n", scope, "usage_key"), 256), 1, 16))
    by_content = F.concat(F.lit("claude:h"), F.substring(F.sha2(F.concat_ws("\n", scope, "line"), 256), 1, 16))
    record = F.coalesce(F.when(F.col("usage_key").isNotNull(), by_key), F.concat(F.lit("claude:"), F.col("own_id")), by_content)
    found = rows.select(
        record.alias("id"), F.lit("claude").alias("source"), F.col("path").alias("source_path"), "session_id", "ts_ms", "model", project.alias("project_key"), "event_index",
        *CLAUDE_USAGE, F.lit(0).cast("long").alias("reasoning_output_tokens"),
    )
    return last_by(found, "id", ["source_path", "event_index"]).drop("event_index")


def claude_records(lines: DataFrame, ingest_ms: int) -> DataFrame:
    """Usage records of complete lines. A message's usage that repeats adds nothing, one that changed replaces what was."""
    return _claude_records(_claude_usage(_claude_events(lines, ingest_ms)))


def claude_scan(lines: DataFrame, ingest_ms: int, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of lines that go on where others ended, and the state after them: for each file the last model, session and folder
    (no usage_key), and for each message its last usage, all as rows before the first line."""
    new = _claude_events(lines, ingest_ms)
    held = state.withColumn("counts", F.col("usage_key").isNotNull())
    events = new.unionByName(held, allowMissingColumns=True)
    # a state's rows count as usage only to be compared with: they have no line
    records = _claude_records(_claude_usage(events).filter("line is not null"))
    context = events.groupBy("path").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_index"))).alias(c) for c in ("_model", "_session", "_cwd")]
    )
    # usage before a model was known isn't remembered
    usage = _claude_usage(events).filter("usage_key is not null").groupBy("path", "usage_key")
    usage = usage.agg(F.max_by(F.struct(*CLAUDE_USAGE), "event_index").alias("u")).select("path", "usage_key", "u.*")
    none = [F.lit(None).cast("long").alias(c) for c in CLAUDE_USAGE]
    rows = context.select("path", F.lit(-2).cast("long").alias("event_index"), F.lit(None).cast("string").alias("usage_key"), "_model", "_session", "_cwd", *none)
    texts = [F.lit(None).cast("string").alias(c) for c in ("_model", "_session", "_cwd")]
    return records, rows.unionByName(usage.select("path", F.lit(-1).cast("long").alias("event_index"), "usage_key", *texts, *CLAUDE_USAGE))
