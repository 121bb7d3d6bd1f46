"""Column functions on usage counters, models, paths and texts. All stay in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTERS = (
    "input_tokens",
    "cached_input_tokens",
    "cache_creation_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
)
HALF_HOUR_MS = 1_800_000
QUARTER_HOUR_MS = 900_000
DAY_MS = 86_400_000


def total_tokens() -> Column:
    total = F.col(COUNTERS[0])
    for name in COUNTERS[1:]:
        total = total + F.col(name)
    return total


def sums(*names: str) -> list[Column]:
    return [F.sum(n).cast("long").alias(n) for n in names or COUNTERS]


def input_context() -> Column:
    return F.col("input_tokens") + F.col("cached_input_tokens") + F.col("cache_creation_input_tokens")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null unless whole is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def cached_share() -> Column:
    return ratio(F.col("cached_input_tokens"), input_context())


def token_metrics() -> dict[str, Column]:
    """The seven totals that an audit shows side by side."""
    i, c, n, o, r = (F.col(x) for x in COUNTERS)
    return {
        "current_total": i + c + n + o + r,
        "without_cached": i + n + o + r,
        "without_cache_creation": i + c + o + r,
        "without_reasoning": i + c + n + o,
        "without_all_cache": i + o + r,
        "plain_input_output": i + o,
        "raw_io_equivalent": i + c + o + r,
    }


def bucket_start(ts_ms: Column, width_ms: int = HALF_HOUR_MS) -> Column:
    return (F.floor(ts_ms / width_ms) * width_ms).cast("long")


def local_day(ts_ms: str, zone: str = "UTC") -> Column:
    """The calendar day in zone of a column of epoch milliseconds, whatever the session's zone is."""
    if zone == "UTC":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts_ms) / DAY_MS).cast("int"))
    moment = f"timestampadd(MILLISECOND, {ts_ms}, timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"cast(convert_timezone('UTC', '{zone}', {moment}) as date)")


def day_start_ms(day: Column) -> Column:
    """Epoch milliseconds at which a UTC day begins."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS


def normalized_model(model: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(model)), "[ _]+", "-"), "-+", "-")


def model_identity(model: Column) -> Column:
    """id (without a model prefix and a date at the end), display_name and provider."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(model), "(?i)^model[-_]?", ""), r"[-_]\d{8,}$", "")
    low = F.lower(bare)
    provider = (
        F.when(low.contains("claude"), "anthropic").when(low.rlike("gpt|codex|^o[0-9]"), "openai").otherwise("unknown")
    )
    return F.struct(low.alias("id"), bare.alias("display_name"), provider.alias("provider"))


def project_display_name(path: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit("Unknown project"))


def redacted(text: Column) -> Column:
    """Local user folders become ~."""
    text = F.regexp_replace(text, r"(/Users/|/home/)[^/\s]+", "~")
    return F.regexp_replace(text, r"(?i)[A-Z]:\\Users\\[^\\\s]+", "~")


def csv_safe(text: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.regexp_replace(text, r"^([=+\-@])", "'$1")


def iso_utc(ts_ms: Column) -> Column:
    """ISO-8601 with milliseconds in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / DAY_MS).cast("int"))
    rest = F.pmod(ts_ms, F.lit(DAY_MS))
    parts = [F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60]
    clock = F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))


def compact_number(value: Column) -> Column:
    """1234 as 1.2K, in thousands, millions, billions and trillions; ends in no zeros after the point."""
    out = value.cast("string")
    for unit, name in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        tenths = F.floor(F.abs(value) / unit * 10 + 0.5).cast("long")
        whole = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
        out = F.when(F.abs(value) >= unit, F.concat(F.when(value < 0, "-").otherwise(""), whole, F.lit(name))).otherwise(out)
    return out


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the code units of a text of the basic plane, as 8 hexadecimal digits."""
    units = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    start = F.lit(2166136261).cast("long")
    h = F.aggregate(units, start, lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))
    h = F.when(F.length(text) > 0, h).otherwise(start)
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 16), 8, "0"))


def url_component(text: Column) -> Column:
    """Percent encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def in_range(ts: Column, begin: int | None, end: int | None) -> Column:
    """begin <= ts < end; either may be open."""
    found = F.lit(True)
    if begin is not None:
        found = found & (ts >= begin)
    if end is not None:
        found = found & (ts < end)
    return found


def is_unassigned(session: Column) -> Column:
    return session.isNull() | (session == "")


def percent_change(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, (current - previous).cast("double") / previous.cast("double") * 100)
