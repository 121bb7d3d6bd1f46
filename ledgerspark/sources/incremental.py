"""Incremental scans of append-only logs: each file is read on from its cursor, in blocks of bytes.

A listing is joined with the cursors of the last scan, which tell for each file where reading goes on. The bytes to read are cut into blocks
of BLOCK bytes, dealt to tasks; a line belongs to the block in which it begins, so a file of any size is read by many tasks and
no line is cut. What stands behind the last line break is pending: the cursor keeps where it begins, and the next scan reads it
again with what has come. What a decoder carries from line to line (the last model, session and folder, the last
usage of each message) is kept as rows of a state table; they go before the new lines in the same windows that a whole scan
uses. So appending in any cuts gives the records of one scan of everything.

Cursors: source, path, logical_id, offset (bytes read), pending (how many of these belong to the unfinished line), size, modified_ms,
version, revision. Cases: a file that is new, or that was read by another version, or is not longer than what was read of it, is read from its
start and replaces its rows; an unfinished line over MAX_PENDING bytes is given up; empty files and missing roots have no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decoders, jsonl

BLOCK = 64 * 1024 * 1024
STEP = 1024 * 1024
CURSOR = "source string, path string, logical_id string, offset long, pending long, size long, modified_ms long, version int, revision int"
STATE = "path string, event_index long, usage_key string, _model string, _session string, _cwd string, " + ", ".join(f"{c} long" for c in decoders.CLAUDE_USAGE)
LINE = "path string, begin long, line string, ended boolean"


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size, modified_ms of all JSONL files below the roots; their content isn't read."""
    return jsonl.files(spark, roots).select("path", "size", "modified_ms")


def same_listing(one: DataFrame, other: DataFrame) -> bool:
    """Whether two listings have the same files with the same sizes and times."""
    first, second = (jsonl.snapshot(x).first() for x in (one, other))
    return first == second


def plan(found: DataFrame, cursors: DataFrame, version: int) -> DataFrame:
    """A row a file: path, size, modified_ms, start (null where nothing is to be read), replaces (its older rows go)."""
    known = cursors.select("path", "offset", "pending", F.col("size").alias("_size"), F.col("modified_ms").alias("_time"), F.col("version").alias("_version"))
    rows = found.join(known, "path", "left")
    same_version = F.coalesce(F.col("_version") == version, F.lit(False))
    unchanged = same_version & (F.col("_size") == F.col("size")) & (F.col("_time") == F.col("modified_ms")) & (F.col("offset") >= F.col("size"))
    resumes = same_version & (F.col("offset") < F.col("size"))
    start = F.when(F.coalesce(unchanged, F.lit(False)), F.lit(None)).when(resumes, F.col("offset") - F.col("pending")).otherwise(0)
    return rows.select(
        "path", "size", "modified_ms", start.cast("long").alias("start"), (F.col("_version").isNotNull() & ~resumes & start.isNotNull()).alias("replaces")
    )


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _end_of_line(held, at: int, size: int) -> int:
    """Where the line that holds the byte at `at` ends, its line break included; size if it isn't ended."""
    while at < size:
        some = held.read_at(min(STEP, size - at), at)
        found = some.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(some)
    return size


def read_lines(planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, begin, line, ended) of the bytes that a plan asks for: lines with the byte at which they begin. Sizes are those of the
    listing, so bytes that came since belong to the next scan."""
    asked = planned.filter("start is not null and size > start")
    blocks = asked.select("path", "start", "size", F.explode(F.sequence("start", F.col("size") - 1, F.lit(block).cast("long"))).alias("low"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as held:
                    size, low, high = r["size"], r["low"], min(r["low"] + block, r["size"])
                    # a line that began in the block before is read there
                    at = low if low == r["start"] else _end_of_line(held, low - 1, size)
                    while at < high:
                        end = _end_of_line(held, min(high, at + STEP) - 1, size)
                        begins, lines, ended = [], [], []
                        for line in _cut(held.read_at(end - at, at)):
                            begins.append(at)
                            at += len(line)
                            ended.append(line.endswith(b"\n"))
                            lines.append(line.decode("utf-8", "replace").strip())
                        yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(lines), "begin": pa.array(begins, pa.int64()), "line": lines, "ended": ended})

    return blocks.repartition(F.col("path"), F.col("low")).mapInArrow(read, LINE)


def _cut(some: bytes) -> list[bytes]:
    """Lines with their line breaks; only the line feed is one."""
    parts = some.split(b"\n")
    return [x + b"\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def parsed(lines: DataFrame, tail: bool = False) -> DataFrame:
    """Complete lines that aren't blank, and with tail unfinished ones too: path, event_index (the byte at which it begins), line, value (null where
    it is no JSON)."""
    return lines.filter("line <> ''" if tail else "ended and line <> ''").select("path", F.col("begin").alias("event_index"), "line", F.try_parse_json("line").alias("value"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(path, code, n): lines that are no JSON, and unfinished ones that are too long to wait for."""
    rows = lines.withColumn("value", F.try_parse_json("line"))
    code = F.when(F.col("ended") & (F.col("line") != "") & F.col("value").isNull(), "MALFORMED_JSONL")
    code = code.when(~F.col("ended") & (F.octet_length("line") > jsonl.MAX_PENDING), "MALFORMED_JSONL_PENDING_OVERFLOW")
    return rows.select("path", code.alias("code")).filter("code is not null").groupBy("path", "code").agg(F.count("*").alias("n"))


def advanced(planned: DataFrame, lines: DataFrame, source: str, version: int, logical: DataFrame, revision: int = 0) -> DataFrame:
    """The cursors (CURSOR) of the files that a plan has read; logical has path and logical_id."""
    tail = lines.filter(~F.col("ended")).groupBy("path").agg(F.max("begin").alias("begin"), F.max(F.octet_length("line")).alias("n"))
    kept = F.when(F.col("n") <= jsonl.MAX_PENDING, F.col("size") - F.col("begin")).otherwise(0)
    rows = planned.filter("start is not null").join(tail, "path", "left").join(logical, "path", "left")
    return rows.select(
        F.lit(source).alias("source"), "path", "logical_id", F.col("size").alias("offset"), F.coalesce(kept, F.lit(0)).cast("long").alias("pending"),
        "size", "modified_ms", F.lit(version).alias("version"), F.lit(revision).alias("revision"),
    )


def scan_claude(planned: DataFrame, state: DataFrame, ingest_ms: int, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and the new state of the files that a plan reads on: of those that are read from their start the old state is void."""
    going_on = planned.filter("start is not null and not replaces").select("path")
    before = state.join(going_on, "path", "left_semi")
    return decoders.claude_scan(parsed(lines), ingest_ms, before)
