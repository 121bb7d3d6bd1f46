"""Append-only JSONL logs: discovery, snapshots, complete lines and what is still pending.

Files are read with their bytes, so a line that isn't ended yet is known as such and never parsed, and a
character is never cut. A file is one row until it is split to lines in the same task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PENDING = 8 * 1024 * 1024
PEEK = 64 * 1024
_GLOB = "*.[jJ][sS][oO][nN][lL]"


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that are there, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            found.append(root)
    return found


def files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, modified_ms, size, content of all JSONL files below the roots; missing roots have none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    there = existing(spark, roots)
    if there:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB)
        found = reader.load(there)
    else:
        found = spark.createDataFrame([], schema)
    # what was there when the file was listed; bytes that came since belong to the next snapshot
    content = F.expr("substring(content, 1, cast(length as int))")
    return found.select("path", F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("size"), content.alias("content"))


def _lines(content: Column) -> Column:
    return F.split(F.decode(content, "UTF-8"), "\n")


def lines(found: DataFrame) -> DataFrame:
    """path, event_index, line, value of each complete line that isn't blank; value is null where a line is no JSON."""
    every = found.select("path", _lines(F.col("content")).alias("l"))
    ended = F.slice(F.col("l"), F.lit(1), F.size("l") - 1)
    kept = F.filter(F.transform(ended, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    rows = every.select("path", F.posexplode(kept).alias("line_index", "line"))
    rows = rows.withColumn("value", F.try_parse_json("line"))
    # an event's index counts the lines before it that could be parsed
    index = F.expr("count_if(value is not null) over (partition by path order by line_index rows between unbounded preceding and 1 preceding)")
    return rows.withColumn("event_index", index)


def status(found: DataFrame) -> DataFrame:
    """A row a file: lines, malformed lines, and whether text is pending or was too long to wait for."""
    tail = F.element_at(_lines(F.col("content")), -1)
    pending = found.select("path", F.octet_length(tail).alias("n"))
    counted = lines(found).groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").isNull()).alias("n_malformed"))
    joined = pending.join(counted, "path", "left")
    return joined.select(
        "path",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_malformed", F.lit(0)).alias("n_malformed"),
        ((F.col("n") > 0) & (F.col("n") <= MAX_PENDING)).alias("has_pending"),
        (F.col("n") > MAX_PENDING).alias("pending_overflow"),
    )


def peeked(found: DataFrame) -> DataFrame:
    """path and the complete lines of a file's first 64 KiB, as files."""
    return found.withColumn("content", F.expr(f"substring(content, 1, {PEEK})"))


def snapshot(found: DataFrame) -> DataFrame:
    """One row: how many files there are and a fingerprint of their paths, sizes and times, in no order."""
    each = F.xxhash64("path", "size", "modified_ms").cast("decimal(38,0)")
    return found.agg(F.count("*").alias("n_files"), F.sha2(F.coalesce(F.sum(each), F.lit(0)).cast("string"), 256).alias("fingerprint"))
