"""Streaming: records that arrive are put in the store's place by id, and the buckets they touch are summed anew.

Late records are no special case: a batch names the buckets it touches, of whatever age, and those are
recomputed from the records, so the result is that of a batch run over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.usage import COUNTERS, bucket_start, total_tokens
from ..operators import matching
from ..operators.store import Store

RECORDS = """id string, source string, source_path string, session_id string, ts_ms long, model string, project_key string,
             input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long,
             reasoning_output_tokens long"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """New files of records as JSON lines in a folder."""
    return spark.readStream.schema(RECORDS).json(path)


def windowed(records: DataFrame, late: str = "1 day", width: str = "30 minutes") -> DataFrame:
    """Sums by source and window for sinks that can't be rewritten; what is later than `late` is left out."""
    moment = F.timestamp_millis("ts_ms")
    return (
        records.withColumn("moment", moment)
        .withWatermark("moment", late)
        .groupBy(F.window("moment", width).alias("w"), "source")
        .agg(F.count("*").alias("record_count"), F.sum(total_tokens()).alias("total_tokens"))
        .select(F.unix_millis("w.start").alias("bucket_start"), "source", "record_count", "total_tokens")
    )


def _of(rows: DataFrame, touched: DataFrame, how: str) -> DataFrame:
    """The rows whose bucket is, or isn't, among those touched; a missing project or model is one of its own."""
    named = touched.select(*[F.col(c).alias(f"_{c}") for c in touched.columns])
    same = F.lit(True)
    for c in touched.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, same, how)


def apply_batch(store: Store, batch: DataFrame, number: int | None = None, stream: str = "records") -> None:
    """One micro-batch: upsert by id, the last of a batch by time wins, and the touched buckets anew, in one publish.

    A numbered batch is applied once: one that comes again after it was published is left alone, and one that failed on the way
    has changed nothing, so what it touches is found anew."""
    from ..operators.rollup import buckets

    if batch.isEmpty() or number is not None and store.marks().get(stream, -1) >= number:
        return
    old = store.table("records")
    old = old if old is not None else batch.limit(0)
    before = old.join(batch.select("id").distinct(), "id", "left_semi")
    touched = before.unionByName(batch.select(*old.columns)).select("source", "model", "project_key", bucket_start(F.col("ts_ms")).alias("bucket_start")).distinct()
    records = matching.upserted(old, batch.select(*old.columns), "id", ["ts_ms", *COUNTERS])
    fresh = buckets(_of(records.withColumn("bucket_start", bucket_start(F.col("ts_ms"))), touched, "left_semi").drop("bucket_start"))
    known = store.table("buckets")
    summed = fresh if known is None else _of(known, touched, "left_anti").unionByName(fresh.select(*known.columns))
    store.publish(marks=None if number is None else {stream: number}, records=records, buckets=summed)


def run(spark: SparkSession, path: str, store: Store, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feeds the store from a folder: once through what is there, or again and again."""
    stream = read_records(spark, path).writeStream.foreachBatch(lambda batch, number: apply_batch(store, batch, number, checkpoint))
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
