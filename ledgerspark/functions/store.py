"""Tables in the shared folder: intermediate results that cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; rows of the tables meant here take some hundred bytes.
BROADCAST_ROWS = 100_000
#: Rows that a task gets of a shuffle in `dealt`, about, and how much of what was shuffled Spark may put together for one.
TASK_ROWS, TASK_BYTES = 200_000, "8m"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder, but only with a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
        base = _own[0]
    return base.rstrip("/")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has few rows; else the planner picks a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, shuffles have partitions in proportion to rows, so that what a task sorts doesn't grow with the input."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    # None where nobody has set it; what holds then is Spark's default, which get gives without one of ours
    spark.conf.set(names[0], str(max(int(spark.conf.get(names[0])), -(-rows // TASK_ROWS))))
    spark.conf.set(names[1], TASK_BYTES)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
