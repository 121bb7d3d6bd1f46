"""A corpus pipeline of five operators over ``documents``: STAGES, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents. Rows are judged
one by one: where a doc_id is null or repeated, rows that share it get numbers of their own (keyed), which stand
for doc_id within a stage, so a row that goes takes no other along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import decontamination, jaccard_join, mixing, quality_rules, training_order
from ledgerspark.llm.common import small, stored, table


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of its own for each row, in the order of doc_id (null first): doc_id itself where all differ."""
    n = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    if n["rows"] == n["named"] and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    ordered = docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return stored(ordered.withColumn("_row", F.monotonically_increasing_id()), "keyed")


def numbered(rows: DataFrame) -> DataFrame:
    """What an operator gets to judge: the rows with their numbers for doc_id."""
    return rows.withColumn("doc_id", F.col("_row")).drop("_row")


def _without(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """keyed rows but for those whose number is in marks, as documents again."""
    marks = stored(marks.select(F.col("doc_id").alias("_row")).distinct(), "marks")
    return rows.join(small(marks), "_row", "left_anti").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or that a learned rule rejects go; labels teach with all rows of their doc_id."""
    rows, labels = keyed(docs), table(spark, sf_dir, "labels")
    own = rows.select("doc_id", "_row").filter("not (doc_id <=> _row)")
    if not own.isEmpty():
        known = labels.join(rows.select("doc_id", "_row"), "doc_id")
        labels = known.withColumn("doc_id", F.col("_row")).select(*labels.columns)
    found = quality_rules.verdicts(numbered(rows), labels)
    return _without(rows, found.filter("not kept")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of rows that share it, one."""
    rows = keyed(docs)
    found = stored(jaccard_join.near_duplicates(numbered(rows)), "near")
    return _without(rows, found.filter("doc_id <> component_id")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a share go."""
    rows = keyed(docs)
    found = decontamination.contamination(numbered(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.filter("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.repeated(docs)


def materialise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards in training order; returns where each sequence is."""
    return training_order.ordered(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", materialise),
]

#: Learned rules and token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-"))
    return docs
