"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the total by weight; a share above ``max_epochs`` times the source's size
stops there, and what is left over goes to the other sources by weight, until none is above its cap.

A document is then repeated as often as its whole source is, and a seeded prefix of the source, in the
order of a hash of doc_id, once more. The prefix ends where the words come nearest to the target. Its end
is found in two steps that no hot source can unbalance: sums over 4096 hash bins by source, then a
running sum over the documents of the one bin in which the prefix ends.

Cases: a null or empty text has size 0 and is never short of its target; a null source is a source of its
own, the last in order; a null doc_id hashes as the empty text. Repeated rows count as often as they
occur. An empty table gives an empty result. Other columns play no part; ``repeated`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored, table

BINS_HEX = 3


def source_targets(sizes: DataFrame, max_epochs: float = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """From (source, size): source, source_size, weight, target. The window without keys has one row a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = by_source.withColumn("_at", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") + 1).cast("int"))
    )
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_epochs)).withColumn(
        "_ratio", F.col("_cap") / F.col("weight")
    )
    # With sources in the order of cap by weight, those that reach their cap come first. The level at which
    # the others stand is the highest of the levels that follow from capping the first 0, 1, 2, ... of them.
    filling = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    level = (F.sum("source_size").over(everything) - (F.sum("_cap").over(filling) - F.col("_cap"))).cast("double") / (
        F.sum("weight").over(everything) - (F.sum("weight").over(filling) - F.col("weight"))
    )
    return (
        capped.withColumn("_level", level)
        .withColumn("_top", F.max("_level").over(everything))
        .select(
            "source",
            "source_size",
            "weight",
            F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_top")).alias("target"),
        )
    )


def _sized(docs: DataFrame, seed: str, *keep: str) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, size.alias("_size"), key.alias("_key"), F.substring(key, 1, BINS_HEX).alias("_bin"))


def _plan(sized: DataFrame, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """A row a source: its target, whole repetitions, words wanted beyond them, and the bin where those end."""
    targets = source_targets(sized.select("source", F.col("_size").alias("size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_whole", whole.cast("long")).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    bins = sized.groupBy(F.col("source").alias("_src"), "_bin").agg(F.sum("_size").alias("_bin_size"))
    up_to = Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_before", F.sum("_bin_size").over(up_to) - F.col("_bin_size"))
    last = (
        bins.join(targets, bins["_src"].eqNullSafe(targets["source"]))
        .filter(F.col("_before") < F.col("_rest"))
        .groupBy("_src")
        .agg(F.max("_bin").alias("_last"), F.max("_before").alias("_base"))
    )
    plan = targets.join(last, targets["source"].eqNullSafe(last["_src"]), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "_whole", "_rest", "_last", "_base"
    )
    return plan


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source, _size, _key and _bin get _copies and what plan has."""
    joined = rows.join(small(plan), rows["source"].eqNullSafe(plan["_source"]))
    running = (
        Window.partitionBy("_source", "_bin")
        .orderBy("_key", "_size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("_base") + F.sum("_size").over(running) - F.col("_size")
    at_end = F.coalesce(F.col("_bin") == F.col("_last"), F.lit(False))
    ends = joined.filter(at_end).withColumn("_extra", (2 * before + F.col("_size") <= 2 * F.col("_rest")).cast("long"))
    earlier = F.coalesce(F.col("_bin") < F.col("_last"), F.lit(False)).cast("long")
    both = ends.unionByName(joined.filter(~at_end).withColumn("_extra", earlier))
    return both.withColumn("_copies", F.col("_whole") + F.col("_extra"))


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """From docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    sized = stored(_sized(docs, seed, "doc_id", "source"), "mix-sizes")
    mixed = _copies(sized, stored(_plan(sized, max_epochs, weights), "mix-plan"))
    return mixed.select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def repeated(
    docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix"
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts aren't shuffled but for those of the last bins."""
    sized = stored(_sized(docs, seed, "source"), "mix-sizes")
    plan = stored(_plan(sized, max_epochs, weights).drop("source_size", "target"), "mix-plan")
    mixed = _copies(_sized(docs, seed, *docs.columns), plan)
    copies = F.array_repeat(F.lit(0), F.col("_copies").cast("int"))
    return mixed.withColumn("_copy", F.explode(copies)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: Needs the whole-document order only for sums, so the bins of the Spark form don't show in it.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 AS weight FROM by_source),
capped AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER filling - cap) AS DOUBLE)
            / CAST(sum(weight) OVER () - (sum(weight) OVER filling - weight) AS DOUBLE) AS level
  FROM capped
  WINDOW filling AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
running AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - s.size AS before
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT *, whole + CASE WHEN before < rest AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM running)
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies,
       CAST(copies * size AS BIGINT) AS taken
FROM counted
"""
