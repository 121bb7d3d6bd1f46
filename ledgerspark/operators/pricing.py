"""The price catalogue and costs. Prices are whole thousandths of a dollar a million tokens, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import small
from ..functions.usage import normalized_model

# Id, exact names, aliases, families, then the price of a million input, cached input, cache creation
# and output tokens, in thousandths of a dollar.
CATALOGUE = [
    ("openai-gpt-5.4", ["gpt-5.4"], ["gpt-5.4-codex"], ["gpt-5.4"], 2500, 250, None, 15000),
    ("openai-gpt-5", ["gpt-5"], [], ["gpt-5"], 1250, 125, None, 10000),
    ("anthropic-claude-opus-4", ["claude-opus-4"], [], ["claude-opus-4"], 15000, 1500, 18750, 75000),
    ("anthropic-claude-sonnet-4", ["claude-sonnet-4"], [], ["claude-sonnet-4"], 3000, 300, 3750, 15000),
    ("anthropic-claude-haiku-3.5", ["claude-haiku-3.5"], [], ["claude-haiku-3.5"], 800, 80, 1000, 4000),
]
# The names that an export shows for these.
LABELS = {
    "openai-gpt-5.4": "GPT-5.4", "openai-gpt-5": "GPT-5", "anthropic-claude-opus-4": "Claude Opus 4", "anthropic-claude-sonnet-4": "Claude Sonnet 4",
    "anthropic-claude-haiku-3.5": "Claude Haiku 3.5",
}
SCHEMA = """price_id string, exact array<string>, aliases array<string>, families array<string>,
            in_price long, cached_price long, creation_price long, out_price long, place int"""


def catalogue(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame([(*e, i) for i, e in enumerate(entries or CATALOGUE)], SCHEMA)


def resolve(models: DataFrame, prices: DataFrame) -> DataFrame:
    """From (model): model, normalized_model, match_kind and the price entry; one row a distinct model.

    Exact names win over aliases and these over families; of families the longest. Prices are few and broadcast."""
    each = models.select("model").distinct().withColumn("normalized_model", normalized_model(F.col("model")))
    names = prices.select(
        "price_id",
        "place",
        F.explode(
            F.concat(
                F.transform("exact", lambda n: F.struct(F.lit(0).alias("rank"), n.alias("name"))),
                F.transform("aliases", lambda n: F.struct(F.lit(1).alias("rank"), n.alias("name"))),
                F.transform("families", lambda n: F.struct(F.lit(2).alias("rank"), n.alias("name"))),
            )
        ).alias("n"),
    ).select("price_id", "place", F.col("n.rank").alias("rank"), normalized_model(F.col("n.name")).alias("name"))
    m, name = F.col("normalized_model"), F.col("name")
    family = (m == name) | m.contains(F.concat(name, F.lit("-")))
    hit = F.when(F.col("rank") < 2, m == name).otherwise(family)
    order = F.struct(
        "rank",
        F.when(F.col("rank") == 2, -F.length(name)).otherwise(F.col("place")).alias("a"),
        F.col("price_id").alias("b"),
    )
    best = each.join(F.broadcast(names), hit).groupBy("model").agg(F.min_by(F.struct("rank", "price_id"), order).alias("hit"))
    rank = F.col("hit.rank")
    kinds = F.when(rank == 0, "exact").when(rank == 1, "alias").when(rank == 2, "family-fallback")
    costs = prices.select("price_id", "in_price", "cached_price", "creation_price", "out_price")
    return (
        each.join(best, "model", "left")
        .withColumns({"match_kind": F.coalesce(kinds, F.lit("unmatched")), "price_id": F.col("hit.price_id")})
        .drop("hit")
        .join(F.broadcast(costs), "price_id", "left")
        .select("model", "normalized_model", "match_kind", "price_id", *costs.columns[1:])
    )


def label() -> Column:
    """The name of a row's price entry; its id where it has none."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(names[F.col("price_id")], F.col("price_id"))


def cost_units() -> Column:
    """The cost of a row's counters in billionths of a dollar; null without a price."""
    units = (
        F.col("input_tokens") * F.col("in_price")
        + F.col("cached_input_tokens") * F.coalesce("cached_price", "in_price")
        + F.col("cache_creation_input_tokens") * F.coalesce("creation_price", "in_price")
        + (F.col("output_tokens") + F.col("reasoning_output_tokens")) * F.col("out_price")
    )
    return units


def dollars(units: Column) -> Column:
    return F.coalesce(units.cast("decimal(38,0)"), F.lit(0)).cast("double") / 1e9


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows (with model and counters) with match_kind, price_id, cost_units."""
    found = resolve(rows, prices).drop("normalized_model")
    joined = rows.join(small(found), "model", "left")
    return joined.withColumn("cost_units", cost_units()).drop("in_price", "cached_price", "creation_price", "out_price")


#: In DuckDB: what resolve() finds, as a table (model, match_kind, prices) of records' models.
PRICES_SQL = """catalogue(price_id, rank, name, place, in_price, cached_price, creation_price, out_price) AS (VALUES
  ('openai-gpt-5.4', 0, 'gpt-5.4', 0, 2500, 250, 2500, 15000), ('openai-gpt-5.4', 1, 'gpt-5.4-codex', 0, 2500, 250, 2500, 15000),
  ('openai-gpt-5.4', 2, 'gpt-5.4', 0, 2500, 250, 2500, 15000),
  ('openai-gpt-5', 0, 'gpt-5', 1, 1250, 125, 1250, 10000), ('openai-gpt-5', 2, 'gpt-5', 1, 1250, 125, 1250, 10000),
  ('anthropic-claude-opus-4', 0, 'claude-opus-4', 2, 15000, 1500, 18750, 75000), ('anthropic-claude-opus-4', 2, 'claude-opus-4', 2, 15000, 1500, 18750, 75000),
  ('anthropic-claude-sonnet-4', 0, 'claude-sonnet-4', 3, 3000, 300, 3750, 15000), ('anthropic-claude-sonnet-4', 2, 'claude-sonnet-4', 3, 3000, 300, 3750, 15000),
  ('anthropic-claude-haiku-3.5', 0, 'claude-haiku-3.5', 4, 800, 80, 1000, 4000), ('anthropic-claude-haiku-3.5', 2, 'claude-haiku-3.5', 4, 800, 80, 1000, 4000)),
models AS (SELECT DISTINCT model, regexp_replace(regexp_replace(lower(trim(model)), '[ _]+', '-', 'g'), '-+', '-', 'g') AS normalized_model FROM records),
price_hits AS (
  SELECT m.model, m.normalized_model, c.*, row_number() OVER (PARTITION BY m.model ORDER BY c.rank, CASE WHEN c.rank = 2 THEN -length(c.name) ELSE c.place END, c.price_id) AS rn
  FROM models m JOIN catalogue c ON (m.normalized_model = c.name) OR (c.rank = 2 AND contains(m.normalized_model, c.name || '-'))),
prices AS (
  SELECT m.model, m.normalized_model, CASE h.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'family-fallback' ELSE 'unmatched' END AS match_kind,
         h.price_id, h.in_price, h.cached_price, h.creation_price, h.out_price
  FROM models m LEFT JOIN price_hits h ON h.model = m.model AND h.rn = 1)"""

COST_SQL = """(input_tokens * in_price + cached_input_tokens * cached_price + cache_creation_input_tokens * creation_price
  + (output_tokens + reasoning_output_tokens) * out_price)"""
