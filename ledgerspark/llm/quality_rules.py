"""Quality rules: a decision list learned by sequential covering, in DataFrame operations only.

From labelled documents, rules that reject are grown one after the other: a rule is a conjunction of
thresholds on text statistics, to which the literal of the best FOIL gain is added until the rule covers no
good document any more; it is then cut back to the prefix that does best on held-out rows, and kept if it is precise
there. Rows it covers leave the data and the next rule is grown. The list becomes one ordered conditional
expression. All counting is done by Spark: a grouped sum over (feature, bin) for each literal.

The rules are fitted on a sample of at most about ``sample_rows`` labelled documents, chosen by a hash of
doc_id; statistics and verdicts cover every document.

Cases: null and empty texts have no words and fail the base test; rows with a null label teach nothing;
without labels, or with labels of one class, the list is empty and keeps all that pass the base test.
Repeated rows each get their verdict. Other columns of the tables play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .textstats import FEATURES, features, with_stats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: An accuracy far above the rows of a sample, so that percentiles don't depend on the order of tasks and reruns agree.
EXACT = 1_000_000


@dataclass(frozen=True)
class Literal:
    feature: str
    cut: float
    above: bool

    def holds(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: tuple[tuple[Literal, ...], ...] = field(default=())

    def rejects(self) -> Column:
        """The list as a conditional expression over the feature columns: the number of the first rule that
        covers a row, from 1 on, or 0."""
        found = F.lit(0)
        for number, rule in reversed([*enumerate(self.rules, 1)]):
            found = F.when(_all(rule), number).otherwise(found)
        return found


def _all(rule: tuple[Literal, ...]) -> Column:
    holds = F.lit(True)
    for literal in rule:
        holds = holds & literal.holds()
    return holds


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best_literal(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[float, Literal | None, int, int]:
    """Of rows (bad, bins): the literal of the best gain, its gain and the rows of either class it covers."""
    counted = (
        rows.select("bad", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        .collect()
    )  # at most a row for each feature and bin
    best: tuple[float, Literal | None, int, int] = (0.0, None, 0, 0)
    for number, (name, own_cuts) in enumerate(cuts.items()):
        bins = {r["bin"]: (r["bad"], r["good"]) for r in counted if r["feature"] == number}
        all_bad, all_good = (sum(x[i] for x in bins.values()) for i in (0, 1))
        low_bad = low_good = 0
        for k, cut in enumerate(own_cuts):
            low_bad, low_good = (x + y for x, y in zip((low_bad, low_good), bins.get(k, (0, 0)), strict=True))
            for above, bad, good in ((True, all_bad - low_bad, all_good - low_good), (False, low_bad, low_good)):
                gain = _gain(bad, good, all_bad, all_good) if all_bad else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, Literal(name, cut, above), bad, good)
    return best


def learn(
    labelled: DataFrame,
    max_rules: int = 8,
    max_literals: int = 4,
    min_precision: float = 0.95,
    min_support: int = 5,
    n_cuts: int = 60,
) -> DecisionList:
    """From labelled (doc_id, bad 0/1, f_*): the decision list. Of the rows, a third by hash is held out for pruning."""
    names = list(FEATURES)
    labelled = stored(labelled.repartition(4, "doc_id"), "rule-rows")
    percents = [k / n_cuts for k in range(1, n_cuts)]
    probed = labelled.groupBy("bad").agg(
        *[F.percentile_approx(f"f_{x}", percents, EXACT).alias(x) for x in names], F.count("*").alias("n")
    )
    by_class = probed.collect()  # two rows
    if len(by_class) < 2:
        return DecisionList()
    cuts = {x: sorted({c for r in by_class for c in (r[x] or [])}) for x in names}

    def bin_of(name: str) -> Column:
        """How many cuts are at most the value."""
        at_most = F.filter(F.array(*[F.lit(c) for c in cuts[name]]), lambda c: c <= F.col(f"f_{name}"))
        return F.size(at_most)

    held_out = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held_out")
    binned = labelled.select("bad", held_out, F.array(*map(bin_of, names)).alias("bins"), *[f"f_{x}" for x in names])
    rows = stored(binned.repartition(4), "rule-bins")
    rules: list[tuple[Literal, ...]] = []
    while len(rules) < max_rules:
        left = rows.filter(DecisionList(tuple(rules)).rejects() == 0)
        growing, rule = left.filter(~F.col("held_out")), []
        while len(rule) < max_literals:
            _, literal, _, good = _best_literal(growing.filter(_all(tuple(rule))), cuts)
            if literal is None:
                break
            rule.append(literal)
            if not good:
                break
        if not rule:
            break
        prefixes = [tuple(rule[: k + 1]) for k in range(len(rule))]
        sums = []
        for k, prefix in enumerate(prefixes):
            sums.append(F.sum(F.when(_all(prefix), F.col("bad"))).alias(f"bad{k}"))
            sums.append(F.sum(F.when(_all(prefix), 1 - F.col("bad"))).alias(f"good{k}"))
        seen = left.filter("held_out").agg(*sums).first()
        scored = []
        for k, prefix in enumerate(prefixes):
            bad, good = seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0
            if bad >= min_support and bad >= min_precision * (bad + good):
                scored.append(((bad - good) / (bad + good), bad, -k, prefix))
        if not scored:
            break
        rules.append(max(scored)[3])
    return DecisionList(tuple(rules))


def sampled_labels(labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, label) of about sample_rows labelled rows at most, chosen by a hash of doc_id."""
    known = labels.select("doc_id", F.col(label).alias("_label")).dropna().distinct()
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < 1_000_000 * sample_rows // n)
    return known


def verdicts(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> DataFrame:
    """docs' doc_id with statistics, features, base_failed, rule (the first that rejects, or 0) and kept."""
    teachers = F.broadcast(sampled_labels(labels, "quality", sample_rows))  # bounded by sample_rows
    taught = with_stats(docs.join(teachers, "doc_id"), "doc_id", "_label")
    rules = learn(taught.select("doc_id", (1 - F.col("_label")).cast("int").alias("bad"), *features()), **options)
    # stored, a hundred bytes a document: else each use of a verdict would count all the words again
    stats = stored(with_stats(docs, "doc_id"), "rule-stats").select("*", *features())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": rules.rejects()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop(*[f"f_{x}" for x in FEATURES])
