"""Quality classifier: hierarchical empirical Bayes over documents, their paths and their hosts.

A document's own evidence is a naive Bayes log likelihood ratio over binned text statistics, with bins and
counts from labelled documents. Sites add what their other documents say: for every host and every path
in it the expected number of good documents is summed over all documents (labels where there are any, else
the classifier's probability). Rates shrink: a path's to its host's, a host's to the global one, as strongly
as the spread between sites of the corpus asks for (moments of the beta-binomial). A document never counts
as evidence for its own site. The score is the posterior from site and document together.

``host`` and ``path`` are columns; for ``documents``, source stands for the host and lang for the path.

Cases: null or empty texts have zero statistics; a null host or path is a site of its own; null labels teach
nothing, and without labels of both classes every document scores the site's rate, one half. Repeated rows
are documents of their own. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table
from .quality_rules import sampled_labels
from .textstats import FEATURES, features, with_stats

BINS = 12
#: Features overlap in what they say; their sum counts by this factor.
TEMPER = 0.5


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def evidence(rows: DataFrame) -> tuple[Column, float]:
    """From rows (label, f_*): the log likelihood ratio of good to bad as a column over f_*, and the share of good."""
    names = list(FEATURES)
    cuts_at = [k / BINS for k in range(1, BINS)]
    by_class = rows.groupBy("label").agg(
        F.count("*").alias("n"), *[F.percentile_approx(f"f_{x}", cuts_at, 1000).alias(x) for x in names]
    )
    by_class = {r["label"]: r for r in by_class.collect()}  # two rows
    if 0 not in by_class or 1 not in by_class:
        return F.lit(0.0), 0.5
    cuts = {x: sorted({c for r in by_class.values() for c in r[x]}) for x in names}

    def bin_of(x: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[x]]), lambda c: c <= F.col(f"f_{x}")))

    counted = rows.select("label", F.posexplode(F.array(*map(bin_of, names))).alias("feature", "bin"))
    counted = counted.groupBy("label", "feature", "bin").count().collect()  # a row for each class, feature and bin
    seen = {(r["label"], r["feature"], r["bin"]): r["count"] for r in counted}
    total = F.lit(0.0)
    for number, x in enumerate(names):
        n_bins = len(cuts[x]) + 1
        ratios = []
        for k in range(n_bins):
            good, bad = ((seen.get((c, number, k), 0) + 0.5) / (by_class[c]["n"] + 0.5 * n_bins) for c in (1, 0))
            ratios.append(F.lit(math.log(good / bad)))
        total = total + F.element_at(F.array(*ratios), bin_of(x) + 1)
    good, bad = by_class[1]["n"], by_class[0]["n"]
    return total * TEMPER, good / (good + bad)


def _strength(sites: DataFrame, n: str, s: str, least: float = 2.0, most: float = 1000.0) -> tuple[float, float]:
    """Mean rate of sites and how many documents the prior is worth, by the moments of rates of sites."""
    rate = F.col(s) / F.col(n)
    r = sites.agg(F.sum(s), F.sum(n), F.avg(1 / F.col(n)), F.var_samp(rate)).first()  # one row
    if not r[1]:
        return 0.5, least
    mean = min(max(r[0] / r[1], 1e-6), 1 - 1e-6)
    within = mean * (1 - mean) * r[2]
    between = max((r[3] or 0.0) - within, 1e-9)
    return mean, min(max(mean * (1 - mean) / between - 1, least), most)


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = 20_000) -> DataFrame:
    """doc_id, doc_score (own evidence), host_rate, path_rate (without the document), score, kept (score >= 0.5)."""
    teachers = F.broadcast(sampled_labels(labels, "quality", sample_rows))  # bounded by sample_rows
    taught = with_stats(docs.join(teachers, "doc_id"), "_label").select(F.col("_label").alias("label"), *features())
    ratio, prior = evidence(stored(taught, "site-labels"))
    each = docs.select("doc_id", "text", F.col(host).alias("_host"), F.col(path).alias("_path"))
    each = with_stats(each, "doc_id", "_host", "_path").select("doc_id", "_host", "_path", *features())
    each = each.select("doc_id", "_host", "_path", ratio.alias("_ratio"))
    own = _sigmoid(F.col("_ratio") + math.log(prior / (1 - prior)))
    known = labels.select("doc_id", F.col("quality").alias("_label")).dropna().groupBy("doc_id").agg(F.max("_label").alias("_label"))
    each = each.withColumn("doc_score", own).join(known, "doc_id", "left")
    each = stored(each.withColumn("_good", F.coalesce(F.col("_label").cast("double"), "doc_score")).drop("_label"), "site-docs")

    paths = stored(each.groupBy("_host", "_path").agg(F.count("*").alias("_np"), F.sum("_good").alias("_sp")), "site-paths")
    hosts = paths.groupBy("_host").agg(F.sum("_np").alias("_nh"), F.sum("_sp").alias("_sh"))
    mean, host_worth = _strength(hosts, "_nh", "_sh")
    _, path_worth = _strength(paths, "_np", "_sp")
    named = hosts.select(F.col("_host").alias("_h"), "_nh", "_sh")
    sites = paths.join(named, paths["_host"].eqNullSafe(named["_h"])).select(
        F.col("_host").alias("_h"), F.col("_path").alias("_p"), "_np", "_sp", "_nh", "_sh"
    )
    sites = small(stored(sites, "sites"))
    at = each["_host"].eqNullSafe(sites["_h"]) & each["_path"].eqNullSafe(sites["_p"])
    joined = each.join(sites, at)
    host_rate = (F.col("_sh") - F.col("_good") + host_worth * mean) / (F.col("_nh") - 1 + host_worth)
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("_sp") - F.col("_good") + path_worth * F.col("host_rate")) / (F.col("_np") - 1 + path_worth)
    joined = joined.withColumn("path_rate", path_rate)
    return joined.withColumn("score", _sigmoid(F.col("_ratio") + _logit(F.col("path_rate")))).select(
        "doc_id", "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
