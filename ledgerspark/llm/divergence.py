"""Source divergence audit: how far the term use of each source of a language is from its other sources and from the language.

A language keeps the terms that LEAST_DOCS of its documents have. Each group (a source of a language) gives every kept term a
probability p, in billionths, smoothed by ADDED counts; so does the whole language (q). All arithmetic is on integers.

1. Count: a task counts the terms of its texts by group, in occurrences and in documents; one shuffle by language and term then
   adds these up and drops terms that too few documents have.
2. Terms (upper-bound search): of a group's terms, those with p > q and the largest p - q are asked for, TOP of them. Terms with
   about the same count are a bucket, whose bound is its largest p less the smallest q in it. Buckets are evaluated best bound
   first, in rounds of growing numbers; those whose bound is strictly below the value that ranks TOP so far are never looked at.
3. Pairs (postings): the sum over all kept terms of the differences of two sources. A term's posting list has the sources that use it.
   Where neither does, the difference is one constant; where one does, it depends on its count alone, so it is summed
   over the counts that occur; only terms of both are compared one by one, in numpy, and added up before they are shuffled.

Cases: null text, lang and source are ''. Empty texts have no terms, but their group is there; a language without kept terms has pairs of
value 0 and no terms. Every row is a document of its own, repeated or not; ties of value go by item. Very long texts are read in blocks. An
empty table gives an empty result. Other columns play no part. Counts are bounded by 64 bits, products by 38 digits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, table
from .jaccard_join import slices

LEAST_DOCS = 30
ADDED = 5
BILLION = 1_000_000_000
TOP = 50
#: A task holds so many counts of terms by group before it sends them.
HELD = 300_000
BLOCK = 1 << 20
#: Pairs of one posting list or of several that are compared at a time.
PAIRS = 1_000_000
#: A language's sources are laid out so many times for the sums over counts.
SALTS = 16
#: A-Z in lower case; a-z and bytes of other characters as they are; all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _blocks(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, several rows a term that are yet to be added up."""

    def rows(held: dict) -> pa.RecordBatch:
        found = [(*group, term, n, d[term]) for group, (total, d) in held.items() for term, n in total.items()]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text")), strict=True):
                total, d = held[lang, source]
                size -= len(total)
                seen = set()
                for block in _blocks(text.translate(LETTERS)):
                    terms = block.split()
                    total.update(terms)
                    seen.update(terms)
                d.update(seen)
                size += len(total)
                if size > HELD:
                    yield rows(held)
                    held.clear()
                    size = 0
        if size:
            yield rows(held)

    texts = _groups(docs, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "lang string, source string, term string, n long, d long")


def _groups(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("lang", "source")), *more)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): of the terms that enough documents of the language have, the counts in the source
    and in the language; first marks one source of each."""
    # dealt by language and term at once: sources are added up, and languages too, where the rows then are
    sums = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = W.partitionBy("lang", "term")
    sums = sums.withColumns({"total": F.sum("n").over(of_term), "docs": F.sum("d").over(of_term), "first": F.min("source").over(of_term)})
    rows = sums.filter(F.col("docs") >= least)
    return stored(rows.select("lang", "source", "term", "n", "total", (F.col("first") == F.col("source")).alias("first")), "terms")


def probability(n: str, sum_: str, size: str) -> Column:
    """In billionths, from a count, the counts of all kept terms and their number; null without terms."""
    exact = f"cast({BILLION} as decimal(20,0)) * cast({n} + {ADDED} as decimal(20,0))"
    return F.expr(f"1 + ({exact}) div nullif(cast({sum_} + {ADDED} * {size} as decimal(20,0)), 0)")


def group_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row a group that occurs: lang, source, sid (its number in the language), n_sum, k (its terms), v, lang_sum, p0."""
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_sum"), F.count("*").alias("k"))
    of_lang = terms.groupBy("lang").agg(F.sum("n").alias("lang_sum"), F.count_if("first").alias("v"))
    groups = _groups(docs).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["n_sum", "k", "lang_sum", "v"])
    sid = F.row_number().over(W.partitionBy("lang").orderBy("source")).alias("sid")
    return stored(groups.select("*", sid).withColumn("p0", probability("0", "n_sum", "v")), "groups")


def probabilities(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, sid, term, n, p, q, p0): a row a term that a group has."""
    known = terms.join(small(groups), ["lang", "source"])
    p, q = probability("n", "n_sum", "v").alias("p"), probability("total", "lang_sum", "v").alias("q")
    return stored(known.select("lang", "source", "sid", "term", "n", p, q, "p0"), "probabilities")


def top_terms(probs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): of each group the terms with the largest p - q over 0, by best-first search in buckets."""
    n = F.col("n")
    bucket = F.when(n <= 16, n).otherwise(16 + F.floor(8 * (F.log2(n) - 4))).cast("int")
    over = probs.filter("p > q").select("lang", "source", bucket.alias("bucket"), "term", "p", "q")
    of_bucket = over.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("size"))
    left, best, turn = stored(of_bucket, "buckets"), None, 0
    key = ["lang", "source"]
    ranked = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("value"), "item"))
    while best is None or not left.isEmpty():
        before = W.partitionBy(*key).orderBy(F.desc("bound"), "bucket").rowsBetween(W.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("size").over(before), F.lit(0))
        turned = stored(left.withColumn("now", ahead < top * 4**turn), "turned")
        chosen = turned.filter("now").select(*key, "bucket")
        found = over.join(small(chosen), [*key, "bucket"]).select(*key, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", ranked).filter(F.col("rank") <= top), "best")
        kth = best.filter(F.col("rank") == top).select(*key, F.col("value").alias("kth"))
        rest = turned.filter("not now").drop("now").join(small(kth), key, "left")
        left = stored(rest.filter("kth is null or bound >= kth").drop("kth"), "buckets")
        turn += 1
    return best


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From posting lists, what terms of both sources add to a pair beyond what each has alone: (lang, a, b, value), a < b."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        sizes = np.diff(batch.column("sid").offsets.to_numpy())
        begins = np.cumsum(sizes) - sizes
        sid, p, p0 = (batch.column(x).flatten().to_numpy() for x in ("sid", "p", "p0"))
        out = defaultdict(list)
        for lang in set(langs.tolist()):
            for m in np.unique(sizes[langs == lang]).tolist():
                at = begins[(langs == lang) & (sizes == m)]
                for i in range(m - 1):
                    # places i and i + 1 ... of lists of m sources, some lists and partners at a time
                    for j0 in range(i + 1, m, PAIRS):
                        others = np.arange(j0, min(m, j0 + PAIRS))
                        step = max(1, PAIRS // len(others))
                        for k in range(0, len(at), step):
                            s, t = at[k : k + step, None] + i, at[k : k + step, None] + others
                            value = abs(p[s] - p[t]) - abs(p[s] - p0[t]) - abs(p0[s] - p[t]) + abs(p0[s] - p0[t])
                            out[lang].append(_added((np.broadcast_to(sid[s], t.shape).astype(np.int64) << 32 | sid[t]).ravel(), value.ravel()))
        rows = []
        for lang, parts in out.items():
            pairs, values = _added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            rows += zip([lang] * len(pairs), (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), values.tolist(), strict=True)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "a", "b", "value"])


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, values)
    return found, sums


def source_pairs(probs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each two sources of a language, by number, the sum of their differences over all kept terms."""
    postings = probs.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "p0"))).alias("x"))
    postings = postings.filter("size(x) > 1").select("lang", *(F.col(f"x.{c}").alias(c) for c in ("sid", "p", "p0")))
    both = postings.mapInArrow(_pair_sums, "lang string, a long, b long, value long")
    # a term that a has and b hasn't: by a's counts, of which many terms share one
    alike = probs.groupBy("lang", F.col("sid").alias("a"), "p").agg(F.count("*").alias("k"))
    alike = alike.withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(SALTS)))
    others = groups.select("lang", F.col("sid").alias("b"), "p0", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    alone = alike.join(others, ["lang", "salt"]).filter("a <> b").withColumn("value", F.col("k") * F.abs(F.col("p") - F.col("p0")))
    alone = alone.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    one, two = (groups.select("lang", F.col("sid").alias(x), F.col("k").alias(f"k{x}"), F.col("p0").alias(f"p{x}"), "v") for x in "ab")
    apart = F.coalesce((F.col("v") - F.col("ka") - F.col("kb")) * F.abs(F.col("pa") - F.col("pb")), F.lit(0))
    neither = one.join(two.drop("v"), "lang").filter("a < b").select("lang", "a", "b", apart.alias("value"))
    every = neither.unionByName(alone).unionByName(both)
    return stored(every.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    terms = kept_terms(docs, least_docs)
    groups = group_table(docs, terms)
    probs = probabilities(terms, groups)
    found = source_pairs(probs, groups)
    turned = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "sid", "source")
    named = turned.join(names.withColumnRenamed("sid", "a"), ["lang", "a"])
    named = named.join(names.toDF("lang", "b", "item"), ["lang", "b"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.unionByName(top_terms(probs, top).withColumn("part", F.lit("term")).select(pairs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
term AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
held AS (SELECT lang, source, term, count(*) AS n FROM word JOIN term USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM doc),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN term USING (lang) LEFT JOIN held USING (lang, source, term)),
whole AS (SELECT lang, term, sum(n) AS n FROM held GROUP BY lang, term),
v AS (SELECT lang, count(*) AS v FROM term GROUP BY lang),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
  FROM every JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM whole JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
best AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM best
  QUALIFY rank <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
