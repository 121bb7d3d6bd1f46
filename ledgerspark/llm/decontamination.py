"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

``build_index`` stores the postings (term, doc, pos) of training tokens, lists together and in order; a hot
term's list is split over SALTS parts. ``find_phrases`` looks up windows of test text: in each window it
takes the two rarest terms, intersects their lists with the offsets subtracted, and only alignments that
pass are checked against the lists of all the other terms. ``find_near`` gives proximity matches.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is WINDOW words in
a row; a test item with fewer, but not none, is one window.

Cases: null and empty texts have no words and are never hit; items without words match nothing; a null
doc_id is taken as one document of its own; repeated rows of a document get the same result each, and rows
that share a doc_id but not a text get what is found in any of them; items that share an item_id count as
one item. Empty tables give empty results or none hit. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, table

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SALTS = 32
NULL_ID = -(2**63)


def terms(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NULL_ID))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc, pos), stored by term; only of the terms in vocabulary (term) if there is one."""
    postings = docs.select(doc_key().alias("doc"), F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    if vocabulary is not None:
        postings = postings.join(small(vocabulary), "term", "left_semi")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.col("doc"), F.lit(SALTS))
    postings = postings.select("term", "doc", "pos").repartition(parts, F.col("term"), salt)
    return stored(postings.sortWithinPartitions("term", "doc", "pos"), "index")


def test_terms(items: DataFrame) -> DataFrame:
    """A row a word of the test items: item (a key), item_id, idx, term, n_item (words in the item)."""
    rows = items.select("item_id", terms(F.col("text")).alias("_terms")).filter(F.size("_terms") > 0).distinct()
    key = F.xxhash64("item_id", "_terms")
    return rows.select(
        key.alias("item"), "item_id", F.size("_terms").alias("n_item"), F.posexplode("_terms").alias("idx", "term")
    )


def find_phrases(index: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, item, start, length): maximal runs of at least a window of words of item from doc's word start on."""
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    words = stored(words.join(counts, "term", "left").fillna(0, ["df"]), "test-terms")
    length = F.least(F.col("n_item"), F.lit(window))
    # each word belongs to the windows that start in the last `window` places, itself included
    first = F.greatest(F.col("idx") - length + 1, F.lit(0))
    last = F.least(F.col("idx"), F.col("n_item") - length)
    windows = (
        words.withColumn("at", F.explode(F.sequence(first, last)))
        .groupBy("item", "at")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term", "idx"))).alias("rarest"))
        .filter(F.col("rarest")[0]["df"] > 0)
    )
    second = F.coalesce(F.get("rarest", F.lit(1)), F.col("rarest")[0])
    anchors = windows.select(
        "item",
        F.col("rarest")[0]["term"].alias("term"),
        F.col("rarest")[0]["idx"].alias("idx"),
        second["term"].alias("term2"),
        second["idx"].alias("idx2"),
    ).distinct()
    anchors = stored(anchors, "anchors")
    one = index.join(small(anchors), "term").select(
        "doc", "item", "idx2", (F.col("pos") - F.col("idx")).alias("shift")
    )
    seconds = anchors.select("item", F.col("term2").alias("term"), "idx2").distinct()
    two = index.join(small(seconds), "term").select(
        "doc", "item", "idx2", (F.col("pos") - F.col("idx2")).alias("shift")
    )
    aligned = one.join(two, ["doc", "item", "idx2", "shift"], "left_semi").select("doc", "item", "shift").distinct()
    aligned = stored(aligned, "aligned")
    expected = aligned.join(small(words.select("item", "n_item", "idx", "term")), "item").withColumn(
        "pos", F.col("shift") + F.col("idx")
    )
    near = index.join(small(aligned.select("doc").distinct()), "doc", "left_semi")
    found = expected.join(near, ["doc", "pos", "term"], "left_semi").select("doc", "item", "n_item", "shift", "idx")
    in_order = Window.partitionBy("doc", "item", "shift").orderBy("idx")
    return (
        found.distinct()
        .withColumn("run", F.col("idx") - F.row_number().over(in_order))
        .groupBy("doc", "item", "n_item", "shift", "run")
        .agg(F.min("idx").alias("_first"), F.count("*").alias("length"))
        .filter(F.col("length") >= length)
        .select("doc", "item", (F.col("shift") + F.col("_first")).alias("start"), "length")
    )


def find_near(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """From pairs (term, term2): (term, term2, doc, pos, pos2) where both terms stand at most `within` words apart.

    Places are looked up by blocks of `within` words, so a common term meets only its neighbours."""
    block = F.floor(F.col("pos") / within)
    one = index.join(small(pairs), "term").withColumn("block", block)
    one = one.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    two = index.select(F.col("term").alias("term2"), "doc", F.col("pos").alias("pos2"))
    two = two.join(small(pairs.select("term2").distinct()), "term2").withColumn("block", F.floor(F.col("pos2") / within))
    met = one.join(two, ["term2", "doc", "block"])
    far = F.abs(F.col("pos") - F.col("pos2"))
    same = (F.col("pos") == F.col("pos2")) & (F.col("term") == F.col("term2"))
    return met.filter((far <= within) & ~same).select("term", "term2", "doc", "pos", "pos2")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit of at least percent)."""
    words = stored(test_terms(items), "test-words")
    index = build_index(docs, words.select("term").distinct())
    phrases = stored(find_phrases(index, words.select("item", "n_item", "idx", "term"), window), "phrases")
    end = (F.col("start") + F.col("length") - 1).cast("int")
    hits = phrases.select("doc", F.explode(F.sequence(F.col("start").cast("int"), end)).alias("pos")).distinct()
    hits = hits.groupBy("doc").agg(F.count("*").alias("n_hit"))
    ids = words.select("item", "item_id").distinct()
    named = phrases.select("doc", "item").distinct().join(small(ids), "item").select("doc", "item_id").distinct()
    listed = F.array_sort(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    named = named.groupBy("doc").agg(
        F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256")
    )
    found = hits.join(named, "doc")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")
    each = docs.select("doc_id", doc_key().alias("doc"), n_words.alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return each.join(found, "doc", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM doc_window JOIN item_window USING (n, phrase)),
hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
