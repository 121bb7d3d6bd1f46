"""Approximate nearest neighbours by a hash-prefix forest: for some rows, the rows whose vectors have the largest cosine.

Each of TREES trees gives a vector a string of SYMBOLS symbols: a symbol is the axis, with its sign, that the vector lies nearest to after
a random rotation to AXES axes. A tree is its strings in sorted order, so those that begin with a prefix stand together.

1. Classes: equal vectors are one entry, with the smallest vec_ids; no more of its copies than are asked for can be among the nearest.
2. Trees: an entry's strings are computed once. The first symbols of a string (as many as the number of entries asks for) name its block; a block
   larger than BLOCK entries is split by hash, as counts and candidates of its parts just add up.
3. Descent: a query goes to its block in each tree and finds, by binary search in the sorted strings, how many entries share each length of
   prefix with it, up to the longest match.
4. Ascent: all trees of a query ascend together, to the longest length at which they have `wanted` entries between them. Above the blocks the sizes of
   blocks are added up; at length 0 all entries are candidates, in one tree.
5. All entries that share that prefix are candidates, without a cap. They are scored where they stand, in double precision on the vectors
   themselves; each block sends a query's best ones only, with ties decided by vec_id.

`wanted` is fitted: SAMPLE queries are compared with all entries, and for each true neighbour the counts of step 3 tell how many candidates
its query must ask for to reach it; the share RECALL of them is met, and never under LEAST_A_TREE entries a tree. So recall holds at every size, and
what a query costs follows from the data: where no vector is much nearer than others, much must be looked at.

Memory: a task holds the entries of one part of a block and a batch of queries.

Cases: null and zero vectors, those with null or non-finite components, and those of another length than that of the smallest vec_id take no
part, nor do rows with a null vec_id. Rows that share a vec_id are one row, with the least of their vectors. With fewer candidates than are asked for, all are given.
An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, table

NEAREST = 5
EVERY = 50
TREES = 40
AXES = 32
BITS = 6
SYMBOLS = 6
BLOCK = 32_768
LEAST_A_TREE = 64
SAMPLE = 200
RECALL = 0.97
#: Scores that are computed at a time.
CELLS = 2_000_000
#: Products of matrices may differ in their last bits from sums of one row's products: so near, the latter decide.
SLACK = 1e-9


def rotations(n: int, trees: int = TREES, symbols: int = SYMBOLS, seed: int = 7) -> np.ndarray:
    """(trees, symbols, n, axes) with orthonormal axes; fewer than AXES if n is smaller."""
    random = np.random.default_rng([seed, n])
    return np.linalg.qr(random.normal(size=(trees, symbols, n, min(n, AXES))))[0]


def strings(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """(rows, trees): symbols from the first on, BITS bits each."""
    out = np.zeros((len(x), len(turns)), np.int64)
    for tree, several in enumerate(turns):
        for turn in several:
            y = x @ turn
            axis = abs(y).argmax(1)
            symbol = 2 * axis + (y[np.arange(len(y)), axis] > 0)
            out[:, tree] = (out[:, tree] << BITS) | symbol
    return out


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, each from sums of its own products in one order."""
    dot, xx, yy = ((a * b).sum(1) for a, b in ((x, y), (x, x), (y, y)))
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def best_of(q: np.ndarray, v: np.ndarray, rep: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in v, score) of the n best entries of each query, ties to the smaller rep."""
    about = (q @ v.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((v * v).sum(1))
    if len(v) > n:
        least = np.partition(about, len(v) - n, axis=1)[:, len(v) - n] - SLACK
        at, of = np.nonzero(about >= least[:, None])
    else:
        at, of = (x.ravel() for x in np.indices(about.shape))
    exact = scores(q[at], v[of])
    order = np.lexsort((rep[of], -exact, at))
    at, of, exact = at[order], of[order], exact[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < n], of[place < n], exact[place < n]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, one for each vec_id."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("v")).filter("vec_id is not null and v is not null")
    number = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is larger than all others
    rows = rows.filter(number & F.exists("v", lambda x: x != 0))
    first = rows.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    rows = rows.filter(F.size("v") == (first["n"] if first else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def forest(rows: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """A row a class of equal vectors: rep and ids (its smallest vec_ids), v, strings (one a tree)."""
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    some = rows.withColumn("k", rank).filter(F.col("k") <= nearest + 1)
    classes = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch.column("v"))
            turns = rotations(x.shape[1]) if turns is None else turns
            found = pa.array(strings(x, turns).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "ids", "v")), found], names=["rep", "ids", "v", "strings"])

    kind = rows.schema["v"].dataType.simpleString()
    classes = classes.select(F.col("ids")[0].alias("rep"), "ids", "v")
    return stored(classes.mapInArrow(run, f"rep long, ids array<long>, v {kind}, strings array<long>"), "forest")


def prefix(of: str, length: int | Column) -> Column:
    """The first symbols of a string."""
    return F.expr(f"shiftright({of}, {BITS * (SYMBOLS - length)})")


def grouped(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """From rows in order of part and of is_query: for each part of a block, its entries (columns as arrays, of which `more`
    are asked for besides the strings) with a batch of its queries, again and again."""
    part, held, entries = None, [], None
    for batch in batches:
        ids = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1])) + 1).tolist(), len(ids)] if len(ids) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ids[a] != part:
                part, held, entries = ids[a], [], None
            some = batch.slice(a, b - a)
            asking = some.column("is_query").to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(asking, True))
            if n:
                held.append(some.slice(0, n))
            if n < len(some) and held:
                if entries is None:
                    whole = pa.Table.from_batches(held).combine_chunks().sort_by("string")
                    entries = {x: whole.column(x).combine_chunks() for x in ("string", *more)}
                    held = [True]
                yield entries, some.slice(n)


def _span(sorted_: np.ndarray, string: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share so many symbols with each of some stand."""
    width = BITS * (SYMBOLS - length)
    low = (string >> width) << width
    return np.searchsorted(sorted_, low), np.searchsorted(sorted_, low + (1 << width))


def block_sizes(entries: DataFrame) -> DataFrame:
    """(tree, block, size, salts)."""
    sizes = entries.groupBy("tree", "block").agg(F.count("*").alias("size"))
    return stored(sizes.withColumn("salts", F.ceil(F.col("size") / BLOCK)), "blocks")


def _together(entries: DataFrame, queries: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Entries and queries (tree, block, ...) dealt by parts of blocks, entries first. A query comes to every part of its block."""
    salts = small(sizes.select("tree", "block", "salts"))
    mine = entries.join(salts, ["tree", "block"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    asking = queries.join(salts, ["tree", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    part = F.xxhash64("tree", "block", "salt").alias("part")
    sides = (x.select(part, F.lit(k).alias("is_query"), "string", *columns) for x, k in ((mine, False), (asking, True)))
    return next(sides).unionByName(next(sides)).repartition("part").sortWithinPartitions("part", "is_query")


def prefix_counts(entries: DataFrame, queries: DataFrame, sizes: DataFrame, depth: int) -> DataFrame:
    """(rep, length, n): how many entries of all trees share a prefix of each length with the query (its class's rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, asking in grouped(batches, []):
            sorted_, string = held["string"].to_numpy(), asking.column("string").to_numpy()
            for length in range(depth, SYMBOLS + 1):
                begin, end = _span(sorted_, string, length)
                some = np.flatnonzero(end > begin)
                columns = [asking.column("rep").take(pa.array(some)), pa.array(np.full(len(some), length, np.int32)), pa.array((end - begin)[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "length", "n"])

    found = _together(entries, queries, sizes, ["rep"]).mapInArrow(run, "rep long, length int, n long")
    for length in range(1, depth):
        above = stored(sizes.groupBy("tree", F.expr(f"shiftright(block, {BITS * (depth - length)})").alias("above")).agg(F.sum("size").alias("n")), "above")
        asked = queries.withColumn("above", prefix("string", length)).join(small(above), ["tree", "above"])
        found = found.unionByName(asked.select("rep", F.lit(length).alias("length"), "n"))
    return stored(found.groupBy("rep", "length").agg(F.sum("n").alias("n")), "counts")


def true_neighbours(classes: DataFrame, sample: list, nearest: int) -> DataFrame:
    """(rep, other, shared): for each query of a bounded sample (rep, v, strings) its nearest classes among all, and the longest prefix that
    they share in any tree."""
    q, reps, own = np.array([r["v"] for r in sample], np.float64), np.array([r["rep"] for r in sample]), np.array([r["strings"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), max(1, CELLS // len(q))):
                some = batch.slice(k, max(1, CELLS // len(q)))
                at, of, score = best_of(q, _vectors(some.column("v")), some.column("rep").to_numpy(), nearest + 1)
                theirs = some.column("strings").flatten().to_numpy().reshape(len(some), -1)
                differ = own[at] ^ theirs[of]
                shared = sum((differ >> (BITS * (SYMBOLS - length)) == 0).any(1).astype(np.int32) for length in range(1, SYMBOLS + 1))
                columns = [reps[at], some.column("rep").to_numpy()[of], score, shared]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "other", "score", "shared"])

    found = classes.mapInArrow(run, "rep long, other long, score double, shared int")
    place = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "other"))
    return found.filter("rep <> other").withColumn("k", place).filter(F.col("k") <= nearest).select("rep", "other", "shared")


def wanted(classes: DataFrame, queries: DataFrame, counts: DataFrame, nearest: int) -> int:
    """How many entries a query asks its trees for, so that the share RECALL of a sample's true neighbours is among them."""
    sample = queries.orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()
    if not sample:
        return 0
    near = true_neighbours(classes, sample, nearest)
    # found if the ascent goes as far as the shared prefix: if one symbol more has too few entries
    more = counts.select(F.col("rep").alias("_rep"), (F.col("length") - 1).alias("shared"), "n")
    need = near.join(more, (F.col("rep") == F.col("_rep")) & (near["shared"] == more["shared"]), "left").select((F.coalesce("n", F.lit(0)) + 1).alias("need"))
    needs = sorted(r["need"] for r in need.collect())  # SAMPLE * nearest at most
    return max(needs[int(RECALL * (len(needs) - 1))] if needs else 0, LEAST_A_TREE * TREES)


def visits(queries: DataFrame, levels: DataFrame, sizes: DataFrame, depth: int) -> DataFrame:
    """(rep, tree, string, block, length): the blocks whose entries a query looks at."""
    asking = queries.join(levels, "rep")
    own = asking.filter(F.col("length") >= depth).withColumn("block", prefix("string", depth))
    found = own.select("rep", "tree", "string", "block", "length")
    for length in range(1, depth):
        above = sizes.select("tree", "block", F.expr(f"shiftright(block, {BITS * (depth - length)})").alias("above"))
        several = asking.filter(F.col("length") == length).drop("block").withColumn("above", prefix("string", length)).join(above, ["tree", "above"])
        found = found.unionByName(several.select(found.columns))
    # a query that ascends to the root meets all entries, once, in the first tree
    every = asking.filter("length = 0 and tree = 0").drop("block").join(sizes.select("tree", "block"), "tree")
    return found.unionByName(every.select(found.columns))


def candidates(entries: DataFrame, asked: DataFrame, sizes: DataFrame, depth: int, nearest: int) -> DataFrame:
    """(query, rep, ids, score): the best entries of each part of a block for each query (its class's rep)."""
    n = nearest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, asking in grouped(batches, ["rep", "ids", "v"]):
            sorted_, reps, v = held["string"].to_numpy(), held["rep"].to_numpy(), _vectors(held["v"])
            string, length, q = asking.column("string").to_numpy(), asking.column("length").to_numpy(), _vectors(asking.column("v"))
            spans = []
            whole = np.flatnonzero(length <= depth)
            for k in range(0, len(whole), max(1, CELLS // len(v))):
                spans.append((whole[k : k + max(1, CELLS // len(v))], 0, len(v)))
            for i in np.flatnonzero(length > depth):
                begin, end = _span(sorted_, string[i : i + 1], int(length[i]))
                if end[0] > begin[0]:
                    spans.append((np.array([i]), int(begin[0]), int(end[0])))
            for some, begin, end in spans:
                at, of, score = best_of(q[some], v[begin:end], reps[begin:end], n)
                of = pa.array(of + begin)
                columns = [asking.column("rep").take(pa.array(some[at])), held["rep"].take(of), held["ids"].take(of), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "rep", "ids", "score"])

    together = _together(entries.withColumn("length", F.lit(0)), asked, sizes, ["rep", "ids", "v", "length"])
    found = together.mapInArrow(run, "query long, rep long, ids array<long>, score double")
    # an entry that several trees give has the same score in each
    return found.groupBy("query", "rep").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))


def neighbours(embeddings: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = sound_vectors(embeddings)
    classes = forest(rows, nearest)
    n = classes.count()
    depth = 1
    while depth < SYMBOLS - 1 and n > BLOCK << (BITS * depth):
        depth += 1
    trees = classes.select("rep", "ids", "v", F.posexplode("strings").alias("tree", "string")).withColumn("block", prefix("string", depth))
    # queries of one class ask once
    asking = stored(rows.filter(F.col("vec_id") % every == 0).select("vec_id", F.col("v").alias("_v")), "asking")
    reps = classes.select("rep", "v")
    of_query = stored(reps.join(asking, F.col("v") == F.col("_v")).select("rep", F.col("vec_id").alias("query_id")), "queries")
    queries = stored(classes.join(of_query.select("rep").distinct(), "rep", "left_semi"), "query-classes")
    each = queries.select("rep", F.posexplode("strings").alias("tree", "string")).withColumn("block", prefix("string", depth))
    sizes = block_sizes(trees.select("tree", "block"))
    counts = prefix_counts(trees.drop("v", "ids"), each, sizes, depth)
    enough = wanted(classes, queries, counts, nearest)
    levels = counts.filter(F.col("n") >= enough).groupBy("rep").agg(F.max("length").alias("length"))
    levels = queries.select("rep").join(levels, "rep", "left").fillna(0, ["length"])
    asked = visits(each, stored(levels, "levels"), sizes, depth).join(queries.select("rep", "ids", "v"), "rep")
    found = stored(candidates(trees, asked, sizes, depth, nearest), "candidates")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    found = found.withColumn("k", place).filter(F.col("k") <= nearest + 1).select(F.col("query").alias("rep"), "ids", "score")
    pairs = of_query.join(found, "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
