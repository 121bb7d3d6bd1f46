"""N-gram Jaccard join: all documents whose shingle sets overlap enough, as components, by T-occurrence search.

Two sets of which one has n shingles link only if they share T = 0.8 n of them, rounded up, or more.

1. Documents with equal sets become one set, with the smallest doc_id for a name.
2. Of the first 0.3 n hashes of a set, in the order of hashes, a partner lacks at most n - T. Only these are dealt, by value,
   to tasks that tell which are shared. Two partners deal some of the same ones (least_shared); a set with fewer has no partner. A batch
   of documents sends a hash it has several times once only, so a common shingle costs a task as many entries as there are batches.
3. What is left, a small share of the texts, is dealt in the same way with all hashes; a set stays with those it shares, if
   they are T or more.
4. Of n shared hashes, two partners have one of the first n - T + 1 in common, in the order of hashes. These make the
   inverted lists. Lists with the same members are looked at once.
5. In each list that still spans several components, a pivot is the query against the others: DivideSkip
   merges the short inverted lists of the sets it meets, probes the long ones by binary search, and keeps
   those that reach the overlap. What links is united, so most of a group of near copies is one component
   after a round or two, with about one search a copy.
6. After PIVOT_ROUNDS rounds each set that isn't in the largest component of a list is a query to all
   sets that its lists hold and whose sizes allow it, so no link between components is lost. A query's hashes are sent once a block
   it visits, so blocks are large, BLOCK sets or BLOCK_BYTES of hashes, and where there are several, sets of like size are in one.

Shingles are told apart by 64 bits of hash, sets by their size and 64 more.

Cases: null and empty texts have an empty set and no partner; a null doc_id is taken as one document of its
own, before all others; rows that share a doc_id count as one document that has all their links. Very long
texts are whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, shingles
from .common import stored, table
from .components import components

WIDTH = 5
PERCENT = 80
NULL_ID = -(2**63)
PIVOT_ROUNDS = 2
#: Of a set's hashes, how many in a hundred are dealt first.
FIRST_PERCENT = 30
#: Sets that one search compares with its query.
CHUNK = 512
#: Sets, and bytes of their hashes, of a block that all remaining queries visit; but CHUNK sets at least.
BLOCK, BLOCK_BYTES = 4096, 24_000_000
#: How often homes of lists that share a set become one.
HOME_ROUNDS = 2
SLICE_BYTES = 4_000_000
BYTES_A_PART = 48_000_000


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """100 * overlap >= PERCENT * union and union >= n."""
    return -(-PERCENT * n // 100)


def first_hashes(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many hashes of a set of n are dealt: percent of them, but more than a partner may lack."""
    return np.minimum(n, np.maximum(percent * n // 100, n - least_overlap(n)) + 1)


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many of a linked set's dealt hashes its partner deals too, at least.

    A set of k hashes deals 0.3 k and one more, of which its partner lacks 0.2 k at most, so both deal the first 0.1 k and one more
    of those they share, for the smaller k of the two; and no partner has fewer than T."""
    least = least_overlap(n)
    return least if percent == 100 else (percent + PERCENT - 100) * least // 100 + 1


def slices(batches: Iterator[pa.RecordBatch], least: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of about SLICE_BYTES of text, or of one longer text: a task's memory is bounded by those."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < len(batch):
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + least, "right")))
            yield batch.slice(k, m - k)
            k = m


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))


def _sets(batch: pa.RecordBatch, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets of a batch's texts, their sizes and hashes."""
    found = shingles.shingle_sets(batch.column("text").to_pylist(), width)
    return found, np.array([len(x) for x in found], np.int64), np.array([shingles.set_hash(x) for x in found], np.int64)


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row a document: doc, n (shingles), sig (hash of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, n, sig = _sets(batch, width)
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "n": n, "sig": sig})

    return stored(_texts(docs).mapInArrow(run, "doc long, n long, sig long"), "sets")


#: Kinds of entries: names and sizes of sets; hashes that are known to be shared; hashes to look up; hashes that several sets
#: of the batch have, which are shared wherever another batch has them.
OWN, SEVERAL, ASKED, KNOWN = b"o", b"s", b"a", b"k"
ENTRY = "part int, kind binary, sigs binary, hashes binary"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _entries(kind: bytes, part: np.ndarray, sigs: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    return [(p, kind, packed.raw(sigs[at], "<i8"), packed.raw(hashes[at], "<u8")) for p, at in packed.by_part(part)]


def _parts_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (shingles.mix(x.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _fresh(sigs: np.ndarray, hashes: np.ndarray, by_hash: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order of hash or of sig first."""
    order = np.lexsort((sigs, hashes) if by_hash else (hashes, sigs))
    sigs, hashes = sigs[order], hashes[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (hashes[1:] != hashes[:-1])
    return sigs[new], hashes[new]


def _several(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: where a new one begins, and which occur more than once."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    counts = np.diff(np.append(np.flatnonzero(new), len(values)))
    return new, np.repeat(counts > 1, counts)


def shared_sets(docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """(rep, n, hashes): of each distinct set that may have a partner, those of its first hashes that other sets have too."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_PART)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, n, sig = _sets(batch, width)
            ids = batch.column("doc").to_numpy()
            order = np.lexsort((ids, sig))
            first = order[np.flatnonzero(np.diff(sig[order], prepend=sig[order][:1] - 1))] if len(order) else order
            first = first[n[first] > 0]  # the smallest doc_id of each set
            if not len(first):
                continue
            counts = first_hashes(n[first], percent)
            values = np.concatenate([sets[i][:m] for i, m in zip(first, counts, strict=True)])
            sigs = np.repeat(sig[first], counts)
            sets.clear()
            order = np.argsort(values, kind="stable")
            values, sigs = values[order], sigs[order]
            new, several = _several(values)
            # names and sizes go where a set is put together, with the hashes that several sets here have
            rows = []
            for p, at in packed.by_part(_parts_of(sig[first], parts)):
                own = first[at]
                rows.append((p, OWN, packed.raw(np.stack([sig[own], ids[own], n[own]]), "<i8"), b""))
            rows += _entries(SEVERAL, _parts_of(sigs[several], parts), sigs[several], values[several])
            rows += _entries(ASKED, _parts_of(values[~several], parts), sigs[~several], values[~several])
            once = values[several & new]
            rows += [(p, KNOWN, b"", packed.raw(once[at], "<u8")) for p, at in packed.by_part(_parts_of(once, parts))]
            yield packed.batch(rows, NAMES)

    def tell_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, hashes, known = [], [], [np.zeros(0, np.uint64)]
        for batch in batches:
            passed = pc.or_(pc.equal(batch.column("kind"), OWN), pc.equal(batch.column("kind"), SEVERAL))
            if pc.any(passed).as_py():
                yield batch.filter(passed)
            for r in batch.filter(pc.invert(passed)).to_pylist():
                if r["kind"] == ASKED:
                    sigs.append(np.frombuffer(r["sigs"], "<i8"))
                    hashes.append(np.frombuffer(r["hashes"], "<u8"))
                else:
                    known.append(np.frombuffer(r["hashes"], "<u8"))
        if not hashes:
            return
        s, h = _fresh(np.concatenate(sigs), np.concatenate(hashes), True)
        _, shared = _several(h)
        shared |= np.isin(h, np.unique(np.concatenate(known)))
        # hashes that one batch alone has several times are shared there already; those that others have too are known here
        rows = _entries(SEVERAL, _parts_of(s[shared], parts), s[shared], h[shared])
        if rows:
            yield packed.batch(rows, NAMES)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, hashes, own = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == OWN:
                    own.append(np.frombuffer(r["sigs"], "<i8").reshape(3, -1))
                else:
                    sigs.append(np.frombuffer(r["sigs"], "<i8"))
                    hashes.append(np.frombuffer(r["hashes"], "<u8"))
        if not hashes:
            return
        sig, doc, n = np.concatenate(own, axis=1)
        order = np.lexsort((doc, n, sig))
        sig, doc, n = sig[order], doc[order], n[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = sig[1:] != sig[:-1]
        sig, doc, n = sig[keep], doc[keep], n[keep]
        s, h = _fresh(np.concatenate(sigs), np.concatenate(hashes), False)
        begins, ends = np.searchsorted(s, sig), np.searchsorted(s, sig, "right")
        likely = np.flatnonzero(ends - begins >= least_shared(n, percent))
        for k in range(0, len(likely), 500):
            some = likely[k : k + 500]
            content = [packed.raw(h[begins[i] : ends[i]], "<u8") for i in some]
            yield pa.RecordBatch.from_pydict({"rep": doc[some], "n": n[some], "hashes": pa.array(content, pa.binary())})

    sent = _texts(docs).mapInArrow(send, ENTRY).repartitionById(parts, F.col("part"))
    told = sent.mapInArrow(tell_shared, ENTRY).repartitionById(parts, F.col("part"))
    return stored(told.mapInArrow(put_together, "rep long, n long, hashes binary"), "shared-sets")


def likely_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rep, n, hashes): of each distinct set that shares T hashes or more, those it shares."""
    first = shared_sets(docs, FIRST_PERCENT, width).select(F.col("rep").alias("doc")).distinct()
    # a shuffle at every size: what is left of the texts grows with them
    left = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "doc_id", "text").join(first.hint("merge"), "doc", "left_semi")
    return shared_sets(stored(left.select("doc_id", "text"), "likely-texts"), 100, width)


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(hash, rep, n): the lists by the first hashes of each set, of which only one in each group of lists with the
    same members stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            if not len(batch):
                continue
            found = [hashes_of(x.as_py()) for x in batch.column("hashes")]
            found = [h[: len(h) - least_overlap(int(m)) + 1] for h, m in zip(found, n, strict=True)]
            lengths = [len(h) for h in found]
            flat = np.concatenate(found).view(np.int64)
            reps = np.repeat(batch.column("rep").to_numpy(), lengths)
            for k in range(0, len(flat), 200_000):
                part = slice(k, k + 200_000)
                yield pa.RecordBatch.from_pydict({"hash": flat[part], "rep": reps[part], "n": np.repeat(n, lengths)[part]})

    entries = stored(sets.mapInArrow(run, "hash long, rep long, n long"), "lists")
    members = F.sum(F.xxhash64("rep").cast("decimal(38,0)"))
    lists = entries.groupBy("hash").agg(F.count("*").alias("m"), members.alias("s"), F.min("rep").alias("r"))
    # stored before a join on hash, here and below: then both sides are dealt for the join alone, which splits a hot hash
    lists = stored(lists.filter("m > 1").groupBy("m", "s", "r").agg(F.min("hash").alias("hash")).select("hash"), "lists-once")
    return stored(entries.join(lists, "hash", "left_semi"), "lists")


def hashes_of(content: bytes) -> np.ndarray:
    return np.frombuffer(content, "<u8")


class Index:
    """Inverted lists of some sets, for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        self.sizes, self.owner = sizes, owner[order]
        self.hashes, begins = np.unique(flat[order], return_index=True)
        self.ends = np.append(begins, len(flat))

    def search(self, query: np.ndarray, n: int) -> np.ndarray:
        """DivideSkip: places of the sets that overlap query, the shared hashes of a set of n, enough."""
        at = np.minimum(np.searchsorted(self.hashes, query), len(self.hashes) - 1)
        at = at[self.hashes[at] == query]
        lengths = self.ends[at + 1] - self.ends[at]
        need = least_overlap(n)
        if len(at) < need:
            return at[:0]
        by_length = at[np.argsort(lengths, kind="stable")]
        n_long = min(int(need / (0.01 * np.log2(lengths.max()) + 1)), need - 1)
        short, long = by_length[: len(at) - n_long], by_length[len(at) - n_long :]
        merged = np.concatenate([self.owner[self.ends[i] : self.ends[i + 1]] for i in short])
        merged = np.bincount(merged, minlength=len(self.sizes))
        likely = np.flatnonzero(merged >= need - n_long)
        counts = merged[likely]
        for k, i in enumerate(long):
            listed = self.owner[self.ends[i] : self.ends[i + 1]]
            found = np.searchsorted(listed, likely)
            counts += listed[np.minimum(found, len(listed) - 1)] == likely
            enough = counts + (len(long) - 1 - k) >= need
            likely, counts = likely[enough], counts[enough]
            if not len(likely):
                break
        return likely[100 * counts >= PERCENT * (n + self.sizes[likely] - counts)]


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (pivot, rep) those that link, as (a, b). Each pivot is the query of searches among CHUNK sets or so."""
    sizes = stored(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "chunks")
    queries = sizes.select("pivot", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"))
    queries = queries.select(F.xxhash64("pivot", "chunk").alias("block"), F.col("pivot").alias("rep"), F.lit(0).cast("long").alias("component"))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = pairs.join(sizes, "pivot").select(F.xxhash64("pivot", chunk).alias("block"), "rep", F.col("rep").alias("component"))
    return searched(others, queries, sets)


def searched(members: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links from queries (block, rep, component) to members (block, rep, component) of the same block, one to each
    component other than the query's own."""
    both = members.withColumn("query", F.lit(0)).unionByName(queries.withColumn("query", F.lit(1)))
    both = both.join(sets, "rep").repartition("block").sortWithinPartitions("block", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, rows = None, None, []
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                if r["block"] != block:
                    block, index, rows = r["block"], None, []
                if not r["query"]:
                    rows.append(r)
                    continue
                if index is None and rows:
                    index = Index([hashes_of(x["hashes"]) for x in rows], np.array([x["n"] for x in rows]))
                    reps, components_ = (np.array([x[c] for x in rows]) for c in ("rep", "component"))
                if index is None:
                    continue
                at = index.search(hashes_of(r["hashes"]), r["n"])
                at = at[components_[at] != r["component"]]
                at = at[np.unique(components_[at], return_index=True)[1]]
                a += [r["rep"]] * len(at)
                b += reps[at].tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.mapInArrow(search, "a long, b long")


def blocks_of(m: Column, hashes: Column) -> Column:
    """How many blocks m sets with so many hashes in all make."""
    return F.least(F.ceil(m / CHUNK), F.greatest(F.ceil(m / BLOCK), F.ceil(8 * hashes / BLOCK_BYTES)))


def rest_linked(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in lists (hash, rep, n, component), all of them but for more than one to a component.

    Members that lie close together are dealt to blocks, those of several blocks by bands of size, so that a query goes past most of them. Members
    outside their list's largest component are queries to all blocks of their lists; lists with the same blocks are looked at once."""
    of_list = lists.groupBy("hash", "component").agg(F.count("*").alias("k"))
    of_list = of_list.groupBy("hash").agg(F.max_by("component", "k").alias("largest"), F.min("component").alias("least"))
    placed = stored(lists.join(stored(of_list, "rest-lists"), "hash"), "rest")
    homes = stored(placed.groupBy("rep", "component", "n").agg(F.min("least").alias("home")), "homes")
    for _ in range(HOME_ROUNDS):  # what is met through others lies in one home too
        nearest = placed.select("hash", "rep").join(homes.select("rep", "home"), "rep").groupBy("hash").agg(F.min("home").alias("home"))
        homes = stored(placed.join(stored(nearest, "list-homes"), "hash").groupBy("rep", "component", "n").agg(F.min("home").alias("home")), "homes")
    band = F.floor(F.log("n") / math.log(100 / PERCENT))
    bands = stored(homes.groupBy("home", band.alias("band")).agg(F.count("*").alias("m"), F.sum("n").alias("hashes")), "bands")
    several = bands.groupBy("home").agg((blocks_of(F.sum("m"), F.sum("hashes")) > 1).alias("several"))
    sizes = stored(bands.join(several, "home").select("home", "band", "several", blocks_of(F.col("m"), F.col("hashes")).alias("k")), "home-sizes")
    block = F.when(F.col("several"), F.xxhash64("home", "band", F.pmod(F.xxhash64("rep"), F.col("k")))).otherwise(F.xxhash64("home"))
    members = stored(homes.withColumn("band", band).join(sizes, ["home", "band"]).select("rep", "component", "n", block.alias("block")), "blocks")
    spans = members.groupBy("block").agg(F.min("n").alias("small"), F.max("n").alias("large"))
    members = members.drop("n")
    blocks = stored(placed.select("hash", "rep").join(members, "rep").select("hash", "block").distinct(), "list-blocks")
    looks = blocks.groupBy("hash").agg(F.sum(F.xxhash64("block").cast("decimal(38,0)")).alias("look"), F.count("*").alias("m"))
    looks = stored(looks, "looks")
    one = stored(looks.groupBy("look", "m").agg(F.min("hash").alias("hash")), "looks-once")
    to_blocks = one.join(blocks, "hash").join(stored(spans, "spans"), "block").select("look", "m", "block", "small", "large")
    asking = placed.filter("component <> largest").join(looks, "hash").select("look", "m", "rep", "n", "component").distinct()
    fits = (100 * F.col("n") >= PERCENT * F.col("small")) & (100 * F.col("large") >= PERCENT * F.col("n"))
    visits = asking.join(to_blocks, ["look", "m"]).filter(fits).select("block", "rep", "component").distinct()
    visits = stored(visits, "visits")
    # a block that very many queries visit is laid out several times
    salts = stored(visits.groupBy("block").agg(F.ceil(F.count("*") / (4 * CHUNK)).alias("salts")), "salts")
    visits = visits.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    visits = visits.select(F.xxhash64("block", "salt").alias("block"), "rep", "component")
    laid = members.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    laid = laid.select(F.xxhash64("block", "salt").alias("block"), "rep", "component")
    return searched(laid, visits, sets)


def near_size(a: str, b: str) -> Column:
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def join_components(sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that have a partner."""
    lists = inverted_lists(sets)
    united = sets.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(PIVOT_ROUNDS + 1):
        placed = lists.join(united.withColumnRenamed("node", "rep"), "rep", "left")
        placed = placed.withColumn("component", F.coalesce("component", "rep"))
        least, most = F.min("component").alias("least"), F.max("component").alias("most")
        pivot = F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(turn))).alias("p")
        spread = placed.groupBy("hash").agg(least, most, pivot).filter("least <> most").select("hash", "p.*")
        spread = stored(spread, "open-lists").toDF("hash", "pivot", "pn", "pc")
        if spread.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            met = placed.join(spread, "hash").filter((F.col("component") != F.col("pc")) & near_size("n", "pn"))
            links = linked(stored(met.select("pivot", "rep").distinct(), "pairs"), sets)
            used = spread.select("hash", F.col("pivot").alias("rep"))
            still = lists.join(spread.select("hash"), "hash", "left_semi")
            lists = stored(still.join(used, ["hash", "rep"], "left_anti"), "lists")
        else:
            links = rest_linked(placed.join(spread.select("hash"), "hash", "left_semi"), sets)
        edges = links.unionByName(united.select(F.col("node").alias("a"), F.col("component").alias("b")))
        united = stored(components(edges), "components")
    return united


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id."""
    table = set_table(docs, width)
    united = join_components(likely_sets(docs, width))
    names = table.filter("n > 0").groupBy("sig", "n").agg(F.min("doc").alias("rep"))
    # rows that share a doc_id are one document: they unite the components of all their sets
    twice = table.filter("n > 0").groupBy("doc").agg(F.count_distinct("sig").alias("k")).filter("k > 1")
    named = table.join(names, ["sig", "n"], "left")
    extra = named.join(twice, "doc", "left_semi").filter("rep is not null")
    if not extra.isEmpty():
        edges = extra.select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        united = components(edges.unionByName(united.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    united = united.withColumnRenamed("node", "rep")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc")).otherwise(F.col("doc"))
    return named.join(united, "rep", "left").select(
        F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(own != NULL_ID, own).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id) p
  JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * k >= 80 * (s.n + t.n - k)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.b FROM reached r JOIN link l ON l.a = r.other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN size USING (doc_id)
"""
