"""Suffix-array dedup by prefix-free parsing: bytes of passages that an earlier document has already.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller doc_id is
removed. Sorting the suffixes at all bytes would move the corpus many times over, so texts are parsed first:

1. Parse: a K-byte string whose rolling hash is a multiple of EVERY triggers the end of a phrase and the start of the next,
   which share these K bytes. So no suffix of a phrase that is longer than K begins another, and a LENGTH-byte string either
   lies in one phrase, wherever it occurs, or goes on from one phrase to the next around the same trigger.
2. Dictionary: phrases, and joints of the parse (the last bytes of a phrase and the first of those that follow, as far as
   strings of LENGTH bytes reach over the trigger), each with its first document. Later documents lose all of it, as each of its strings
   is in the first document. So what is equal for long stretches is compared by phrases and not by bytes.
3. Order: suffixes of the dictionary's phrases and joints, up to LENGTH bytes, are sorted by their bytes. A suffix shorter than a phrase
   allows is followed in the parse by its joint, so both together are the order of the corpus. Where neighbours agree
   in LENGTH bytes, all but those in the first document go.
4. The removed stretches of each document are put together and cut out.

Suffixes are dealt to tasks by the least K-byte hash of their LENGTH bytes, which neighbouring suffixes mostly share: a
stretch of them moves as one string, about four bytes a suffix. Only stretches move whose least hash is in several documents: the hashes
are gathered first, and one that is in a single document has suffixes that agree with no other's. A batch of documents sends a hash, a phrase, a
joint and a stretch for the first of its documents only. A task drops suffixes whose 64-bit hash occurs once there, and sorts the rest.
Phrases, joints and stretches are told apart by 128 bits of hash, suffixes by their bytes.

Memory: a task holds CHUNK bytes of text (one text at least) and some arrays of that length, or the suffixes of about BYTES_A_PART bytes of
text. All suffixes with one least hash meet in one task.

Cases: a null text is empty; texts under LENGTH bytes lose nothing; a null doc_id counts as one smaller than
all others; repeated rows (one doc_id, one text) get the same result each and don't remove each other.
Rows that share a doc_id but not a text are told apart by 128 bits of hash: each has a number of its own, and they
lose nothing to each other. doc_ids may be any 64-bit numbers. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import stored, table

LENGTH = 50
K = 20
W = LENGTH - K + 1
EVERY = 512
NULL_ID = -(2**63)
BYTES_A_PART = 8_000_000
CHUNK = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, mod 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE)
        )
    return _powers[size]


class Rolling:
    """Hashes of all stretches of some bytes."""

    def __init__(self, content: np.ndarray):
        self.n = len(content)
        self.up, self.down = _power(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((content.astype(np.uint64) + np.uint64(1)) * self.up[: self.n], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick of each window of width places, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(content: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: begin, end and owner of each phrase and joint that has LENGTH bytes or more."""
    hashes = Rolling(content).all(K) if len(content) >= K else np.zeros(0, np.uint64)
    at = np.flatnonzero(hashes % np.uint64(EVERY) == 0)
    owner = np.searchsorted(ends, at, "right")
    inside = at + K <= ends[owner]
    point = np.concatenate([begins, at[inside]])
    owner = np.concatenate([np.arange(len(begins)), owner[inside]])
    order = np.lexsort((point, owner))  # stable: a document's begin stays before a trigger there
    point, owner = point[order], owner[order]
    goes_on = np.append(owner[1:] == owner[:-1], False)
    trigger = np.append(point[1:], 0)
    phrase_end = np.where(goes_on, trigger + K, ends[owner])
    joint = np.maximum(point, trigger + K - LENGTH + 1)[goes_on]
    joint_end = np.minimum(ends[owner], trigger + LENGTH - 1)[goes_on]
    begin, end, owner = np.append(point, joint), np.append(phrase_end, joint_end), np.append(owner, owner[goes_on])
    full = end - begin >= LENGTH
    return begin[full], end[full], owner[full]


def stretches(content: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places that are wanted and whose LENGTH bytes have the same least K-byte hash: first place, number, hash."""
    least = _extreme(Rolling(content).all(K), W, np.minimum)
    at = np.flatnonzero(wanted[: len(least)])
    key = least[at]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])[: len(at)])
    return at[begins], np.diff(np.append(begins, len(at))), key[begins]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, size of them, for each begin."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: the number of the first, bytes end to end, begins, ends."""
    k = 0
    while k < len(texts):
        m, size = k, 0
        while m < len(texts) and (m == k or size + len(texts[m]) <= CHUNK):
            size += len(texts[m])
            m += 1
        lengths = np.array([len(x) for x in texts[k:m]])
        ends = np.cumsum(lengths)
        yield k, np.frombuffer(b"".join(texts[k:m]), np.uint8), ends - lengths, ends
        k = m


ENTRY = "part int, kind binary, docs binary, counts binary, behind binary, places binary, sizes binary, content binary"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]
PIECE, ONCE, TWICE = b"p", b"1", b"2"
REMOVED, ASKED, SHARED = b"r", b"a", b"s"
SIDES = {REMOVED: ("gone", "gone_sizes"), ASKED: ("asked", "asked_sizes"), SHARED: ("shared", "no_sizes")}
MARKS = "doc long, " + ", ".join(f"{x} binary" for pair in SIDES.values() for x in pair)
LOW = np.uint64(0xFFFFFFFF)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(x.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _entries(kind: bytes, part: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray | None = None, ids: np.ndarray | None = None, behind: np.ndarray | None = None) -> list[tuple]:
    """Packed by part; in each, sorted by document."""
    rows = []
    for p, at in packed.by_part(part):
        at = at[np.lexsort((place[at], doc[at]))]
        sizes = b"" if size is None else packed.raw(size[at], "<u4")
        late = None if behind is None else behind[at]
        rows.append((p, kind, *_holders(doc[at], late), packed.raw(place[at], "<u4"), sizes, b"" if ids is None else packed.raw(ids[at], "<u8")))
    return rows


def _holders(doc: np.ndarray, behind: np.ndarray | None) -> tuple[bytes, bytes, bytes]:
    """Documents as differences, how often each comes in a row, and how far each is behind the first text of its doc_id (nothing
    where all are first texts)."""
    docs, counts = packed.runs(doc)
    late = b"" if behind is None or not behind.any() else _shrunk(packed.raw(behind, "<i8"))
    return _shrunk(packed.raw(np.diff(docs, prepend=0), "<i8")), _shrunk(packed.raw(counts, "<i4")), late


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, places and sizes (0 where none are given) of a packed row."""
    docs = np.cumsum(np.frombuffer(_grown(r["docs"]), "<i8"))
    place = np.frombuffer(r["places"], "<u4").astype(np.int64)
    size = np.frombuffer(r["sizes"], "<u4").astype(np.int64) if r["sizes"] else np.zeros(len(place), np.int64)
    return np.repeat(docs, np.frombuffer(_grown(r["counts"]), "<i4")), place, size


def _behind(r: dict, n: int) -> np.ndarray:
    return np.frombuffer(_grown(r["behind"]), "<i8") if r["behind"] else np.zeros(n, np.int64)


def _apart(batch: pa.RecordBatch, *kinds: bytes) -> tuple[pa.RecordBatch, list[dict]]:
    """The rows that are of some kinds, and the others opened as dictionaries."""
    passed = pa.array([x in kinds for x in batch.column("kind").to_pylist()], pa.bool_())
    return batch.filter(passed), batch.filter(pc.invert(passed)).to_pylist()


def _runs_of(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of some sorted rows the value at the begin of its group; new marks the begins."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, behind, content): doc is a number of each doc_id and text, in the order of doc_id, null first, and the doc_id itself where
    all differ; behind is how far it is from the first text of its doc_id."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content")
    n = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    none = F.lit(0).cast("long").alias("behind")
    if n["rows"] == n["named"] and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select("doc_id", F.col("doc_id").alias("doc"), none, content)
    named = docs.select("doc_id", content).withColumn("digest", F.unhex(F.md5("content")))
    keys = named.select("doc_id", "digest").distinct().orderBy(F.asc_nulls_first("doc_id"), "digest")
    keys = stored(keys.withColumn("doc", F.monotonically_increasing_id()), "texts-in-order")
    first = stored(keys.groupBy("doc_id").agg(F.min("doc").alias("first")).withColumnRenamed("doc_id", "_id"), "first-texts")
    keys = keys.join(first, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("behind", F.col("doc") - F.col("first"))
    keys = stored(keys.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "doc", "behind"), "text-numbers")
    found = named.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    return found.select("doc_id", "doc", "behind", "content")


def removed_places(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, gone, gone_sizes, late, late_sizes): stretches of documents that go, by the dictionary and by the order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, size // BYTES_A_PART)

    def first_come(doc: np.ndarray, behind: np.ndarray, place: np.ndarray, size: np.ndarray, ids: np.ndarray, where: np.ndarray) -> tuple:
        """The same, sorted by id and document, and which of them are in a later doc_id than the first with the id."""
        order = np.lexsort((doc, ids[:, 1], ids[:, 0]))
        doc, behind, place, size, ids, where = doc[order], behind[order], place[order], size[order], ids[order], where[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])[: len(doc)]
        return doc, behind, place, size, ids, where, doc - behind > _runs_of(new, doc - behind)

    def digests(content: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        held = memoryview(content)
        joined = b"".join([xxhash.xxh3_128_digest(held[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(joined, "<u8").reshape(-1, 2)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, late, laid, found, base = batch.column("doc").to_numpy(), batch.column("behind").to_numpy(), [], [], 0
            for k, content, begins, ends in chunks(batch.column("content").to_pylist()):
                begin, end, owner = pieces(content, begins, ends)
                found.append((names[k + owner], late[k + owner], begin - begins[owner], end - begin, digests(content, begin, end), begin + base))
                laid.append((base, names[k : k + len(ends)], content, ends))
                base += len(content)
            if not found:
                continue
            doc, behind, place, size, ids, where, later = first_come(*(np.concatenate(x) for x in zip(*found, strict=True)))
            own = ~later
            rows = _entries(REMOVED, _part(doc[later], parts), doc[later], place[later], size[later])
            rows += _entries(PIECE, _part(ids[own, 0], parts), doc[own], place[own], size[own], ids[own], behind[own])
            change = np.zeros(base + 1, np.int8)
            np.add.at(change, where[own], 1)
            np.add.at(change, (where + size)[own] - LENGTH + 1, -1)
            wanted = np.cumsum(change, dtype=np.int8) > 0
            holders, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for base, some, content, ends in laid:
                if len(content) >= LENGTH:
                    first, _, key = stretches(content, wanted[base : base + len(content)])
                    holders.append(some[np.searchsorted(ends, first, "right")])
                    keys.append(key)
            doc, key = np.concatenate(holders), np.concatenate(keys)
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            new = new_key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            doc, key, new_key = doc[new], key[new], new_key[new]
            begins = np.flatnonzero(new_key)
            several = np.diff(np.append(begins, len(key))) > 1
            low = (key & LOW).astype(np.int64)
            for kind, at in ((ONCE, begins[~several]), (TWICE, begins[several])):
                rows += _entries(kind, _part(key[at], parts), doc[at], low[at])
            shared = several[np.cumsum(new_key) - 1] if len(key) else several
            rows += _entries(SHARED, _part(doc[shared], parts), doc[shared], low[shared])
            if rows:
                yield packed.batch(rows, NAMES)

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], []
        for batch in batches:
            passed, others = _apart(batch, REMOVED, SHARED)
            if passed.num_rows:
                yield passed
            for r in others:
                doc, place, size = _opened(r)
                if r["kind"] == PIECE:
                    found.append((doc, _behind(r, len(doc)), place, size, np.frombuffer(r["content"], "<u8").reshape(-1, 2), place))
                else:
                    held.append((doc, place, np.full(len(doc), r["kind"] == TWICE)))
        rows = []
        if found:
            doc, _, place, size, _, _, later = first_come(*(np.concatenate(x) for x in zip(*found, strict=True)))
            rows += _entries(REMOVED, _part(doc[later], parts), doc[later], place[later], size[later])
            rows += _entries(ASKED, _part(doc[~later], parts), doc[~later], place[~later], size[~later])
        if held:
            doc, low, twice = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, low))
            doc, low, twice = doc[order], low[order], twice[order]
            new = np.concatenate([[True], low[1:] != low[:-1]])
            begins = np.flatnonzero(new)
            shared = np.logical_or.reduceat(twice, begins) | (np.maximum.reduceat(doc, begins) > doc[begins])
            asked = shared[np.cumsum(new) - 1] & ~twice  # the batch of a TWICE has told its documents
            rows += _entries(SHARED, _part(doc[asked], parts), doc[asked], low[asked])
        if rows:
            yield packed.batch(rows, NAMES)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = {kind: [(none, none, none)] for kind in SIDES}
        for batch in batches:
            for r in batch.to_pylist():
                found[r["kind"]].append(_opened(r))
        sides = []
        for kind in SIDES:
            doc, place, size = (np.concatenate(x) for x in zip(*found.pop(kind), strict=True))
            order = np.lexsort((place, doc))
            sides.append((doc[order], place[order], size[order] if kind != SHARED else none))
        ids = np.unique(np.concatenate([doc for doc, _, _ in sides]))
        for k in range(0, len(ids), 2000):
            some = ids[k : k + 2000]
            columns = [pa.array(some, pa.int64())]
            for doc, place, size in sides:
                cuts = list(zip(np.searchsorted(doc, some, "left"), np.searchsorted(doc, some, "right"), strict=True))
                columns += [pa.array([packed.raw(x[a:b], "<u4") for a, b in cuts], pa.binary()) for x in (place, size)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MARKS.split(", ")])

    parsed = texts.select("doc", "behind", "content").mapInArrow(parse, ENTRY).repartitionById(parts, F.col("part"))
    told = parsed.mapInArrow(dictionary, ENTRY).repartitionById(parts, F.col("part"))
    marks = stored(told.mapInArrow(by_document, MARKS), "marks")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes of the dictionary's phrases and joints whose least hash is in several documents, in stretches."""
        for batch in batches:
            names, late = batch.column("doc").to_numpy(), batch.column("behind").to_numpy()
            asked, sizes, shared = (batch.column(x).to_pylist() for x in ("asked", "asked_sizes", "shared"))
            for k, content, begins, ends in chunks(batch.column("content").to_pylist()):
                if len(content) < LENGTH:
                    continue
                change = np.zeros(len(content) + 1, np.int8)
                known = []
                for j, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                    place, size = (np.frombuffer(x[k + j], "<u4").astype(np.int64) for x in (asked, sizes))
                    ok = begin + place + size <= end
                    np.add.at(change, begin + place[ok], 1)
                    np.add.at(change, begin + (place + size)[ok] - LENGTH + 1, -1)
                    known.append(np.frombuffer(shared[k + j], "<u4").astype(np.uint64) | np.uint64(j << 32))
                first, n, key = stretches(content, np.cumsum(change, dtype=np.int8) > 0)
                owner = np.searchsorted(ends, first, "right")
                held = np.isin(key & LOW | owner.astype(np.uint64) << np.uint64(32), np.concatenate(known))
                first, n, key, owner = first[held], n[held], key[held], owner[held]
                ids = digests(content, first, first + n + LENGTH - 1)
                doc, behind, place, n, _, at, later = first_come(names[k + owner], late[k + owner], first - begins[owner], n, ids, np.arange(len(n)))
                rows = _entries(REMOVED, _part(doc[later], parts), doc[later], place[later], n[later] + LENGTH - 1)
                own = ~later
                doc, behind, place, n, first, key = doc[own], behind[own], place[own], n[own], first[at[own]], key[at[own]]
                for p, some in packed.by_part(_part(key, parts)):
                    some = some[np.lexsort((place[some], doc[some]))]
                    flat = _shrunk(content[ranges(first[some], n[some] + LENGTH - 1)].tobytes())
                    rows.append((p, PIECE, *_holders(doc[some], behind[some]), packed.raw(place[some], "<u4"), packed.raw(n[some], "<u4"), flat))
                if rows:
                    yield packed.batch(rows, NAMES)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, flats, hashes, at = [], [], [], []
        base = run = 0
        for batch in batches:
            passed, others = _apart(batch, REMOVED)
            if passed.num_rows:
                yield passed
            for r in others:
                doc, place, n = _opened(r)
                flat = np.frombuffer(_grown(r["content"]), np.uint8)
                begin = np.cumsum(n + LENGTH - 1) - n - LENGTH + 1
                pos = ranges(begin, n)
                hashes.append(Rolling(flat).at(pos, pos + LENGTH))
                at.append(pos + base)
                runs.append((doc, _behind(r, len(doc)), place, begin + base))
                flats.append(flat)
                base += len(flat)
                run += len(n)
        if not run:
            return
        doc, behind, place, begin = (np.concatenate(x) for x in zip(*runs, strict=True))
        flat, string, pos = np.concatenate(flats), np.concatenate(hashes), np.concatenate(at)
        flats.clear(), hashes.clear(), at.clear()
        sorted_ = np.argsort(string)
        string = string[sorted_]
        equal = string[1:] == string[:-1]
        pos = pos[sorted_[np.append(equal, False) | np.insert(equal, 0, False)]]
        owner = np.searchsorted(begin, pos, "right") - 1
        doc, behind, place = doc[owner], behind[owner], place[owner] + pos - begin[owner]
        # eight bytes at a time as numbers, so that their order is that of the bytes
        words = np.ndarray((max(0, len(flat) - 7),), ">u8", flat.data, strides=(1,))
        keys = [words[pos + k].astype(np.uint64) for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
        suffix = np.lexsort((doc, *reversed(keys)))
        doc, behind, place = doc[suffix], behind[suffix], place[suffix]
        new = np.ones(len(doc), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[suffix[1:]] != key[suffix[:-1]]
        later = doc - behind > _runs_of(new, doc - behind)
        doc, place = doc[later], place[later]
        if not len(doc):
            return
        by_place = np.lexsort((place, doc))
        doc, place = doc[by_place], place[by_place]
        begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]))
        last = np.append(begins[1:], len(doc)) - 1
        rows = _entries(REMOVED, _part(doc[begins], parts), doc[begins], place[begins], place[last] - place[begins] + LENGTH)
        yield packed.batch(rows, NAMES)

    # joined by a shuffle at every size: a broadcast would be of marks of all documents
    asking = marks.filter((F.length("asked") > 0) & (F.length("shared") > 0)).select("doc", "asked", "asked_sizes", "shared")
    fetched = texts.select("doc", "behind", "content").join(asking.hint("merge"), "doc")
    dealt = fetched.mapInArrow(suffixes, ENTRY).repartitionById(parts, F.col("part"))
    late = dealt.mapInArrow(order, ENTRY).repartitionById(parts, F.col("part")).mapInArrow(by_document, MARKS)
    late = stored(late.select("doc", F.col("gone").alias("late"), F.col("gone_sizes").alias("late_sizes")), "late")
    return marks.select("doc", "gone", "gone_sizes").join(late.hint("merge"), "doc", "full")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of begin and end), kept (the bytes that are left)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                content = r["content"]
                n = len(content)
                change = np.zeros(n + 1, np.int64)
                place, size = (np.frombuffer((r[a] or b"") + (r[b] or b""), "<u4").astype(np.int64) for a, b in (("gone", "late"), ("gone_sizes", "late_sizes")))
                ok = place + size <= n
                np.add.at(change, place[ok], 1)
                np.add.at(change, (place + size)[ok], -1)
                gone = np.cumsum(change)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [[int(a), int(b)] for a, b in edges.reshape(-1, 2)]
                left = np.frombuffer(content, np.uint8)[~gone].tobytes()
                rows.append((r["doc_id"], n, int(gone.sum()), len(spans), spans, left))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.list_(pa.int64())), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    texts = _texts(docs)
    joined = texts.join(removed_places(docs, texts).hint("merge"), "doc", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"
    return joined.select("doc_id", "content", "gone", "gone_sizes", "late", "late_sizes").mapInArrow(cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


#: By hexadecimal digits, two a byte: all strings, runs of those that go, and what lies between the runs.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
gone AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first_id < doc_id),
marked AS (
  SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS is_new FROM gone)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM marked GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a AS place, substr(h, 2 * before + 1, 2 * (a - before)) AS piece
  FROM (SELECT spans.*, h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans JOIN d USING (doc_id))
  UNION ALL
  SELECT doc_id, 1000000000, substr(h, 2 * coalesce(last_b, 0) + 1)
  FROM d LEFT JOIN (SELECT doc_id, max(b) AS last_b FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY place))) AS kept_sha256 FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
