"""Vector code compression: vectors become one byte a part, by codebooks that are refined on all rows.

Components are taken as whole numbers, floor(SCALE * x), so distances, sums and means are exact and reruns agree. A vector is cut into
PARTS equal parts; each part position has a codebook of up to ENTRIES entries, at first the parts of the smallest vec_ids.

A round assigns each part to its nearest entry and replaces entries by the floor of the mean of their parts. The nearest
entry is found by exponion search: with d the distance to the entry a part had before (the first one at first), no entry farther than 2 d from that
entry can be as near as d. So its neighbours are looked at in order of their distance to it, as far as 2 d and no farther, compared as
squares of whole numbers; among equal distances the lowest index stays.

A task holds a batch of rows and the codebooks. Sums of parts are added up in a task before they are shuffled; what reaches the
driver is a sum and a count for each component of an entry. Rows with their codes are written between rounds.

Cases: null vectors and those with null or non-finite components are dropped, as are those of another length than the vector of the
smallest vec_id whose length PARTS divides; a null vec_id comes after all others; rows that share a vec_id are taken in the order of their
vectors, each as a row of its own; null labels are one label. Fewer rows than ENTRIES give fewer entries. A component of 2**20 or more ends in a ValueError, as
its squares would not fit in 64 bits. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = SCALE << 20
ROW = "vec_id long, label {label}, v array<long>, code binary, error long"


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of book and the squared distance, by exponion search from the entries of start."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, 1)
    best, least = start.copy(), ((x - book[start]) ** 2).sum(1)
    # how many neighbours of its entry lie within twice a row's distance
    reach = np.zeros(len(x), np.int64)
    for entry in range(len(book)):
        at = np.flatnonzero(start == entry)
        reach[at] = np.searchsorted(gaps[entry], 4 * least[at], "right")
    by_reach = np.argsort(-reach, kind="stable")
    ends = np.searchsorted(-reach[by_reach], -np.arange(len(book)), "left")
    for rank, end in enumerate(ends.tolist()):
        at = by_reach[:end]
        entry = order[start[at], rank]
        found = ((x[at] - book[entry]) ** 2).sum(1)
        nearer = (found < least[at]) | ((found == least[at]) & (entry < best[at]))
        best[at[nearer]], least[at[nearer]] = entry[nearer], found[nearer]
    return best, least


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, PARTS, components of a part)."""
    return batch.column("v").flatten().to_numpy().reshape(len(batch), PARTS, -1)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with new code and error, starting from the code they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _values(batch)
            if abs(x).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST // SCALE} or more")
            held = batch.column("code").to_pylist()
            before = np.array([list(c) if c else [0] * PARTS for c in held], np.int64)
            found = [nearest(x[:, p], before[:, p], books[p]) for p in range(PARTS)]
            code = np.stack([c for c, _ in found], 1).astype(np.uint8)
            columns = [*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sum(e for _, e in found), pa.int64())], names=["vec_id", "label", "v", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return stored(rows.mapInArrow(run, ROW.format(label=label)), "codes")


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the means of the parts that have each entry; those without parts stay."""
    shape = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            x, code = _values(batch), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())), pa.array(counts[part, entry])],
            names=["part", "entry", "sums", "n"],
        )

    some = rows.select("v", "code").mapInArrow(run, "part int, entry int, sums array<long>, n long")
    added = some.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    added = added.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    new = books.copy()
    for r in added.collect():  # PARTS * ENTRIES * components of a part at most
        new[r["part"], r["entry"], r["place"]] = r["x"] // r["n"]
    return new


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, in whole numbers."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is larger than all others
    rows = rows.filter(F.col("v").isNotNull() & sound & (F.size("v") > 0) & (F.size("v") % PARTS == 0))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    rows = rows.filter(F.size("v") == (first["n"] if first else 0))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")))


def compressed(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows = whole_vectors(embeddings)
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), PARTS, -1 if first else 1).transpose(1, 0, 2)
    rows = rows.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    for _ in range(rounds):
        rows = assigned(rows, books)
        books = refined(rows, books)
    rows = assigned(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = stored(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(small(of_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _step(k: int) -> str:
    """SQL of one assignment by book k, and of book k + 1."""
    return f"""
far{k} AS (
  SELECT vec_id, x.p, e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN book{k} b ON x.p = b.p AND x.i = b.i GROUP BY vec_id, x.p, e),
code{k} AS (SELECT vec_id, p, e, d FROM far{k} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
mean{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM x JOIN code{k} USING (vec_id, p) GROUP BY p, e, i),
book{k + 1} AS (
  SELECT p, e, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN mean{k} USING (p, e, i))"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([t FOR t IN embedding IF t IS NULL OR NOT isfinite(t)]) = 0),
flat AS (SELECT vec_id, len(v) // {PARTS} AS w, unnest(v) AS t, generate_subscripts(v, 1) - 1 AS j FROM kept),
x AS (SELECT vec_id, j // w AS p, j % w AS i, CAST(floor({SCALE} * CAST(t AS DOUBLE)) AS BIGINT) AS c FROM flat),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS (SELECT p, e, i, c FROM x JOIN first USING (vec_id)),
{_step(0)}, {_step(1)}, {_step(2)},
err AS (
  SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM code2 GROUP BY vec_id),
lab AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM err JOIN kept USING (vec_id) GROUP BY label),
sha AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book2)
SELECT vec_id, lower(code) AS code, error, label_error, codebooks_sha256
FROM err JOIN kept USING (vec_id) JOIN lab ON kept.label IS NOT DISTINCT FROM lab.label, sha
"""
