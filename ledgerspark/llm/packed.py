"""Rows that carry many small values as bytes, for shuffles of numpy arrays by a number of a part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ids: each once, and how often."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[begins], np.diff(np.append(begins, len(ids)))


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places of its rows in the order they had."""
    order = np.argsort(part, kind="stable")
    values, counts = runs(part[order])
    at = 0
    for p, n in zip(values.tolist(), counts.tolist(), strict=True):
        yield p, order[at : at + n]
        at += n


def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The first column is the part, the others are bytes."""
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def owners(docs: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i4"))


def raw(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values).astype(kind).tobytes()
