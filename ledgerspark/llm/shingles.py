"""Words and word shingles of many texts at a time as 64-bit hashes (numpy inside tasks).

Nothing is kept between calls, and a text is read in blocks, so a task's memory follows the number of its words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes with A-Z in lower case, plus 1.
_LOWER = np.array([c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse, mod 2**64; those of a block and a bit are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, BLOCK + 4096)
    found = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    if size <= 2 * BLOCK:
        _powers[:] = found
    return found


def _block_end(data: np.ndarray, end: int) -> int:
    """The first white space from end on, so that no word is cut."""
    while end < len(data):
        at = np.flatnonzero(_SPACE[data[end : end + 4096]])
        if len(at):
            return end + int(at[0])
        end += 4096
    return len(data)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (maximal runs without ASCII white space, A-Z in lower case) of all texts, and how many each has."""
    lengths = np.array([len(x) if x else 0 for x in texts], np.int64)
    data = np.frombuffer(b"\n".join(x or b"" for x in texts), np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = _block_end(data, min(at + BLOCK, len(data)))
        part = data[at:end]
        up, down = _power(len(part) + 1)
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[part]
        edges = np.flatnonzero(np.diff(inside))
        first, last = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))


def shingles(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words at their first words, laid end to end; where each text begins; its number of words.

    The last width - 1 places of a text hold no run of its own."""
    flat, lengths = word_hashes(texts)
    rolled = np.zeros(len(flat), np.uint64)
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    for k in range(width):
        rolled = mix(rolled + padded[k : len(flat) + k] + _ODD)
    return rolled, np.cumsum(lengths) - lengths, lengths


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, in order; a text with fewer words has its whole sequence for one."""
    rolled, begins, lengths = shingles(texts, width)
    out = []
    for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[b : b + n - width + 1]))
        else:
            # the run that starts at the first word goes on into another text: hashed anew
            out.append(_short(texts[len(out)], n) if n else rolled[:0])
    return out


def _short(text: bytes, n: int) -> np.ndarray:
    flat, _ = word_hashes([text])
    x = np.array([n], np.uint64)
    for k in range(n):
        x = mix(x * _ODD + flat[k])
    return x


def set_hash(values: np.ndarray) -> int:
    """Hash of a set of hashes; 0 for none."""
    if not len(values):
        return 0
    sums = np.array([[mix(values + _ODD).sum(dtype=np.uint64), mix(values ^ _ODD).sum(dtype=np.uint64)]])
    return int(mix((sums * np.array([1, _BASE], np.uint64)).sum(1, dtype=np.uint64) + np.uint64(len(values))).view(np.int64)[0])
