"""Source divergence, vector codes and the prefix forest beside brute-force versions, and on awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from ledgerspark.llm import divergence, prefix_forest, vector_codes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long"
VECTORS = "vec_id long, embedding array<float>, label int, v array<long>, code binary, rep long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_divergence(rows, least, top):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall(lower(r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, k in df.items() if k >= least]
        counts = collections.defaultdict(collections.Counter)
        for la, source, words in docs:
            if la == lang:
                counts[source].update(w for w in words if df[w] >= least)

        def p(c, v=len(kept)):
            total = sum(c.values())
            return lambda t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v)

        q = p(sum(counts.values(), collections.Counter()))
        for s in {d[1] for d in docs if d[0] == lang}:
            own = p(counts[s])
            parts = {"pair": [(o, sum(abs(own(t) - p(counts[o])(t)) for t in kept)) for o in {d[1] for d in docs if d[0] == lang} - {s}]}
            parts["term"] = [(t, own(t) - q(t)) for t in kept if counts[s][t] and own(t) > q(t)]
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[: top if part == "term" else None])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "日本", "über", "x-y", "O'k"] + ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(120)]
    rows = []
    for i in range(150):
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "", None, "é"])
        picked = [rng.choice(words[: 127 if source != "s1" else 60]) for _ in range(rng.choice([0, 3, 60, 200]))]
        rows.append((i, " ".join(picked), rng.choice(["en", "en", "de", None]), source, "t", 1, 2))
    rows += [(900, None, "en", "s9", None, None, None), (901, "", "fr", "only", "", 0, 0), (None, "a a a", None, "s1", "", 0, 0), (902, "42 -- \x00", "it", "a", "", 0, 0), (902, "z", "it", "b", "", 0, 0)]
    rows += [rows[3], (903, "A " * 5000 + "long " * 5000, "en", "s2", "", 0, 0)]
    return rows


@pytest.mark.parametrize("least, top, held", [(10, 5, 300_000), (3, 50, 40), (1, 7, 1)])
def test_divergence(spark, monkeypatch, least, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", 100)
    rows = corpus(least)
    found = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(4), least, top).collect()
    assert sorted(tuple(r) for r in found) == brute_divergence(rows, least, top)


def test_divergence_of_one_group_with_a_third_of_all_rows_and_of_ties(spark):
    """Equal counts everywhere: all values tie, and go by item."""
    rows = [(i, " ".join(f"{x}{y}" for x in "abcdefgh" for y in "stuvwxyz"), "en", "big" if i % 3 else f"s{i % 4}", "", 0, 0) for i in range(60)]
    rows += [(100 + i, " ".join(f"own{x}{y}" for x in "abcdefgh" for y in "stuvwxyz"), "en", "odd", "", 0, 0) for i in range(30)]
    found = divergence.divergence(spark.createDataFrame(rows, DOCS), 30, 50).collect()
    assert sorted(tuple(r) for r in found) == brute_divergence(rows, 30, 50)
    odd = [r["item"] for r in sorted(found, key=lambda r: r["rank"]) if r["part"] == "term" and r["source"] == "odd"]
    assert len(odd) == 50 and odd == sorted(odd)


def test_posting_pairs_in_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = corpus(17)
    found = divergence.divergence(spark.createDataFrame(rows, DOCS), 2, 3).collect()
    assert sorted(tuple(r) for r in found) == brute_divergence(rows, 2, 3)


def awkward_vectors(n, seed, size=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, size))
    rows = []
    for i in range(n):
        x = (base[i % 8] + rng.normal(size=size) * rng.choice([0.02, 0.5])) / math.sqrt(size)
        if i % 9 == 4:
            x = np.array(rows[i // 3][1])  # copies
        if i % 31 == 7:
            x = np.round(x, 1) * 2
        rows.append((i * 5, [float(np.float32(v)) for v in x], None if i % 6 == 1 else i % 4, [1], b"x", 3))
    bad = [None, [], [0.0] * size, [None] + rows[0][1][1:], [math.nan] + rows[0][1][1:], [math.inf] + rows[0][1][1:], rows[0][1][:32], rows[0][1] + [0.5] * 16]
    return rows + [(100_000 + 50 * i, v, 1, None, None, None) for i, v in enumerate(bad)]


def brute_codes(rows):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    parts = [[[math.floor(256 * x) for x in r[1][4 * p : 4 * p + 4]] for p in range(16)] for r in kept]
    books = [[list(x[p]) for x in parts[:64]] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(16)] for x in parts]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [x[p] for x, f in zip(parts, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), r[2]) for r, f in zip(kept, assign(), strict=True)]
    label = collections.Counter()
    for _, _, e, la in errors:
        label[la] += e
    return collections.Counter((v, c, e, label[la], digest) for v, c, e, la in errors)


def test_vector_codes(spark):
    rows = awkward_vectors(150, 1)
    rows += [rows[2], (rows[3][0], rows[4][1], 2, None, None, None), (None, rows[5][1], None, None, None, None)]
    found = vector_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert collections.Counter(map(tuple, found)) == brute_codes(rows)


def test_vector_codes_of_few_rows_and_none(spark):
    rows = awkward_vectors(10, 2)
    found = vector_codes.compressed(spark.createDataFrame(rows, VECTORS)).collect()
    assert collections.Counter(map(tuple, found)) == brute_codes(rows)
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(Exception, match="a component of"):
        vector_codes.compressed(spark.createDataFrame([(1, [3e30] * 64, 1, None, None, None)], VECTORS)).collect()


def test_exponion_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    for spread in (3, 40, 2000):
        book = rng.integers(-spread, spread, (64, 4))
        book[9] = book[40]
        x = np.concatenate([rng.integers(-spread, spread, (500, 4)), book])
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        for start in (np.zeros(len(x), np.int64), rng.integers(0, 64, len(x)), far.argmin(1)):
            best, least = vector_codes.nearest(x, start, book)
            assert (best == far.argmin(1)).all() and (least == far.min(1)).all()


def brute_neighbours(rows, every, nearest):
    seen = {}
    for r in rows:
        if r[0] is not None and r[1] and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]):
            seen[r[0]] = min(seen.get(r[0], r[1]), r[1])
    ids = sorted(seen)
    x = np.array([seen[i] for i in ids])
    out = {}
    for k, q in enumerate(ids):
        if q % every == 0:
            s = prefix_forest.scores(np.repeat(x[k : k + 1], len(x), 0), x)
            order = [j for j in np.lexsort((ids, -s)) if j != k][:nearest]
            out[q] = [(n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    return out


def answers(found):
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return dict(got)


def test_forest_of_few_rows_is_exact(spark):
    rows = awkward_vectors(200, 3)
    rows += [rows[10], (rows[20][0], rows[21][1], 1, None, None, None), (None, rows[5][1], 1, None, None, None)]
    rows += [(200_000 + k, rows[0][1], 1, None, None, None) for k in range(90)]  # a third of all are one vector
    found = prefix_forest.neighbours(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert answers(found) == brute_neighbours(rows, 50, 5)
    two = prefix_forest.neighbours(spark.createDataFrame(rows[:2] + rows[-1:], VECTORS)).collect()
    assert answers(two) == brute_neighbours(rows[:2] + rows[-1:], 50, 5)
    assert prefix_forest.neighbours(spark.createDataFrame([], VECTORS)).collect() == []
    assert prefix_forest.neighbours(spark.createDataFrame(rows[:1], VECTORS)).collect() == []


@pytest.mark.parametrize("block, depth_of", [(32_768, 1), (20, 2)])
def test_forest_recall(spark, monkeypatch, block, depth_of):
    """Deeper blocks, split blocks, and ascents to above the blocks and to the root, beside all pairs."""
    monkeypatch.setattr(prefix_forest, "BLOCK", block)
    monkeypatch.setattr(prefix_forest, "LEAST_A_TREE", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 2500)] + 0.7 * rng.normal(size=(2500, 64))).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, None, None, None) for i, r in enumerate(x)]
    asked, looked = [], prefix_forest.visits

    def visits(*given):
        found = looked(*given)
        asked.append((given[3], found.groupBy("rep").agg({"length": "max"}).collect()))
        return found

    monkeypatch.setattr(prefix_forest, "visits", visits)
    found = answers(prefix_forest.neighbours(spark.createDataFrame(rows, VECTORS).repartition(4)).collect())
    want = brute_neighbours(rows, 50, 5)
    hits = sum(len({a[1:] for a in found[q]} & {a[1:] for a in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert asked[0][0] >= depth_of and len({r[1] for r in asked[0][1]}) >= 1


def test_forest_finds_long_prefixes_and_near_copies(spark):
    """Near copies share long prefixes in most trees: all are candidates, beyond any number that is asked for."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    x = np.concatenate([one + 1e-4 * rng.normal(size=(400, 64)), rng.normal(size=(800, 64))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, None, None, None) for i, r in enumerate(x)]
    found = answers(prefix_forest.neighbours(spark.createDataFrame(rows, VECTORS).repartition(3)).collect())
    want = brute_neighbours(rows, 50, 5)
    assert all(found[q] == want[q] for q in want if q < 400)
