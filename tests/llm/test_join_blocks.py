"""op6: what the last step sends (F1)."""

import numpy as np

from ledgerspark.llm import jaccard_join
from ledgerspark.llm.packed import raw


def _tables(spark, sets):
    """sets (rep, n, hashes) and their lists by all hashes, each set a component of its own."""
    rows = [(k, len(x), raw(np.sort(np.array(x, np.uint64)), "<u8")) for k, x in enumerate(sets)]
    lists = [(int(h), k, len(x), k) for k, x in enumerate(sets) for h in x]
    return spark.createDataFrame(lists, "hash long, rep long, n long, component long"), spark.createDataFrame(rows, "rep long, n long, hashes binary")


def _spied(monkeypatch):
    asked = []
    searched = jaccard_join.searched
    monkeypatch.setattr(jaccard_join, "searched", lambda members, queries, sets: asked.append(queries.count()) or searched(members, queries, sets))
    return asked


def test_a_query_visits_few_blocks(spark, monkeypatch):
    """1,300 sets that share one hash and link with none: 1,299 queries, each sent once rather than to three blocks of 512."""
    lists, sets = _tables(spark, [[1, *range(10 * k + 10, 10 * k + 14)] for k in range(1300)])
    asked = _spied(monkeypatch)
    assert jaccard_join.rest_linked(lists.filter("hash = 1"), sets).count() == 0
    assert asked == [1299]


def test_blocks_by_size_lose_no_link(spark, monkeypatch):
    """Sets of 10 to 60 hashes in many small blocks: the links are those of all pairs."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    rng = np.random.default_rng(3)
    sets = [[1, *range(100 * (k // 4) + 10, 100 * (k // 4) + 10 + int(rng.integers(9, 60)))] for k in range(60)]
    lists, table = _tables(spark, sets)
    asked = _spied(monkeypatch)
    found = {tuple(sorted((r["a"], r["b"]))) for r in jaccard_join.rest_linked(lists, table).collect()}
    want = {
        (i, j) for i, x in enumerate(sets) for j, y in enumerate(sets)
        if i < j and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    }
    assert want and found == want
    assert asked[0] < 59 * 10
