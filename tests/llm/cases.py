"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, term string, _copies int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(seed=1, n=40):
    """Rows for DOCS: the last three columns clash with names that operators use."""
    rng = random.Random(seed)
    passage = sentence(rng, 90)
    rows = []
    for i in range(n):
        text = sentence(rng, rng.randint(60, 160))
        if i % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 5 == 1:
            text = text + "\n" + passage + "\n" + sentence(rng, 30)
        elif i % 5 == 2 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "CHANGED"
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", 1, 7, "t", 3))
    rows += [
        (100, None, None, None, None, None, None, None),
        (101, "", "en", None, 0, 0, "", 0),
        (102, " \n\t ", "en", "s1", 0, 0, "", 0),
        (103, "one two", "en", "s1", 0, 0, "", 0),
        (104, "ONE two", "en", "s1", 0, 0, "", 0),
        (105, sentence(rng, 6000), "en", "s2", 0, 0, "", 0),
        (None, rows[3][1], "en", "s2", 0, 0, "", 0),
        rows[7],
        (106, "é ñ \x1cA\x0bb 日本 語" * 30, "xx", "é", 0, 0, "", 0),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS).repartition(3)
