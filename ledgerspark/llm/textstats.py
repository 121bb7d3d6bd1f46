"""Statistics of a text as columns: words, symbols, repeated lines and repeated word windows.

Null and empty texts give zeros. Nothing here leaves the row, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "[^#*$%&|<>]+"


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows of this width from the given starts, in order, cover together."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda seen, x: F.struct(x.alias("last"), (seen["n"] + F.least(F.lit(width), x - seen["last"])).alias("n")),
        lambda seen: seen["n"],
    )


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in w. Hashes find the windows, words confirm them."""
    n_windows = F.size(w) - 2

    def same(i: Column, j: Column) -> Column:
        return (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            other = F.get(s, k)
            return F.coalesce((other["h"] == x["h"]) & same(other["i"], x["i"]), F.lit(False))

        found = F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1))
        return _covered(F.sort_array(F.transform(found, lambda x: x["i"])), 3)

    def by_hash(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(several, let(F.sort_array(numbered), repeated)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(n_windows > 1, let(hashes, by_hash)).otherwise(0)


def left_over(text: Column, others: str) -> Column:
    """How many characters of text stay when runs of others go."""
    return F.length(F.regexp_replace(text, others, ""))


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """keep of docs and the statistics of its text, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_w"), lines.alias("_lines"))
    found = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": left_over(F.col("_text"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeat_words(F.col("_w")),
        "n_lines": F.size("_lines"),
        "n_upper": left_over(F.col("_text"), "[^A-Z]+"),
        "n_marks": left_over(F.col("_text"), "[^!?]+"),
        "n_digits": left_over(F.col("_text"), "[^0-9]+"),
    }
    return split.select(*keep, *[c.cast("long").alias(name) for name, c in found.items()])


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


#: Ratios of the statistics; what models of quality look at.
FEATURES = {
    "symbol_share": lambda: share("n_symbols", "word_chars"),
    "upper_share": lambda: share("n_upper", "word_chars"),
    "mark_share": lambda: share("n_marks", "n_words"),
    "digit_share": lambda: share("n_digits", "word_chars"),
    "dup_line_share": lambda: share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: share("n_repeat_words", "n_words"),
    "mean_word": lambda: share("word_chars", "n_words"),
    "line_words": lambda: share("n_words", "n_lines"),
    "n_words": lambda: F.col("n_words").cast("double"),
}


def features() -> list[Column]:
    return [f().alias(f"f_{name}") for name, f in FEATURES.items()]
