"""Toxicity: a support vector machine on a subsequence string kernel, by Nyström landmarks.

The kernel of two words sums, over all subsequences of four letters, the products of LAMBDA to the power
of their spans in either word, normalised by word. So ``idiot`` and ``idxiot`` share most of their weight, and an
insult's stem is found under any ending. Letters are lower-cased, digits and signs that stand for letters
read as these, other signs dropped; both ends of a word are letters of their own; letters set apart by
spaces are also read as one word. Spans over MAX_SPAN weigh nothing.

Learning sees labelled documents whose crc32(doc_id) mod 5 isn't 0, at most about ``train_rows`` of them,
by hash. Of their words it takes those of 3 to 40 letters, at most 2,000 as insults and ``n_words`` others (a quarter of them at a time), and makes gapped
spellings of the 500 surest insults: bounds of fitting, as scoring reads every word. Words found in toxic documents far more often than in others (likelihood ratio) are the insults
to learn, other words the counterpart; landmarks are some of both. The machine is fitted in the space
of the landmarks. A text scores by its two worst words, on a logistic scale fitted to the labels.

As the kernel has an explicit map (four letters are hashed to a place in a table), the machine's weight of each four letters is a table of 2**21 numbers,
and a word's margin is a sum of table entries: whole texts are scored in linear time. A word of over PIECE characters, as a text
without spaces is one, is read to its end in pieces that overlap, as one insult would be lost in the whole. Its two worst pieces that
don't overlap count as words.

Cases: null and empty texts score as texts without a bad word; a null label teaches nothing; a null
doc_id counts as held out; without toxic or without other training rows all texts have one score near 0. Repeated rows are scored each.
An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LAMBDA = 0.5
MAX_SPAN = 7
CODE_BITS = 21
PIECE = 24
#: An insult of up to so many letters lies whole in a piece.
OVERLAP = 16
LANDMARKS = 300
#: Rounds of adding the words of clean documents that the machine takes for insults.
HARD_ROUNDS = 3
CACHED_WORDS = 400_000
FLOOR = -4.0
_START, _END = 1, 2
_SPREAD = np.uint32(0x9E3779B1)
# Signs that stand for letters.
STAND_FOR = str.maketrans("0134578@$!|", "oleastbasii")
_spaced = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\S)").findall


def letters(word: str) -> np.ndarray:
    """Codes below 64: 1 start, 2 end, 3 to 28 a to z, above that all other letters, folded."""
    code = [_START]
    for c in word.lower().translate(STAND_FOR):
        if "a" <= c <= "z":
            code.append(ord(c) - 94)
        elif c.isalnum():
            code.append(29 + ord(c) % 35)
    return np.array([*code, _END], np.uint32)


def pieces(word: str) -> list[str]:
    """The word, or if it is long its parts of PIECE letters, each OVERLAP into the one before."""
    if len(word) <= PIECE:
        return [word]
    word = "".join(filter(str.isalnum, word.lower().translate(STAND_FOR)))
    return [word[k : k + PIECE] for k in range(0, max(len(word) - OVERLAP, 1), PIECE - OVERLAP)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, code of four letters, weight) of all subsequences within spans; a word's weights have norm 1."""
    coded = [letters(w) for w in words]
    lengths = np.array([len(c) for c in coded])
    flat = np.concatenate([*coded, np.zeros(MAX_SPAN, np.uint32)])
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.cumsum(lengths)[owner]
    place = np.arange(len(owner))
    owners, codes, weights = [], [], []
    for span in range(3, MAX_SPAN):
        inside = np.flatnonzero(place + span < end)
        outer = (flat[inside] << 18) | flat[inside + span]
        for i, j in itertools.combinations(range(1, span), 2):
            owners.append(owner[inside])
            codes.append(((outer | (flat[inside + i] << 12) | (flat[inside + j] << 6)) * _SPREAD) >> (32 - CODE_BITS))
            weights.append(np.full(len(inside), LAMBDA ** (span - 3), np.float32))
    o, c, w = map(np.concatenate, (owners, codes, weights))
    norm = np.sqrt(np.bincount(o, w * w, minlength=len(words)))
    return o, c, w / np.maximum(norm, 1e-9)[o].astype(np.float32)


class Machine:
    """margin of a word = weights of its four-letter subsequences + bias; score of a text by its two worst words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.slopes, self.shift = weights, bias, np.array([1.0, 0.0]), 0.0
        self.known: dict[str, float] = {}
        self.seconds: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "seconds": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        return self._margins(words)[0]

    def _margins(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the highest margin of its pieces, and the next of a piece that doesn't overlap that one."""
        split = [pieces(w) for w in words]
        first = np.cumsum([0, *map(len, split)])[:-1]
        flat = [x for part in split for x in part]
        found = []
        for k in range(0, len(flat), 20_000):
            some = flat[k : k + 20_000]
            owner, code, weight = subsequences(some)
            found.append(np.bincount(owner, self.weights[code] * weight, minlength=len(some)) + self.bias)
        if not found:
            return np.zeros(0), np.zeros(0)
        every = np.concatenate(found)
        second = np.full(len(words), FLOOR)
        for i, part in enumerate(split):
            if len(part) > 1:
                own = every[first[i] : first[i] + len(part)]
                apart = np.abs(np.arange(len(own)) - own.argmax()) * (PIECE - OVERLAP) >= PIECE
                second[i] = own[apart].max(initial=FLOOR)
        return np.maximum.reduceat(every, first), second

    def worst(self, texts: list) -> np.ndarray:
        """Of each text, the two highest margins among its words."""
        split = []
        for text in texts:
            words = text.lower().split() if text else []
            split.append(words + [x.replace(" ", "") for x in _spaced(text.lower())] if words else words)
        if len(self.known) > CACHED_WORDS:
            self.known, self.seconds = {}, {}
        new = [*{w for words in split for w in words if w not in self.known}]
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            first, second = self._margins(some)
            self.known.update(zip(some, first.tolist(), strict=True))
            self.seconds.update((w, x) for w, x in zip(some, second.tolist(), strict=True) if x > FLOOR)
        look = self.known.__getitem__
        more = [[self.seconds[w] for w in words if len(w) > PIECE and w in self.seconds] for words in split]
        two = [heapq.nlargest(2, [*map(look, words), *x]) + [FLOOR, FLOOR] for words, x in zip(split, more, strict=True)]
        return np.clip([x[:2] for x in two], FLOOR, 2.0).reshape(-1, 2)

    def scores(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.worst(texts) @ self.slopes + self.shift)))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1000.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on the squared hinge loss; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * c / len(y) * 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and shift; labels drawn in a little, so separable data has an end."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def gapped(words: list[str], each: int = 5) -> list[str]:
    """Words with a letter put in or one of theirs doubled, at places and with letters that a hash picks."""
    out = []
    for word in words:
        for k in range(each):
            digest = hashlib.blake2b(f"{k}:{word}".encode(), digest_size=4).digest()
            at = 1 + digest[0] % max(len(word) - 1, 1)
            letter = word[at - 1] if k == 0 else chr(97 + digest[1] % 26)
            out.append(word[:at] + letter + word[at:])
    return out


def fit_words(bad: list[str], other: list[str]) -> Machine:
    """The machine that tells bad words from others, as weights of four-letter subsequences."""
    marks = bad[: LANDMARKS // 2]
    marks += other[: LANDMARKS - len(marks)]
    owner, code, weight = subsequences(marks)
    used, at = np.unique(code, return_inverse=True)
    explicit = np.zeros((len(marks), len(used)), np.float32)
    np.add.at(explicit, (owner, at), weight)

    def kernel(words: list[str]) -> np.ndarray:
        """Of words and landmarks."""
        o, c, w = subsequences(words)
        place = np.minimum(np.searchsorted(used, c), len(used) - 1)
        same = used[place] == c
        out = np.zeros((len(words), len(marks)))
        for k in range(0, len(words), 1000):
            some = same & (o >= k) & (o < k + 1000)
            part = np.zeros((min(1000, len(words) - k), len(used)), np.float32)
            np.add.at(part, (o[some] - k, place[some]), w[some])
            out[k : k + 1000] = part @ explicit.T
        return out

    values, vectors = np.linalg.eigh((explicit @ explicit.T).astype(float))
    good = values > 1e-6 * values.max()
    to_space = vectors[:, good] / np.sqrt(values[good])
    bad = bad + gapped(bad[:500])
    words = bad + other
    y = np.array([1.0] * len(bad) + [-1.0] * len(other))
    w, bias = _svm(kernel(words) @ to_space, y)
    weights = np.zeros(1 << CODE_BITS, np.float32)
    weights[used] = explicit.T @ (to_space @ w)
    return Machine(weights, bias)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, n_words: int = 20_000) -> Machine:
    """All that reaches the driver is bounded by train_rows and n_words."""
    known = labels.select("doc_id", F.col("toxic").alias("bad")).dropna().filter(~held_out()).distinct()
    n = known.count()
    if n > train_rows:
        part = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000))
        known = known.filter(part < 1_000_000 * train_rows // n)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("bad", "text").persist()
    try:
        totals = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
        n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
        if not n_bad or not n_good:
            return Machine(np.zeros(1 << CODE_BITS, np.float32), -30.0)
        each = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s]+", ""), r"\s+"))
        words = rows.select("bad", F.explode(each).alias("word")).filter("length(word) between 3 and 40")
        words = words.groupBy("word").agg(F.sum("bad").alias("k"), F.sum(1 - F.col("bad")).alias("m"))
        words = stored(words, "toxic-words")
        share = n_bad / (n_bad + n_good)
        k, m = F.col("k"), F.col("m")
        rate = (k / (k + m)).alias("rate")
        ratio = k * F.log(rate / share) + F.when(m > 0, m * F.log((1 - rate) / (1 - share))).otherwise(0.0)
        found = words.filter(k > share * (k + m)).select("word", ratio.alias("ratio"), rate)
        bad = found.filter("ratio > 8 and rate > 0.7").orderBy(F.desc("ratio"), "word").limit(2000).collect()
        if not bad:
            bad = found.filter("rate > 0.7").orderBy(F.desc("ratio"), "word").limit(10).collect()
        insults = [r["word"] for r in bad]
        clean = words.filter("m > 0 and (k = 0 or k < m)").select("word")
        others = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(n_words // 4).collect()]
        machine = fit_words(insults, others)
        for _ in range(HARD_ROUNDS):

            def margins(batches: Iterator[pa.RecordBatch], machine: Machine = machine) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    listed = batch.column("word").to_pylist()
                    if listed:
                        yield pa.RecordBatch.from_pydict({"word": listed, "margin": machine.margins(listed)})

            hard = clean.mapInArrow(margins, "word string, margin double").filter("margin > -0.5")
            hard = [r["word"] for r in hard.orderBy(F.desc("margin"), "word").limit(n_words // 4).collect()]
            others = [*dict.fromkeys(hard + others)][:n_words]
            machine = fit_words(insults, others)

        def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first, second = machine.worst(batch.column("text").to_pylist()).T
                yield pa.RecordBatch.from_pydict({"bad": batch.column("bad"), "first": first, "second": second})

        seen = rows.withColumn("bad", F.col("bad").cast("int")).mapInArrow(worst, "bad int, first double, second double").collect()
    finally:
        rows.unpersist()
    margins_seen = np.array([(r["first"], r["second"]) for r in seen])
    toxic = np.array([r["bad"] for r in seen], float)
    machine.slopes, machine.shift = _logistic(margins_seen, toxic)
    if machine.slopes.min() < 0:  # then one of the two says it all, and no bad word may make a text better
        best = int(machine.slopes.argmax())
        slope, machine.shift = _logistic(margins_seen[:, best : best + 1], toxic)
        machine.slopes = np.where(np.arange(2) == best, slope[0], 0.0)
    machine.known, machine.seconds = {}, {}
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                some = batch.slice(k, 2000)
                found = sent.value.scores(some.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "score": found})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
