"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. Each word gets its log-odds between toxic and clean training texts under an informative Dirichlet prior (the
   words' joint frequencies), shrunk by two standard deviations; odds for toxicity count from the log-odds of the classes
   on, so that a word alone has to overturn them. A word without evidence falls back to its first four letters.
2. A linear-time scan finds all maximal-scoring segments of a text: every disjoint passage that no extension improves.
3. Karlin and Altschul's statistics turn a segment's score S in a text of n words into the expected number of such
   segments by chance, K n exp(-lambda S). A text's evidence is the sum of -log of that over its significant segments,
   and a logistic curve fitted on the training texts turns evidence into a probability.

So that texts without significant segments rank too, the best segment of weaker odds (less doubt, classes left out)
adds evidence, in all less than 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import cut, fresh

WORD_BITS, START_BITS = 20, 16
#: All buckets: words first, then the first letters of words.
BUCKETS = (1 << WORD_BITS) + (1 << START_BITS)
START = 4
#: At most so many training texts of each class, those whose id has the smallest hash.
SAMPLE = 20_000
PRIOR, DOUBT, DRIFT = 0.02, 2.0, 0.02
WEAK_PRIOR, WEAK_DOUBT, WEAK_HALF = 0.01, 1.64, 10.0
LETTERS = re.compile(r"[^\W\d_]+")
#: So many characters are read at once; a task remembers the buckets of so many words.
BATCH = 500_000
REMEMBERED = 50_000


class Buckets(dict):
    """word -> number; `words` and `starts` are the buckets of the numbered words. One for each task, gone with it."""

    def __init__(self) -> None:
        self.words: list[int] = []
        self.starts: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        raw = word.encode()
        self.words.append(zlib.crc32(raw) & ((1 << WORD_BITS) - 1))
        self.starts.append((1 << WORD_BITS) + (zlib.crc32(word[:START].encode()) & ((1 << START_BITS) - 1)) if len(word) > START else -1)
        return at

    def numbered(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, past, words a text, word buckets, start buckets), for runs of texts of about BATCH characters."""
        k = 0
        while k < len(texts):
            first, size, parts = k, 0, []
            if len(self) > REMEMBERED:
                self.clear()
                self.words.clear()
                self.starts.clear()
            while k < len(texts) and (k == first or size + len(texts[k]) <= BATCH):
                # Words come one by one, so that a very long text needs no list of them.
                parts.append(np.fromiter((self[w[0]] for w in LETTERS.finditer(texts[k].lower())) if len(texts[k]) > BATCH else map(self.__getitem__, LETTERS.findall(texts[k].lower())), np.int64))
                size += len(texts[k])
                k += 1
            at = np.concatenate(parts)
            yield first, k, np.array([len(p) for p in parts]), np.array(self.words, np.int64)[at], np.array(self.starts, np.int64)[at]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, past, score) of all maximal-scoring segments, by Ruzzo and Tompa's linear-time scan.

    Runs of scores of one sign count as one, so that the scan takes a step for each positive run.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    jump = np.flatnonzero(np.diff(positive) > 1)
    firsts, pasts = positive[np.concatenate([[0], jump + 1])].tolist(), (positive[np.concatenate([jump, [len(positive) - 1]])] + 1).tolist()
    found: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    for first, past in zip(firsts, pasts, strict=True):
        left, right = float(sums[first]), float(sums[past])
        while True:
            # The nearest earlier candidate that starts lower; `back` skips those that can't.
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                back.append(j)
                found.append((first, past, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, r - low) for a, b, low, r in found]


def best_segment(scores: np.ndarray) -> float:
    """The highest sum of a segment, 0 at least: a prefix sum less the lowest before it."""
    if not len(scores):
        return 0.0
    sums = np.cumsum(scores, dtype=np.float64)
    return float(max(0.0, (sums - np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))).max()))


@dataclass
class Model:
    """scores and weak scores of each bucket, without drift; rate (lambda) and scale (K) of the extreme values; the logistic curve."""

    scores: np.ndarray
    weak: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def of_words(self, scores: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = scores[words]
        return np.where((own == 0) & (starts >= 0), scores[starts], own) - DRIFT


def log_odds(toxic: Column, clean: Column, n1: float, n0: float, classes: float, share: float = PRIOR, doubt: float = DOUBT) -> Column:
    """Shrunken log-odds with a Dirichlet prior in proportion to the joint counts, those above 0 less the classes' log-odds; 0 where there is too little to tell."""
    prior, all_prior = share * (toxic + clean) + F.lit(1e-9), share * (n1 + n0)
    a, b = toxic + prior, clean + prior
    odds = F.log(a / F.greatest(F.lit(n1 + all_prior) - a, F.lit(1e-9))) - F.log(b / F.greatest(F.lit(n0 + all_prior) - b, F.lit(1e-9)))
    sure = F.greatest(F.abs(odds) - doubt * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    return F.when(odds > 0, F.least(F.greatest(sure - classes, F.lit(0.0)), F.lit(6.0))).otherwise(F.greatest(-sure, F.lit(-4.0)))


def extreme_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(rate * values)) = 1, by bisection; 1 where no value is positive."""
    weights = weights / weights.sum()
    if values.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    over = lambda x: float(weights @ np.exp(np.minimum(x * values, 700))) > 1
    if over(low):
        return low
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve (intercept, slope) by Newton's steps, with a weak ridge that keeps separable data finite."""
    ridge, theta = np.diag([1e-3, 1e-2]), np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weights * (p - y)) + ridge @ theta
        step = np.linalg.solve(design.T @ (design * (weights * p * (1 - p))[:, None]) + ridge, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(labelled, toxic): at most `sample` ids of each class that aren't held out; an id with both labels is toxic. And the log-odds of clean to toxic among all of them, 0 at least."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for y in (0, 1)]
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return cut(first[0].unionByName(first[1])), float(max(0.0, np.log(n.get(0, 1) / n.get(1, 1))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled documents; the sample has a bounded size and is broadcast, the texts stay in place.

    Without labels of both classes every score is that of the share of toxic labels. Null texts count as empty.
    """
    context = docs.sparkSession.sparkContext
    known, classes = training_sample(labels, sample)
    texts = docs.select(F.col(id_col).cast("long").alias("labelled"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "labelled").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, BUCKETS), np.int64), Buckets()
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for first, _, sizes, words, starts in seen.numbered(batch.column(1).to_pylist()):
                for k, (w, s) in enumerate(zip(np.split(words, np.cumsum(sizes)[:-1]), np.split(starts, np.cumsum(sizes)[:-1]), strict=True)):
                    counts[toxic[first + k], np.unique(w)] += 1
                    counts[toxic[first + k], np.unique(s[s >= 0])] += 1
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], ["bucket", "toxic", "clean"])

    # At most BUCKETS rows, of which only those with odds reach the driver.
    counts = cut(texts.mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    edge = 1 << WORD_BITS
    sums = {r["start"]: (float(r["n1"]), float(r["n0"])) for r in counts.groupBy((F.col("bucket") >= edge).alias("start")).agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")).collect()}
    model = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32))
    n1, n0 = sums.get(False, (0.0, 0.0))
    if not (n1 and n0):
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        model.curve = (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0)
        return model
    kinds = [(F.col("bucket") >= edge) if start else (F.col("bucket") < edge) for start in sums]
    for name, how in (("score", (classes, PRIOR, DOUBT)), ("weak", (0.0, WEAK_PRIOR, WEAK_DOUBT))):
        parts = [F.when(kind, log_odds(F.col("toxic"), F.col("clean"), *of, *how)) for kind, of in zip(kinds, sums.values(), strict=True)]
        counts = counts.withColumn(name, F.coalesce(*parts))
    found = counts.filter("score <> 0 or weak <> 0").select("bucket", "clean", F.col("score").cast("float"), F.col("weak").cast("float")).toPandas()
    at = found["bucket"].to_numpy(np.int64)
    model.scores[at], model.weak[at] = found["score"], found["weak"]
    # Words without odds have the drift alone.
    words = found[at < edge]
    model.rate = extreme_rate(np.append(words["score"].to_numpy(float), 0.0) - DRIFT, np.append(words["clean"].to_numpy(float), n0 - words["clean"].sum()))
    shared = context.broadcast(model)

    @F.pandas_udf("n long, segments array<double>, weak double")
    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, seen = shared.value, Buckets()
        for text in batches:
            sizes, out, weak = [], [], []
            for *_, counted, words, starts in seen.numbered(text.tolist()):
                ends = np.cumsum(counted)[:-1]
                for own in np.split(m.of_words(m.scores, words, starts), ends):
                    sizes.append(len(own))
                    out.append([s for *_, s in maximal_segments(own)])
                weak += [best_segment(own) for own in np.split(m.of_words(m.weak, words, starts), ends)]
            yield pd.DataFrame({"n": sizes, "segments": out, "weak": weak})

    scored = cut(texts.select("toxic", segments("text").alias("s")).select("toxic", "s.n", "s.segments", "s.weak"))
    top = F.coalesce(F.array_max("segments"), F.lit(0.0))
    chance = scored.filter("toxic = 0 and n > 0").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.exp(-model.rate * top)).alias("e")).first()
    model.scale = chance["m"] / chance["e"] if chance["e"] else 1.0
    x = F.aggregate("segments", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), model.rate * s - F.log(F.lit(model.scale) * F.greatest(F.col("n"), F.lit(1)))))
    x = x + F.col("weak") / (F.col("weak") + WEAK_HALF)
    binned = scored.groupBy("toxic", (F.round(F.least(x, F.lit(100.0)) * 4) / 4).alias("x")).agg(F.count(F.lit(1)).alias("w")).toPandas()
    model.curve = logistic(binned["x"].to_numpy(float), binned["toxic"].to_numpy(float), binned["w"].to_numpy(float))
    shared.destroy()
    return model


PASSAGES = "array<struct<first: int, past: int, score: double, expected: double>>"
RESULT = f"score double, passages {PASSAGES}"


def scored_texts(m: Model, seen: Buckets, texts: list[str]) -> pd.DataFrame:
    """The score of each text and the character ranges of its significant passages."""
    x, passages = np.zeros(len(texts)), [[] for _ in texts]
    for first, _, counted, words, starts in seen.numbered(texts):
        own, ends = m.of_words(m.scores, words, starts), np.cumsum(counted)
        weak = np.array([best_segment(w) for w in np.split(m.of_words(m.weak, words, starts), ends[:-1])])
        x[first : first + len(weak)] = weak / (weak + WEAK_HALF)
        # Only texts with a positive word have segments.
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(own > 0), "right")).tolist():
            n, marks = int(counted[k]), None
            for a, b, s in maximal_segments(own[ends[k] - n : ends[k]]):
                evidence = m.rate * s - np.log(m.scale * n)
                if evidence > 0:
                    x[first + k] += evidence
                    # Lower-casing changes a few characters' lengths; the ranges are those of the lower-case text.
                    marks = marks or [w.span() for w in LETTERS.finditer(texts[first + k].lower())]
                    passages[first + k].append({"first": marks[a][0], "past": marks[b - 1][1], "score": s, "expected": float(np.exp(-evidence))})
    intercept, slope = m.curve
    return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(intercept + slope * np.minimum(x, 100), -30, 30))), "passages": passages})


def scorer(docs: DataFrame, model: Model):  # noqa: ANN201
    """A function of a text column: RESULT, with the character ranges of the significant passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = Buckets()
        for text in batches:
            yield scored_texts(shared.value, seen, ["" if t is None else t for t in text.tolist()])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row. Null and empty texts score as texts without evidence."""
    score = scorer(docs, fit(docs, labels, sample, id_col, text_col))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("s")).select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.passages").alias("passages"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that don't score as toxic, with all their columns."""
    score = scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col))
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, score(F.col(text_col).cast("string"))).filter(F.col(name)["score"] < 0.5).drop(name)
