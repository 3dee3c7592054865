"""Quality rules: counts of whole texts, and robust outliers among the texts of a language and source.

Each group of language and source gets a minimum-covariance-determinant estimate of its transformed statistics: from
two starts, concentration steps keep the half of the rows that lies nearest by Mahalanobis distance, until the
determinant settles; the lower one wins and is reweighted. A step is one grouped aggregation: rows are counted and
summed by bins of their distance, so that the nearest half is a run of bins and no group is ever in one task. Sums are
of whole numbers, so that reruns agree. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.functions.text import let
from corveil.llm.common import cut

#: The white space between words, symbols, and the bounds of the base rules.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The transformed statistics in steps of 1 / UNIT.
STATISTICS, UNIT = ("word_length", "symbols", "dup_lines", "repeats"), 4096
#: What each statistic varies by at least: the noise of a text of some 50 words, and one line that a short text has twice.
FLOOR = (0.05, 0.05, 0.15, 0.15)
#: Groups with fewer judged rows are estimated together with the other small ones of their language, and these in turn with those of all languages.
LEAST_ROWS = 50
#: Bins for each doubling of the squared distance; concentration steps at most.
BINS, STEPS = 16, 20
#: Shares of clean rows within the bounds of the reweighting and of the verdict, by the chi-square distribution.
REWEIGHTED, CLEAN = 0.975, 0.9999
#: Estimates are broadcast up to so many groups.
GROUPS = 20_000
N = len(STATISTICS)
LOWER = [(i, j) for i in range(N) for j in range(i + 1)]


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def quantile(share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, N) < share else (low, middle)
    return high


def consistent(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to give that of all."""
    return share / chi_square(quantile(share), N + 2)


def covered(windows: Column) -> Column:
    """How many words lie in three-word windows whose hash occurs twice or more; windows: their hashes in order."""
    at = lambda x, i: F.struct(x.alias("h"), i.alias("i"))

    def repeated(s: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

    def words(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    some = let(lambda s: let(words, repeated(s)), F.sort_array(F.transform(windows, at)))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), some).otherwise(0)


def repeat_words(words: Column) -> Column:
    """The words in three-word windows that occur twice or more, each word once."""
    windows = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(lambda w: let(covered, windows(w)), words)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counts = let(lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")), words)
    by_line = let(lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")), lines)
    d = docs.withColumns({"_counts": counts, "_lines": by_line}).withColumns({
        "n_words": F.col("_counts.n_words"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("_lines.n_dup_lines"),
        "n_repeat_words": F.col("_counts.n_repeat_words"),
        "n_lines": F.col("_lines.n_lines"),
    }).drop("_counts", "_lines")
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistics as whole numbers: logarithm of the mean word length, roots and arc sines of shares, which even out their variance."""
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), F.sqrt(F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1))), F.asin(F.sqrt(share("n_dup_lines", "n_lines"))), F.asin(F.sqrt(share("n_repeat_words", "n_words"))))
    return [F.round(v * UNIT).cast("long").alias(name) for v, name in zip(values, STATISTICS, strict=True)]


def held(df: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined with a table of one or two rows for each group, by broadcast if there are few groups."""
    return df.join(F.broadcast(small) if small.count() <= 2 * GROUPS else small, key, how)


def estimation_groups(d: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, key): the group in which rows of a language and source are estimated; null if there are too few rows of all kinds."""
    judged = d.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    small = F.col("n") < least_rows
    by_lang = judged.filter(small).groupBy("lang").agg(F.sum("n").alias("pooled"))
    rest = by_lang.filter(F.col("pooled") < least_rows).agg(F.coalesce(F.sum("pooled"), F.lit(0)).alias("rest"))
    own, pooled = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    key = F.when(~small, own).when(F.col("pooled") >= least_rows, pooled).when(F.col("rest") >= least_rows, F.lit("{}"))
    # The sum over all is one row.
    return judged.join(by_lang, "lang", "left").crossJoin(F.broadcast(rest)).select("lang", "source", key.alias("key"))


def factored(moments: DataFrame, scale: float) -> DataFrame:
    """(key, start, m0.., l00.., det) of moments (key, start, n, s0.., p00..): means and the lower triangular root of scale times the covariance plus the floor; det is its logarithm."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n / UNIT for i in range(N)]
    d = moments.select("key", "start", *[mean[i].alias(f"m{i}") for i in range(N)], *[(F.col(f"p{i}{j}") / n / UNIT**2).alias(f"c{i}{j}") for i, j in LOWER])
    covariance = {(i, j): scale * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in LOWER}
    for i, j in LOWER:
        left = covariance[i, j]
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # The floor keeps the diagonal up, whatever rounding does.
        d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(min(FLOOR) ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return d.withColumn("det", sum(2 * F.log(f"l{i}{i}") for i in range(N))).drop(*[f"c{i}{j}" for i, j in LOWER])


def distance() -> Column:
    """The squared Mahalanobis distance of a row's statistics from the model beside them."""
    y: list[Column] = []
    for i in range(N):
        left = F.col(STATISTICS[i]) / UNIT - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * y[k]
        y.append(left / F.col(f"l{i}{i}"))
    return sum(v * v for v in y)


def sums() -> list[Column]:
    """Whole-number sums of the statistics and of their products."""
    x = [F.col(s) for s in STATISTICS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(N)], *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in LOWER]]


SUMMED = ["n", *[f"s{i}" for i in range(N)], *[f"p{i}{j}" for i, j in LOWER]]


def starts(rows: DataFrame) -> DataFrame:
    """Two models a group: means and covariance of all its rows, and medians with absolute deviations from them."""
    mean = factored(rows.groupBy("key").agg(*sums()).withColumn("start", F.lit(0)), 1.0)
    values = rows.select("key", F.posexplode(F.array(*STATISTICS)).alias("i", "x")).groupBy("key", "i", "x").agg(F.count(F.lit(1)).alias("n"))

    def median(d: DataFrame, x: str, name: str) -> DataFrame:
        """The lower median by key and i, from counts of values."""
        own = W.partitionBy("key", "i")
        upto, whole = F.sum("n").over(own.orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)), F.sum("n").over(own)
        return d.withColumn("upto", upto).withColumn("whole", whole).filter(2 * F.col("upto") >= F.col("whole")).groupBy("key", "i").agg(F.min(x).alias(name))

    values = cut(values)
    middle = median(values, "x", "middle")
    apart = values.join(middle, ["key", "i"]).groupBy("key", "i", F.abs(F.col("x") - F.col("middle")).alias("away")).agg(F.sum("n").alias("n"))
    spread = middle.join(median(apart, "away", "away"), ["key", "i"])
    one = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c))) / UNIT
    robust = spread.groupBy("key").agg(*[one(i, "middle").alias(f"m{i}") for i in range(N)], *[F.sqrt(F.pow(1.4826 * one(i, "away"), 2) + FLOOR[i] ** 2).alias(f"l{i}{i}") for i in range(N)])
    robust = robust.withColumns({f"l{i}{j}": F.lit(0.0) for i, j in LOWER if i != j}).withColumns({"start": F.lit(1), "det": sum(2 * F.log(f"l{i}{i}") for i in range(N))})
    return mean.unionByName(robust)


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The models of the nearest half of each group's rows, by the distances of `model`: whole bins of distance, until they hold half."""
    near = F.floor(BINS * F.log2(distance() + 2.0**-20)).cast("int")
    bins = held(rows, model, "key").groupBy("key", "start", near.alias("bin")).agg(*sums())
    own = W.partitionBy("key", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("before", before).withColumn("half", F.floor((F.sum("n").over(own) + N + 1) / 2)).filter("before < half")
    return factored(inner.groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in SUMMED]), 1.0)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(key, m0.., l00..): the reweighted minimum-covariance-determinant model of each group of rows (key, statistics)."""
    model = cut(starts(rows))
    settled = None
    for _ in range(steps):
        model = cut(concentrated(rows, model))
        state = model.agg(F.sum(F.round(F.col("det") * 1e6).cast("decimal(38,0)")), F.sum(F.xxhash64("key", "start", "m0", "m1", "m2", "m3").cast("decimal(38,0)"))).first()
        if state == settled:
            break
        settled = state
    best = model.groupBy("key").agg(F.min(F.struct("det", "start", *[c for c in model.columns if c not in ("key", "det", "start")])).alias("b")).select("key", "b.*")
    # The half's covariance is that of the nearest half of normal rows; what the floor added is scaled alike.
    bound = quantile(REWEIGHTED) * consistent(0.5)
    inner = held(rows, best.drop("det"), "key").filter(distance() <= bound)
    return factored(inner.groupBy("key", "start").agg(*sums()), consistent(REWEIGHTED)).drop("start", "det")


def judge(docs: DataFrame, least_rows: int = LEAST_ROWS, clean: float = CLEAN, id_col: str = "doc_id", text_col: str = "text", groups: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    base_failed: under 50 words, or over half of them in repeated three-word windows. Of the others a row is kept
    unless its statistics lie beyond the distance that `clean` of normal rows stay within. Groups of fewer than
    least_rows judged rows are estimated together; where all that is left is fewer, its rows are kept (their distance
    is null). Null texts count as empty, null languages and sources as ''. Equal texts of a group are judged alike;
    repeated rows count as rows of their own. An empty table gives an empty result.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in groups)
    d = measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), source.alias("source"), F.col(text_col).alias("text")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = cut(d.select("doc_id", "lang", "source", *counts, "base_failed", *transformed()))
    named = cut(estimation_groups(d, least_rows))
    on = ["lang", "source"]
    d = d.join(F.broadcast(named) if named.count() <= GROUPS else named, on, "left")
    judged = d.filter(~F.col("base_failed") & F.col("key").isNotNull()).select("key", *STATISTICS)
    model = cut(estimates(judged))
    far = held(d, model, "key", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= quantile(clean))
    return far.select("doc_id", *counts, "base_failed", kept.alias("kept"), F.round("distance", 6).alias("distance"))
