"""Metrics and their errors: registries of aggregates over Columns, pooled errors, rollups and bootstraps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.operators.batch import ranges, ranked
from corveil.operators.edits import counted_edits

#: name -> (aggregate of Columns, whether higher is better)
AGGREGATES: dict[str, tuple[Callable[..., Column], bool]] = {
    "mean": (lambda x: F.avg(x), True),
    # The element in the middle of the order of arrival, which is what the name means in the evaluation configs.
    "median": (lambda x, order: median_arrival(x, order), True),
    "sorted_median": (lambda x: F.median(x), True),
    "bypass": (lambda x: F.lit(999), True),
    "perplexity": (lambda x: F.exp(-F.avg(x)), False),
    "weighted_mean": (lambda x, w: F.sum(x) / F.sum(w), True),
    "weighted_perplexity": (lambda x, w: F.exp(-F.sum(x) / F.sum(w)), False),
    "bits_per_byte": (lambda x, w: -F.sum(x) / F.sum(w) / F.log(F.lit(2.0)), False),
    "pop_std": (lambda x: F.stddev_pop(x), False),
    "sample_std": (lambda x: F.stddev_samp(x), False),
    "mean_stderr": (lambda x: F.stddev_samp(x) / F.sqrt(F.count(x)), False),
    "f1": (lambda gold, pred: f1(gold, pred), True),
    "mcc": (lambda gold, pred: matthews(gold, pred), True),
    "brier_score": (lambda gold, *p: brier(gold, list(p)), False),
}

#: name -> (the request types that it is for, its default aggregate, whether higher is better)
METRICS: dict[str, tuple[tuple[str, ...], str, bool]] = {
    "acc": (("loglikelihood", "multiple_choice"), "mean", True), "acc_norm": (("loglikelihood", "multiple_choice"), "mean", True), "acc_mutual_info": (("multiple_choice",), "mean", True), "exact_match": (("generate_until",), "mean", True),
    "perplexity": (("loglikelihood",), "perplexity", False), "word_perplexity": (("loglikelihood_rolling",), "weighted_perplexity", False), "byte_perplexity": (("loglikelihood_rolling",), "weighted_perplexity", False), "bits_per_byte": (("loglikelihood_rolling",), "bits_per_byte", False),
    "f1": (("multiple_choice",), "f1", True), "mcc": (("multiple_choice",), "mcc", True), "brier_score": (("multiple_choice",), "brier_score", False), "anls": (("generate_until",), "mean", True),
    "bypass": (("loglikelihood", "multiple_choice", "generate_until"), "bypass", True),
}


def metric(name: str, request_type: str) -> tuple[str, bool]:
    """(default aggregate, whether higher is better) of a metric; an unknown one, or one that isn't for the request type, is an error."""
    kinds, how, higher = METRICS.get(name) or ((), "", False)
    if request_type not in kinds:
        raise ValueError(f"no metric {name!r} for {request_type} requests")
    return how, higher


def aggregate(name: str, *columns: Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown metric {name!r}")
    return AGGREGATES[name][0](*columns)


def median_arrival(x: Column, order: Column) -> Column:
    """The middle element in the order of arrival, not of size: element n // 2, counted from 0; for groups that fit in a row, else `middles`."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return F.element_at(rows, (F.floor(F.size(rows) / 2) + 1).cast("int"))["x"]


def middles(df: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """(keys, median) of each group: of the order of arrival by a numeric column `order`, else of size.

    By arrival it is the element n // 2, counted from 0, null values included; by size the mean of the middle one or
    two values that aren't null. Rows are numbered by ranges, so that no row or task holds a group, and rows of null
    keys are a group like any other. The columns of `keys` keep their names.
    """
    d = df.select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"), F.col(order or value).alias("_o"))
    d = d if order else d.filter("_o is not null")
    sizes = d.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    d = ranked(ranges(d, "_o", "_b"), ["_key"], "_b", [F.col("_o")], "_k").join(sizes, "_key")
    if order:
        return d.filter("_k = _n div 2").select("_key.*", F.col("_v").alias("median"))
    return d.filter("_k between (_n - 1) div 2 and _n div 2").groupBy("_key").agg(F.avg("_v").alias("median")).select("_key.*", "median")


def confusion(gold: Column, pred: Column) -> dict[str, Column]:
    return {"tp": F.count_if((gold == 1) & (pred == 1)), "fp": F.count_if((gold == 0) & (pred == 1)), "fn": F.count_if((gold == 1) & (pred == 0)), "tn": F.count_if((gold == 0) & (pred == 0))}


def f1(gold: Column, pred: Column) -> Column:
    c = confusion(gold, pred)
    below = 2 * c["tp"] + c["fp"] + c["fn"]
    return F.when(below > 0, 2 * c["tp"] / below).otherwise(0.0)


def matthews(gold: Column, pred: Column) -> Column:
    c = {k: v.cast("double") for k, v in confusion(gold, pred).items()}
    below = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return F.when(below > 0, (c["tp"] * c["tn"] - c["fp"] * c["fn"]) / below).otherwise(0.0)


def brier(gold: Column, probabilities: list[Column]) -> Column:
    """Mean over rows of the summed squared differences to the one-hot gold class."""
    return F.avg(sum(((p - (gold == k).cast("double")) ** 2 for k, p in enumerate(probabilities)), F.lit(0.0)))


def explained_variance(values: Column, returns: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): max where the name contains max, min where it contains min, else the mean."""
    n = F.col(name)
    kind = F.when(n.contains("max"), F.max(value)).when(n.contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(kind.alias(value))


def pooled_stderr(size: Column, stderr: Column) -> Column:
    """sqrt(sum((n - 1) * se^2 * n) / (sum(n) - k) / sum(n))"""
    return F.sqrt(F.sum((size - 1) * stderr * stderr * size) / (F.sum(size) - F.count(size)) / F.sum(size))


def combined_stderr(rows: Column) -> Column:
    """The pairwise combination, in order, of an array of (n, mean, stderr) structs: variances of the means with the means' shifts."""
    def merge(s: Column, x: Column) -> Column:
        n = s["n"] + x["n"]
        var = ((s["n"] - 1) * s["var"] + (x["n"] - 1) * x["var"]) / (n - 1) + s["n"] * x["n"] / (n * (n - 1)) * (s["mean"] - x["mean"]) ** 2
        return F.struct(n.alias("n"), ((s["mean"] * s["n"] + x["mean"] * x["n"]) / n).alias("mean"), var.alias("var"))

    parts = F.transform(rows, lambda r: F.struct(r["n"].alias("n"), r["mean"].alias("mean"), (r["stderr"] ** 2).alias("var")))
    return F.sqrt(F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], merge)["var"])


def task_metrics(samples: DataFrame) -> DataFrame:
    """samples (task, metric, filter, value): (task, metric, filter, value, stderr, samples), stderr null for one sample."""
    return samples.groupBy("task", "metric", "filter").agg(F.avg("value").alias("value"), aggregate("mean_stderr", F.col("value")).alias("stderr"), F.count("value").alias("samples"))


def group_rollup(results: DataFrame, hierarchy: DataFrame, levels: int, weighted: bool = True) -> DataFrame:
    """results (task, value, stderr, samples) rolled up along hierarchy (task, parent), at most `levels` steps.

    A parent's value is the mean of its children, weighted by their samples or not; its error the pooled one.
    """
    out, level = results.withColumn("level", F.lit(0)), results
    for k in range(1, levels + 1):
        n = F.col("samples")
        value = F.sum(F.col("value") * n) / F.sum(n) if weighted else F.avg("value")
        level = level.join(hierarchy, "task").groupBy(F.col("parent").alias("task")).agg(value.alias("value"), pooled_stderr(n, F.col("stderr")).alias("stderr"), F.sum("samples").alias("samples"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Per key the most frequent vote, the first seen of several, with its number and its first value."""
    votes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    by = W.partitionBy(*keys).orderBy(F.desc("votes"), "first")
    return votes.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").select(*keys, vote, "votes", "value")


def best_worst(df: DataFrame, keys: list[str], value: str, order: str, sizes: list[int]) -> DataFrame:
    """(keys, k, best_mean, best_std, worst_mean, worst_std) of the best and worst of k draws with replacement.

    What resampling estimates has a closed form: of n sorted values, the largest of k draws is at most the i-th with
    probability (i / n) ** k. A group is one prompt's rollouts.
    """
    own = W.partitionBy(*keys)
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), F.row_number().over(own.orderBy(value, order)).alias("_i"), F.count(F.lit(1)).over(own).alias("_n"))
    d = d.withColumn("k", F.explode(F.array(*map(F.lit, sizes))))
    i, n, k = F.col("_i"), F.col("_n"), F.col("k")
    best = F.pow(i / n, k) - F.pow((i - 1) / n, k)
    worst = F.pow((n - i + 1) / n, k) - F.pow((n - i) / n, k)
    mean = lambda p: F.sum(F.col("_x") * p)
    std = lambda p: F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_x") * F.col("_x") * p) - F.pow(mean(p), F.lit(2))))
    return d.groupBy(*keys, "k").agg(mean(best).alias("best_mean"), std(best).alias("best_std"), mean(worst).alias("worst_mean"), std(worst).alias("worst_std"))


def poisson(u: Column) -> Column:
    """The number with mean 1 that a uniform u of [0, 1) stands for: its inverse distribution, up to 8."""
    total, part, out = 0.0, math.exp(-1.0), F.lit(0)
    for n in range(1, 9):
        total += part
        out = F.when(u >= total, n).otherwise(out)
        part /= n
    return out


def bootstrap_stderr(df: DataFrame, value: str, key: str, resamples: int = 100, seed: int = 1234) -> DataFrame:
    """(stderr): the sample std of the mean over Poisson resamples.

    Each row's number of copies in a resample comes from a hash of its key and the resample, so that rows never gather;
    tasks send one pair of sums a resample.
    """
    d = df.filter(F.col(value).isNotNull()).select(value, key, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("resample").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    d = d.withColumn("_u", F.conv(F.left(h, F.lit(13)), 16, 10).cast("long") / float(1 << 52)).withColumn("_n", poisson(F.col("_u")))
    means = d.groupBy("resample").agg((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"))
    return means.agg(F.stddev_samp("mean").alias("stderr"))


def described(name: str, x: Column) -> list[Column]:
    """mean, max and min of x, named name/mean and so on with underscores."""
    return [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]


def batch_metrics(df: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Descriptive statistics of a batch (score, reward, advantage, return_, value, length, prompt_length), in one aggregate.

    Rows without response (length 0) are aborted; the non-aborted ones have statistics of their own.
    """
    alive = lambda c: F.when(F.col("length") > 0, F.col(c))
    out = [x for c in ("score", "reward", "advantage", "return_", "length", "prompt_length") for x in described(c, F.col(c))]
    out += [x for c in ("score", "length") for x in described(f"{c}_alive", alive(c))]
    clip = lambda x: F.avg((x == longest).cast("int"))
    return df.groupBy(*keys).agg(*out, clip(F.col("length")).alias("clip_ratio"), clip(alive("length")).alias("clip_ratio_alive"), F.avg((F.col("length") == 0).cast("int")).alias("aborted_ratio"), explained_variance(F.col("value"), F.col("return_")).alias("explained_variance"))


def validation_sections(df: DataFrame) -> DataFrame:
    """df (data_source, var, metric) with section: val-core for mean, maj and best metrics at the largest N of a source's core variable, else val-aux.

    The core variable is acc where a source has it, else reward. N is the number behind @ in the metric's name.
    """
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    d = df.withColumn("_n", n)
    # A few rows for each source.
    core = F.when(F.max((F.col("var") == "acc").cast("int")).over(W.partitionBy("data_source")) == 1, "acc").otherwise("reward")
    most = F.max("_n").over(W.partitionBy("data_source", "var"))
    first = F.regexp_like("metric", F.lit("^(mean|maj|best)"))
    return d.withColumn("section", F.when((F.col("var") == core) & first & (F.col("_n") == most), "val-core").otherwise("val-aux")).drop("_n")


def ordered_hash(df: DataFrame, key: str, order: str, text: Column, run: int = 1000) -> DataFrame:
    """(key, task_hash): the SHA-256 of the rows' hashes in their order, by way of the hashes of runs of rows, so that no row holds a whole key."""
    d = ranked(ranges(df, order, "_b"), [key], "_b", [F.col(order)], "_k")
    d = d.select(key, F.floor(F.col("_k") / run).alias("_run"), F.struct(F.col("_k"), F.sha2(text, 256).alias("h")).alias("_s"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["h"]), ""), 256)
    runs = d.groupBy(key, "_run").agg(joined("_s").alias("h"))
    return runs.groupBy(key).agg(joined(F.struct("_run", "h")).alias("task_hash"))


def bleu(df: DataFrame, pred: str, gold: str, order: int = 4) -> DataFrame:
    """(bleu) of the corpus, 0 to 100: geometric mean of clipped n-gram precisions with the brevity penalty; white space tokens.

    The n-grams of both sides are counted by row and n-gram, so that long texts cost what their words do.
    """
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")

    def grams(side: str, n: int) -> Column:
        x = F.col(side)
        return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(x, i, n), " ").alias("g"), F.lit(side == "_p").alias("p")))).otherwise(F.array().cast("array<struct<n:int,g:string,p:boolean>>"))

    d = df.select(words(F.col(pred)).alias("_p"), words(F.col(gold)).alias("_g"), F.monotonically_increasing_id().alias("_row"))
    d = d.select("_row", F.explode(F.concat(*[grams(side, n) for side in ("_p", "_g") for n in range(1, order + 1)])).alias("x")).select("_row", "x.*")
    both = d.groupBy("_row", "n", "g").agg(F.count_if(F.col("p")).alias("a"), F.count_if(~F.col("p")).alias("b"))
    part = lambda n, x: F.coalesce(F.sum(F.when(F.col("n") == n, x)), F.lit(0)).cast("double")
    sums = [x for n in range(1, order + 1) for x in (part(n, F.least("a", "b")).alias(f"m{n}"), part(n, F.col("a")).alias(f"c{n}"))]
    d = both.agg(*sums, part(1, F.col("b")).alias("_gold_words"))
    mean = sum((F.log(F.col(f"m{n}") / F.col(f"c{n}")) for n in range(2, order + 1)), F.log(F.col("m1") / F.col("c1"))) / order
    full = F.least(F.lit(0.0), 1 - F.col("_gold_words") / F.col("c1"))
    some = F.least(*[F.col(f"m{n}") for n in range(1, order + 1)]) > 0
    return d.select(F.when(some, 100 * F.exp(mean + full)).otherwise(0.0).alias("bleu"))


def chrf(df: DataFrame, pred: str, gold: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """(chrf) of the corpus, 0 to 100: the F score of character n-grams without white space, precisions and recalls averaged over n-grams that both sides have."""
    def grams(x: Column, n: int) -> Column:
        x = F.regexp_replace(x, r"\s+", "")
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    # The counts of each side's n-grams meet by row and n-gram: grouped aggregation instead of nested loops over a text.
    d = df.select(pred, gold, F.monotonically_increasing_id().alias("_row"))
    sides = [d.select("_row", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), grams(F.col(c), n).alias("g")) for n in range(1, order + 1)])).alias("x")).select("_row", "x.n", F.explode("x.g").alias("g"), F.lit(c == pred).alias("p")) for c in (pred, gold)]
    both = sides[0].unionByName(sides[1]).groupBy("_row", "n", "g").agg(F.count_if(F.col("p")).alias("a"), F.count_if(~F.col("p")).alias("b"))
    sums = both.groupBy("n").agg(F.sum(F.least("a", "b")).alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0 and b > 0")
    f = sums.agg(F.avg(F.col("m") / F.col("a")).alias("p"), F.avg(F.col("m") / F.col("b")).alias("r"))
    p, r, w = F.col("p"), F.col("r"), beta * beta
    return f.select(F.when(p + r > 0, 100 * (1 + w) * p * r / (w * p + r)).otherwise(0.0).alias("chrf"))


def ter(df: DataFrame, pred: str, gold: str, lower: bool = True) -> DataFrame:
    """(ter) of the corpus, 0 to 100 and more: word edits and shifts of phrases over reference words; in lower case unless told otherwise."""
    d = counted_edits(df, pred, gold, lower).agg(F.sum("edits").alias("e"), F.sum("words").alias("n"))
    return d.select(F.when(F.col("n") > 0, 100 * F.col("e") / F.col("n")).when(F.col("e") > 0, 100.0).otherwise(0.0).alias("ter"))


def placed(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with place, from 1, by falling value and then by name; for aggregated tables."""
    return df.withColumn("place", F.row_number().over(W.orderBy(F.desc(value), name)))
