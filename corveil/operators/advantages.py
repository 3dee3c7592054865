"""Advantage estimators: group-relative ones as windows over (uid), token-level ones as array scans.

Group form: one row per sample with uid, score and, for length-weighted baselines, length. Token form: one row per
sample with arrays of rewards, values and mask in token order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-6
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Adds an estimator under a name; a name can be given once."""
    def add(f: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"advantage estimator {name!r} is registered twice")
        REGISTRY[name] = f
        return f

    return add


def estimate(name: str, df: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """The estimator of this name applied to df."""
    if name not in REGISTRY:
        raise ValueError(f"unknown advantage estimator {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](df, **how)


def group(uid: str) -> W:
    return W.partitionBy(uid)


@register("grpo")
def grpo(df: DataFrame, uid: str = "uid", score: str = "score", by_std: bool = True) -> DataFrame:
    """(score - mean) / (std + eps) with the sample std; a sample alone has mean 0 and std 1."""
    n, s = F.count(F.lit(1)).over(group(uid)), F.col(score)
    mean = F.when(n > 1, F.avg(s).over(group(uid))).otherwise(0.0)
    std = F.when(n > 1, F.stddev_samp(s).over(group(uid))).otherwise(1.0)
    return df.withColumn("advantage", (s - mean) / (std + EPS) if by_std else s - mean)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """As grpo, with the variance floored at eps."""
    n, s = F.count(F.lit(1)).over(group(uid)), F.col(score)
    mean = F.when(n > 1, F.avg(s).over(group(uid))).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp(s).over(group(uid)), F.lit(EPS)))).otherwise(1.0)
    return df.withColumn("advantage", (s - mean) / (std + EPS))


@register("grpo_passk")
def grpo_passk(df: DataFrame, uid: str = "uid", score: str = "score", idx: str = "idx", by_std: bool = True) -> DataFrame:
    """Only the best sample of a group gets the lead over the second; a group of one is an error."""
    g, s = group(uid), F.col(score)
    order = g.orderBy(F.desc(score), idx)
    second = F.nth_value(s, 2).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    lead = s - second
    lead = lead / (F.stddev_samp(s).over(g) + EPS) if by_std else lead
    n = F.count(F.lit(1)).over(g)
    checked = F.when(n < 2, F.raise_error(F.lit("a group needs at least two samples")).cast("double"))
    return df.withColumn("advantage", checked.when(F.row_number().over(order) == 1, lead).otherwise(0.0))


@register("rloo")
def rloo(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """n / (n - 1) * (score - mean); a sample alone keeps its score."""
    n, s = F.count(F.lit(1)).over(group(uid)), F.col(score)
    return df.withColumn("advantage", F.when(n > 1, n / (n - 1) * (s - F.avg(s).over(group(uid)))).otherwise(s))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """(n * score - sum) / (n - 1); a sample alone gets 0."""
    n, s = F.count(F.lit(1)).over(group(uid)), F.col(score)
    return df.withColumn("advantage", F.when(n > 1, (n * s - F.sum(s).over(group(uid))) / (n - 1)).otherwise(0.0))


@register("opo")
def opo(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """score - sum(length * score) / sum(length); a sample alone has the baseline 0."""
    g, s = group(uid), F.col(score)
    baseline = F.sum(F.col(length) * s).over(g) / F.sum(length).over(g)
    return df.withColumn("advantage", s - F.when(F.count(F.lit(1)).over(g) > 1, baseline).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """alpha * (score - mean) / f_norm, where alpha is the number of samples over that of non-zero scores; a sample alone has mean 0."""
    g, s = group(uid), F.col(score)
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(s != 0), F.lit(1))).alias("alpha"))
    mean = F.when(F.count(F.lit(1)).over(g) > 1, F.avg(s).over(g)).otherwise(0.0)
    # One row.
    return df.withColumn("advantage", s - mean).join(F.broadcast(alpha)).withColumn("advantage", F.col("alpha") * F.col("advantage") / f_norm).drop("alpha")


@register("reinforce_plus_plus_baseline")
def rf_pp_baseline(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """score - group mean, whitened over all tokens: each sample counts with its number of tokens."""
    g, s = group(uid), F.col(score)
    d = df.withColumn("advantage", s - F.when(F.count(F.lit(1)).over(g) > 1, F.avg(s).over(g)).otherwise(s))
    return whiten_weighted(d, "advantage", length)


def whiten_weighted(df: DataFrame, column: str, weight: str) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with masked moments: mean and var over weight rows each, var with Bessel's correction."""
    n, total = F.sum(weight), F.sum(F.col(column) * F.col(weight))
    moments = df.agg((total / (n + 1e-8)).alias("_mean"), F.sum(F.col(column) * F.col(column) * F.col(weight)).alias("_sq"), n.alias("_n"), total.alias("_sum"))
    var = (F.col("_sq") - 2 * F.col("_mean") * F.col("_sum") + F.col("_mean") * F.col("_mean") * F.col("_n")) / (F.col("_n") + 1e-8)
    moments = moments.select("_mean", (var * F.col("_n") / (F.col("_n") - 1)).alias("_var"))
    return df.join(F.broadcast(moments)).withColumn(column, (F.col(column) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_mean", "_var")


def backwards(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running results of a scan from the last element to the first, in the order of the array."""
    kept = F.aggregate(F.reverse(values), F.array(zero), lambda out, x: F.array_append(out, step(F.element_at(out, -1), x)))
    return F.reverse(F.slice(kept, 2, F.size(values)))


@register("remax")
def remax(df: DataFrame, rewards: str = "rewards", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Sum of the rewards from each token on, less the sample's baseline, on masked-in tokens."""
    suffix = backwards(F.zip_with(rewards, mask, lambda r, m: r * m), lambda run, r: run + r, F.lit(0.0))
    return df.withColumn("advantages", F.zip_with(suffix, mask, lambda r, m: r - F.col(baseline) * m))


@register("reinforce_plus_plus")
def reinforce_pp(df: DataFrame, rewards: str = "rewards", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """Discounted returns, restarted behind each masked-out token, then whitened over all masked-in tokens."""
    pairs = F.arrays_zip(F.col(rewards).alias("r"), F.col(mask).alias("m"))
    d = df.withColumn("returns", _returns(pairs, gamma))
    return whiten_arrays(d, "returns", mask, "advantages")


def _returns(pairs: Column, gamma: float) -> Column:
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        run = x["r"] + gamma * state["run"]
        return F.struct((run * x["m"]).alias("run"), F.array_append(state["out"], run).alias("out"))

    return F.reverse(F.aggregate(F.reverse(pairs), start, step)["out"])


def whiten_arrays(df: DataFrame, values: str, mask: str, out: str, shift: bool = True) -> DataFrame:
    """Masked whitening over all tokens of all rows: per-row sums, one global aggregate of a row, then an expression."""
    zero = F.lit(0.0)
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), zero, lambda a, x: a + x)
    square = F.aggregate(F.zip_with(values, mask, lambda v, m: v * v * m), zero, lambda a, x: a + x)
    n = F.aggregate(mask, zero, lambda a, x: a + x)
    moments = df.select(total.alias("t"), square.alias("q"), n.alias("n")).agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("t") / (F.col("n") + 1e-8)
    var = (F.col("q") - 2 * mean * F.col("t") + mean * mean * F.col("n")) / (F.col("n") + 1e-8)
    moments = moments.select(mean.alias("_mean"), (var * F.col("n") / (F.col("n") - 1)).alias("_var"))
    white = F.zip_with(values, mask, lambda v, m: ((v - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8) + (F.lit(0.0) if shift else F.col("_mean"))) * m)
    return df.join(F.broadcast(moments)).withColumn(out, white).drop("_mean", "_var")


@register("gae")
def gae(df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "mask", gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantages by a backward scan that carries its state over masked-out tokens, whitened; returns before whitening."""
    rows = F.arrays_zip(F.col(rewards).alias("r"), F.col(values).alias("v"), F.col(mask).alias("m"))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        last = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["last"]
        carried = last * x["m"] + s["last"] * (1 - x["m"])
        return F.struct((x["v"] * x["m"] + s["next"] * (1 - x["m"])).alias("next"), carried.alias("last"), F.array_append(s["out"], carried).alias("out"))

    raw = F.reverse(F.aggregate(F.reverse(rows), start, step)["out"])
    d = df.withColumn("raw", raw).withColumn("returns", F.zip_with("raw", values, lambda a, v: a + v))
    return whiten_arrays(d, "raw", mask, "advantages").drop("raw")
