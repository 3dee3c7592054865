"""KL penalties, policy losses and their aggregation over tokens, as expressions on a long token table.

A token row has row_id, logp, old_logp, advantage and mask (1.0 or 0.0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.functions import text as T
from corveil.operators import batch


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """k1 or kl, abs, k2 or mse, k3 or low_var_kl; a trailing + only changes gradients."""
    kind, d = kind.removesuffix("+"), logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        back = clamp(-d, -20.0, 20.0)
        return clamp(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(f"unknown KL penalty {kind!r}")


def aggregate_loss(df: DataFrame, loss: str, mode: str, row: str = "row_id", mask: str = "mask", horizon: float | None = None) -> DataFrame:
    """One row (loss): token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    x, m = F.col(loss) * F.col(mask), F.col(mask)
    if mode == "token-mean":
        return df.agg((F.sum(x) / (F.sum(m) + 1e-8)).alias("loss"))
    rows = df.groupBy(row).agg(F.sum(x).alias("total"), F.sum(m).alias("n"), F.count(F.lit(1)).alias("width"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("total").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.col("total") / (F.col("n") + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return rows.agg((F.sum("total") / (F.lit(horizon) if horizon else F.max("width"))).alias("loss"))
    raise ValueError(f"unknown aggregation {mode!r}")


def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """The clipped loss with its lower bound for negative advantages; adds loss, clipped and clipped_low."""
    ratio, a = F.exp(clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0)), F.col("advantage")
    plain, bound = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    first, third = F.greatest(plain, bound), -a * dual
    loss = F.when(a < 0, F.least(third, first)).otherwise(first)
    return df.withColumns({"loss": loss, "clipped": (bound > plain).cast("double"), "clipped_low": ((first > third) & (a < 0)).cast("double")})


def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """-clip(ratio) * advantage * logp, the ratio being a constant."""
    ratio = F.exp(clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0))
    return df.withColumn("loss", -clamp(ratio, 1 - low, 1 + high) * F.col("advantage") * F.col("logp"))


def sequence_ratio(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Adds log_ratio: the mean over a row's masked-in tokens of logp - old_logp."""
    own = W.partitionBy(row)
    n = F.greatest(F.sum("mask").over(own), F.lit(1.0))
    return df.withColumn("log_ratio", F.sum((F.col("logp") - F.col("old_logp")) * F.col("mask")).over(own) / n)


def gspo(df: DataFrame, low: float = 3e-4, high: float = 4e-4, row: str = "row_id") -> DataFrame:
    """The clipped loss with the sequence's geometric mean ratio, its logarithm at most 10."""
    d = sequence_ratio(df, row)
    ratio, a = F.exp(F.least(F.col("log_ratio"), F.lit(10.0))), F.col("advantage")
    plain, bound = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    return d.withColumns({"loss": F.greatest(plain, bound), "clipped": (bound > plain).cast("double")}).drop("log_ratio")


def gpg(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", -F.col("logp") * F.col("advantage"))


def geo_mean(df: DataFrame, clip: float = 0.4, row: str = "row_id") -> DataFrame:
    """Per row: -mean advantage * exp(mean clipped log-ratio), the clip being on the side that the advantage's sign asks for."""
    d = F.col("logp") - F.col("old_logp")
    sign = F.signum("advantage")
    clipped = sign * F.least(sign * d, F.lit(clip))
    n = F.sum("mask") + 1e-8
    rows = df.groupBy(row).agg((F.sum(clipped * F.col("mask")) / n).alias("log_ratio"), (F.sum(F.col("advantage") * F.col("mask")) / n).alias("advantage"))
    return rows.withColumn("loss", -F.col("advantage") * F.exp("log_ratio"))


def covariance(df: DataFrame) -> DataFrame:
    """Adds cov: (advantage - mean) * (logp - mean) with the means over masked-in tokens."""
    means = df.filter("mask > 0").agg(F.avg("advantage").alias("_a"), F.avg("logp").alias("_l"))
    return df.join(F.broadcast(means)).withColumn("cov", (F.col("advantage") - F.col("_a")) * (F.col("logp") - F.col("_l"))).drop("_a", "_l")


def top_covariance(df: DataFrame, ratio: float, order: list[str], n: int) -> DataFrame:
    """The max(int(ratio * n), 1) rows with the highest covariance, ties by order."""
    return batch.highest(covariance(df), "cov", max(int(ratio * n), 1), order)


def kl_cov(df: DataFrame, key: list[str], ratio: float = 2e-4, coefficient: float = 1.0) -> DataFrame:
    """-advantage * ratio, plus coefficient * |logp - old_logp| on the share of tokens with the highest covariance."""
    n = df.filter("mask > 0").count()
    top = top_covariance(df.filter("mask > 0"), ratio, key, n).select(*key, F.lit(True).alias("_top"))
    d = F.col("logp") - F.col("old_logp")
    loss = -F.col("advantage") * F.exp(d)
    return df.join(top, key, "left").withColumn("loss", loss + F.when(F.col("_top"), coefficient * F.abs(d)).otherwise(0.0)).drop("_top")


def clip_cov(df: DataFrame, key: list[str], ratio: float = 2e-4, low: float = 1.0, high: float = 5.0, seed: int = 42) -> DataFrame:
    """The clipped loss, zeroed on a hash-drawn max(int(ratio * n), 1) of the tokens whose covariance lies between low and high."""
    d = covariance(vanilla(df))
    n = df.filter("mask > 0").count()
    middling = d.filter((F.col("mask") > 0) & (F.col("cov") > low) & (F.col("cov") < high))
    # The first 13 digits of the hash as a number: a double holds them, so that the smallest hashes are the largest values.
    h = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary")), F.lit(13)), 16, 10).cast("double")
    drawn = batch.highest(middling.select(*key, (-h).alias("_drawn")), "_drawn", max(int(ratio * n), 1), key)
    return d.join(drawn.select(*key, F.lit(True).alias("_out")), key, "left").withColumn("loss", F.when(F.col("_out"), 0.0).otherwise(F.col("loss"))).drop("_out", "cov")


def value_loss(prediction: Column, value: Column, target: Column, clip: float = 0.5) -> tuple[Column, Column]:
    """(0.5 * the larger square error of prediction and clipped prediction, whether the clipped one is larger)."""
    near = F.greatest(F.least(prediction, value + clip), value - clip)
    a, b = (prediction - target) ** 2, (near - target) ** 2
    return 0.5 * F.greatest(a, b), (b > a).cast("double")


def adaptive_kl(kls: Column, start: float, target: float, horizon: float, n: int) -> Column:
    """The coefficient after each step of an ordered array of KL values: times 1 + clip(kl / target - 1, +-0.2) * n / horizon."""
    return F.slice(F.aggregate(kls, F.array(F.lit(start)), lambda out, k: F.array_append(out, F.element_at(out, -1) * (1 + clamp(k / target - 1, -0.2, 0.2) * n / horizon))), 2, F.size(kls))


LOSSES: dict[str, Callable[..., DataFrame]] = {"vanilla": vanilla, "cispo": cispo, "gspo": gspo, "gpg": gpg, "geo_mean": geo_mean, "kl_cov": kl_cov, "clip_cov": clip_cov}


def log_total(logits: Column) -> Column:
    """log(sum(exp(logits))), shifted by the largest."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda t, x: t + F.exp(x - top)))


def logprob(logits: Column, token: Column) -> Column:
    """The log-probability of the token with this number, from 0."""
    return F.get(logits, token) - log_total(logits)


def entropy(logits: Column) -> Column:
    """The entropy of the distribution that the logits stand for, in nats."""
    return T.let(lambda x, z: z - F.aggregate(x, F.lit(0.0), lambda t, v: t + v * F.exp(v - z)), logits, log_total(logits))
