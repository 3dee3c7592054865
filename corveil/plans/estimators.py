"""Queries on group statistics, token-level estimators, penalties and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.operators import advantages, losses
from corveil.plans.catalog import query, table

GROUPS = "g AS (SELECT user_id AS uid, event_id AS idx, value AS score, 10 + event_id % 7 AS length FROM events)"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
TOKENS = f"""t AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS pos, l_quantity AS reward, l_extendedprice / 10000 AS value,
  -l_discount * 10 AS logp, -l_tax * 10 AS old_logp, (l_quantity - 25) / 10 AS advantage, CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask FROM lineitem)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, idx, score, length of the events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("idx"), F.col("value").alias("score"), (10 + F.col("event_id") % 7).alias("length"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens of their order, at positions that order all columns."""
    by = W.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.row_number().over(by).alias("pos"), F.col("l_quantity").alias("reward"), (F.col("l_extendedprice") / 10000).alias("value"),
        (-F.col("l_discount") * 10).alias("logp"), (-F.col("l_tax") * 10).alias("old_logp"), ((F.col("l_quantity") - 25) / 10).alias("advantage"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("mask"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of an order as arrays."""
    fields = ["reward", "value", "mask"]
    packed = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    d = tokens(spark, sf_dir).groupBy("row_id").agg(packed.alias("t"))
    return d.select("row_id", F.transform("t", lambda x: x["reward"]).alias("rewards"), F.transform("t", lambda x: x["value"]).alias("values"), F.transform("t", lambda x: x["mask"]).alias("mask"))


def rounded(c: str | Column, n: int = 9) -> Column:
    """Rounded behind the last digit of the averages, so that no exact half is left to chance."""
    return F.round(c, n)


def scored(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:  # noqa: ANN003
    return advantages.estimate(name, groups(spark, sf_dir), **how).select("uid", "idx", rounded("advantage").alias("advantage"))


@query(f"WITH {GROUPS} SELECT uid, idx, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) ELSE score / (1 + 1e-6) END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def adv_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_grpo."""
    return scored(spark, sf_dir, "grpo")


@query(f"WITH {GROUPS} SELECT uid, idx, round(score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def adv_grpo_without_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_grpo without the division by the standard deviation."""
    return scored(spark, sf_dir, "grpo", by_std=False)


@query(f"WITH {GROUPS} SELECT uid, idx, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) / (sqrt(greatest(var_samp(score) OVER w, 1e-6)) + 1e-6) ELSE score / (1 + 1e-6) END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def adv_grpo_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_grpo_vectorized, agg_group_mean_std."""
    return scored(spark, sf_dir, "grpo_vectorized")


@query(f"""WITH {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx) AS k, nth_value(score, 2) OVER (PARTITION BY uid ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM g)
SELECT uid, idx, round(CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 9) AS advantage FROM r""")
def adv_grpo_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_grpo_passk, topk_two."""
    return scored(spark, sf_dir, "grpo_passk")


@query(f"WITH {GROUPS} SELECT uid, idx, round(CASE WHEN count(*) OVER w > 1 THEN count(*) OVER w / (count(*) OVER w - 1)::DOUBLE * (score - avg(score) OVER w) ELSE score END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def adv_rloo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_rloo."""
    return scored(spark, sf_dir, "rloo")


@query("SELECT l_orderkey AS uid, round(sum(CASE WHEN n > 1 THEN (n * l_quantity - s) / (n - 1) ELSE 0 END), 4) AS total, count(*) AS n FROM (SELECT l_orderkey, l_quantity, count(*) OVER w AS n, sum(l_quantity) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) GROUP BY l_orderkey")
def adv_rloo_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_rloo_vectorized on groups with singletons; totals by group."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_quantity").alias("score"))
    d = advantages.estimate("rloo_vectorized", d)
    return d.groupBy("uid").agg(F.round(F.sum("advantage"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {GROUPS} SELECT uid, idx, round(score - CASE WHEN count(*) OVER w > 1 THEN sum(length * score) OVER w / sum(length) OVER w ELSE 0 END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def adv_opo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_opo."""
    return scored(spark, sf_dir, "opo")


@query(f"WITH {GROUPS}, a AS (SELECT count(*) / greatest(count(*) FILTER (WHERE score <> 0), 1)::DOUBLE AS alpha FROM g) SELECT uid, idx, round(alpha * (score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END), 9) AS advantage FROM g, a WINDOW w AS (PARTITION BY uid)")
def adv_gpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_gpg."""
    return scored(spark, sf_dir, "gpg")


@query(f"""WITH {GROUPS}, a AS (SELECT uid, idx, length, score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE score END AS x FROM g WINDOW w AS (PARTITION BY uid)),
m AS (SELECT sum(x * length) / (sum(length) + 1e-8) AS mean, sum(length)::DOUBLE AS n FROM a), v AS (SELECT mean, (SELECT sum(length * (x - mean) * (x - mean)) FROM a) / (n + 1e-8) * n / (n - 1) AS var FROM m)
SELECT uid, idx, round((x - mean) / sqrt(var + 1e-8), 5) AS advantage FROM a, v""")
def adv_reinforce_pp_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_rf_pp_baseline, agg_masked_whiten."""
    d = advantages.estimate("reinforce_plus_plus_baseline", groups(spark, sf_dir))
    return d.select("uid", "idx", rounded("advantage", 5).alias("advantage"))


@query(f"""WITH {TOKENS}, s AS (SELECT row_id, pos, (sum(reward * mask) OVER (PARTITION BY row_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - 10 * mask) * 1.0 AS a FROM t)
SELECT row_id, round(sum(a * pos), 4) AS weighted, count(*)::INTEGER AS n FROM s GROUP BY row_id""")
def adv_remax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_remax: suffix sums less a baseline; a position-weighted sum by row."""
    d = advantages.estimate("remax", rows(spark, sf_dir).withColumn("baseline", F.lit(10.0)))
    total = F.aggregate(F.transform("advantages", lambda a, i: a * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return d.select("row_id", F.round(total, 4).alias("weighted"), F.size("advantages").alias("n"))


@query(f"""WITH RECURSIVE {TOKENS}, n AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS size FROM t),
s AS (SELECT row_id, pos, reward AS run, mask FROM n WHERE pos = size UNION ALL SELECT n.row_id, n.pos, n.reward + 0.9 * s.run * s.mask, n.mask FROM s JOIN n ON n.row_id = s.row_id AND n.pos = s.pos - 1),
m AS (SELECT sum(run * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS k FROM s), v AS (SELECT mean, (SELECT sum(mask * (run - mean) * (run - mean)) FROM s) / (k + 1e-8) * k / (k - 1) AS var FROM m)
SELECT row_id, round(sum(run), 9) AS returns, round(sum((run - mean) / sqrt(var + 1e-8) * mask), 4) AS advantage FROM s, v GROUP BY row_id""")
def adv_reinforce_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_reinforce_pp: discounted returns that restart behind masked-out tokens, whitened."""
    d = advantages.estimate("reinforce_plus_plus", rows(spark, sf_dir), gamma=0.9)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return d.select("row_id", F.round(total("returns"), 9).alias("returns"), F.round(total("advantages"), 4).alias("advantage"))


@query(f"""WITH RECURSIVE {TOKENS}, n AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS size FROM t),
s AS (SELECT row_id, pos, mask, value, (reward - value) * mask AS last, value * mask AS nextv FROM n WHERE pos = size
 UNION ALL SELECT n.row_id, n.pos, n.mask, n.value, (n.reward + s.nextv - n.value + 0.95 * s.last) * n.mask + s.last * (1 - n.mask), n.value * n.mask + s.nextv * (1 - n.mask) FROM s JOIN n ON n.row_id = s.row_id AND n.pos = s.pos - 1),
m AS (SELECT sum(last * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS k FROM s), v AS (SELECT mean, (SELECT sum(mask * (last - mean) * (last - mean)) FROM s) / (k + 1e-8) * k / (k - 1) AS var FROM m)
SELECT row_id, round(sum(last + value), 9) AS returns, round(sum((last - mean) / sqrt(var + 1e-8) * mask), 4) AS advantage FROM s, v GROUP BY row_id""")
def adv_gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adv_gae: the backward scan that carries its state over masked-out tokens."""
    d = advantages.estimate("gae", rows(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return d.select("row_id", F.round(total("returns"), 9).alias("returns"), F.round(total("advantages"), 4).alias("advantage"))


@query(f"""WITH {TOKENS} SELECT row_id, round(sum(logp - old_logp), 6) AS k1, round(sum(abs(logp - old_logp)), 6) AS abs_kl, round(sum(0.5 * (logp - old_logp) * (logp - old_logp)), 6) AS k2,
  round(sum(greatest(-10, least(10, exp(old_logp - logp) - (old_logp - logp) - 1))), 6) AS k3 FROM t GROUP BY row_id""")
def kl_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kl_penalty: k1, abs, k2 and k3."""
    kinds = {"k1": "k1", "abs": "abs_kl", "k2": "k2", "k3+": "k3"}
    d = tokens(spark, sf_dir)
    return d.groupBy("row_id").agg(*[F.round(F.sum(losses.kl_penalty(F.col("logp"), F.col("old_logp"), k)), 6).alias(v) for k, v in kinds.items()])


@query(f"""WITH {TOKENS}, r AS (SELECT row_id, sum((logp - old_logp) * mask) / (sum(mask) + 1e-8) AS kl, sum((reward - 0.1 * (logp - old_logp)) * mask) AS total FROM t GROUP BY row_id)
SELECT round(avg(kl), 6) AS current_kl, round(sum(total), 2) AS total_reward, count(*) AS n FROM r""")
def kl_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kl_reward, rew_kl: rewards less the weighted penalty, and the mean of the rows' masked means."""
    kl = losses.kl_penalty(F.col("logp"), F.col("old_logp"), "kl")
    by_row = tokens(spark, sf_dir).groupBy("row_id").agg((F.sum(kl * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("kl"), F.sum((F.col("reward") - 0.1 * kl) * F.col("mask")).alias("total"))
    return by_row.agg(F.round(F.avg("kl"), 6).alias("current_kl"), F.round(F.sum("total"), 2).alias("total_reward"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE d AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS k, value / 100 AS kl FROM events),
s AS (SELECT DISTINCT user_id, 0 AS k, 0.2::DOUBLE AS beta FROM events UNION ALL SELECT d.user_id, d.k, beta * (1 + greatest(-0.2, least(0.2, kl / 0.5 - 1)) * 64 / 1000) FROM s JOIN d ON d.user_id = s.user_id AND d.k = s.k + 1)
SELECT user_id, k AS step, round(beta, 9) AS coefficient FROM s WHERE k > 0""")
def kl_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kl_adaptive: the coefficient after each step of a run; a user's events are a run."""
    kls = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] / 100)
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(losses.adaptive_kl(kls, 0.2, 0.5, 1000.0, 64).alias("b"))
    return d.select("user_id", F.posexplode("b").alias("i", "c")).select("user_id", (F.col("i") + 1).alias("step"), F.round("c", 9).alias("coefficient"))


LOSS_BY_ROW = "round(sum(loss * mask), 5) AS loss"


def by_row(df: DataFrame, *more: Column) -> DataFrame:
    return df.groupBy("row_id").agg(F.round(F.sum(F.col("loss") * F.col("mask")), 5).alias("loss"), *more)


@query(f"""WITH {TOKENS}, r AS (SELECT *, exp(greatest(-20, least(20, logp - old_logp))) AS ratio FROM t), l AS (SELECT *, -advantage * ratio AS p, -advantage * greatest(0.8, least(1.2, ratio)) AS b FROM r),
f AS (SELECT *, greatest(p, b) AS first FROM l), x AS (SELECT *, CASE WHEN advantage < 0 THEN least(-advantage * 3, first) ELSE first END AS loss, (b > p)::INTEGER AS clipped, (advantage < 0 AND first > -advantage * 3)::INTEGER AS low FROM f)
SELECT row_id, {LOSS_BY_ROW}, sum(clipped)::BIGINT AS clipped, sum(low)::BIGINT AS clipped_low FROM x GROUP BY row_id""")
def policy_loss_vanilla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_vanilla: clip, dual clip and clip fractions."""
    return by_row(losses.vanilla(tokens(spark, sf_dir)), F.sum("clipped").cast("long").alias("clipped"), F.sum("clipped_low").cast("long").alias("clipped_low"))


@query(f"WITH {TOKENS}, x AS (SELECT *, -greatest(0.8, least(1.2, exp(logp - old_logp))) * advantage * logp AS loss FROM t) SELECT row_id, {LOSS_BY_ROW} FROM x GROUP BY row_id")
def policy_loss_cispo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_cispo."""
    return by_row(losses.cispo(tokens(spark, sf_dir)))


@query(f"""WITH {TOKENS}, r AS (SELECT *, exp(least(10, sum((logp - old_logp) * mask) OVER w / greatest(sum(mask) OVER w, 1))) AS ratio FROM t WINDOW w AS (PARTITION BY row_id)),
x AS (SELECT *, greatest(-advantage * ratio, -advantage * greatest(1 - 3e-4, least(1 + 4e-4, ratio))) AS loss FROM r) SELECT row_id, {LOSS_BY_ROW} FROM x GROUP BY row_id""")
def policy_loss_gspo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_gspo."""
    return by_row(losses.gspo(tokens(spark, sf_dir)))


@query(f"WITH {TOKENS}, x AS (SELECT *, -logp * advantage AS loss FROM t) SELECT row_id, {LOSS_BY_ROW} FROM x GROUP BY row_id")
def policy_loss_gpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_gpg."""
    return by_row(losses.gpg(tokens(spark, sf_dir)))


@query(f"""WITH {TOKENS} SELECT row_id, round(-(sum(advantage * mask) / (sum(mask) + 1e-8)) * exp(sum(sign(advantage) * least(sign(advantage) * (logp - old_logp), 0.4) * mask) / (sum(mask) + 1e-8)), 5) AS loss FROM t GROUP BY row_id""")
def policy_loss_geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_geo_mean."""
    return losses.geo_mean(tokens(spark, sf_dir)).select("row_id", F.round("loss", 5).alias("loss"))


@query(f"""WITH {TOKENS}, m AS (SELECT avg(advantage) AS a, avg(logp) AS l FROM t WHERE mask > 0)
SELECT round(sum((advantage - a) * (logp - l) * mask), 2) AS total, count(*) FILTER (WHERE mask > 0) AS n FROM t, m""")
def token_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariances from which loss_clip_cov and loss_kl_cov pick their tokens."""
    d = losses.covariance(tokens(spark, sf_dir))
    return d.agg(F.round(F.sum(F.col("cov") * F.col("mask")), 2).alias("total"), F.count_if(F.col("mask") > 0).alias("n"))


@query(f"""WITH {TOKENS}, m AS (SELECT avg(advantage) AS a, avg(logp) AS l FROM t WHERE mask > 0),
c AS (SELECT row_id, pos, (advantage - a) * (logp - l) AS cov FROM t, m WHERE mask > 0), n AS (SELECT greatest((count(*) * 0.002)::BIGINT, 1) AS k FROM c),
top AS (SELECT row_id, pos FROM (SELECT *, row_number() OVER (ORDER BY round(cov, 9) DESC, row_id, pos) AS r FROM c), n WHERE r <= floor((SELECT count(*) FROM c) * 0.002)),
x AS (SELECT t.*, -advantage * exp(logp - old_logp) + CASE WHEN top.row_id IS NULL THEN 0 ELSE abs(logp - old_logp) END AS loss FROM t LEFT JOIN top ON t.row_id = top.row_id AND t.pos = top.pos)
SELECT round(sum(loss * mask) / (sum(mask) + 1e-8), 5) AS loss FROM x""")
def policy_loss_kl_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_kl_cov, topk_cov: the tokens of highest covariance pay for their divergence."""
    d = losses.kl_cov(tokens(spark, sf_dir), ["row_id", "pos"], ratio=0.002)
    return losses.aggregate_loss(d, "loss", "token-mean").select(F.round("loss", 5).alias("loss"))


@query(f"""WITH {TOKENS}, m AS (SELECT avg(advantage) AS a, avg(logp) AS l FROM t WHERE mask > 0), r AS (SELECT *, exp(greatest(-20, least(20, logp - old_logp))) AS ratio FROM t),
f AS (SELECT *, greatest(-advantage * ratio, -advantage * greatest(0.8, least(1.2, ratio))) AS first FROM r), x AS (SELECT *, CASE WHEN advantage < 0 THEN least(-advantage * 3, first) ELSE first END AS loss FROM f),
c AS (SELECT row_id, pos, (advantage - a) * (logp - l) AS cov FROM t, m WHERE mask > 0), d AS (SELECT row_id, pos, row_number() OVER (ORDER BY md5('42:' || row_id || ':' || pos), row_id, pos) AS k FROM c WHERE cov > 1 AND cov < 5),
o AS (SELECT row_id, pos FROM d WHERE k <= (SELECT greatest(floor(count(*) * 0.01)::BIGINT, 1) FROM c))
SELECT round(sum(CASE WHEN o.row_id IS NULL THEN loss ELSE 0 END * mask) / (sum(mask) + 1e-8), 5) AS loss FROM x LEFT JOIN o ON x.row_id = o.row_id AND x.pos = o.pos""")
def policy_loss_clip_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_clip_cov: a hash-drawn part of the tokens of middling covariance has no loss."""
    d = losses.clip_cov(tokens(spark, sf_dir), ["row_id", "pos"], ratio=0.01)
    return losses.aggregate_loss(d, "loss", "token-mean").select(F.round("loss", 5).alias("loss"))


MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


@query(f"""WITH {TOKENS}, r AS (SELECT row_id, sum(advantage * mask) AS total, sum(mask) AS n, count(*) AS width FROM t GROUP BY row_id)
SELECT 'token-mean' AS mode, round(sum(total) / (sum(n) + 1e-8), 6) AS loss FROM r UNION ALL SELECT 'seq-mean-token-sum', round(avg(total), 6) FROM r
UNION ALL SELECT 'seq-mean-token-mean', round(avg(total / (n + 1e-8)), 6) FROM r UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(total) / max(width), 4) FROM r""")
def loss_agg_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_loss: the four ways to aggregate."""
    d, out = tokens(spark, sf_dir), None
    for mode in MODES:
        one = losses.aggregate_loss(d, "advantage", mode).select(F.lit(mode).alias("mode"), F.round("loss", 4 if mode.endswith("norm") else 6).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TOKENS}, x AS (SELECT row_id, mask, greatest(least(value * 1.3, value + 0.5), value - 0.5) AS near, value * 1.3 AS p, reward / 10 AS ret FROM t)
SELECT row_id, round(sum(0.5 * greatest((p - ret) * (p - ret), (near - ret) * (near - ret)) * mask), 5) AS loss, sum(((near - ret) * (near - ret) > (p - ret) * (p - ret))::INTEGER)::BIGINT AS clipped FROM x GROUP BY row_id""")
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_value: the clipped value loss and where it clips."""
    loss, clipped = losses.value_loss(F.col("value") * 1.3, F.col("value"), F.col("reward") / 10)
    return by_row(tokens(spark, sf_dir).withColumns({"loss": loss, "clipped": clipped}), F.sum("clipped").cast("long").alias("clipped"))


@query(f"""WITH {TOKENS} SELECT round(max(abs(exp(logp) - exp(old_logp))), 6) AS max_diff, round(avg(abs(exp(logp) - exp(old_logp))), 6) AS mean_diff, round(stddev_samp(abs(exp(logp) - exp(old_logp))), 6) AS std_diff, round(corr(exp(logp), exp(old_logp)), 6) AS pearson FROM t WHERE mask > 0""")
def prob_diff_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_prob_diff: how far two probabilities of the same tokens are apart."""
    p, q = F.exp("logp"), F.exp("old_logp")
    diff = F.abs(p - q)
    return tokens(spark, sf_dir).filter("mask > 0").agg(*[F.round(f, 6).alias(n) for f, n in ((F.max(diff), "max_diff"), (F.avg(diff), "mean_diff"), (F.stddev_samp(diff), "std_diff"), (F.corr(p, q), "pearson"))])
