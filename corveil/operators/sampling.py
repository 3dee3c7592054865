"""Domain-balanced batches, few-shot examples and weighted draws, ordered by hashes instead of random state."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.operators.batch import numbered, ranged_sum, ranges, ranked


def hashed(key: Column, seed: int) -> Column:
    """The MD5 of seed:key, which orders rows at random but always alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def fraction(h: Column) -> Column:
    """A hash as a number of [0, 1), by its first 13 hexadecimal digits."""
    return F.conv(F.left(h, F.lit(13)), 16, 10).cast("long") / float(1 << 52)


def parse_weights(text: str) -> dict[str, float]:
    """name:weight,... or a JSON object; weights over 0, normalised; an error if none is left."""
    found = json.loads(text) if text.lstrip().startswith("{") else dict(part.rsplit(":", 1) for part in text.split(",") if part.strip())
    found = {k.strip(): float(v) for k, v in found.items() if float(v) > 0}
    if not found:
        raise ValueError(f"no positive weight in {text!r}")
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def quotas(weights: dict[str, float], batch: int) -> dict[str, int]:
    """Rows of each domain in a batch by largest remainders, the first of equals."""
    exact = {k: w * batch for k, w in weights.items()}
    out = {k: math.floor(v + 1e-12) for k, v in exact.items()}
    for k in sorted(weights, key=lambda k: -(exact[k] - out[k]))[: batch - sum(out.values())]:
        out[k] += 1
    return out


def domain_batches(df: DataFrame, domain: str, key: str, weights: dict[str, float], batch: int, seed: int = 0, epoch: int = 0, shuffled: bool = True) -> DataFrame:
    """(domain, key, batch, slot): batches with each domain's quota, a domain's rows by hash (or by key), starting over when it ends.

    Weights of domains without rows are shared among the others. There are as many batches as rows fill.
    """
    counts = {r[0]: r["n"] for r in df.groupBy(domain).agg(F.count(F.lit(1)).alias("n")).collect() if r[0] in weights}
    total = sum(weights[k] for k in counts)
    share = quotas({k: weights[k] / total for k in weights if k in counts}, batch)
    batches = sum(counts.values()) // batch
    first, table = 0, []
    for k in share:
        table.append((k, share[k], first, counts[k]))
        first += share[k]
    # One row per domain with a weight.
    plan = F.broadcast(df.sparkSession.createDataFrame(table, f"{domain} string, quota long, first long, n long"))
    rows = df.select(domain, key).join(plan, domain)
    if shuffled:
        rows = rows.withColumn("_h", hashed(F.col(key), seed + epoch)).withColumn("_b", F.substring("_h", 1, 3))
        rows = ranked(rows, [domain], "_b", [F.col("_h"), F.col(key)], "_r")
    else:
        rows = ranked(ranges(rows, key, "_b"), [domain], "_b", [F.col(key)], "_r")
    # A row comes again every n places of its domain.
    need = F.col("quota") * batches
    times = F.ceil((need - F.col("_r")) / F.col("n"))
    places = F.when((times > 0) & (F.col("quota") > 0), F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda t: F.col("_r") + t * F.col("n")))
    rows = rows.withColumn("_place", F.explode(places))
    return rows.select(domain, key, F.floor(F.col("_place") / F.col("quota")).cast("long").alias("batch"), (F.col("first") + F.col("_place") % F.col("quota")).cast("long").alias("slot"))


def few_shot(docs: DataFrame, pool: DataFrame, key: str, k: int, seed: int = 1234) -> DataFrame:
    """(key, shot, example): k examples of the pool for each document, never itself; fewer if the pool has fewer.

    The pool lies in a circle in the order of a hash. Each document starts at a place of its own and takes the next k
    examples that aren't itself: an equi-join of k + 1 places a document.
    """
    circle = numbered(pool.select(F.col(key).alias("example")).withColumn("_h", fraction(hashed(F.col("example"), seed))), ["_h", "example"], "_at").select("_at", "example")
    n = pool.count()
    start = F.floor(fraction(hashed(F.col(key), seed + 1)) * n)
    places = docs.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(k, n - 1))), lambda j: (start + j) % n)).alias("_j", "_at")) if n else docs.select(key, F.lit(0).alias("_j"), F.lit(None).cast("long").alias("_at"))
    found = places.join(circle, "_at").filter(F.col("example") != F.col(key))
    # At most k + 1 rows of a document.
    shot = F.row_number().over(W.partitionBy(key).orderBy("_j")) - 1
    return found.withColumn("shot", shot).filter(F.col("shot") < k).select(key, "shot", "example")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, power: float = 1.0, seed: int = 0) -> DataFrame:
    """(draw, key): n draws with replacement in proportion to weight ** power.

    Draws are points of [0, 1), matched with the rows' intervals of the cumulative weights; both sides are cut into
    cells, so that the match is an equi-join. The order of the rows is that of a hash of their key.
    """
    d = df.select(key, F.greatest(F.pow(F.col(weight), F.lit(power)), F.lit(0.0)).alias("_w"), hashed(F.col(key), seed).alias("_h")).filter("_w > 0")
    d = ranged_sum(d.withColumn("_b", F.substring("_h", 1, 3)), "_w", "_b", [F.col("_h"), F.col(key)], "_upto", "_all")
    d = d.select(key, ((F.col("_upto") - F.col("_w")) / F.col("_all")).alias("low"), (F.col("_upto") / F.col("_all")).alias("high"))
    cells = max(1, min(n, 1 << 16))
    d = d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * cells).cast("long"))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), fraction(hashed(F.col("id"), seed)).alias("u")).withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    return draws.join(d, "cell").filter("u >= low and u < high").select("draw", key)


def curriculum(weights: DataFrame, batch: DataFrame, domain: str, score: str, rate: float = 0.5, floor: float = 0.01) -> DataFrame:
    """(domain, weight): a sampler's weights after a batch, moved by `rate` towards each domain's share of what is left to learn (1 - mean score).

    Domains that the batch lacks keep their weight; none falls below `floor` before all are scaled to sum 1. Called in
    foreachBatch, it keeps the sampler's state in a table.
    """
    seen = batch.groupBy(domain).agg((1 - F.avg(score)).alias("_left"))
    d = weights.join(F.broadcast(seen), domain, "left")
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    target = F.col("_left") / F.sum("_left").over(whole) * F.sum(F.when(F.col("_left").isNotNull(), F.col("weight"))).over(whole)
    moved = F.greatest(F.when(F.col("_left").isNull() | target.isNull(), F.col("weight")).otherwise(F.col("weight") + rate * (target - F.col("weight"))), F.lit(floor))
    # One row per domain.
    return d.withColumn("weight", moved).withColumn("weight", F.col("weight") / F.sum("weight").over(whole)).select(domain, "weight")


def sample_limit(n: int, limit: float | None) -> int:
    """How many of n rows a limit keeps: all without one, a share rounded up below 1, else so many."""
    return n if limit is None else math.ceil(n * limit) if limit < 1 else min(n, int(limit))
