"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Nodes with over 1/HUBS of the edges, and HUB at least, are joined by broadcast.
HUBS, HUB = 5000, 1000
#: Edges a task of the component search holds about, and the fewest tasks it runs.
EDGES, TASKS = 250_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in have:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder and read back, so that later stages survive lost executors.

    The folder is the one named by spark.checkpoint.dir. Where that is unset, a session on one machine takes a local
    one, and any other is an error. spark.cleaner.referenceTracking.cleanCheckpoints removes spent ones.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def hash_bucket(h: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash, so that buckets follow the order of the hash itself."""
    return F.shiftright(h, 64 - bits)


def ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """Adds the row's number from 0 in its group, in the order of (bucket, *order).

    A group is never gathered: rows are numbered in their (group, bucket), and each bucket gets the count of those
    before it from the pre-aggregated counts. `group` and `bucket` must not be null.
    """
    keys, ahead = [*group, bucket], fresh(df, "ahead")
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ahead)).withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(rank, own.cast("long")).join(offsets, keys).withColumn(rank, F.col(rank) + F.col(ahead)).drop(ahead)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that edges (a, b) mention.

    Alternates the large-star and small-star steps until the edges are stars around their smallest node. Each step is
    a grouped minimum and a join back, so that no component is ever in one task; each round is checkpointed. Nodes with
    more than their share of the edges, at most 2 * HUBS of them, are broadcast instead of gathering their edges. The
    number of tasks follows that of the edges, so that small edge tables don't leave many small files each round.
    """
    def stars(e: DataFrame, n: int, large: bool) -> DataFrame:
        tasks = max(TASKS, 2 * n // EDGES)
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = e.coalesce(tasks)
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        hub = F.col("n") > max(n // HUBS, HUB)
        hubs = F.broadcast(least.filter(hub).select("a", "m"))
        e = e.join(hubs, "a").unionByName(e.join(hubs.select("a"), "a", "left_anti").join(least.filter(~hub).select("a", "m"), "a"))
        m = F.least("a", "m")
        if large:
            out = e.filter("b > a").select(F.col("b").alias("a"), m.alias("b"))
        else:
            out = e.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        return out.coalesce(tasks).distinct().coalesce(tasks)

    e = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        e = cut(stars(cut(stars(e, seen[0], True)), seen[0], False))
    out = e.groupBy("a").agg(F.min("b").alias("b"))
    return out.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
