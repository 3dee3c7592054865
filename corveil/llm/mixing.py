"""Mixing sources to target weights along a time-varying curriculum.

Targets fill like communicating vessels: each source gets its weight's share of the words, but stops at its own bound,
and the excess is shared by weight among the others. Over training time t in [0, 1] a source's weight follows the
schedule 1 + slope * (2 t - 1); its integral is the part of its target that it has given by t. A document's place in
its source's word count, divided by the target, is inverted through that integral to the position at which training
meets the document, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.llm.common import WORD, cut, fresh

#: Weights and slopes of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
SHARE = 1.5
REPEATS = 2


def pick(values: Sequence[float], number: Column) -> Column:
    """values[number % len(values)], counted from 0."""
    out = F.lit(values[-1])
    for k, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.pmod(number, F.lit(len(values))) == k, F.lit(v)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with number (of the source in code point order, null last), weight and target.

    A source is capped once the level at which the others would fill exceeds its bound divided by its weight; sorted by
    that quotient, the level for each number of capped sources is a closed form. One row per source goes through here.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("number", F.row_number().over(order) - 1)
    s = s.withColumn("weight", pick(weights, F.col("number")).cast("long")).withColumn("bound", F.col("source_size") * repeats)
    by = W.orderBy(F.col("bound") / F.col("weight"), "number")
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("bound"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("weight"), "number", "level"))).over(whole)
    return s.withColumn("final", final["level"]).select("source", "source_size", "number", "weight", F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("bound")), F.col("bound").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def invert_demand(part: Column, slope: Column) -> Column:
    """The time by which a source has given this part of its target: the inverse of t + slope * (t * t - t)."""
    b = 1 - slope
    return F.when(slope == 0, part).otherwise((F.sqrt(b * b + 4 * slope * part) - b) / (2 * slope))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, number, position, last_position) of each document, by position.

    A source's documents come in the order of the MD5 of their id, or of their text where that is null. Words are taken from the first until the target
    is met, in as many rounds as it takes; the document at the border gives only its first words. So a source gives
    its target, rounded down, and no document more than `repeats` times its size. `position` is null where nothing is
    taken; `last_position` is that of the last round. Null text: size 0. Null source: a source of its own, the last.
    Rows with the same id are documents of their own. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    d = cut(d.select("doc_id", size.alias("size"), "source", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")).alias("h")))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    bucket = F.substring("h", 1, 3).alias("bucket")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # A row per source and bucket; the words before each bucket of a source, so that no source is in one task.
    buckets = d.groupBy("source", bucket).agg(F.sum("size").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    buckets = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "ahead", "source_size", "number", "target")
    own = W.partitionBy("source", "bucket").orderBy("h", F.col("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("bucket", bucket).withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.alias("d").join(buckets.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))).select("doc_id", "size", "source_size", "number", "target", (F.col("own") + F.col("ahead")).alias("before"))
    whole = F.floor("target").cast("long")

    def given(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") * k - F.col("before"))).cast("long")

    def at(k: int) -> Column:
        part = F.least(F.lit(1.0), (F.col("before") + F.col("source_size") * k) / F.col("target"))
        return F.when(given(k) > 0, F.round(invert_demand(part, pick(slopes, F.col("number"))), 9))

    d = d.select("doc_id", "size", "source_size", "target", sum((given(k) for k in range(1, repeats)), given(0)).alias("taken"), "number", at(0).alias("position"), F.greatest(*(at(k) for k in range(repeats))).alias("last_position"))
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:  # noqa: ANN003
    """The rows of docs, all columns, once for each round in which the mix takes words of them, sorted by position.

    A document at the border of its source's target stays whole. Documents without words are taken in no round. Rows
    with equal id and size are interchangeable: each pairs with one of theirs in the plan.
    """
    columns = docs.columns
    none, key, size, n, at = (fresh(docs, x) for x in ("none", "key", "size", "n", "at"))
    by = W.partitionBy(none, key, size)

    def keyed(df: DataFrame, id_: Column, words: Column, order: Column) -> DataFrame:
        return df.withColumns({none: id_.isNull(), key: F.coalesce(id_, F.lit(-1)).cast("long"), size: words}).withColumn(n, F.row_number().over(by.orderBy(order)))

    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).filter("taken > 0")
    plan = keyed(plan.select("doc_id", F.col("size").alias("words"), "position", "last_position"), F.col("doc_id"), F.col("words"), F.col("position"))
    later = F.when(F.col("last_position") > F.col("position"), F.col("last_position"))
    plan = plan.select(none, key, size, n, F.array_compact(F.array("position", later)).alias(at))
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = keyed(docs, F.col(id_col).cast("long"), words, F.xxhash64(text_col))
    rows = rows.join(plan, [none, key, size, n]).withColumn(at, F.explode(at))
    return rows.orderBy(at, key).select(*columns)
