"""Batch algebra on an explicit row number: Spark's rows have no order of their own.

`numbered` gives rows a number from 0 in an order. It cuts the order into ranges of about equal numbers of rows, counts
them and then numbers within the ranges, so that no task sees all rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranges(df: DataFrame, column: str, name: str = "_bucket", buckets: int = 256) -> DataFrame:
    """df with the number of the row's range of a numeric column; ranges have about equally many rows, null is -1."""
    bounds = df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    if not bounds:
        return df.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(0))
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    d = df.withColumn("_x", F.col(column).cast("double"))
    d = Bucketizer(splits=splits, inputCol="_x", outputCol="_y", handleInvalid="keep").transform(d)
    return d.withColumn(name, F.when(F.col("_x").isNull(), -1).otherwise(F.col("_y")).cast("int")).drop("_x", "_y")


def ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """df with the row's number from 0 in its group, in the order of (bucket, *order).

    A group is never gathered: rows are numbered in their (group, bucket), and each bucket gets the count of those
    before it from the pre-aggregated counts. `group` and `bucket` must not be null.
    """
    keys = [*group, bucket]
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ahead")).withColumn("_ahead", F.coalesce(F.sum("_ahead").over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(rank, own.cast("long")).join(offsets, keys).withColumn(rank, F.col(rank) + F.col("_ahead")).drop("_ahead")


def numbered(df: DataFrame, order: list[str], name: str = "_idx", buckets: int = 256) -> DataFrame:
    """df with the row's number from 0 in the order of its first column (a number), then of the others."""
    return ranked(ranges(df, order[0], buckets=buckets), [], "_bucket", [F.col(c) for c in order], name).drop("_bucket")


def highest(df: DataFrame, value: str, k: int, order: list[str], slack: float = 0.001) -> DataFrame:
    """The k rows with the largest value, equal ones by order: nothing is sorted but what lies above a bound.

    The bound is a quantile of a sketch whose error is at most `slack` of the rows, so that at least k rows, and about
    k plus 3 * slack of all, lie above it; these are numbered by ranges. No task and no limit takes all k rows.
    """
    n = df.count()
    if k < n:
        bound = df.approxQuantile(value, [max(0.0, 1 - k / n - 2 * slack)], slack)
        df = df.filter(F.col(value) >= bound[0]) if bound else df
    down = "_down"
    return numbered(df.withColumn(down, -F.col(value)), [down, *order], "_nth").filter(F.col("_nth") < k).drop(down, "_nth")


def ranged_sum(df: DataFrame, value: str, bucket: str, order: list[Column], upto: str, whole: str) -> DataFrame:
    """df with the running sum of value in the order of (bucket, *order) and the sum of all, by sums of the buckets."""
    sums = df.groupBy(bucket).agg(F.sum(value).alias("_s"))
    # One row per bucket.
    ahead = sums.select(bucket, F.coalesce(F.sum("_s").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_ahead"), F.sum("_s").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(whole))
    own = F.sum(value).over(W.partitionBy(bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn(upto, own).join(ahead, bucket).withColumn(upto, F.col(upto) + F.col("_ahead")).drop("_ahead")


def reorder(df: DataFrame, permutation: DataFrame, idx: str = "_idx") -> DataFrame:
    """The rows renumbered by permutation (_idx, _new): an inner join, so rows that it lacks go."""
    return df.join(permutation, idx).drop(idx).withColumnRenamed("_new", idx)


def sliced(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int | None = None, idx: str = "_idx") -> DataFrame:
    """The rows that the slice start:stop:step of n rows names, under the rules of a list's slice."""
    at = range(*slice(start, stop, step).indices(n))
    low, high = (min(at), max(at)) if len(at) else (0, -1)
    return df.filter(F.col(idx).between(low, high) & ((F.col(idx) - low) % abs(at.step) == 0))


def minibatches(df: DataFrame, n: int, size: int, epochs: int, seed: int | None = None, idx: str = "_idx", order: list[str] | None = None) -> DataFrame:
    """_epoch, _batch and _at of each row in each epoch; n rows must divide into batches of `size`. With a seed each epoch has an order of its own."""
    if n % size:
        raise ValueError(f"{n} rows don't divide into batches of {size}")
    d = df.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        d = d.withColumn("_place", F.col(idx))
    else:
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_epoch").cast("string"), F.lit(":"), F.col(idx).cast("string")).cast("binary"))
        d = ranked(d.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3)), ["_epoch"], "_b", [F.col("_h")], "_place").drop("_h", "_b")
    return d.withColumns({"_batch": F.floor(F.col("_place") / size), "_at": F.col("_place") % size}).drop("_place")


def unfold_columns(df: DataFrame, n: int, arrays: list[str], idx: str = "_idx") -> DataFrame:
    """Each row as n rows with an n-th of its arrays each, the other columns repeated; an array that doesn't divide is an error."""
    def part(c: str) -> Column:
        size = F.size(c)
        whole = F.when(size % n == 0, F.floor(size / n).cast("int")).otherwise(F.raise_error(F.lit(f"column {c} doesn't divide into {n} parts")).cast("int"))
        return F.slice(c, F.col("_part") * whole + 1, whole)

    d = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.select(*[part(c).alias(c) if c in arrays else F.col(c) for c in df.columns if c != idx], (F.col(idx) * n + F.col("_part")).alias(idx))


def grouped_chunks(df: DataFrame, group: str, size: int, order: list[str], bucket: str) -> DataFrame:
    """_chunk and _at of each row among those of its group: chunks of `size` that never mix groups, with the rows' own columns to restore their order by."""
    d = ranked(df, [group], bucket, [F.col(c) for c in order], "_k")
    return d.withColumns({"_chunk": F.floor(F.col("_k") / size), "_at": F.col("_k") % size}).drop("_k")


def repeat(df: DataFrame, n: int, idx: str = "_idx", interleave: bool = True, total: int | None = None) -> DataFrame:
    """Each row n times with _rep and its new number: a, a, b, b if interleaved, else a, b, a, b."""
    out = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    size = F.lit(total if total is not None or interleave else df.count())
    return out.withColumn("_new", F.col(idx) * n + F.col("_rep") if interleave else F.col("_rep") * size + F.col(idx))


def sample_repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as its own count says; none for 0."""
    return df.withColumn("_rep", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0))), lambda i: i < times)))


def pad(df: DataFrame, divisor: int, idx: str = "_idx") -> DataFrame:
    """Rows up to a multiple of the divisor by cycling from the first; _pad marks those added."""
    n = df.count()
    missing = -n % divisor
    out = df.withColumn("_pad", F.lit(False))
    for at in range(0, missing if n else 0, max(n, 1)):
        more = df.filter(F.col(idx) < min(n, missing - at)).withColumn(idx, F.col(idx) + n + at).withColumn("_pad", F.lit(True))
        out = out.unionByName(more)
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_pad")).drop("_pad")


def chunk(df: DataFrame, chunks: int, idx: str = "_idx") -> DataFrame:
    """_chunk of each row in equal parts; the rows must divide evenly."""
    n = df.count()
    if n % chunks:
        raise ValueError(f"{n} rows don't divide into {chunks} chunks")
    return df.withColumn("_chunk", F.floor(F.col(idx) / max(n // chunks, 1)))


def split(df: DataFrame, size: int, idx: str = "_idx") -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(idx) / size))


def stride(df: DataFrame, rank: int, world: int, limit: int | None = None, idx: str = "_idx") -> DataFrame:
    """Rows rank, rank + world, ... below the limit, which is an absolute stop."""
    return df.filter((F.col(idx) % world == rank) & (F.lit(True) if limit is None else F.col(idx) < limit))


def fold(df: DataFrame, size: int, columns: list[str], idx: str = "_idx") -> DataFrame:
    """Groups of `size` following rows as arrays, in order."""
    rows = F.array_sort(F.collect_list(F.struct(idx, *columns)))
    folded = df.groupBy(F.floor(F.col(idx) / size).alias("_group")).agg(rows.alias("_rows"))

    def field(name: str) -> Column:
        return F.transform("_rows", lambda r: r[name]).alias(name)

    return folded.select("_group", *map(field, columns))


def unfold(df: DataFrame, size: int, columns: list[str], idx: str = "_idx") -> DataFrame:
    """The inverse of fold."""
    rows = df.select("_group", F.posexplode(F.arrays_zip(*columns)).alias("_at", "_row"))
    return rows.select((F.col("_group") * size + F.col("_at")).alias(idx), *[F.col("_row")[c].alias(c) for c in columns])


def union_columns(a: DataFrame, b: DataFrame, idx: str = "_idx") -> DataFrame:
    """Columns of both, row by row; columns that both have must be equal, null to null."""
    shared = [c for c in b.columns if c in a.columns and c != idx]
    joined = a.join(b.select(idx, *[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != idx]), idx)
    for c in shared:
        differs = ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        joined = joined.withColumn(c, F.when(differs, F.raise_error(F.lit(f"column {c} differs")).cast(dict(a.dtypes)[c])).otherwise(F.col(c))).drop(f"_b_{c}")
    return joined


def rolling_windows(tokens: Column, length: int, step: int) -> Column:
    """Windows of at most `length` tokens, one every `step`; the last ends with the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(tokens) - length) / step).cast("int")))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda k: F.slice(tokens, k * step + 1, length))).otherwise(F.array().cast("array<array<string>>"))


def pad_or_cut(tokens: Column, length: int, fill: int, left: bool = True, cut: str = "left") -> Column:
    """Arrays of one length: filled on a side, cut on the left, right or in the middle, or an error if too long."""
    missing = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(tokens)))
    half = length // 2
    shorter = {
        "left": F.slice(tokens, F.greatest(F.size(tokens) - length + 1, F.lit(1)), length),
        "right": F.slice(tokens, 1, length),
        "middle": F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.greatest(F.size(tokens) - (length - half) + 1, F.lit(1)), length - half)),
    }
    filled = F.concat(missing, tokens) if left else F.concat(tokens, missing)
    if cut == "error":
        return F.when(F.size(tokens) > length, F.raise_error(F.lit("sequence is too long")).cast("array<int>")).otherwise(filled)
    return F.when(F.size(tokens) > length, shorter[cut]).otherwise(filled)


def eos_mask(tokens: Column, ends: list[int]) -> Column:
    """1 up to and including the first end token, 0 behind it."""
    at = F.array_min(F.transform(F.array(*map(F.lit, ends)), lambda e: F.nullif(F.array_position(tokens, e), F.lit(0))))
    return F.transform(tokens, lambda _, i: F.when(i < F.coalesce(at, F.size(tokens).cast("long")), 1).otherwise(0))


def sft_loss_mask(prompt: Column, response: Column, length: Column) -> Column:
    """1 where a token is trained on: from the prompt's last token to the one before the response's last, in a sequence of `length` tokens."""
    first = F.least(prompt, length) - 1
    last = F.least(prompt + response, length) - 1
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(((prompt > 1) & (i < first)) | (i == last), 0).otherwise(1))


def pair_stack(prompt: Column, chosen: Column, rejected: Column, length: int) -> Column:
    """A struct of input_ids and attention_mask, each a pair of arrays of one length: the prompt with the chosen and with the rejected response."""
    both = [F.concat(prompt, x) for x in (chosen, rejected)]
    ids = [pad_or_cut(x, length, 0, left=False, cut="right") for x in both]
    masks = [pad_or_cut(F.transform(x, lambda _: F.lit(1)), length, 0, left=False, cut="right") for x in both]
    return F.struct(F.array(*ids).alias("input_ids"), F.array(*masks).alias("attention_mask"))


def token_diff(a: Column, b: Column, mask: Column) -> Column:
    """How many masked positions of two token arrays differ; 0 where either is empty."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m"))
    count = F.size(F.filter(pairs, lambda p: (p["m"] == 1) & ~p["a"].eqNullSafe(p["b"])))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(count)


def masked_values(df: DataFrame, values: str, mask: str) -> DataFrame:
    """A row for each value whose mask is 1, in place of the arrays."""
    d = df.withColumn("_p", F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")))).filter("_p.m = 1")
    return d.withColumn(values, F.col("_p.v")).drop("_p", mask)
