"""Load balancing: Karmarkar-Karp and greedy partitions of lengths, and token-budget micro-batches.

A batch of rows is balanced in one task; batches of a corpus are balanced side by side.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[int]:
    """Part of each length by the largest differencing method over k parts; `equal`: parts of one size, if k divides."""
    if equal and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows don't divide into {k} equal parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    heap = []
    for at, rows in enumerate(groups):
        parts = sorted(([(lengths[i], [i]) for i in rows] + [(0, [])] * (k - len(rows))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], at, parts))
    at = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # The fullest part of one joins the emptiest of the other.
        parts = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], at, parts))
        at += 1
    out = [0] * len(lengths)
    for k_, (_, rows) in enumerate(heap[0][2] if heap else []):
        for i in rows:
            out[i] = k_
    return out


def least_loaded(lengths: list[int], k: int) -> list[int]:
    """Each length, in input order, to the part with the smallest sum so far, the first of several."""
    heap, out = [(0, p) for p in range(k)], []
    for n in lengths:
        load, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (load + n, p))
    return out


def balanced(df: DataFrame, batch: str, length: str, order: str, k: int, method: str = "karmarkar_karp", equal: bool = False) -> DataFrame:
    """(batch, order, length, part) of each row, batch by batch."""
    kinds = dict(df.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        n = rows[length].tolist()
        return rows.assign(part=differencing(n, k, equal) if method == "karmarkar_karp" else least_loaded(n, k))

    return df.select(batch, order, length).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {order} {kinds[order]}, {length} {kinds[length]}, part int")


def micro_batches(df: DataFrame, batch: str, length: str, order: str, budget: int) -> DataFrame:
    """(batch, order, length, micro): ceil(total / budget) micro-batches, at most one a row, by falling sum of squared lengths."""
    kinds = dict(df.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        n = rows[length].tolist()
        parts = pd.Series(differencing(n, min(len(n), max(1, -(-sum(n) // budget)))), index=rows.index)
        work = (rows[length].astype(float) ** 2).groupby(parts).sum()
        rank = {p: r for r, p in enumerate(sorted(work.index, key=lambda p: (-work[p], p)))}
        return rows.assign(micro=parts.map(rank).astype(int))

    return df.select(batch, order, length).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {order} {kinds[order]}, {length} {kinds[length]}, micro int")


def rank_order(df: DataFrame, batch: str, length: str, order: str, k: int) -> DataFrame:
    """balanced rows with place: their place in the batch once each of k workers takes the rows of its part in a row."""
    by = W.partitionBy(batch).orderBy("part", order)
    # A batch has a bounded number of rows.
    return balanced(df, batch, length, order, k).withColumn("place", F.row_number().over(by) - 1)


def load_stats(df: DataFrame, batch: str, part: str, length: str) -> DataFrame:
    """(batch, least, most, difference) of the parts' sums."""
    sums = df.groupBy(batch, part).agg(F.sum(length).alias("load"))
    return sums.groupBy(batch).agg(F.min("load").alias("least"), F.max("load").alias("most"), (F.max("load") - F.min("load")).alias("difference"))
