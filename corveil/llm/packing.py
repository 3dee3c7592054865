"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so the decreasing order only depends on how many pieces have each length.
Those counts, at most one row per length however large the input, give the plan: for each length, longest first, the
segment tree finds the tightest remaining capacity that fits in logarithmic time, and the whole run of open sequences
with that capacity takes pieces of the length at once. It is the packing that a document-by-document best-fit
decreasing makes. Spark numbers the pieces of each length and looks the plan up; no task sees more than its own rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import cut, hash_bucket, ranked
from corveil.llm.wordids import WordIds

CAPACITY = 4096
#: The id that closes each document.
CLOSE = 1
#: So many texts come out at once.
SLICE = 200
PLAN = "length long, first long, past long, sequence long, each long, base long"


class CapacityTree:
    """A segment tree over the capacities 0..n: which of them some open run of sequences has left."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.open = bytearray(2 * self.size)

    def put(self, capacity: int, some: bool) -> None:
        k = capacity + self.size
        self.open[k] = some
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] | self.open[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least `least`."""
        k = least + self.size
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, past, sequence, each, base): piece r of a length, first <= r < past, goes to sequence + (r - first) // each, at base + (r - first) % each * length.

    A run of sequences with equal content splits at most once per length, and loses more than half of its remaining
    capacity when it takes pieces, so that there are at most about 12 rows for each of some 4 runs per length.
    """
    tree, runs, plan, opened = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            runs[left].append((first, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        rank, past = 0, counts[length]
        while rank < past:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = opened, -(-(past - rank) // each)
                opened += n
            else:
                first, n = runs[left].pop()
                if not runs[left]:
                    tree.put(left, False)
                each = left // length
            full = min(n, (past - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - left))
                rank += full * each
                give(left - each * length, first, full)
                first, n = first + full, n - full
            if n and rank < past:
                plan.append((length, rank, past, first, past - rank, capacity - left))
                give(left - (past - rank) * length, first, 1)
                rank, first, n = past, first + 1, n - 1
            give(left, first, n)
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces: its ids and the closing one, cut every `capacity` ids.

    A null or empty text has only the closing id. Rows with the same id are documents of their own.
    """
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(words.ids(text.as_py() or ""), np.uintc(CLOSE)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with the place of each: sequence_id, offset.

    Equal lengths are interchangeable: they are numbered in the order of a hash of doc_id and piece. An empty table
    gives an empty one.
    """
    parts = cut(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = parts.sparkSession.createDataFrame(best_fit_plan(counts, capacity), PLAN)
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    placed = ranked(parts.withColumn("h", h).withColumn("bucket", hash_bucket(F.col("h"), 10)), ["length"], "bucket", [F.col("h"), F.col("doc_id"), F.col("piece")], "r")
    # The plan has at most capacity rows times a constant, whatever the input.
    p = F.broadcast(plan.withColumnRenamed("length", "of"))
    k = F.col("r") - F.col("first")
    return placed.join(p, (F.col("length") == F.col("of")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("past"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + k % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
