"""Nearest vectors of a stated query set, by pivots that rule out far lists without losing any of the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pivots are fitted on at most so many vectors, those with the smallest hash; any pivots give the same answers.
SAMPLE, PIVOTS, ROUNDS = 10_000, 64, 5
#: A list is cut into parts of about so many vectors; each part is compared in one task with the queries that reach it.
PART = 4096
#: What a cosine may lose to rounding; distances on the unit sphere are compared with the slack that this gives.
SLACK = 1e-6
UNIT = "id long, width int, raw binary, pivot int, angle double"


def unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(id, unit vector) of the rows whose vector is not null, zero or not finite."""
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if v and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                yield i, x / np.linalg.norm(x)


def pivots_of(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By width, unit vectors spread over a bounded sample: its first vector, then always the one farthest from all before, moved to the middle of what is nearest to them."""
    rows = vectors.filter("vector is not null").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    by_width: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for _, x in unit_rows(batch):
            by_width.setdefault(len(x), []).append(x)
    out = {}
    for width, found in by_width.items():
        x = np.stack(found)
        chosen, nearest = [0], x @ x[0]
        while len(chosen) < min(count, len(x)) and nearest.min() < 1 - SLACK:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[chosen[-1]])
        p = x[chosen]
        for _ in range(ROUNDS):
            own = (x @ p.T).argmax(1)
            sums = np.zeros_like(p)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            p = np.where(size > SLACK, sums / np.maximum(size, SLACK), p)
        out[width] = p
    return out


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def listed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, width, raw, pivot, angle): each usable vector in the list of its nearest pivot; a width that the sample lacks has one list around its first axis."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(unit_rows(batch))
            for width in {len(x) for _, x in rows}:
                own = [(i, x) for i, x in rows if len(x) == width]
                x = np.stack([v for _, v in own])
                away = angles(x, shared.value.get(width, np.eye(1, width)))
                at = away.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array(np.full(len(own), width, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(at.astype(np.int32)), pa.array(away[np.arange(len(own)), at])], ["id", "width", "raw", "pivot", "angle"])

    return vectors.select("id", "vector").mapInArrow(assign, UNIT)


def best_of(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, id, cosine) of the k nearest of v to each q, never itself, equal cosines in nine digits by id."""
    s = np.round(q @ v.T, 9)
    s[asked[:, None] == ids[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    cosine = np.take_along_axis(s, order, 1)
    keep = np.isfinite(cosine).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])[keep]), pa.array(ids[order].ravel()[keep]), pa.array(cosine.ravel()[keep])], ["query_id", "id", "cosine"])


def met(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, cosine): the k best of each part of a list for each query that comes to it.

    queries (id, width, raw, pivot, part) and vectors alike are dealt by list and part and meet in a task there.
    """
    def compare(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            table = pa.Table.from_batches(list(batches))
            width = table.column("width")[0].as_py()
            return table.column("id").to_numpy(), np.frombuffer(b"".join(table.column("raw").to_pylist())).reshape(-1, width)

        q, v = list(left), list(right)
        if sum(b.num_rows for b in q) and sum(b.num_rows for b in v):
            (asked, q), (ids, v) = read(iter(q)), read(iter(v))
            for at in range(0, len(asked), 256):
                yield best_of(asked[at : at + 256], q[at : at + 256], ids, v, k)

    on = ["width", "pivot", "part"]
    sides = [d.select("id", "raw", *on).groupBy(*on) for d in (queries, vectors)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: pa.Table.from_batches(list(compare(iter(a.to_batches()), iter(b.to_batches()))), schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])), "query_id long, id long, cosine double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE, part: int = PART) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest of vectors (id, vector) to each of queries (id, vector), never itself; equal cosines (to nine digits) by id.

    Every vector lies in the list of its nearest pivot. A query first sees its own list; its k-th best angle there is a
    bound. Another list, whose vectors are between its least and largest angle from their pivot, is visited only if the
    triangle inequality leaves room for a nearer one, so that nothing is lost. Vectors that are null, zero or not finite
    are no one's neighbours; a query that is such has no rows. Only counts and angles by list are broadcast, at most
    `pivots` rows a width.
    """
    fitted = pivots_of(vectors, pivots, sample)
    rows = listed(vectors, fitted)
    lists = rows.groupBy("width", "pivot").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    rows = rows.join(F.broadcast(lists.select("width", "pivot", "parts")), ["width", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = listed(queries, fitted)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = asked.join(F.broadcast(lists), ["width", "pivot"]).withColumn("part", every)
    own = ranked(met(first, rows, k), k)
    # The angle within which the k nearest are already known; without k of them every list is open.
    reach = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.acos(F.greatest(F.least(F.min("cosine"), F.lit(1.0)), F.lit(-1.0)))).alias("reach"))
    others = asked.join(reach, F.col("id") == F.col("query_id"), "left").drop("query_id", "angle").withColumnRenamed("pivot", "home")
    away = to_pivots(others, fitted).join(F.broadcast(lists), ["width", "pivot"]).filter("pivot <> home")
    near = F.coalesce(F.greatest(F.col("least") - F.col("angle"), F.col("angle") - F.col("most")) <= F.col("reach") + SLACK, F.lit(True))
    rest = met(away.filter(near).withColumn("part", every), rows, k)
    return ranked(own.select("query_id", "id", "cosine").unionByName(rest), k)


def to_pivots(asked: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """asked (id, width, raw, home, reach) once for each pivot, with the angle to it; a stated query set against a bounded number of pivots."""
    shared = asked.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = shared.value.get(r["width"], np.eye(1, r["width"]))
                away = angles(np.frombuffer(r["raw"])[None, :], p)[0]
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]] * n, pa.int64()), pa.array([r["width"]] * n, pa.int32()), pa.array([r["raw"]] * n, pa.binary()), pa.array([r["home"]] * n, pa.int32()), pa.array([r["reach"]] * n, pa.float64()), pa.array(range(n), pa.int32()), pa.array(away)], ["id", "width", "raw", "home", "reach", "pivot", "angle"])

    return asked.select("id", "width", "raw", "home", "reach").mapInArrow(measure, "id long, width int, raw binary, home int, reach double, pivot int, angle double")
