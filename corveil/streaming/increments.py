"""Incremental jobs as Structured Streaming: resumable filtering, appends, running coefficients and step metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_rows(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines as they arrive in a folder; at most so many files a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)


def once_each(rows: DataFrame, key: str = "id", time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once, over restarts too: with an event time only keys within `late` of it are remembered."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def append_to(rows: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, on_step: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Starts a query that transforms what is there, appends it to a table and ends; a restart goes on behind it.

    A micro-batch that is repeated after a failure overwrites its own part of the table. Rows of each step are
    observed and given to on_step.
    """
    def write(batch: DataFrame, step: int) -> None:
        seen = Observation()
        out = transform(batch).withColumn("step", F.lit(step)).observe(seen, F.count(F.lit(1)).alias("rows"))
        out.write.mode("overwrite").parquet(f"{path}/step={step}")
        if on_step:
            on_step(step, seen.get)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, rows) over tumbling windows, closed once the watermark passes them."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.col("window.start").alias("start"), "rows")


def running_kl(rows: DataFrame, run: str, step: str, kl: str, start: float, target: float, horizon: float) -> DataFrame:
    """(run, step, coefficient): the adaptive KL coefficient of each run, kept as state between micro-batches."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beta = state.get[0] if state.exists else start
        for found in [pd.concat(list(batches)).sort_values(step)]:
            out = []
            for at, value, n in found[[step, kl, "n"]].itertuples(index=False):
                beta *= 1 + min(max(value / target - 1, -0.2), 0.2) * n / horizon
                out.append((key[0], at, beta))
            yield pd.DataFrame(out, columns=["run", "step", "coefficient"])
        state.update((beta,))

    return rows.groupBy(run).applyInPandasWithState(update, "run string, step long, coefficient double", "beta double", "append", GroupStateTimeout.NoTimeout)


def cursor(draws: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a sampler's state (domain, cursor, epoch) in a table: each micro-batch of draws (domain, rows, size) moves the cursors on, and a restart finds them there.

    The order of a domain is a hash of seed and epoch, so that cursor and epoch are all there is to restore. A repeated
    micro-batch writes the same state again, since it starts from that of the step before.
    """
    def move(batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        moved = batch.groupBy("domain").agg(F.sum("rows").alias("rows"), F.max("size").alias("size"))
        if step:
            moved = moved.join(spark.read.parquet(f"{path}/step={step - 1}"), "domain", "full")
        else:
            moved = moved.withColumns({"cursor": F.lit(0).cast("long"), "epoch": F.lit(0).cast("long")})
        at = F.coalesce("cursor", F.lit(0)) + F.coalesce("rows", F.lit(0))
        size = F.coalesce("size", F.lit(None).cast("long"))
        moved.select("domain", F.when(size.isNull(), F.col("cursor")).otherwise(at % size).alias("cursor"), (F.coalesce("epoch", F.lit(0)) + F.when(size.isNull(), 0).otherwise(F.floor(at / size))).cast("long").alias("epoch")).write.mode("overwrite").parquet(f"{path}/step={step}")

    return draws.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(move).start()


class TokenBucket(StatefulProcessor):
    """A bucket a key as one number: the microsecond at which it is full again, were nothing else taken."""

    def __init__(self, interval: int, burst: int) -> None:
        self.interval, self.burst = interval, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.full = handle.getValueState("full", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        found = pd.concat([r[["id", "asked"]] for r in rows]).sort_values(["asked", "id"])
        asked, known = found["asked"].to_numpy(np.int64), self.full.exists()
        before = self.full.get()[0] if known else asked[0]
        # Each token moves the moment on by an interval, from the later of itself and the row's own time.
        steps = np.arange(len(asked), dtype=np.int64) * self.interval
        after = np.maximum(np.maximum.accumulate(asked - steps), before) + steps + self.interval
        free = np.concatenate([[before], after[:-1]]) - (self.burst - 1) * self.interval
        self.full.update((int(after[-1]),))
        if not known:
            self.handle.registerTimer(int(after[-1]) // 1000 + 1)
        yield pd.DataFrame({"key": [str(key[0])] * len(found), "id": found["id"].to_numpy(), "asked": asked, "granted": np.maximum(asked, free)})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        # A full bucket is the same as none; one that was used since waits for its new moment.
        at = self.full.get()[0] // 1000 + 1
        if at > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(at)
        else:
            self.full.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "asked": pd.Series(dtype="int64"), "granted": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def rate_limited(rows: DataFrame, key: str, row_id: str, time: str, per_second: float, burst: int, late: str = "1 minute") -> DataFrame:
    """(key, id, asked, granted) in microseconds: when each row of a key gets a token of a bucket that holds `burst` and gains `per_second`.

    Rows of a micro-batch take tokens in the order of time and id; those of a later one queue behind what was granted
    before. Rows without key or time get none. Rows that come later than `late` behind the newest are dropped, and a
    bucket is forgotten once the watermark says that it is full. The session's state store has to be RocksDB's.
    """
    if per_second <= 0 or burst < 1:
        raise ValueError("a bucket needs a positive rate and room for a token")
    asked = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    asked = asked.select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("id"), F.col(time).alias("time"), F.unix_micros(F.col(time)).alias("asked"))
    bucket = TokenBucket(max(1, round(1_000_000 / per_second)), burst)
    return asked.groupBy("key").transformWithStateInPandas(bucket, "key string, id long, asked long, granted long", "Append", "EventTime")
