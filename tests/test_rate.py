"""Token buckets as state: bursts, queues, restarts, late rows and full buckets that are forgotten."""

import json
import random

import pytest

from corveil.streaming import increments

SCHEMA = "k string, id long, at timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def stamp(seconds):
    return f"2024-01-01T00:{int(seconds) // 60:02d}:{seconds % 60:06.3f}Z"


def by_tokens(batches, rate, burst):
    """The same by counting tokens: each row waits until the bucket holds a whole one."""
    level, at, out = {}, {}, {}
    for rows in batches:
        for k, i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1])):
            now = max(t, at.get(k, t))
            have = min(burst, level.get(k, burst) + (now - at.get(k, now)) * rate)
            wait = max(0, (1 - have) / rate)
            level[k], at[k] = have + wait * rate - 1, now + wait
            out[i] = round(now + wait, 3)
    return out


def test_token_buckets_over_restarts(rocks, tmp_path):
    rng = random.Random(3)
    batches = [[("a" if rng.random() < 0.6 else rng.choice("bc"), 100 * b + i, 20 * b + round(rng.random() * 20, 3)) for i in range(40)] for b in range(3)]
    batches[1].append((None, 999, 25.0))
    # Long after the others: buckets are full again, and a row of the first minute comes too late.
    batches += [[("a", 300, 600.0)], [("a", 301, 601.0), ("b", 302, 5.0)]]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("".join(json.dumps({"k": k, "id": i, "at": stamp(t)}) + "\n" for k, i, t in rows))
        limited = increments.rate_limited(increments.read_rows(rocks, str(source), SCHEMA), "k", "id", "at", 0.5, 3)
        limited.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["granted"] for r in rocks.read.parquet(target).collect()}
    start = 1_704_067_200
    want = by_tokens([[r for r in rows if r[1] != 302] for rows in batches], 0.5, 3)
    assert {i: round(g / 1e6 - start, 3) for i, g in got.items()} == pytest.approx(want, abs=2e-3)
    assert any(g / 1e6 - start - t > 1 for rows in batches for k, i, t in rows if (g := got.get(i)) is not None)


def test_bounds(rocks):
    with pytest.raises(ValueError, match="positive"):
        increments.rate_limited(rocks.range(1), "id", "id", "id", 0, 1)
