"""The writer of JSON lines: failed tasks, repeated attempts, reruns and streams."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corveil.sources import lines, sinks


def files(path):
    return {str(p.relative_to(path)): p.read_text() for p in sorted(Path(path).rglob("*")) if p.is_file()}


def test_rerun_writes_the_same_files(spark, tmp_path):
    d = spark.range(100, numPartitions=3).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("s/"), (F.col("id") % 7).cast("string"))).alias("split"), F.lit("é").alias("x"))
    target = str(tmp_path / "out")
    counts = sinks.split_jsonl(d, target)
    assert counts == {None: 15, "s/1": 15, "s/2": 14, "s/3": 14, "s/4": 14, "s/5": 14, "s/6": 14}
    first = files(target)
    assert not any("staging" in name for name in first) and len(first) == 22
    assert sinks.split_jsonl(d, target, overwrite=True) == counts and files(target) == first
    back = spark.read.json(target)
    assert {(r["id"], r["split"], r["x"]) for r in back.collect()} == {(r["id"], r["split"], r["x"]) for r in d.collect()}


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    target = tmp_path / "out"
    d = spark.range(50, numPartitions=2).select("id", F.lit("a").alias("split"), F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        lines.write_lines(d, str(target), "split")
    assert not target.exists() or all(name.startswith("_staging-") for name in files(target))
    assert lines.write_lines(d.filter("id < 49"), str(target), "split") == {"split=a": 49}
    # A failed overwrite keeps what was there.
    kept = files(target)
    assert sorted(name.partition("/")[0] for name in kept) == ["_counts.json", "split=a", "split=a"]
    with pytest.raises(Exception, match="broken"):
        lines.write_lines(d, str(target), "split", "overwrite")
    assert {name: x for name, x in files(target).items() if not name.startswith("_staging-")} == kept


def test_only_attempts_that_count_are_published(spark, tmp_path):
    target = lines.Target({"path": str(tmp_path / "out"), "by": "k"})
    for attempt in ("lost", "done"):
        folder = tmp_path / "out" / target.staging / attempt / "k=1"
        folder.mkdir(parents=True)
        (folder / "part-00000-0.json").write_text(attempt)
    target.publish([lines.Staged("done", [("k=1", "part-00000-0.json", 1)]), None], False)
    assert files(tmp_path / "out") == {"_counts.json": '{"k=1": 1}', "k=1/part-00000-0.json": "done"}


def test_shards_append_and_empty_tables(spark, tmp_path):
    target = str(tmp_path / "shards")
    d = spark.range(10).select("id", (F.col("id") * 2).alias("i"))
    sinks.rollout_shards(d, target, "id", 4)
    assert {(r["id"], r["shard"]) for r in spark.read.json(target).collect()} == {(k, k // 4) for k in range(10)}
    assert sinks.split_jsonl(spark.createDataFrame([], "split string, x string"), str(tmp_path / "empty")) == {}


def test_stream(spark, tmp_path):
    spark.dataSource.register(lines.Lines)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text(json.dumps({"id": k, "split": "a"}) + "\n")
        rows = spark.readStream.schema("id long, split string").json(str(source))
        query = rows.writeStream.format("lines_by").options(path=str(target), by="split", checkpointLocation=str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(target)).collect()) == [0, 1]
    assert all("step-" in name for name in files(target) if name != "_counts.json")
