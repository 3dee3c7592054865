"""Sinks: one folder of JSON lines per split, rollout shards, samples, results, media files and Markdown tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corveil.sources.lines import NO_VALUE, write_lines


def split_jsonl(df: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> dict[str, int]:
    """JSON lines by split; an existing target is an error unless overwritten. The rows of each split, counted as they are written."""
    found = write_lines(df, path, split, "overwrite" if overwrite else "errorifexists")
    names = {folder: unquote(folder.partition("=")[2]) for folder in found}
    return {None if names[folder] == NO_VALUE else names[folder]: n for folder, n in found.items()}


def shard_of(index: Column, size: int) -> Column:
    """The shard of a sample's number; all candidates of a sample share it."""
    return F.floor(index / size).cast("long")


def rollout_shards(df: DataFrame, path: str, index: str, size: int) -> None:
    """Appends samples in a folder a shard, each shard's rows from one task."""
    write_lines(df.withColumn("shard", shard_of(F.col(index), size)).repartition("shard"), path, "shard", "append")


def generations(df: DataFrame, path: str, step: int) -> None:
    df.withColumn("step", F.lit(step)).write.partitionBy("step").mode("append").json(path)


def samples(df: DataFrame, path: str, keep: list[str]) -> None:
    """Samples without their documents and arguments, and without responses that equal the filtered ones."""
    same = F.col("resps") == F.col("filtered_resps") if {"resps", "filtered_resps"} <= set(df.columns) else F.lit(False)
    out = df.withColumn("resps", F.when(~same, F.col("resps"))) if "resps" in df.columns else df
    out.select(*keep, *[c for c in out.columns if c not in keep and c not in ("doc", "arguments")]).write.partitionBy("task").mode("overwrite").json(path)


def results_json(df: DataFrame) -> str:
    """The aggregated results, a row per task, metric and filter, as sorted JSON."""
    out: dict = {}
    for r in df.collect():
        name = f"{r['metric']},{r['filter']}"
        out.setdefault(r["task"], {})[name] = r["value"]
        out[r["task"]][f"{r['metric']}_stderr,{r['filter']}"] = "N/A" if r["stderr"] is None else r["stderr"]
    return json.dumps(out, sort_keys=True)


def markdown_table(df: DataFrame) -> str:
    """The aggregated results as Markdown, values in four decimals."""
    lines = ["|Task|Filter|Metric|Value|Stderr|", "|--|--|--|--:|--:|"]
    for r in df.orderBy("task", "metric", "filter").collect():
        lines.append(f"|{r['task']}|{r['filter']}|{r['metric']}|{r['value']:.4f}|{'N/A' if r['stderr'] is None else format(r['stderr'], '.4f')}|")
    return "\n".join(lines)


def image_path(split: Column, config: Column, index: Column, row_id: Column, suffix: Column) -> Column:
    return F.format_string("images/%s/%s/%08d_%s%s", split, config, index, row_id, suffix)


def write_media(df: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """Writes each row's bytes under root, which all machines must share; the paths written."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, b in zip(rows[path], rows[content], strict=True):
                target = Path(root, p)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(b)
            yield rows[[path]]

    return df.filter(F.col(content).isNotNull()).select(path, content).mapInPandas(write, f"{path} string")


def run_args(args: dict, path: str) -> None:
    """A run's arguments as JSON with sorted keys, in a small file of the driver's."""
    Path(path).write_text(json.dumps(args, sort_keys=True, indent=2, default=str), encoding="utf-8")


def generated(df: DataFrame, responses: DataFrame, key: str, path: str) -> None:
    """The input with its responses as a list column, as Parquet; rows without responses keep an empty list."""
    none = F.array().cast("array<string>")
    df.join(responses.select(key, "responses"), key, "left").withColumn("responses", F.coalesce("responses", none)).write.mode("overwrite").parquet(path)


def submission(df: DataFrame, path: str, key: str, answer: str) -> None:
    """(questionId, answer) as JSON lines."""
    df.select(F.col(key).alias("questionId"), F.col(answer).alias("answer")).write.mode("overwrite").json(path)


def append_cache(df: DataFrame, path: str, task: str) -> None:
    """Appends (task, doc_id, response) to a cache that is partitioned by task; those that it has stay as they are."""
    new = df.select(F.lit(task).alias("task"), "doc_id", "response")
    spark = df.sparkSession
    try:
        have = spark.read.schema("doc_id long, response string, task string").parquet(path).filter(F.col("task") == task)
        new = new.join(have.select("doc_id"), "doc_id", "left_anti").select("task", "doc_id", "response")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    new.write.partitionBy("task").mode("append").parquet(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if it isn't there, so that a rerun skips the work."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


#: The columns that a flat table of samples has, by request type.
FRAMES = {"generate_until": ("input", "prediction"), "loglikelihood": ("input", "prediction"), "multiple_choice": ("input", "choices", "prediction")}


def sample_frame(df: DataFrame, request_type: str) -> DataFrame:
    """(doc_id, request_type, input, prediction, target) of logged samples, with the list of choices where the type has one."""
    columns = FRAMES[request_type]
    own = {"input": F.get("arguments", 0).alias("input"), "choices": F.slice("arguments", 2, F.size("arguments")).alias("choices"), "prediction": F.get("filtered_resps", 0).alias("prediction")}
    return df.select("doc_id", F.lit(request_type).alias("request_type"), *[own[c] for c in columns], "target")
