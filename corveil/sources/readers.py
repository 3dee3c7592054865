"""Sources: strict and lenient JSON lines, several files of several formats, logs and caches."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no object of the schema is an error. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that don't parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def processed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct ids of all rollouts_*.jsonl in a folder; bad lines are skipped."""
    return jsonl_lenient(spark, f"{folder}/rollouts_*.jsonl", "id string").filter("id is not null").distinct()


def multi_file(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All files as one table, each read by its suffix; columns that a file lacks are null."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault("json" if p.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")) else "parquet", []).append(p)
    out = None
    for kind, own in kinds.items():
        reader = spark.read.schema(schema) if schema and kind == "json" else spark.read
        df = reader.json(own) if kind == "json" else reader.option("mergeSchema", "true").parquet(*own)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def dataset_split(spark: SparkSession, path: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """A table partitioned by config and split; partitions that aren't asked for aren't read."""
    df = spark.read.parquet(path)
    for column, value in (("config", config), ("split", split)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def latest_by(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """The latest row of each key; of equally late ones the one with the highest ties."""
    by = W.partitionBy(*keys).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return df.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def replay(docs: DataFrame, log: DataFrame, keys: list[str], response: str = "response", default: str | None = None) -> DataFrame:
    """Each document with its logged response, the default where there is none."""
    return docs.join(log.select(*keys, response), keys, "left").withColumn(response, F.coalesce(F.col(response), F.lit(default)))


def resolved(path: str, snapshots: list[str]) -> str:
    """The path if it has a scheme or exists, else the first snapshot folder that holds it; an error if none does."""
    if "://" in path or os.path.exists(path):
        return path
    for folder in snapshots:
        if os.path.exists(found := os.path.join(folder, path)):
            return found
    raise FileNotFoundError(path)


def config_names(asked: str | None, available: Sequence[str]) -> list[str]:
    """The names of a comma-separated list, or all that are available; an unknown one is an error."""
    names = [n for n in (x.strip() for x in (asked or "").split(",")) if n] or list(available)
    if unknown := [n for n in names if n not in available]:
        raise ValueError(f"unknown configs: {', '.join(unknown)}")
    return names


def sft_rows(df: DataFrame, prompt: str, response: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, prompt, response), both taken from columns or fields within them; null texts are empty."""
    return df.select(*keep, F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("prompt"), F.coalesce(F.col(response).cast("string"), F.lit("")).alias("response"))


def multiturn_rows(df: DataFrame, messages: str = "messages", tools: str = "tools", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, messages, tools): conversations as lists; a table without tools has empty ones."""
    none = F.array().cast("array<string>")
    return df.select(*keep, F.col(messages).alias("messages"), (F.coalesce(F.col(tools), none) if tools in df.columns else none).alias("tools"))


def preference_pairs(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(prompt, chosen, rejected) of rows that have all three."""
    d = df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))
    return d.dropna()


def prompt_file(spark: SparkSession, path: str) -> str:
    """A template file as one text, by any path that Spark reads; an empty one is an error."""
    found = spark.read.text(path, wholetext=True).first()
    if found is None or not found[0].strip():
        raise ValueError(f"{path} is empty")
    return found[0].strip()
