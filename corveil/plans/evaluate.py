"""Declarative evaluation: documents to requests, responses, filtered responses, sample metrics, aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.operators.metrics import task_metrics
from corveil.operators.responses import Filter, pipelines, take_first


@dataclass(frozen=True)
class Task:
    """What to ask of each document, how to filter the responses, and how to score them.

    `prompt` and `target` are Columns of the documents; `metrics` maps a name to a function of (response, target).
    """

    name: str
    key: str
    prompt: Column
    target: Column
    metrics: Mapping[str, Callable[[Column, Column], Column]]
    filters: Mapping[str, list[Filter]] = field(default_factory=lambda: {"none": [take_first]})
    process: Callable[[DataFrame], DataFrame] = lambda df: df


Responder = Callable[[DataFrame], DataFrame]


def requests(task: Task, docs: DataFrame) -> DataFrame:
    """(task, doc_id, prompt, target): one request per document."""
    return task.process(docs).select(F.lit(task.name).alias("task"), F.col(task.key).alias("doc_id"), task.prompt.alias("prompt"), task.target.alias("target"))


def choice_requests(df: DataFrame, choices: str = "choices") -> DataFrame:
    """One request per choice, numbered."""
    return df.select("*", F.posexplode(choices).alias("choice_idx", "choice")).drop(choices)


def from_log(log: DataFrame) -> Responder:
    """Answers requests from a log (task, doc_id, resps); documents that it lacks get no responses."""
    def respond(asked: DataFrame) -> DataFrame:
        return asked.join(log.select("task", "doc_id", "resps"), ["task", "doc_id"], "left").withColumn("resps", F.coalesce("resps", F.array().cast("array<string>")))

    return respond


def samples(task: Task, docs: DataFrame, responder: Responder) -> DataFrame:
    """(task, doc_id, filter, metric, value) of every sample."""
    answered = pipelines(responder(requests(task, docs)), "resps", dict(task.filters))
    long = answered.select("task", "doc_id", "target", F.explode("filtered_resps").alias("filter", "filtered"))
    response = F.get(F.col("filtered"), 0)
    scores = F.create_map(*[x for name, f in task.metrics.items() for x in (F.lit(name), f(response, F.col("target")).cast("double"))])
    return long.select("task", "doc_id", "filter", F.explode(scores).alias("metric", "value"))


def evaluate(task: Task, docs: DataFrame, responder: Responder) -> DataFrame:
    """(task, metric, filter, value, stderr, samples)."""
    return task_metrics(samples(task, docs, responder))


def best_choice(losses: Column, lengths: Column | None = None) -> Column:
    """The choice with the smallest loss, by length if lengths are given; from 0."""
    scaled = losses if lengths is None else F.zip_with(losses, lengths, lambda x, n: x / n)
    return (F.array_position(scaled, F.array_min(scaled)) - 1).cast("int")
