"""What surrounds a judge: its prompts, what its answers say, and the aggregates of its verdicts. The judge itself is a responder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.functions import parse
from corveil.functions import text as T

TEMPLATES = {
    "binary": "Question: {question}\nReference: {reference}\nResponse: {response}\nIs the response right? Answer 1 for yes or 0 for no.",
    "comparative": "Question: {question}\nFirst response: {response}\nSecond response: {reference}\nScore both from 1 to 10, as two numbers.",
    "correctness": "Question: {question}\nReference: {reference}\nResponse: {response}\nAnswer yes if both mean the same, else no.",
}


def prompt(kind: str, question: Column, response: Column, reference: Column | None = None, template: str | None = None) -> Column:
    """A judge's prompt from one of TEMPLATES or a template of one's own, with its places filled."""
    out = F.lit(template or TEMPLATES[kind])
    for name, value in (("question", question), ("response", response), ("reference", reference if reference is not None else F.lit(""))):
        out = F.replace(out, F.lit(f"{{{name}}}"), T.or_empty(value))
    return out


#: What each kind of judge's answer says.
PARSERS: dict[str, Callable[[Column], Column]] = {"binary": parse.judge_binary, "comparative": parse.judge_pair, "correctness": parse.judge_yes}


def judged(df: DataFrame, kind: str, question: str, response: str, reference: str, respond: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """df with judge: a struct of prompt, raw, result and success. respond gives (key, raw) for (key, prompt); a missing answer has no result."""
    asked = df.select(key, prompt(kind, F.col(question), F.col(response), F.col(reference)).alias("prompt"))
    raw = respond(asked).select(key, "raw")
    d = asked.join(raw, key, "left").select(key, F.struct("prompt", "raw", PARSERS[kind](F.col("raw")).alias("result"), F.col("raw").isNotNull().alias("success")).alias("judge"))
    return df.join(d, key)


def extracted(raw: Column) -> Column:
    """extracted_answer of a judge's JSON answer, an empty text where it has none."""
    return T.or_empty(F.get_json_object(parse.json_candidate(raw), "$.extracted_answer"))


def attempted(df: DataFrame, verdicts: DataFrame, key: str, kind: str) -> DataFrame:
    """(kind, n, correct, incorrect, not_attempted, attempted_accuracy, f1) by kind and overall.

    verdicts (key, verdict) say CORRECT or INCORRECT, or their letters A and B; rows without either weren't attempted.
    """
    d = df.join(verdicts, key, "left").withColumn("_v", F.regexp_extract(F.upper(F.coalesce("verdict", F.lit(""))), r"\b(A|B|INCORRECT|CORRECT)\b", 1))
    share = lambda *v: F.avg(F.col("_v").isin(*v).cast("int"))
    out = d.rollup(kind).agg(F.grouping(kind).alias("_all"), F.count(F.lit(1)).alias("n"), share("A", "CORRECT").alias("correct"), share("B", "INCORRECT").alias("incorrect"), share("").alias("not_attempted"))
    right, tried = F.col("correct"), F.col("correct") + F.col("incorrect")
    out = out.withColumn("attempted_accuracy", F.when(tried > 0, right / tried).otherwise(0.0))
    f1 = F.when(right > 0, 2 * right * F.col("attempted_accuracy") / (right + F.col("attempted_accuracy"))).otherwise(0.0)
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(kind)).alias(kind), "n", "correct", "incorrect", "not_attempted", "attempted_accuracy", f1.alias("f1"))
