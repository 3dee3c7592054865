"""Chat prompts and canonical training rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.functions import text as T

MESSAGES = "array<struct<role: string, content: string>>"
CANONICAL = (
    "id string, data_source string, prompt array<struct<role: string, content: string>>, images array<string>, ability string, "
    "reward_model struct<style: string, ground_truth: string>, "
    "extra_info struct<id: string, split: string, index: bigint, question: string, answer: string, reward_type: string, tolerance: double>"
)


def fold_messages(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(key, prompt): each conversation's messages in the order of their turns."""
    rows = F.array_sort(F.collect_list(F.struct(turn, role, content)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r[role].alias("role"), r[content].alias("content"))).alias("prompt"))


def zip_messages(roles: Column, contents: Column) -> Column:
    """A struct of lists as a list of structs."""
    return F.transform(F.arrays_zip(roles.alias("role"), contents.alias("content")), lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))


def normalize_prompt(prompt: Column, question: Column) -> Column:
    """The prompt if it has messages, else one user message with the question."""
    alone = F.array(F.struct(F.lit("user").alias("role"), T.or_empty(question).alias("content")))
    return F.when(F.size(prompt) > 0, prompt).otherwise(alone)


def part_text(parts: Column) -> Column:
    """Typed parts (type, text) as one string: text as it is, media as their marks, others as JSON."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", T.or_empty(p["text"])).when(p["type"] == "image", "<image>").when(p["type"] == "video", "<video>").otherwise(F.to_json(p))), "")


def typed_parts(content: Column) -> Column:
    """A string split at <image> and <video> into typed parts, none empty."""
    pieces = F.filter(F.split(F.regexp_replace(content, "(<image>|<video>)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def first_user(prompt: Column) -> Column:
    return F.get(F.filter(prompt, lambda m: (m["role"] == "user") & (m["content"] != "")), 0)["content"]


def choose_question(question: Column, prompt: Column) -> Column:
    return T.or_empty(F.coalesce(F.nullif(question, F.lit("")), first_user(prompt)))


def trim_ends(prompt: Column) -> Column:
    """Without a first system message and without a last message of the assistant."""
    first = F.when(F.get(prompt, 0)["role"] == "system", F.slice(prompt, 2, F.size(prompt))).otherwise(prompt)
    return F.when((F.size(first) > 0) & (F.get(first, F.size(first) - 1)["role"] == "assistant"), F.slice(first, 1, F.greatest(F.size(first) - 1, F.lit(0)))).otherwise(first)


def render(prompt: Column) -> Column:
    """Lines of Role: content."""
    return F.array_join(F.transform(prompt, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), T.or_empty(m["content"]))), "\n")


def explode_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(key, turn, history, question, answer): each user message followed by one of the assistant; history: messages before."""
    by = W.partitionBy(key).orderBy(turn)
    d = df.withColumns({"_next": F.lead(role).over(by), "answer": F.lead(content).over(by), "history": F.row_number().over(by) - 1})
    return d.filter((F.col(role) == "user") & (F.col("_next") == "assistant")).select(key, turn, "history", F.col(content).alias("question"), "answer")


def format_row(config: Column, split: Column, index: Column, row_id: Column, data_source: Column, prompt: Column, ability: Column, style: Column, truth: Column, question: Column, answer: Column, reward_type: Column, tolerance: Column, extra_id: Column | None = None, extra_index: Column | None = None, images: Column | None = None) -> Column:
    """The canonical training row; missing texts are empty, a missing id is config, split and index."""
    own_id = F.coalesce(F.nullif(row_id, F.lit("")), extra_id if extra_id is not None else F.lit(None).cast("string"), F.concat_ws("_", config, split, index.cast("string")))
    asked = choose_question(question, prompt)
    extra = F.struct(
        own_id.alias("id"), T.or_empty(split).alias("split"), F.coalesce(extra_index.try_cast("bigint") if extra_index is not None else F.lit(None).cast("bigint"), index.cast("bigint")).alias("index"),
        asked.alias("question"), T.or_empty(answer).alias("answer"), T.or_empty(reward_type).alias("reward_type"), tolerance.try_cast("double").alias("tolerance"),
    )
    row = F.struct(
        own_id.alias("id"), T.or_empty(data_source).alias("data_source"), normalize_prompt(prompt, asked).alias("prompt"), F.coalesce(images, F.array().cast("array<string>")).alias("images") if images is not None else F.array().cast("array<string>").alias("images"),
        T.or_empty(ability).alias("ability"), F.struct(T.or_empty(style).alias("style"), T.or_empty(truth).alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"),
    )
    return row


def sample_id(row_id: Column, index: Column) -> Column:
    """The id, or sample_ and the absolute index in six digits where it is blank."""
    return F.coalesce(T.not_blank(row_id), F.format_string("sample_%06d", index))


def question_text(*candidates: Column) -> Column:
    """The first candidate that isn't blank, without image marks."""
    return F.trim(F.replace(F.coalesce(*[T.not_blank(c) for c in candidates], F.lit("")), F.lit("<image>"), F.lit("")))


def template(text: str, **values: Column) -> Column:
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), T.or_empty(value))
    return out


#: The flags of a question filter's answer.
QUESTION_FLAGS = ("relevance_filter", "ambiguous_filter", "language_filter", "verifiable_filter", "number_precision_filter")


def question_filtered(answer: Column) -> Column:
    """True if any flag of the JSON answer is the string true."""
    flags = F.from_json(answer, ", ".join(f"{f} string" for f in QUESTION_FLAGS))
    return F.coalesce(F.exists(F.array(*[F.lower(flags[f]) for f in QUESTION_FLAGS]), lambda f: f == "true"), F.lit(False))


def answer_decision(answer: Column) -> Column:
    """keep, reason, normalized_ground_truth and type of a JSON answer; null if it is none."""
    return F.from_json(answer, "keep boolean, reason string, normalized_ground_truth string, type string")


def task_type(data_id: Column, truth: Column, question: Column, ids: dict[str, str], words: dict[str, str], default: str) -> Column:
    """By a part of the id, a bbox_2d in the truth, a word in the question, else the default."""
    out = F.lit(default)
    for word, kind in reversed(words.items()):
        out = F.when(F.contains(F.lower(question), F.lit(word)), kind).otherwise(out)
    out = F.when(F.contains(truth, F.lit("bbox_2d")), "grounding").otherwise(out)
    for part, kind in reversed(ids.items()):
        out = F.when(F.contains(data_id, F.lit(part)), kind).otherwise(out)
    return out


def scale_box(box: list[Column], width: Column, height: Column, to: int = 1000) -> list[Column]:
    """Corners in the range 0 to `to`, rounded half to even, clamped, the smaller first."""
    at = lambda x, side: F.least(F.greatest(F.bround(x / side * to), F.lit(0.0)), F.lit(float(to))).cast("int")
    x, y = [at(box[k], width) for k in (0, 2)], [at(box[k], height) for k in (1, 3)]
    return [F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)]


def media_path(x: Column, root: str, listed_in: str) -> Column:
    """Addresses and absolute paths as they are, others under the root, or beside the list that names them."""
    base = (root or listed_in.rpartition("/")[0]).rstrip("/")
    return F.when(F.regexp_like(x, F.lit("^(https?://|file://|/)")), x).otherwise(F.concat(F.lit(f"{base}/"), F.regexp_replace(x, r"^(\./)+", "")))


def with_box_format(df: DataFrame, kind: str) -> DataFrame:
    """df with the format in which boxes are asked for."""
    return df.withColumn("bbox_format", F.lit(kind))


def split_columns(df: DataFrame, for_model: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The columns that go to the model, and the others with the key, by which they meet again."""
    return df.select(*for_model), df.select(key, *[c for c in df.columns if c not in for_model])


#: The first bytes of PNG, JPEG, GIF, BMP and WebP files, in hexadecimal digits.
IMAGE_HEADS = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "52494646........57454250")


def readable_image(content: Column) -> Column:
    """Whether the bytes begin like an image file; null and empty ones don't."""
    return F.coalesce(F.regexp_like(F.hex(F.substring(content, 1, 12)), F.lit("^(" + "|".join(IMAGE_HEADS) + ")")), F.lit(False))


#: What opens a user's turn and an assistant's in three chat formats.
USER_MARKS = (r"(?i)(?:^|\n)\s*(user\s*\n)", r"(?i)(<\|im_start\|>\s*user\s*\n)", r"(?i)(<\|start_header_id\|>\s*user\s*<\|end_header_id\|>)")
ASSISTANT_MARKS = (r"(?i)\n\s*assistant\s*:?\s*$", r"(?i)<\|im_start\|>\s*assistant\s*$", r"(?i)<\|start_header_id\|>\s*assistant\s*<\|end_header_id\|>\s*$")


def strip_system(x: Column) -> tuple[Column, Column]:
    """(the text from its earliest user mark on, whether it has one)."""
    # The text of the first match, its place by what precedes it.
    places = [F.when(F.regexp_like(x, F.lit(m)), F.length(F.regexp_extract(x, f"(?s)^(.*?){m}", 1)) + F.length(F.regexp_extract(x, f"(?s)({m})", 1)) - F.length(F.regexp_extract(x, m, 1))) for m in USER_MARKS]
    first = F.array_min(F.array(*places))
    return F.when(first.isNotNull(), F.substring(x, first + 1, F.length(x))).otherwise(x), first.isNotNull()


def strip_assistant(x: Column) -> Column:
    """Without the assistant's mark at the end, and then without white space there."""
    end = F.regexp_replace(x, r"\s+$", "")
    cuts = [F.when(F.regexp_like(end, F.lit(m)), F.regexp_replace(F.regexp_replace(end, m, ""), r"\s+$", "")) for m in ASSISTANT_MARKS]
    return F.coalesce(*cuts, x)


#: The filters of a template's places.
TEMPLATE_FILTERS = {"upper": F.upper, "lower": F.lower, "trim": F.trim, "regex_replace": F.regexp_replace}


def rendered(template: str, columns: list[str]) -> Column:
    """A text with {{ column | filter(arguments) }} places as a Column; a column that isn't there is an error."""
    out, at = [], 0
    for place in re.finditer(r"\{\{\s*(\w+)\s*((?:\|[^{}]*)?)\}\}", template):
        if place[1] not in columns:
            raise ValueError(f"no column {place[1]!r} for the template")
        value = F.coalesce(F.col(place[1]).cast("string"), F.lit(""))
        for name, arguments in re.findall(r"\|\s*(\w+)\s*(?:\(([^)]*)\))?", place[2]):
            if name not in TEMPLATE_FILTERS:
                raise ValueError(f"no filter {name!r} for the template")
            value = TEMPLATE_FILTERS[name](value, *re.findall(r"'([^']*)'", arguments))
        out += [F.lit(template[at : place.start()]), value]
        at = place.end()
    return F.concat(*out, F.lit(template[at:]))


def rewrite_instruction(x: Column, kind: Column, rules: dict[str, tuple[str, str, str]]) -> Column:
    """x with its instruction replaced: for a kind's rule (first, last, new) what goes from `first` to the next `last`, or to the end without one."""
    out = x
    for name, (first, last, new) in rules.items():
        rest = F.substring(x, F.locate(first, x) + len(first), F.length(x))
        tail = F.when(F.contains(rest, F.lit(last)), F.substring(rest, F.locate(last, rest) + len(last), F.length(rest))).otherwise("")
        done = F.concat(F.substring_index(x, first, 1), F.lit(new), tail)
        out = F.when((F.lower(kind) == name) & F.contains(x, F.lit(first)), done).otherwise(out)
    return out
