"""Row-wise reward scores and their blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corveil.functions import answers as A
from corveil.functions import mathexpr
from corveil.functions import text as T

BOXED_TYPES = ("numeric", "string_match", "multiple_choice", "number_list", "list_string_match", "counting", "search", "web_action")
#: Other names under which the documentation lists reward types.
ALIASES = {"exact_match": "string_match", "list_match": "list_string_match", "ordering": "number_list"}


def format_reward(response: Column, reward_type: Column | None = None) -> Column:
    """1 for exactly one think pair followed by one answer pair, both with content; half of it for boxed types without exactly one box."""
    once = [T.occurrences(response, tag) == 1 for tag in ("<think>", "</think>", "<answer>", "</answer>")]
    shape = F.regexp_like(response, F.lit(r"(?s)^\s*<think>.*</think>\s*<answer>.*</answer>\s*$"))
    think, answer = T.between_tags(response, "think"), T.between_tags(response, "answer")
    fine = once[0] & once[1] & once[2] & once[3] & shape & T.not_blank(think).isNotNull() & T.not_blank(answer).isNotNull()
    score = F.lit(1.0)
    if reward_type is not None:
        boxes = A.boxed(answer)
        half = reward_type.isin(*BOXED_TYPES) & ~((F.size(boxes) == 1) & (F.get(boxes, 0) != ""))
        half = half | reward_type.isin("grounding", "clicking") & (T.occurrences(answer, "\\boxed") > 1)
        score = F.when(half, 0.5).otherwise(1.0)
    return F.when(F.coalesce(fine, F.lit(False)), score).otherwise(0.0)


def total_reward(accuracy: Column, formatting: Column, f: float = 0.5) -> Column:
    """(1 - f) * accuracy + f * format, accuracy counting as 0 where format is 0."""
    return (1 - f) * F.when(formatting == 0, 0.0).otherwise(accuracy) + f * formatting


def string_match(pred: Column, gold: Column) -> Column:
    p, g = T.normalize_text(pred), T.normalize_text(gold)
    return F.when((p != "") & (p == g), 1.0).otherwise(0.0)


def list_string_match(pred: Column, golds: Column) -> Column:
    p = T.normalize_text(pred)
    return F.when((p != "") & F.exists(golds, lambda g: T.normalize_text(g) == p), 1.0).otherwise(0.0)


def multiple_choice(pred: Column, gold: Column) -> Column:
    return string_match(F.coalesce(T.choice_letter(pred), pred), F.coalesce(T.choice_letter(gold), gold))


def web_action(pred: Column, gold: Column) -> Column:
    """Equal shares for the ACTION, MARK (unless -1) and VALUE (unless None) that gold asks for."""
    number = lambda x: F.coalesce(x.try_cast("double").cast("string"), F.lower(F.trim(x)))
    parts = []
    for key, none in (("ACTION", None), ("MARK", "-1"), ("VALUE", "None")):
        p, g = F.get_json_object(pred, f"$.{key}"), F.get_json_object(gold, f"$.{key}")
        asked = g.isNotNull() & (g != F.lit(none) if none else F.lit(True))
        parts.append((asked.cast("int"), (asked & (number(p) == number(g))).cast("int")))
    asked, hit = sum((a for a, _ in parts[1:]), parts[0][0]), sum((F.coalesce(h, F.lit(0)) for _, h in parts[1:]), F.coalesce(parts[0][1], F.lit(0)))
    return F.when(asked > 0, hit / asked).otherwise(0.0)


def box_score(mean_iou: Column, f1: Column, false_share: Column, missed_share: Column) -> Column:
    """mean IoU + 0.75 F1 - 0.25 (false + missed shares), between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean_iou + 0.75 * f1 - 0.25 * (false_share + missed_share)))


def overlong_penalty(length: Column, longest: int = 16384, buffer: int = 2048, factor: float = 1.0) -> Column:
    """0 up to the buffer before the longest length, from there down to -factor at it and on below."""
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def judge_blend(rule: Column, judge: Column, reward_type: Column, weight: float) -> Column:
    """The judge's score alone for llm_judge, else weight * rule + (1 - weight) * judge; a judge that failed gives 0."""
    j = F.coalesce(judge, F.lit(0.0))
    return F.when(reward_type == "llm_judge", j).otherwise(weight * rule + (1 - weight) * j)


def accuracy(pred: Column, gold: Column, reward_type: Column) -> Column:
    """The accuracy that the type of reward asks for, mathematical equality where it asks for none in particular; llm_judge gives 0 until the judge's score comes in."""
    kind = reward_type
    for alias, name in ALIASES.items():
        kind = F.when(kind == alias, name).otherwise(kind)
    answer = T.extract_answer(pred)
    answer = F.coalesce(F.get(A.boxed(answer), 0), answer)
    other = F.coalesce(~kind.isin(*BOXED_TYPES, "llm_judge"), F.lit(True))
    return T.let(scored, answer, gold, kind, mathexpr.math_equal(F.when(other, answer), gold))


def scored(answer: Column, gold: Column, kind: Column, equal: Column) -> Column:
    numeric = (T.grade_numeric(T.to_number(answer), T.to_number(gold)) == 1).cast("double")
    return (
        F.when(kind == "numeric", numeric)
        .when(kind.isin("string_match", "counting", "search"), string_match(answer, gold))
        .when(kind == "multiple_choice", multiple_choice(answer, gold))
        .when(kind == "number_list", T.number_list_score(answer, gold))
        .when(kind == "list_string_match", list_string_match(answer, F.split(gold, r"\|")))
        .when(kind == "web_action", web_action(answer, gold))
        .when(kind == "llm_judge", 0.0)
        .otherwise(equal.cast("double"))
    )


def token_rewards(length: Column, score: Column) -> Column:
    """The score at the last valid token, 0 before it."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, score).otherwise(0.0))
