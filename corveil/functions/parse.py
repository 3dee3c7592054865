"""Parsers of model output as Column expressions: JSON, boxes, points, choices, judge answers, tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<bbox_2d: array<double>, label: string>>"


def json_candidate(x: Column) -> Column:
    """The text if it is JSON, else what lies from the first { to the last } if that is, else null."""
    part = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.trim(x)).isNotNull(), F.trim(x)).when((part != "") & F.try_parse_json(part).isNotNull(), part)


#: A fenced block with an array alone, and an array of objects anywhere.
FENCED_ARRAY = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
OBJECT_ARRAY = r"(?s)(\[\s*\{.*?\}\s*\])"


def json_fenced(x: Column) -> Column:
    """The array in the first fenced block, else the first [{...}]; each only if it is JSON, null without one."""
    found = [F.regexp_extract(x, p, 1) for p in (FENCED_ARRAY, OBJECT_ARRAY)]
    return F.coalesce(*[F.when((part != "") & F.try_parse_json(part).isNotNull(), part) for part in found])


def boxes(x: Column) -> Column:
    """Labelled boxes of a JSON answer; null if it is none."""
    return F.from_json(F.coalesce(json_fenced(x), x), BOXES)


def four_numbers(x: Column) -> Column:
    """The first four numbers in brackets or parentheses, else zeros."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = r"[\[(]\s*" + r"\s*,\s*".join([number] * 4) + r"\s*[\])]"
    found = F.array(*[F.regexp_extract(x, pattern, k).try_cast("double") for k in range(1, 5)])
    return F.transform(found, lambda v: F.coalesce(v, F.lit(0.0)))


def point(x: Column) -> Column:
    """x and y of a JSON point_2d, else of the first pair of numbers; null without any."""
    number = r"(-?\d+(?:\.\d+)?)"
    pair = F.array(*[F.regexp_extract(x, rf"{number}\s*,\s*{number}", k).try_cast("double") for k in (1, 2)])
    stated = F.from_json(json_fenced(x), "array<struct<point_2d: array<double>>>")
    first = F.coalesce(F.get(stated, 0)["point_2d"], pair)
    return F.when(F.forall(first, lambda v: v.isNotNull()) & (F.size(first) == 2), first)


#: Fixed value: an option, its letter and period, white space, and its text to the end of the line.
OPTION = r"\b([A-Z])\.\s+([^\n]+)"


def choices(x: Column) -> Column:
    """Letter to text of options written as `A. text`, one a line."""
    # A letter that comes twice keeps its last text.
    letters, texts = (F.regexp_extract_all(x, F.lit(OPTION), k) for k in (1, 2))
    options = F.zip_with(letters, texts, lambda c, t: F.struct(c.alias("letter"), F.trim(t).alias("text")))
    last = F.filter(options, lambda o, i: ~F.exists(F.slice(options, i + 2, F.size(options)), lambda p: p["letter"] == o["letter"]))
    return F.map_from_entries(last)


def integers(x: Column) -> tuple[Column, Column]:
    """The first and the last integer of a text, null without one."""
    found = F.regexp_extract_all(x, F.lit(r"-?\d+"), 0)
    return F.try_element_at(found, F.lit(1)).try_cast("long"), F.try_element_at(found, F.lit(-1)).try_cast("long")


def judge_binary(x: Column) -> Column:
    """True if a judge's answer contains a 1."""
    return F.contains(x, F.lit("1"))


def judge_yes(x: Column) -> Column:
    return F.regexp_like(F.lower(F.trim(x)), F.lit("^yes"))


def judge_number(x: Column, low: float, high: float) -> Column:
    """The first number, clamped; null without one."""
    n = F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def judge_pair(x: Column) -> Column:
    """The first two numbers of a comparison, else (-1, -1)."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda v: v.try_cast("double"))
    return F.when(F.size(found) >= 2, F.slice(found, 1, 2)).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def component_scores(x: Column) -> Column:
    """number -> share of lines `component N: a/b`."""
    pattern = r"(?i)component\s+(\d+)\s*:\s*(\d+(?:\.\d+)?)\s*/\s*(\d+)"
    n, a, b = (F.regexp_extract_all(x, F.lit(pattern), k) for k in (1, 2, 3))
    shares = F.zip_with(a, b, lambda p, q: F.try_divide(p.try_cast("double"), q.try_cast("double")))
    return F.map_from_arrays(F.transform(n, lambda v: v.try_cast("int")), shares)


def tool_calls(x: Column) -> tuple[Column, Column]:
    """The names of <tool_call> JSON blocks, and the text without them."""
    pattern = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
    names = F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), lambda c: F.get_json_object(c, "$.name"))
    return names, F.trim(F.regexp_replace(x, pattern, ""))


def passages(rows: Column) -> Column:
    """Doc i (Title: ...), the text in the next line and a blank line between, of an array of contents whose first line is the title."""
    def shown(content: Column, i: Column) -> Column:
        first = F.substring_index(content, "\n", 1)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), first, F.lit(")\n"), F.substring(content, F.length(first) + 2, F.length(content)))

    return F.regexp_replace(F.array_join(F.transform(rows, shown), "\n\n"), r"^\s+|\s+$", "")


def exact_match_text(x: Column, lower: bool = True, punctuation: bool = True, digits: bool = True) -> Column:
    """A text as exact_match compares it."""
    x = F.lower(x) if lower else x
    x = F.regexp_replace(x, r"[\p{Punct}]", "") if punctuation else x
    return F.regexp_replace(x, "[0-9]", "") if digits else x
