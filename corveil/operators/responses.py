"""Response filters: chainable transforms of a column of response lists, and pipelines of them by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corveil.functions import answers as A
from corveil.functions import parse
from corveil.functions import text as T

Filter = Callable[[Column], Column]
INVALID = "[invalid]"


def take_first(r: Column) -> Column:
    return F.slice(r, 1, 1)


def take_first_k(k: int) -> Filter:
    def f(r: Column) -> Column:
        return F.when(F.size(r) < k, F.raise_error(F.lit(f"fewer than {k} responses")).cast("array<string>")).otherwise(F.slice(r, 1, k))

    return f


def majority_vote(r: Column) -> Column:
    """The most frequent response, the first seen of several, as a list of one."""
    best = F.aggregate(F.array_distinct(r), F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n")), lambda s, x: F.when(F.size(F.filter(r, lambda y: y == x)) > s["n"], F.struct(x.alias("x"), F.size(F.filter(r, lambda y: y == x)).alias("n"))).otherwise(s))
    return F.when(F.size(r) > 0, F.array(best["x"])).otherwise(r)


def drop_space(r: Column) -> Column:
    """Without one leading space."""
    return F.transform(r, lambda x: F.regexp_replace(x, "^ ", ""))


def lower(r: Column) -> Column:
    return F.transform(r, F.lower)


def upper(r: Column) -> Column:
    return F.transform(r, F.upper)


def regex(pattern: str, group: int = 1, select: int = 0, fallback: str = INVALID) -> Filter:
    """The match number `select` (from the end if negative), stripped; the fallback without one."""
    def one(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), group)
        at = select + 1 if select >= 0 else select
        return F.coalesce(F.trim(F.try_element_at(found, F.lit(at))), F.lit(fallback))

    return lambda r: F.transform(r, one)


def mapped(table: dict[str, str], default: str) -> Filter:
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(lookup, x), F.lit(default)))


@F.pandas_udf(ArrayType(StringType()))
def last_boxes(r: pd.Series) -> pd.Series:
    """The last box of each response, null for one without."""
    def last(x: str | None) -> str | None:
        found = list(A.spans(x, A.BRACES, "{")) if x else []
        return A.unwrapped(found[-1].strip()) if found else None

    return r.map(lambda xs: None if xs is None else [last(x) for x in xs])


def boxed(r: Column) -> Column:
    """The last box with balanced braces, else the response itself; document by document."""
    return F.zip_with(last_boxes(r), r, lambda box, x: F.coalesce(box, x))


def strict_boxed(r: Column) -> Column:
    return F.transform(last_boxes(r), lambda box: F.coalesce(box, F.lit("")))


def after_think(r: Column) -> Column:
    return F.transform(r, lambda x: F.trim(T.after_think(x)))


def cleaned(x: Column, lower: bool, punctuation: bool, patterns: list[str]) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    x = F.lower(x) if lower else x
    return F.regexp_replace(x, r"\p{P}", "") if punctuation else x


def multi_choice(choices: Column, pattern: str = r"#### (-?[0-9.,]+)", fallback: str = INVALID, lower: bool = False, punctuation: bool = False, ignored: list[str] | None = None) -> Filter:
    """(A), (B), ... of each response: the pattern's match as it is, else the choice whose text comes first, else the letter behind a colon; the fallback without any."""
    texts = F.transform(choices, lambda c: cleaned(F.trim(c), lower, punctuation, ignored or []))
    shown = lambda i: F.concat(F.lit("("), F.char(i + 65), F.lit(")"))

    def one(x: Column) -> Column:
        direct = F.nullif(F.trim(F.regexp_extract(x, pattern, 1)), F.lit(""))
        seen = cleaned(x, lower, punctuation, ignored or [])
        places = F.filter(F.transform(texts, lambda t, i: F.struct(F.when(t != "", F.nullif(F.position(t, seen), F.lit(0))).alias("at"), i.alias("i"))), lambda p: p["at"].isNotNull())
        by_text = F.when(F.size(places) > 0, shown(F.array_min(places)["i"]))
        letters = F.regexp_extract_all(x, F.lit(r":\s*([A-Z])"), 1)
        known = F.filter(letters, lambda c: F.ascii(c) - 64 <= F.size(choices))
        return F.coalesce(direct, by_text, F.when(F.size(known) > 0, F.concat(F.lit("("), F.get(known, 0), F.lit(")"))), F.lit(fallback))

    return lambda r: F.transform(r, one)


def option_letters(question: Column) -> Filter:
    """For each response without marks: the letter of the question's option whose text it contains, the earliest; else the response itself."""
    texts = F.map_values(parse.choices(question))

    def one(x: Column) -> Column:
        clean = F.trim(F.regexp_replace(x, r"[^\w\s]", ""))
        places = F.filter(F.transform(texts, lambda t, i: F.struct(F.when(t != "", F.nullif(F.position(t, clean), F.lit(0))).alias("at"), i.alias("i"))), lambda p: p["at"].isNotNull())
        return F.when(F.size(places) > 0, F.char(F.array_min(places)["i"] + 65)).otherwise(clean)

    return lambda r: F.transform(r, one)


def number_words(r: Column) -> Column:
    """Responses that are a number word from zero to ten, as digits."""
    return F.transform(r, T.words_to_numbers)


def tag_content(r: Column) -> Column:
    return F.transform(r, A.tagged_answer)


def first_box_json(r: Column) -> Column:
    """The first four numbers of each response as JSON, zeros without."""
    return F.transform(r, lambda x: F.to_json(parse.four_numbers(x)))


def first_point_json(r: Column) -> Column:
    return F.transform(r, lambda x: F.to_json(parse.point(x)))


def digits(r: Column) -> Column:
    """The last number of each response."""
    return F.transform(r, lambda x: F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(r"-?\d+(?:\.\d+)?"), 0), F.lit(-1)), F.lit("")))


FILTERS: dict[str, Callable] = {"take_first": take_first, "take_first_k": take_first_k, "majority_vote": majority_vote, "remove_whitespace": drop_space, "lowercase": lower, "uppercase": upper, "regex": regex, "map": mapped, "boxed": boxed, "strict_boxed": strict_boxed, "after_think": after_think, "final_number": digits,
    "first_integer": regex(r"(-?\d+)"), "stated_number": regex(r"(?i)answer\s*[:\uff1a]\s*(-?\d+)"), "multi_choice_regex": multi_choice, "option_letters": option_letters, "number_words": number_words, "answer_tag": tag_content, "bbox": first_box_json, "point": first_point_json}


def pipelines(df: DataFrame, responses: str, named: dict[str, list[Filter]]) -> DataFrame:
    """filtered_resps: a map from each pipeline's name to the responses that its filters leave, applied in order."""
    entries = []
    for name, filters in named.items():
        out = F.col(responses)
        for f in filters:
            out = f(out)
        entries += [F.lit(name), out]
    return df.withColumn("filtered_resps", F.create_map(*entries))
