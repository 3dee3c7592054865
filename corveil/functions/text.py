"""String, answer and number functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that the normalisers treat alike.
MINUS_SIGNS = "−–—"
MARKS = "$£€¥%‰,\\°"
ARTICLES = ("a", "an", "the")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f(*values) with each value worked out once, however often f names it."""
    names = [f"v{k}" for k in range(len(values))]
    bound = F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    return F.get(F.transform(F.array(bound), lambda s: f(*[s[n] for n in names])), 0)


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def not_blank(x: Column) -> Column:
    """x, or null if it is null or only white space."""
    return F.when(F.trim(F.regexp_replace(x, r"\s+", " ")) != "", x)


def strip_string(x: Column) -> Column:
    """White space, minus signs, money and percent marks, answer prefixes, outer quotes and one final period; lower case."""
    x = F.translate(or_empty(x), "\n\t" + MINUS_SIGNS, "  ---")
    x = F.trim(F.translate(x, MARKS, ""))
    for prefix in ("answer:", "final answer:"):
        x = F.when(F.startswith(F.lower(x), F.lit(prefix)), F.trim(F.substring(x, len(prefix) + 1, 1 << 30))).otherwise(x)
    x = F.btrim(x, F.lit("'\""))
    x = F.trim(F.when(F.endswith(x, F.lit(".")), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.lower(F.regexp_replace(x, r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Thousands separators and trailing zeros of numbers go, the rest in lower case with only letters and digits, without articles."""
    x = F.regexp_replace(or_empty(x), r"(\d),(\d{3})\b", "$1$2")
    x = F.regexp_replace(x, r"\b(\d+)\.0+\b", "$1")
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.when(F.size(F.filter(kept, lambda w: F.length(w) > 1)) == 0, F.array_join(words, " ")).otherwise(F.array_join(kept, " "))


def sanitize(x: Column, fallback: str) -> Column:
    """A file name: other characters than letters, digits, dot, underscore and hyphen to one underscore, none of ._ at the ends."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit(fallback))


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path, .png without one."""
    found = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(found == "", ".png").otherwise(found)


def between_tags(x: Column, tag: str) -> Column:
    """What stands in the first pair of tags; null without one."""
    return F.when(F.regexp_like(x, F.lit(f"(?s)<{tag}>.*?</{tag}>")), F.regexp_extract(x, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def extract_answer(x: Column) -> Column:
    """The first answer tag's content, else the whole text; stripped."""
    return F.regexp_replace(F.coalesce(between_tags(x, "answer"), x), r"^\s+|\s+$", "")


def after_think(x: Column) -> Column:
    return F.substring_index(x, "</think>", -1)


def occurrences(x: Column, part: str) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)


def numbers(x: Column) -> Column:
    """All integers of a text."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"-?\d+"), 0), lambda n: n.try_cast("long"))


def to_number(x: Column) -> Column:
    """A number with thousands separators, percent sign (over 100) or as a fraction a/b; null if it is none."""
    x = F.trim(F.replace(x, F.lit(","), F.lit("")))
    parts = F.split(x, "/")
    plain = F.when(F.endswith(x, F.lit("%")), F.try_divide(F.rtrim(F.replace(x, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(100.0))).otherwise(x.try_cast("double"))
    return F.coalesce(plain, F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.get(parts, 1).try_cast("double"))))


def grade_numeric(pred: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """1 within the tolerance (relative if |gold| > 1e-12), 0 beyond, -1 if either is no number."""
    error = F.abs(pred - gold)
    fits = F.when(F.abs(gold) > 1e-12, error / F.abs(gold) <= tolerance).otherwise(error <= tolerance)
    return F.when(pred.isNull() | gold.isNull(), -1).when(fits, 1).otherwise(0)


def relaxed_match(pred: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Relative error of numbers at most 5 per cent (absolute if gold is 0), else equal lower-case text."""
    p, g = to_number(pred), to_number(gold)
    near = F.when(g == 0, F.abs(p) <= tolerance).otherwise(F.abs(p - g) / F.abs(g) <= tolerance)
    return F.when(p.isNotNull() & g.isNotNull(), near).otherwise(F.lower(F.trim(pred)) == F.lower(F.trim(gold))).cast("int")


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    """1 - the smallest normalised edit distance to a reference, 0 below the threshold."""
    clean = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))

    def similarity(gold: Column) -> Column:
        longest = F.greatest(F.length(pred), F.length(gold))
        return F.when(longest == 0, 0.0).otherwise(F.levenshtein(clean(pred), clean(gold)) / longest)

    best = 1 - F.array_min(F.transform(golds, similarity))
    return F.when(best < threshold, 0.0).otherwise(best)


def number_list_score(pred: Column, gold: Column) -> Column:
    """1 for equal lists; 0.2 times the share of equal positions for the same distinct numbers in another order; else 0."""
    p, g = numbers(pred), numbers(gold)
    hits = F.size(F.filter(F.zip_with(p, g, lambda a, b: a == b), lambda x: x))
    same = (F.array_sort(p) == F.array_sort(g)) & (F.size(F.array_distinct(g)) == F.size(g)) & (F.size(g) > 0)
    return F.when((p == g) & (F.size(g) > 0), 1.0).when(same, 0.2 * hits / F.size(g)).otherwise(0.0)


def judge_score(x: Column, scale: str = "0_to_1") -> Column:
    """SCORE of a JSON answer, else of a line, else the first number from 1 to 10; scaled; null if there is none."""
    line = F.regexp_extract(x, r"(?i)score\s*[:=]\s*(\d+)", 1)
    alone = F.regexp_extract(x, r"\b(10|[1-9])\b", 1)
    raw = F.coalesce(F.get_json_object(x, "$.SCORE").try_cast("double"), line.try_cast("double"), alone.try_cast("double"))
    raw = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(1.0)), F.lit(10.0)))
    return {"raw": raw, "0_to_1": (raw - 1) / 9, "-1_to_1": 2 * (raw - 1) / 9 - 1}[scale]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; the union is at least 1e-12."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    inter = side(0) * side(1)
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-12))


def iou_matrix(p: Column, g: Column) -> Column:
    """The intersection over union of each box of p (rows) with each of g, both arrays of boxes x1, y1, x2, y2."""
    corners = lambda x: [F.get(x, k) for k in range(4)]
    return F.transform(p, lambda a: F.transform(g, lambda b: iou(corners(a), corners(b))))


def choice_letter(x: Column) -> Column:
    """The first single capital letter that stands alone or before a mark."""
    return F.nullif(F.regexp_extract(x, r"(?:^|[\s(])([A-Z])(?:$|[\s).:,])", 1), F.lit(""))


def globbed(x: Column, pattern: str) -> Column:
    """Whether the whole text matches a shell pattern: * any run, ? any character, [a-c] and [!a-c] classes; everything else as it is."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if c == "[" else -1
        if end > 0:
            inside = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out += f"[^{inside[1:]}]" if inside[0] == "!" else f"[{inside}]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return F.regexp_like(x, F.lit(f"(?s)^{out}$"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k); 1 if fewer than k are wrong."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    miss = F.aggregate(steps, F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n - c < k, 1.0).otherwise(1 - miss)


def words_to_numbers(x: Column) -> Column:
    """Number words from zero to ten as digits."""
    table = F.create_map(*[F.lit(v) for k, w in enumerate(NUMBER_WORDS) for v in (w, str(k))])
    return F.array_join(F.transform(F.split(F.lower(x), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
