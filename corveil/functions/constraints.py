"""Text-constraint predicates as Column expressions: does a response follow an instruction?

A predicate takes the response and its arguments; relations are `at least` and `less than`. Sentences are the runs
between . ! or ? and white space, which is a plain rule and not a trained splitter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[..., Column]
PREDICATES: dict[str, Predicate] = {}


def predicate(f: Predicate) -> Predicate:
    PREDICATES[f.__name__] = f
    return f


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\w+"), 0)


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def paragraphs(x: Column) -> Column:
    return F.filter(F.split(x, r"\n\n+"), lambda p: F.trim(p) != "")


def related(n: Column, relation: str, bound: int) -> Column:
    if relation not in ("at least", "less than"):
        raise ValueError(f"unknown relation {relation!r}")
    return n >= bound if relation == "at least" else n < bound


def inside(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def keyword_count(x: Column, word: str) -> Column:
    return F.regexp_count(F.lower(x), F.lit(rf"\b\Q{word.lower()}\E\b"))


@predicate
def number_words(x: Column, relation: str, n: int) -> Column:
    return related(F.size(words(x)), relation, n)


@predicate
def number_sentences(x: Column, relation: str, n: int) -> Column:
    return related(F.size(sentences(x)), relation, n)


@predicate
def word_count_in_range(x: Column, low: int, high: int) -> Column:
    return inside(F.size(words(x)), low, high)


@predicate
def sentence_number_in_range(x: Column, low: int, high: int) -> Column:
    return inside(F.size(sentences(x)), low, high)


@predicate
def paragraph_number_in_range(x: Column, low: int, high: int) -> Column:
    return inside(F.size(paragraphs(x)), low, high)


@predicate
def each_paragraph_word_count_in_range(x: Column, low: int, high: int) -> Column:
    return F.forall(paragraphs(x), lambda p: inside(F.size(words(p)), low, high))


@predicate
def each_paragraph_sentence_number_in_range(x: Column, low: int, high: int) -> Column:
    return F.forall(paragraphs(x), lambda p: inside(F.size(sentences(p)), low, high))


@predicate
def each_paragraph_sentence_number_in_range_list(x: Column, ranges: list[tuple[int, int]]) -> Column:
    p = paragraphs(x)
    fits = [inside(F.size(sentences(F.get(p, k))), low, high) for k, (low, high) in enumerate(ranges)]
    return (F.size(p) == len(ranges)) & F.coalesce(F.forall(F.array(*fits), lambda f: f), F.lit(False))


@predicate
def capital_letters(x: Column) -> Column:
    return (F.upper(x) == x) & F.regexp_like(x, F.lit("[A-Z]"))


@predicate
def lowercase_letters(x: Column) -> Column:
    return (F.lower(x) == x) & F.regexp_like(x, F.lit("[a-z]"))


@predicate
def lowercase_counting(x: Column, most: int) -> Column:
    return F.regexp_count(x, F.lit(r"\b[a-z]+\b")) <= most


@predicate
def letter_counting(x: Column, relation: str, n: int) -> Column:
    return related(F.regexp_count(x, F.lit("[a-zA-Z]")), relation, n)


@predicate
def letter_frequency(x: Column, letter: str, relation: str, n: int) -> Column:
    return related(F.regexp_count(F.lower(x), F.lit(rf"\Q{letter.lower()}\E")), relation, n)


@predicate
def capital_word_frequency(x: Column, relation: str, n: int) -> Column:
    return related(F.regexp_count(x, F.lit(r"\b[A-Z][A-Z]*\b")), relation, n)


@predicate
def count_unique(x: Column) -> Column:
    w = words(F.lower(x))
    return F.size(w) == F.size(F.array_distinct(w))


@predicate
def placeholder(x: Column, n: int) -> Column:
    return F.regexp_count(x, F.lit(r"\[[^\]]*\]")) >= n


@predicate
def square_bracket(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"(?s)^\s*\[.*\]\s*$"))


@predicate
def bullet_list(x: Column, n: int) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*\*[^*].*$")) + F.regexp_count(x, F.lit(r"(?m)^\s*-.*$")) == n


@predicate
def highlight_section(x: Column, n: int) -> Column:
    return F.regexp_count(x, F.lit(r"\*[^\n*]+\*")) >= n


@predicate
def section(x: Column, splitter: str, n: int) -> Column:
    return F.regexp_count(x, F.lit(rf"\s?\Q{splitter}\E\s?\d+\s?")) >= n


@predicate
def paragraph_stars(x: Column, n: int) -> Column:
    return F.size(F.filter(F.split(x, r"\s?\*\*\*\s?"), lambda p: F.trim(p) != "")) == n


@predicate
def paragraph_basic(x: Column, n: int) -> Column:
    return F.size(paragraphs(x)) == n


@predicate
def postscript(x: Column, marker: str) -> Column:
    return F.regexp_like(F.lower(x), F.lit(rf"(?m)\s*\Q{marker.lower()}\E.*$"))


@predicate
def title(x: Column) -> Column:
    return F.exists(F.regexp_extract_all(x, F.lit(r"<<([^\n]+)>>"), 1), lambda t: F.trim(t) != "")


@predicate
def json_format(x: Column) -> Column:
    return F.try_parse_json(F.trim(F.regexp_replace(x, "^\\s*```(?:json|Json|JSON)?|```\\s*$", ""))).isNotNull()


@predicate
def two_responses(x: Column) -> Column:
    p = F.filter(F.split(x, r"\*\*\*\*\*\*"), lambda s: F.trim(s) != "")
    return (F.size(p) == 2) & (F.trim(F.get(p, 0)) != F.trim(F.get(p, 1)))


@predicate
def quotation(x: Column) -> Column:
    x = F.trim(x)
    return (F.length(x) > 1) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))


@predicate
def keywords(x: Column, asked: list[str]) -> Column:
    return F.forall(F.array(*[keyword_count(x, w) > 0 for w in asked]), lambda f: f)


@predicate
def keyword_frequency(x: Column, word: str, relation: str, n: int) -> Column:
    return related(keyword_count(x, word), relation, n)


@predicate
def keyword_once(x: Column, word: str) -> Column:
    return keyword_count(x, word) == 1


@predicate
def forbidden_words(x: Column, words_: list[str]) -> Column:
    return ~F.exists(F.array(*[keyword_count(x, w) > 0 for w in words_]), lambda f: f)


@predicate
def exclude_word_harder(x: Column, word: str) -> Column:
    return ~F.contains(F.concat(F.lit(" "), F.lower(x), F.lit(" ")), F.lit(f" {word.lower()} "))


@predicate
def count_increment_word(x: Column, once: str, twice: str) -> Column:
    return (keyword_count(x, once) == 1) & (keyword_count(x, twice) == 2)


@predicate
def each_keyword_in_range(x: Column, asked: list[str], low: int, high: int) -> Column:
    return F.forall(F.array(*[inside(keyword_count(x, w), low, high) for w in asked]), lambda f: f)


@predicate
def total_keyword_in_range(x: Column, asked: list[str], low: int, high: int) -> Column:
    return inside(sum((keyword_count(x, w) for w in asked[1:]), keyword_count(x, asked[0])), low, high)


@predicate
def keyword_specific_position(x: Column, word: str, sentence: int, at: int) -> Column:
    found = F.get(words(F.get(sentences(x), sentence - 1)), at - 1)
    return F.coalesce(F.lower(found) == word.lower(), F.lit(False))


@predicate
def constrained_response(x: Column, options: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, options)), lambda o: F.contains(x, o))


@predicate
def constrained_start(x: Column, start: str) -> Column:
    return F.regexp_like(x, F.lit(rf"(?im)^\s*\Q{start}\E"))


@predicate
def end_phrase(x: Column, end: str) -> Column:
    return F.endswith(F.lower(F.btrim(F.trim(x), F.lit('"'))), F.lit(end.strip().lower()))


@predicate
def start_end_same(x: Column) -> Column:
    w = words(F.lower(x))
    return (F.size(w) > 0) & (F.get(w, 0) == F.get(w, F.size(w) - 1))


@predicate
def first_word_answer(x: Column, word: str) -> Column:
    return F.coalesce(F.get(words(F.lower(x)), 0) == word.lower(), F.lit(False))


@predicate
def last_word_answer(x: Column, word: str) -> Column:
    w = words(F.lower(x))
    return F.coalesce(F.get(w, F.size(w) - 1) == word.lower(), F.lit(False))


@predicate
def first_word_each_sentence(x: Column, word: str) -> Column:
    return F.forall(sentences(F.lower(x)), lambda s: F.coalesce(F.get(words(s), 0) == word.lower(), F.lit(False)))


@predicate
def last_word_each_sentence(x: Column, word: str) -> Column:
    return F.forall(sentences(F.lower(x)), lambda s: F.coalesce(F.get(words(s), F.size(words(s)) - 1) == word.lower(), F.lit(False)))


@predicate
def paragraph_first_word(x: Column, n: int, number: int, word: str) -> Column:
    p = paragraphs(x)
    return (F.size(p) == n) & F.coalesce(F.get(words(F.lower(F.get(p, number - 1))), 0) == word.lower(), F.lit(False))


@predicate
def each_sentence_begins(x: Column, start: str) -> Column:
    return F.forall(sentences(x), lambda s: F.startswith(F.trim(s), F.lit(start)))


@predicate
def each_sentence_ends(x: Column, end: str) -> Column:
    return F.forall(sentences(x), lambda s: F.endswith(F.trim(s), F.lit(end)))


@predicate
def each_paragraph_begins(x: Column, start: str) -> Column:
    return F.forall(paragraphs(x), lambda p: F.startswith(F.trim(p), F.lit(start)))


@predicate
def each_paragraph_ends(x: Column, end: str) -> Column:
    return F.forall(paragraphs(x), lambda p: F.endswith(F.trim(p), F.lit(end)))


@predicate
def whole_begins(x: Column, start: str) -> Column:
    return F.startswith(F.trim(x), F.lit(start))


@predicate
def whole_ends(x: Column, end: str) -> Column:
    return F.endswith(F.trim(x), F.lit(end))


@predicate
def multiset_overlap(x: Column, original: Column, low: int, high: int) -> Column:
    """The number of words that both have, each as often as in both, lies in a range."""
    a, b = words(F.lower(x)), words(F.lower(original))
    count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    return inside(F.aggregate(F.array_distinct(a), F.lit(0), lambda t, w: t + F.least(count(a, w), count(b, w))), low, high)


@predicate
def repeat_prompt(x: Column, prompt: str) -> Column:
    return F.startswith(F.lower(F.trim(x)), F.lit(prompt.strip().lower()))


@predicate
def copy_text(x: Column, original: str) -> Column:
    return F.lower(F.trim(x)) == original.strip().lower()


@predicate
def copy_span(x: Column, original: str, first: int, past: int) -> Column:
    return F.lower(F.trim(x)) == original[first:past].strip().lower()


@predicate
def copying(x: Column, original: str, n: int) -> Column:
    return F.trim(x) == "\n".join([original.strip()] * n)


@predicate
def no_comma(x: Column) -> Column:
    return ~F.contains(x, F.lit(","))


@predicate
def no_dot(x: Column) -> Column:
    return ~F.contains(x, F.lit("."))


@predicate
def no_exclamation(x: Column) -> Column:
    return ~F.contains(x, F.lit("!"))


@predicate
def adjacent_letter(x: Column) -> Column:
    """No two words in a row begin with the same letter."""
    first = F.transform(words(F.lower(x)), lambda w: F.left(w, F.lit(1)))
    return ~F.exists(F.zip_with(first, F.slice(first, 2, F.greatest(F.size(first), F.lit(1))), lambda a, b: a == b), lambda f: F.coalesce(f, F.lit(False)))


@predicate
def palindrome(x: Column) -> Column:
    return F.exists(words(F.lower(x)), lambda w: (F.length(w) > 1) & (w == F.reverse(w)))


@predicate
def without(x: Column, parts: list[str]) -> Column:
    return ~F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(x, p))


@predicate
def percentage_precision(x: Column, digits: int) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)\s?%"), 1)
    return F.forall(found, lambda n: F.length(F.regexp_extract(n, r"\.(\d+)", 1)) == digits)


@predicate
def number_precision(x: Column, digits: int) -> Column:
    return F.forall(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), 0), lambda n: F.length(F.regexp_extract(n, r"\.(\d+)", 1)) == digits)


@predicate
def no_arabic_number(x: Column) -> Column:
    return ~F.regexp_like(x, F.lit("[0-9]"))


@predicate
def bigram_wrapping(x: Column) -> Column:
    """The text is wrapped two words at a time: <<a b>> <<c d>>."""
    return F.regexp_like(F.trim(x), F.lit(r"^(<<\S+ \S+>>)(\s+<<\S+( \S+)?>>)*$"))


@predicate
def sentence_hyphen(x: Column) -> Column:
    """Sentences are joined by hyphens without spaces."""
    return F.contains(x, F.lit("-")) & ~F.regexp_like(x, F.lit(r"\s-|-\s|[.!?]\s+\S"))


@predicate
def repeat_phrase(x: Column, phrase: str, n: int) -> Column:
    """The phrase's first and last word stand n times with something between."""
    first, *_, last = phrase.split() if len(phrase.split()) > 1 else [phrase, phrase]
    return F.regexp_count(x, F.lit(rf"\Q{first}\E.*?\Q{last}\E")) == n


def follows(x: Column, checks: list[tuple[str, dict]]) -> Column:
    """The share of checks (name, arguments) that a response follows; unknown names count as not followed."""
    hits = [PREDICATES[name](x, **how).cast("double") if name in PREDICATES else F.lit(0.0) for name, how in checks]
    return sum(hits[1:], hits[0]) / len(hits)
