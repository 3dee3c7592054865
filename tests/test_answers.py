"""Hand-worked cases of the answer functions, from the reference's described behaviour."""

import pytest
from pyspark.sql import functions as F

from corveil.functions import answers as A
from corveil.functions import parse
from corveil.functions import text as T
from corveil.operators import batch, formatting, metrics, responses, rewards, sampling


@pytest.fixture(scope="module")
def values(spark):
    def run(*columns):
        return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())

    return run


def lit(*texts):
    return [F.lit(t) for t in texts]


def test_boxes(spark):
    cases = {"\\boxed{\\frac{1}{2}}": ["\\frac{1}{2}"], "\\boxed {\\text{ab}} and \\boxed{3": ["ab"], "\\boxed{a\\boxed{b}} \\boxed{c}": ["a\\boxed{b}", "c"], "\\boxed[1] \\boxed{2}": ["2"], "boxed{1}": [], "": [], "\\boxed{\\text{a}b}": ["\\text{a}b"], "\\boxed{ }": [""]}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "x string").select("x", A.boxed("x").alias("b")).collect()
    assert {r["x"]: r["b"] for r in rows} == {**cases, None: None}
    rows = spark.createDataFrame([("\\boxed[a[b]] \\boxed{c}",), ("\\boxed[a",), (None,)], "x string").select(A.bracket_box("x").alias("b")).collect()
    assert [r["b"] for r in rows] == ["a[b]", None, None]


def test_final_answers(spark):
    cases = [("<think>x</think><answer> \\boxed{\\frac{1}{2}} </answer>", "\\frac{1}{2}"), ("t</think> so", "so"), ("\\boxed{1}\\boxed{\\text{ b }}", "b"), ("</answer><answer>x", "x"), ("  ", ""), (None, "")]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string").select("k", A.final_answer(F.col("x")).alias("a")).sort("k").collect()
    assert [r["a"] for r in rows] == [a for _, a in cases]


def test_extracted_answers_are_stripped(values):
    assert values(T.extract_answer(F.lit("<answer> \n a b\n</answer>")), T.extract_answer(F.lit(" all \n"))) == ["a b", "all"]


def test_nested_boxes_in_rewards(values):
    good = F.lit("<think>a</think><answer>\\boxed{\\frac{1}{2}}</answer>")
    assert values(rewards.format_reward(good, F.lit("numeric")), rewards.accuracy(good, F.lit("\\frac{1}{2}"), F.lit("string_match")), rewards.accuracy(F.lit("\\boxed{\\text{Yes}}"), F.lit("yes"), F.lit("string_match"))) == [1.0, 1.0, 1.0]


def test_options(values):
    o = F.create_map(*lit("A", "red house", "B", "blue boat"))
    cases = {"The answer is A": None, "A": "A", "Answer: A": "A", "it is (B)": "B", "a Blue boat here": "B", "Cannot determine the answer, A": "Z", "A or B": None, "Z": "Z", "red house and blue boat": None}
    assert values(*[A.infer_option(F.lit(x), o) for x in cases]) == list(cases.values())
    assert values(A.judged_option(F.lit("hm"), o, F.lit('{"answer": "B"}')), A.judged_option(F.lit("B"), o, F.lit("A")), A.judged_option(F.lit("hm"), o, F.lit(None).cast("string"))) == ["B", "B", None]
    cases = {"(B) yes": "B", "I say (A) or (B)": "B", "c": None, "B.": "B", "we saw here one blue boat there": "B", "": None}
    assert values(*[A.bracketed_choice(F.lit(x), F.create_map(*lit("A", "red house", "B", "blue boat", "X", "none"))) for x in cases]) == list(cases.values())
    assert values(F.to_json(parse.choices(F.lit("Which?\nA. red house\nB. blue\nA. new")))) == ['{"B":"blue","A":"new"}']


@pytest.mark.parametrize(("pred", "gold", "want"), [("23%", "0.23", True), ("23%", "23", True), ("0.5", "50", True), ("50", "0.5", True), ("1:2", "0.5", True), ("Abc.", "abc", True), ("10", "10.4", True), ("10", "11", False), ("", "x", False), ("0.04", "0", True), ("x", "1", False)])
def test_relaxed(values, pred, gold, want):
    assert values(A.relaxed(F.lit(pred), F.lit(gold))) == [want]


def test_counts(values):
    assert values(*[A.count(F.lit(x), last) for x, last in (("3 of 4", False), ("3 of 4", True), ("Twenty birds", False), ("two or three", True), ("none", False), ("-7", False), ("nothing", False))]) == [3, 4, 20, 3, 1, -7, None]


def test_normal_forms(values):
    assert values(*[A.format_norm(F.lit(x)) for x in ("$1,234.50", "+5", "a and  b & c", "6.0 %", ".5")]) == ["1234.5", "5", "a,b,c", "6", "0.5"]
    assert values(*[A.vqa_norm(F.lit(x)) for x in ("The Dog's two.", "dont, no!", "Yes? 1,000", "a/b c", "3.5")]) == ["dog 's 2", "don't no", "yes 1000", "b c", "3.5"]
    assert values(*[A.latex_norm(F.lit(x)) for x in ("\\dfrac12", "x = 3/4", "\\sqrt2", "0.5", ".25", "5^\\circ", "\\frac{a}{b}", "12\\text{ cm}")]) == ["\\frac{1}{2}", "\\frac{3}{4}", "\\sqrt{2}", "\\frac{1}{2}", "0.25", "5", "\\frac{a}{b}", "12"]
    assert A.parsed_args("a=1,b=True,c=x,d=1.5,") == {"a": 1, "b": True, "c": "x", "d": 1.5} and A.parsed_args(" ") == {}
    with pytest.raises(ValueError):
        A.escaped_split(F.lit("a"), "ab")


def test_passages_and_filters(values):
    assert values(parse.passages(F.array(*lit("T1\nbody\nmore", "T2")))) == ["Doc 1 (Title: T1)\nbody\nmore\n\nDoc 2 (Title: T2)"]
    r = F.array(*lit("#### 42", "the blue boat", "x: B", "hm"))
    assert values(responses.multi_choice(F.array(*lit("red house", "blue boat")))(r)) == [["42", "(B)", "(B)", "[invalid]"]]
    assert values(responses.option_letters(F.lit("Q?\nA. red house\nB. blue boat"))(F.array(*lit("the blue boat!", "B.")))) == [["B", "B"]]
    assert values(responses.boxed(F.array(*lit("\\boxed{a{b}}", "z"))), responses.strict_boxed(F.array(*lit("\\boxed{a{b}}", "z")))) == [["a{b}", "z"], ["a{b}", ""]]


def test_globs(values):
    cases = [("src1", "src*", True), ("src", "src?", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("b", "[!a]", True), ("a", "[!a]", False), ("[", "[", True), ("a\nb", "a*b", True), ("c", "[a-c]", True), ("^", "[^]", True)]
    assert values(*[T.globbed(F.lit(x), p) for x, p, _ in cases]) == [w for *_, w in cases]


def test_prompts(spark, values):
    text, cut = formatting.strip_system(F.lit("sys\n User \nhi\n<|im_start|>user\nx"))
    assert values(text, cut, *formatting.strip_system(F.lit("no mark"))) == ["User \nhi\n<|im_start|>user\nx", True, "no mark", False]
    assert values(formatting.strip_assistant(F.lit("x\n Assistant: \n")), formatting.strip_assistant(F.lit("x "))) == ["x", "x "]
    with pytest.raises(ValueError):
        formatting.rendered("{{ nothing }}", ["a"])
    assert values(formatting.readable_image(F.unhex(F.lit("89504E470D0A1A0A00"))), formatting.readable_image(F.lit(None).cast("binary"))) == [True, False]


def test_batches(spark):
    d = spark.range(10).withColumnRenamed("id", "_idx")
    assert [sorted(r["_idx"] for r in batch.sliced(d, 10, *s).collect()) for s in ((None, None, 3), (-3, None, None), (8, 2, -2), (5, 5, None))] == [[0, 3, 6, 9], [7, 8, 9], [4, 6, 8], []]
    with pytest.raises(ValueError):
        batch.minibatches(d, 10, 3, 1)
    with pytest.raises(Exception, match="divide"):
        batch.unfold_columns(spark.createDataFrame([(0, [1, 2, 3])], "_idx long, x array<int>"), 2, ["x"]).collect()
    tied = spark.createDataFrame([(1, k) for k in range(50)] + [(None, 99)], "a int, b int")
    assert sorted((r["_idx"], r["b"]) for r in batch.numbered(tied, ["a", "b"]).collect()) == [(0, 99), *((k + 1, k) for k in range(50))]
    assert batch.numbered(tied.limit(0), ["a", "b"]).count() == 0
    assert [sampling.sample_limit(10, x) for x in (None, 0.25, 3, 99)] == [10, 3, 3, 10]


def test_corpus_scores(spark):
    d = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c", "a x c")], "p string, g string")
    assert metrics.ter(d, "p", "g").first()["ter"] == pytest.approx(100 / 6)
    assert metrics.chrf(d.limit(1), "p", "g").first()["chrf"] == pytest.approx(100)
    assert metrics.chrf(spark.createDataFrame([("ab", "cd")], "p string, g string"), "p", "g").first()["chrf"] == 0


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("(A) is wrong. B", "B"),
        ("A", "A"),
        ("b.", "B"),
        ("I see. \\boxed{D}", "D"),
        ("\\boxed{\\text{(C)}} not B", "C"),
        ("It must be (C), not D: no", "C"),
        ("Not D: or C) hm", "D"),
        ("We take 3. C here", "C"),
        # Within the phrase the A of ANSWER comes first.
        ("The answer is C here", "A"),
        ("I pick D though", "C"),
        ("B-x is it", "B"),
        ("xx D= yy C_ zz", "D"),
        ("we think the lily is in the room", "D"),
        ("one two three violet rug six", "B"),
        ("oxy", None),
        ("hobby", "B"),
        ("  ", None),
        (None, None),
    ],
)
def test_ranked_letter(spark, said, want):
    options = F.create_map(*[F.lit(v) for v in ("A", "plum", "B", "violet rug", "C", "stone", "D", "lily")])
    assert spark.createDataFrame([(said,)], "x string").select(A.ranked_letter(F.col("x"), options).alias("v")).first()["v"] == want
