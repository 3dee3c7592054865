"""Hand-computed cases of the closed forms and of the quirks that results depend on."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corveil.functions import answers as A
from corveil.functions import assignment, constraints, parse
from corveil.functions import text as T
from corveil.operators import advantages, balance, batch, formatting, losses, metrics, responses, rewards, sampling


def one(spark, column, **values):
    """The value of a Column over one row."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (0,)], schema).select(column.alias("v")).first()["v"]


def group(spark, rows):
    return spark.createDataFrame([(u, i, float(s), n) for i, (u, s, n) in enumerate(rows)], "uid string, idx long, score double, length long")


def got(df):
    return {r["idx"]: r["advantage"] for r in df.collect()}


@pytest.mark.parametrize(
    ("name", "how", "rows", "want"),
    [
        ("grpo", {"by_std": False}, [("a", 1, 1), ("a", 0, 1)], [0.5, -0.5]),
        ("grpo", {}, [("a", 2, 1)], [2 / (1 + 1e-6)]),
        ("rloo", {}, [("a", 1, 1), ("a", 0, 1)], [1, -1]),
        ("rloo", {}, [("a", 0.7, 1)], [0.7]),
        ("rloo_vectorized", {}, [("a", 0.7, 1)], [0]),
        ("opo", {}, [("a", 1, 1), ("a", 0, 3)], [0.75, -0.25]),
        ("grpo_vectorized", {}, [("a", 1, 1), ("a", 1, 1)], [0, 0]),
        ("gpg", {}, [("a", 1, 1), ("a", 0, 1)], [1, -1]),
        ("grpo_passk", {"by_std": False}, [("a", 1, 1), ("a", 3, 1), ("a", 2, 1)], [0, 1, 0]),
    ],
)
def test_group_estimators(spark, name, how, rows, want):
    found = got(advantages.estimate(name, group(spark, rows), **how))
    assert [found[i] for i in range(len(want))] == pytest.approx(want)


def test_passk_needs_two(spark):
    with pytest.raises(Exception, match="at least two"):
        advantages.estimate("grpo_passk", group(spark, [("a", 1, 1)])).collect()


def test_registry():
    with pytest.raises(ValueError, match="unknown"):
        advantages.estimate("nothing", None)
    with pytest.raises(ValueError, match="twice"):
        advantages.register("grpo")(lambda df: df)


def test_two_forms_agree(spark):
    rng = np.random.default_rng(0)
    d = group(spark, [(f"u{i % 7}", rng.normal(), 1) for i in range(60)])
    for a, b in (("grpo", "grpo_vectorized"), ("rloo", "rloo_vectorized")):
        x, y = got(advantages.estimate(a, d)), got(advantages.estimate(b, d))
        assert all(x[k] == pytest.approx(y[k], abs=1e-5) for k in x)


def test_gae_carries_over_masked_tokens(spark):
    rewards_, values, mask = [0.0, 1.0, 5.0, 2.0], [0.5, 0.2, 9.0, 0.1], [1.0, 1.0, 0.0, 1.0]
    next_, last, out = 0.0, 0.0, []
    for r, v, m in zip(reversed(rewards_), reversed(values), reversed(mask)):
        new = r + 0.9 * next_ - v + 0.9 * 0.8 * last
        last, next_ = new * m + last * (1 - m), v * m + next_ * (1 - m)
        out.append(last)
    d = spark.createDataFrame([(rewards_, values, mask)], "rewards array<double>, values array<double>, mask array<double>")
    r = advantages.gae(d, gamma=0.9, lam=0.8).first()
    assert r["returns"] == pytest.approx([a + v for a, v in zip(reversed(out), values)])
    kept = [a for a, m in zip(reversed(out), mask) if m]
    white = [(a - np.mean(kept)) / math.sqrt(np.var(kept, ddof=1) + 1e-8) * m for a, m in zip(reversed(out), mask)]
    assert r["advantages"] == pytest.approx(white, abs=1e-6)


def test_losses(spark):
    d = spark.createDataFrame([(1, 1, -1.0, -2.0, 1.0, 1.0), (1, 2, -3.0, -1.0, -1.0, 1.0), (2, 1, -1.0, -1.0, 2.0, 0.0)], "row_id long, pos long, logp double, old_logp double, advantage double, mask double")
    v = {(r["row_id"], r["pos"]): r["loss"] for r in losses.vanilla(d).collect()}
    assert v[1, 1] == pytest.approx(-1.2) and v[1, 2] == pytest.approx(0.8)
    assert losses.aggregate_loss(losses.vanilla(d), "loss", "token-mean").first()["loss"] == pytest.approx(-0.2)
    assert one(spark, losses.kl_penalty(F.lit(-1.0), F.lit(-2.0), "k3+")) == pytest.approx(math.exp(-1) + 1 - 1)
    with pytest.raises(ValueError, match="unknown"):
        losses.aggregate_loss(d, "advantage", "none")
    with pytest.raises(ValueError, match="unknown"):
        losses.kl_penalty(F.lit(1), F.lit(1), "none")
    assert one(spark, losses.adaptive_kl(F.array(F.lit(1.0), F.lit(0.0)), 0.2, 0.5, 10.0, 5)) == pytest.approx([0.2 * 1.1, 0.2 * 1.1 * 0.9])


def test_metrics(spark):
    d = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)], "name string, value double")
    assert {r["name"]: r["value"] for r in metrics.reduce_metrics(d).collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}
    votes = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2)], "k int, vote string, value double, at int")
    assert metrics.majority(votes, ["k"], "vote", "value", "at").first()["value"] == 0.9
    arrived = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "x int, at int")
    assert arrived.agg(metrics.median_arrival(F.col("x"), F.col("at")).alias("m")).first()["m"] == 1
    assert one(spark, T.pass_at_k(F.lit(4), F.lit(2), 2)) == pytest.approx(1 - 1 / 6)
    with pytest.raises(ValueError, match="unknown"):
        metrics.aggregate("none")
    same = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "p string, g string")
    assert metrics.bleu(same, "p", "g").first()["bleu"] == pytest.approx(100)
    other = spark.createDataFrame([("the cat sat on a mat today", "the cat sat on the mat")], "p string, g string")
    assert metrics.bleu(other, "p", "g").first()["bleu"] == pytest.approx(100 * (5 / 7 * 3 / 6 * 2 / 5 * 1 / 4) ** 0.25)


def test_metric_registry():
    assert metrics.metric("exact_match", "generate_until") == ("mean", True) and metrics.metric("perplexity", "loglikelihood") == ("perplexity", False)
    assert all(how in metrics.AGGREGATES for _, how, _ in metrics.METRICS.values())
    for name, kind in (("acc", "generate_until"), ("none", "loglikelihood")):
        with pytest.raises(ValueError, match="no metric"):
            metrics.metric(name, kind)


def test_bootstraps(spark):
    d = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    error = metrics.bootstrap_stderr(d, "x", "id", 300).first()["stderr"]
    assert error == pytest.approx(math.sqrt(8.25 / 400), rel=0.2)
    groups = d.filter("id < 20").select((F.col("id") % 2).alias("g"), "id", "x")
    rows = metrics.best_worst(groups, ["g"], "x", "id", [1, 4]).collect()
    assert len(rows) == 4 and all(r["worst_mean"] <= r["best_mean"] + 1e-9 for r in rows)
    # Against every possible draw.
    small = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 7.0)], "g string, id long, x double")
    r = metrics.best_worst(small, ["g"], "x", "id", [3]).first()
    best = [max(d) for d in itertools.product([3.0, 1.0, 1.0, 7.0], repeat=3)]
    worst = [min(d) for d in itertools.product([3.0, 1.0, 1.0, 7.0], repeat=3)]
    assert (r["best_mean"], r["best_std"], r["worst_mean"], r["worst_std"]) == pytest.approx((np.mean(best), np.std(best), np.mean(worst), np.std(worst)))


@pytest.mark.parametrize(
    ("response", "kind", "want"),
    [
        ("<think>a</think><answer>b</answer>", "other", 1.0), ("<think>a</think>\n<answer>\\boxed{b}</answer>", "numeric", 1.0), ("<think>a</think><answer>b</answer>", "numeric", 0.5), ("<think> </think><answer>b</answer>", "other", 0.0),
        ("<think>a</think><answer> </answer>", "other", 0.0), ("<answer>b</answer>", "other", 0.0), ("<think>a</think><answer>b</answer> tail", "other", 0.0), ("<think>a</think><answer>b</answer><answer>c</answer>", "other", 0.0),
        ("<think>a</think><answer>\\boxed{1}\\boxed{2}</answer>", "grounding", 0.5), ("<think>a</think><answer>\\boxed[1]</answer>", "grounding", 1.0), ("", "other", 0.0), (None, "other", 0.0),
    ],
)
def test_format(spark, response, kind, want):
    assert one(spark, rewards.format_reward(F.col("r"), F.lit(kind)), r=("string", response)) == want


def test_rewards(spark):
    lit = F.lit
    assert [one(spark, rewards.total_reward(lit(a), lit(f), 0.2)) for a, f in ((1.0, 1.0), (1.0, 0.0), (1.0, 0.5))] == pytest.approx([1.0, 0.0, 0.9])
    assert one(spark, rewards.overlong_penalty(lit(15360))) == pytest.approx(-0.5)
    assert one(spark, T.number_list_score(lit("1, 3, 2"), lit("1,2,3"))) == pytest.approx(0.2 / 3)
    assert [one(spark, T.judge_score(lit(x))) for x in ('{"SCORE": 10}', "Score: 1", "5 it is", "none")] == [1.0, 0.0, pytest.approx(4 / 9), None]
    assert one(spark, rewards.box_score(lit(0.5), lit(0.5), lit(1.0), lit(1.0))) == pytest.approx(0.375)
    assert one(spark, rewards.token_rewards(lit(3), lit(0.7))) == [0.0, 0.0, 0.7]
    cases = [("<answer>\\boxed{1,000}</answer>", "1000", "numeric", 1), ("<answer>The Cat!</answer>", "cat", "string_match", 1), ("<answer>(B) yes</answer>", "B", "multiple_choice", 1), ("<answer>x</answer>", "y|x", "list_match", 1), ("<answer>3 2 1</answer>", "1 2 3", "ordering", 0.2 / 3), ("<answer>a</answer>", "b", "exact_match", 0), ("<answer>Yes</answer>", "yes", "new", 1), ("x", "x", "llm_judge", 0)]
    for pred, gold, kind, want in cases:
        assert one(spark, rewards.accuracy(lit(pred), lit(gold), lit(kind))) == pytest.approx(want), (pred, kind)
    assert one(spark, rewards.web_action(lit('{"ACTION":"CLICK","MARK":3,"VALUE":"a"}'), lit('{"ACTION":"click","MARK":-1,"VALUE":"None"}'))) == 1.0


def test_text(spark):
    assert one(spark, T.strip_string(F.lit(" Answer:  '$1,200.' "))) == "1200"
    assert one(spark, T.normalize_text(F.lit("The 1,200.00 Cats"))) == "1200 cats"
    assert one(spark, T.normalize_text(F.lit("A"))) == "a"
    assert one(spark, T.anls(F.lit("abc"), F.array(F.lit("abd"), F.lit("zzz")))) == pytest.approx(2 / 3)
    assert one(spark, T.sanitize(F.lit("..a b/c.."), "x")) == "a_b_c" and one(spark, T.sanitize(F.lit("__"), "x")) == "x"
    assert one(spark, T.words_to_numbers(F.lit("Two of ten"))) == "2 of 10"
    assert one(spark, T.to_number(F.lit("3/4"))) == 0.75 and one(spark, T.to_number(F.lit("x"))) is None and one(spark, T.to_number(F.lit("1/0"))) is None


def test_batches(spark):
    d = batch.numbered(spark.range(5), ["id"])
    assert sorted((r["_idx"], r["id"]) for r in d.collect()) == [(i, i) for i in range(5)]
    p = batch.pad(d, 4).collect()
    assert len(p) == 8 and sorted(r["id"] for r in p if r["_pad"]) == [0, 1, 2]
    assert batch.unpad(batch.pad(d, 4)).count() == 5 and batch.pad(batch.numbered(spark.range(2), ["id"]), 7).count() == 7
    with pytest.raises(ValueError, match="divide"):
        batch.chunk(d, 2)
    back = batch.unfold(batch.fold(d.withColumn("x", F.col("id") * 2), 2, ["x"]), 2, ["x"])
    assert sorted((r["_idx"], r["x"]) for r in back.collect()) == [(i, 2 * i) for i in range(5)]
    tiled = batch.repeat(d, 2, interleave=False)
    assert [r["id"] for r in tiled.orderBy("_new").collect()] == [0, 1, 2, 3, 4] * 2
    assert [r["id"] for r in batch.repeat(d, 2).orderBy("_new").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(d, d.withColumn("id", F.col("id") + 1)).collect()
    assert one(spark, batch.pad_or_cut(F.array(*map(F.lit, range(5))), 4, 0, cut="middle")) == [0, 1, 3, 4]
    assert one(spark, batch.pad_or_cut(F.array(F.lit(1)), 3, 0)) == [0, 0, 1]
    assert one(spark, batch.eos_mask(F.array(*map(F.lit, [4, 2, 7, 2])), [2, 9])) == [1, 1, 0, 0]


def test_sampling(spark):
    assert sampling.quotas({c: 1 / 6 for c in "abcdef"}, 256) == {"a": 43, "b": 43, "c": 43, "d": 43, "e": 42, "f": 42}
    assert sampling.parse_weights("a:1, b:3,c:0") == {"a": 0.25, "b": 0.75}
    with pytest.raises(ValueError, match="positive"):
        sampling.parse_weights('{"a": 0}')
    d = spark.range(40).select("id", F.when(F.col("id") < 30, "a").otherwise("b").alias("domain"))
    rows = sampling.domain_batches(d, "domain", "id", {"a": 0.5, "b": 0.25, "gone": 0.25}, 6).collect()
    assert len(rows) == 36 and len({(r["batch"], r["slot"]) for r in rows}) == 36
    assert all(sum(r["domain"] == "a" for r in rows if r["batch"] == b) == 4 for b in range(6))
    shots = sampling.few_shot(d, d, "id", 3).collect()
    assert len(shots) == 120 and all(r["id"] != r["example"] for r in shots)
    w = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id long, w double")
    drawn = [r["id"] for r in sampling.weighted_draws(w, "id", "w", 2000).collect()]
    assert len(drawn) == 2000 and drawn.count(3) == 0 and drawn.count(2) == pytest.approx(1500, rel=0.1)


def test_balance():
    rng = np.random.default_rng(2)
    for equal in (False, True):
        lengths = rng.integers(1, 100, 24).tolist()
        parts = balance.differencing(lengths, 4, equal)
        loads = [sum(n for n, p in zip(lengths, parts) if p == k) for k in range(4)]
        assert max(loads) - min(loads) <= max(lengths) and (not equal or all(parts.count(k) == 6 for k in range(4)))
    assert balance.differencing([8, 7, 6, 5, 4], 2) in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 1, 0, 1], [1, 0, 0, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])
    assert balance.least_loaded([5, 1, 1, 9], 2) == [0, 1, 1, 1]
    with pytest.raises(ValueError, match="divide"):
        balance.differencing([1, 2, 3], 2, True)


def test_assignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        pairs = assignment.assign(cost)
        small, large = min(n, m), max(n, m)
        best = min(sum(cost[i, p] if n <= m else cost[p, i] for i, p in enumerate(perm)) for perm in itertools.permutations(range(large), small))
        assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)
    assert assignment.match_counts([[0, 0, 1, 1]], [])[:3] == (0, 1, 0)
    assert assignment.match_counts([[0, 0, 2, 2], [5, 5, 6, 6]], [[0, 0, 2, 2]])[:3] == (1, 1, 0)


def test_response_filters(spark):
    r = F.array(*map(F.lit, [" b", "a", "a", "x 3 \\boxed{7}", "<think>q</think> z"]))
    assert one(spark, responses.majority_vote(r)) == ["a"] and one(spark, responses.drop_space(r))[0] == "b"
    assert one(spark, responses.boxed(r))[3] == "7" and one(spark, responses.strict_boxed(r))[1] == "" and one(spark, responses.after_think(r))[4] == "z"
    assert one(spark, responses.regex(r"(\d)", select=-1)(r)) == ["[invalid]", "[invalid]", "[invalid]", "7", "[invalid]"]
    with pytest.raises(Exception, match="fewer"):
        one(spark, responses.take_first_k(9)(r))


def test_formatting(spark):
    zipped = one(spark, formatting.zip_messages(F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.array(F.lit("s"), F.lit("q"), F.lit("a"))))
    assert [tuple(m) for m in zipped] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    p = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "q"), ("assistant", "a"))])
    assert one(spark, formatting.render(formatting.trim_ends(p))) == "User: q"
    parts = one(spark, formatting.typed_parts(F.lit("a<image>b<video>")))
    assert [tuple(x) for x in parts] == [("text", "a"), ("image", None), ("text", "b"), ("video", None)]
    assert one(spark, formatting.part_text(formatting.typed_parts(F.lit("a<image>b<video>")))) == "a<image>b<video>"
    assert one(spark, formatting.question_filtered(F.lit(json.dumps({"language_filter": "True"})))) is True and one(spark, formatting.question_filtered(F.lit("junk"))) is False
    assert [one(spark, c) for c in formatting.scale_box([F.lit(50.0), F.lit(20.0), F.lit(0.5), F.lit(500.0)], F.lit(100), F.lit(200))] == [5, 100, 500, 1000]
    row = one(spark, formatting.format_row(F.lit("c"), F.lit("s"), F.lit(7), F.lit(""), F.lit(None).cast("string"), F.array().cast(formatting.MESSAGES), F.lit("a"), F.lit("rule"), F.lit(None).cast("string"), F.lit("why?"), F.lit("b"), F.lit("numeric"), F.lit("x")))
    assert row["id"] == "c_s_7" and row["data_source"] == "" and row["prompt"][0]["content"] == "why?" and row["extra_info"]["tolerance"] is None and row["reward_model"]["ground_truth"] == ""


@pytest.mark.parametrize(
    ("name", "how", "good", "bad"),
    [
        ("number_words", {"relation": "less than", "n": 3}, "a b", "a b c"), ("number_sentences", {"relation": "at least", "n": 2}, "A b. C d!", "A b."), ("paragraph_number_in_range", {"low": 2, "high": 2}, "a\n\nb", "a"),
        ("each_paragraph_word_count_in_range", {"low": 1, "high": 2}, "a b\n\nc", "a b c"), ("capital_letters", {}, "ABC 1", "ABc"), ("lowercase_letters", {}, "abc", "aBc"), ("letter_frequency", {"letter": "a", "relation": "at least", "n": 2}, "banana", "bin"),
        ("placeholder", {"n": 1}, "see [name]", "see"), ("square_bracket", {}, "[a]", "a"), ("bullet_list", {"n": 2}, "* a\n- b", "* a"), ("highlight_section", {"n": 1}, "*a*", "a"), ("section", {"splitter": "Part", "n": 2}, "Part 1 x Part 2", "Part 1"),
        ("paragraph_stars", {"n": 2}, "a *** b", "a"), ("postscript", {"marker": "P.S."}, "x\nP.S. y", "x"), ("title", {}, "<<T>>", "<< >>"), ("json_format", {}, '```json\n{"a":1}\n```', "{a"), ("two_responses", {}, "a ****** b", "a ****** a"), ("quotation", {}, '"a"', "a"),
        ("keywords", {"asked": ["cat", "dog"]}, "Cat dog", "cat"), ("forbidden_words", {"words_": ["cat"]}, "dog", "a cat"), ("keyword_once", {"word": "a"}, "a b", "a a"), ("exclude_word_harder", {"word": "cat"}, "cats", "the cat is"),
        ("count_increment_word", {"once": "a", "twice": "b"}, "a b b", "a b"), ("keyword_specific_position", {"word": "c", "sentence": 2, "at": 1}, "A b. C d.", "A b. D c."), ("end_phrase", {"end": "Bye"}, 'x bye"', "x"), ("start_end_same", {}, "a b a", "a b"),
        ("first_word_each_sentence", {"word": "a"}, "A b. A c.", "A b. C."), ("last_word_each_sentence", {"word": "b"}, "A b. C b.", "A b. C."), ("paragraph_first_word", {"n": 2, "number": 2, "word": "c"}, "a\n\nC d", "a\n\nd"), ("each_paragraph_ends", {"end": "."}, "a.\n\nb.", "a\n\nb."),
        ("repeat_prompt", {"prompt": "Hi"}, "hi there", "there"), ("copying", {"original": "a", "n": 2}, "a\na", "a"), ("no_comma", {}, "a", "a,b"), ("adjacent_letter", {}, "ab cd", "ab ac"), ("palindrome", {}, "a level b", "a b"),
        ("percentage_precision", {"digits": 1}, "5.5% and 1.0 %", "5%"), ("number_precision", {"digits": 2}, "1.25", "1.2"), ("bigram_wrapping", {}, "<<a b>> <<c d>>", "a b"), ("copy_span", {"original": "abcdef", "first": 1, "past": 3}, "BC", "abc"),
        ("total_keyword_in_range", {"asked": ["a", "b"], "low": 2, "high": 3}, "a b", "a"), ("count_unique", {}, "a b c", "a b a"), ("no_arabic_number", {}, "a", "a1"), ("constrained_response", {"options": ["yes", "no"]}, "yes!", "maybe"),
    ],
)
def test_constraints(spark, name, how, good, bad):
    p = constraints.PREDICATES[name]
    assert one(spark, p(F.col("t"), **how), t=("string", good)) is True
    assert one(spark, p(F.col("t"), **how), t=("string", bad)) is False


def test_unknown_relation():
    with pytest.raises(ValueError, match="relation"):
        constraints.related(None, "at most", 3)


def test_vqa_norm(spark):
    """Goldens: periods before anything but a digit go, contractions follow the fixed table, two-step forms included."""
    want = {"it is 5.": "it is 5", "5 oclock.": "5 o'clock", "lets go": "lets go", "couldnt've": "couldn't've", "3.5 m.": "3.5 m", "a cat, the dog": "cat dog", "None": "0", "Ten men": "10 men", "dont; stop": "don't stop", "x/y": "x y", "the man's hat": "man 's hat", "": "", "...": "", "youre\tok?": "you're ok"}
    d = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r["x"]: r["y"] for r in d.select("x", A.vqa_norm(F.col("x")).alias("y")).collect()} == want
    assert spark.createDataFrame([("." * 40,)], "x string").select(A.vqa_norm(F.col("x"))).first()[0] == "." * 8


@pytest.mark.parametrize("k", [1, 7, 300, 999, 1000, 5000])
def test_highest(spark, k):
    """Ties across the border go by the order columns; more rows than there are give all."""
    rows = [(i, float(i * 7919 % 40) if i % 3 else -1.5) for i in range(1000)]
    d = spark.createDataFrame(rows, "i long, x double")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    out = batch.highest(d, "x", k, ["i"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert out.columns == ["i", "x"] and batch.highest(d.limit(0), "x", k, ["i"]).count() == 0


def test_fenced_arrays(spark):
    """A fenced block that is no JSON gives way to the first array of objects, and that to null."""
    rows = {
        '```json\n[{"a": 1}]\n```': '[{"a": 1}]',
        "```\n[1, 2]\n```": "[1, 2]",
        '```json\n[oops]\n``` but [{"b": 2}]': '[{"b": 2}]',
        "```json\n[oops]\n``` and [{b}]": None,
        "[{b}]": None,
        'x [ {"c": [1]} ] y': '[ {"c": [1]} ]',
        "nothing": None,
        "": None,
    }
    d = spark.createDataFrame([(k,) for k in rows], "x string")
    assert {r["x"]: r["y"] for r in d.select("x", parse.json_fenced(F.col("x")).alias("y")).collect()} == rows


def test_final_answer_without_wrappers(spark):
    rows = {r"\text{a {b}}": "a {b}", r"\text{\text{q}}": "q", r"\boxed{\text{\text{ x }}}": "x", r"\text{a} b": r"\text{a} b", r"\text{a}{b}": r"\text{a}{b}", "<answer>\\text{ yes }</answer>": "yes", "plain": "plain"}
    d = spark.createDataFrame([(k,) for k in rows], "x string")
    assert {r["x"]: r["y"] for r in d.select("x", A.final_answer(F.col("x")).alias("y")).collect()} == rows
