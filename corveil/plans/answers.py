"""Queries on final answers, their normal forms, choices, counts, and the row scores of benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corveil.functions import answers as A
from corveil.functions import constraints, mathexpr, parse
from corveil.operators import judging, responses
from corveil.plans.catalog import query, table

TEXT = "string"


def text(c: str):  # noqa: ANN201
    return F.col(c).cast(TEXT)


@query(r"""SELECT event_id, 2 AS boxes, '\frac{' || user_id || '}{' || (event_id % 9 + 1) || '}' AS first, event_type AS last, CASE WHEN event_id % 2 = 0 THEN '[' || user_id || ']' END AS brackets FROM events""")
def balanced_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_extract_boxed, fn_boxed_bracket, rf_boxed, rf_strict_boxed: nested braces, \\text unwrapped, an unbalanced box last."""
    i = F.col("event_id")
    x = F.concat(F.lit("so \\boxed{\\frac{"), text("user_id"), F.lit("}{"), (i % 9 + 1).cast(TEXT), F.lit("}} or \\boxed { \\text{"), "event_type", F.lit("} } and \\boxed{{open"))
    wrong = F.when(i % 2 == 0, F.concat(F.lit("\\boxed[1] then \\boxed [ ["), text("user_id"), F.lit("] ]"))).otherwise("\\boxed{2}")
    b = A.boxed(x)
    return table(spark, sf_dir, "events").select("event_id", F.size(b).alias("boxes"), F.get(b, 0).alias("first"), F.element_at(b, -1).alias("last"), A.bracket_box(wrong).alias("brackets"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{' || user_id || '}' WHEN 1 THEN 'u' || user_id WHEN 2 THEN event_type WHEN 3 THEN '' ELSE event_type || ' ' || user_id END AS answer FROM events""")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_final_answer, rf_after_think: answer tags over the text behind the thoughts over the last box over all."""
    k, u, e = F.col("event_id") % 5, text("user_id"), F.col("event_type")
    x = F.when(k == 0, F.concat(F.lit("<think>\\boxed{no}</think> <answer> it is \\boxed{{"), u, F.lit("}} </answer> \\boxed{no}")))
    x = x.when(k == 1, F.concat(F.lit("thought</think>\n u"), u, F.lit(" "))).when(k == 2, F.concat(F.lit("\\boxed{1} then \\boxed{ \\text{"), e, F.lit("} }"))).when(k == 3, "  ")
    x = x.otherwise(F.concat(F.lit("<answer>"), e, F.lit(" "), u, F.lit("</answer>")))
    return table(spark, sf_dir, "events").select("event_id", A.final_answer(x).alias("answer"))


@query("""SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN 3 WHEN 2 THEN -7 END::BIGINT AS first, CASE o_custkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN 10 WHEN 2 THEN -7 END::BIGINT AS last, CASE WHEN o_custkey % 4 = 0 THEN (o_custkey % 8 = 0)::INTEGER ELSE 0 END::DOUBLE AS exact FROM orders""")
def count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_int_extract, countqa, countbenchqa: integers first, then number words by the table's order; equality with the true count."""
    c, k = F.col("o_custkey"), F.col("o_custkey") % 4
    x = F.when(k == 0, F.concat(F.lit("I see "), c.cast(TEXT), F.lit(" of "), text("o_orderkey"))).when(k == 1, "Ten or three").when(k == 2, "about -7").otherwise("many")
    gold = F.when(c % 8 == 0, c).otherwise(-1)
    first = A.count(A.final_answer(x))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), A.count(x, last=True).alias("last"), F.coalesce((first == gold).cast("double"), F.lit(0.0)).alias("exact"))


@query("""WITH r AS (SELECT p_partkey, p_size, p_partkey % 2 = 0 AS human, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN (p_size = 0)::INTEGER WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END::DOUBLE AS score FROM part)
SELECT p_partkey, score AS overall, CASE WHEN human THEN score END AS human, CASE WHEN NOT human THEN score END AS augmented FROM r""")
def chart_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chartqa: relaxed equality of numbers, percentages, fractions, ratios and texts, split by the kind of question."""
    k, n = F.col("p_partkey") % 7, F.col("p_size")
    s = n.cast(TEXT)
    pred = F.when(k == 0, (n * 1.04).cast(TEXT)).when(k == 1, (n * 1.2).cast(TEXT)).when(k == 2, F.concat(s, F.lit("%"))).when(k == 3, F.concat((n * 100).cast(TEXT), F.lit("%")))
    pred = pred.when(k == 4, F.concat((n * 3).cast(TEXT), F.lit(":3"))).when(k == 5, F.concat(F.lit("Level "), "p_brand", F.lit("."))).otherwise("none")
    gold = F.when(k == 5, F.concat(F.lit("level "), "p_brand")).otherwise(s)
    score, human = A.relaxed(A.final_answer(pred), gold).cast("double"), F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("overall"), F.when(human, score).alias("human"), F.when(~human, score).alias("augmented"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 END::DOUBLE AS accuracy FROM part""")
def drawn_value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evochart: printed values must be equal, drawn ones lie within five per cent."""
    k, n = F.col("p_partkey") % 4, F.col("p_retailprice")
    pred = F.when(k == 0, F.format_string("%.2f units", n)).when(k == 1, F.format_string("%.2f", n * 1.02)).when(k == 2, F.format_string("%.2f", n * 1.02)).otherwise(F.lower("p_name"))
    gold = F.when(k == 3, F.upper("p_name")).otherwise(F.format_string("%.2f", n))
    return table(spark, sf_dir, "part").select("p_partkey", A.clear_or_near(pred, gold, k.isin(0, 1, 3)).alias("accuracy"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN (p_size % 2 = 0)::INTEGER WHEN 2 THEN 2 / 3.0 ELSE 0.5 END::DOUBLE AS score FROM part""")
def chart_list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chartqa_pro: relaxed numbers, exact years, lists element by element."""
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    year = (1990 + n).cast(TEXT)
    pred = F.when(k == 0, (n * 1.01).cast(TEXT)).when(k == 1, F.when(n % 2 == 0, year).otherwise("1980")).when(k == 2, F.concat(F.lit("["), n.cast(TEXT), F.lit(", 5]"))).otherwise(F.concat(F.lit("['"), F.col("p_brand"), F.lit("', 'zzzzzzzzzzzzzz']")))
    gold = F.when(k == 0, n.cast(TEXT)).when(k == 1, year).when(k == 2, F.concat(F.lit("["), n.cast(TEXT), F.lit(", 5, 77]"))).otherwise(F.concat(F.lit("["), F.col("p_brand"), F.lit(", 12]")))
    return table(spark, sf_dir, "part").select("p_partkey", A.list_or_year(pred, gold, k == 1).alias("score"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 - 1.0::DOUBLE / length(p_name) ELSE 0 END::DOUBLE AS anls FROM part WHERE length(p_name) > 4""")
def infographic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """infovqa: normal forms that agree, one wrong letter, another answer altogether."""
    k = F.col("p_partkey") % 3
    pred = F.when(k == 0, F.concat(F.lit("<answer>$"), F.format_string("%,d", F.col("p_partkey") + 1000), F.lit(" and 7.0 %</answer>"))).when(k == 1, F.concat(F.substring("p_name", 1, 3), F.lit("#"), F.expr("substring(p_name, 5)"))).otherwise("0")
    gold = F.when(k == 0, F.concat((F.col("p_partkey") + 1000).cast(TEXT), F.lit(", 7.0"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").filter("length(p_name) > 4").select("p_partkey", F.round(A.infographic_score(pred, F.array(F.lit("something else entirely"), gold)), 9).alias("anls"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'C' END AS choice, (event_id % 6 IN (0, 3))::INTEGER AS hit FROM events""")
def letter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blink, game_qa, embspatial, erqa, cv_bench: the last letter in brackets, before a space or period, else the option's text."""
    k, u = F.col("event_id") % 6, text("user_id")
    options = F.create_map(F.lit("A"), F.concat(F.lit("plum "), u), F.lit("B"), F.concat(F.lit("oven "), u), F.lit("C"), F.concat(F.lit("lily "), u))
    x = F.when(k == 0, "(A) no, (B)").when(k == 1, "<think>(A)</think> \\boxed{C}").when(k == 2, "It is A.").when(k == 3, "b").when(k == 4, F.concat(F.lit("we see here the Lily "), u, F.lit(" in the room"))).otherwise("none")
    choice = A.bracketed_choice(A.final_answer(x), options)
    return table(spark, sf_dir, "events").select("event_id", choice.alias("choice"), F.coalesce((choice == "B").cast("int"), F.lit(0)).alias("hit"))


MARKED = ", ".join(f"({rank}, {rule}, '{before}', '{behind}')" for rule, (rank, before, behind) in enumerate(A.LETTER_MARKS))
PHRASES = ", ".join(f"'{p}'" for p in A.CHOICE_PHRASES)


def ranked_letter_sql(rows: str, keys: str) -> str:
    """DuckDB SQL of the ranked letters A to D: rows gives (keys, x, texts by letter a to d)."""
    cleaned = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    for mark in ",.!?;:'\"":
        cleaned = f"trim({cleaned}, '{mark.replace(chr(39), chr(39) * 2)}')"
    return f"""
WITH r AS ({rows}), s AS (SELECT *, ' ' || {cleaned} || ' ' AS y FROM r), t AS (SELECT *, upper(y) AS u, lower(y) AS l, regexp_replace(upper(y), '^\\s+|\\s+$', '', 'g') AS bare FROM s),
o AS (SELECT t.*, v.k, v.c, CASE v.k WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c_ ELSE d END AS choice, list_min([strpos(l, p) for p in [{PHRASES}] if strpos(l, p) > 0]) AS spoken FROM t, (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D')) v(k, c)),
marks AS (SELECT o.*, m.rank, m.rule, m.before || o.c || m.behind AS mark FROM o, (VALUES {MARKED}) m(rank, rule, before, behind) UNION ALL SELECT *, 8, 11, k || '. ' || c FROM o UNION ALL SELECT *, 0, 13, c FROM o),
found AS (
  SELECT {keys}, rank, rule, k, c, length(u) - strpos(reverse(u), reverse(mark)) - length(mark) + 1 AS place FROM marks WHERE contains(u, mark)
  UNION ALL SELECT {keys}, 7, 8, k, c, spoken + strpos(substr(u, spoken), c) - 2 FROM o WHERE strpos(substr(u, spoken), c) > 0
  UNION ALL SELECT {keys}, 10, 9, k, c, 0 FROM o WHERE starts_with(bare, c) UNION ALL SELECT {keys}, 9, 10, k, c, length(y) - 1 FROM o WHERE suffix(bare, c)
  UNION ALL SELECT {keys}, 0.5, 12, k, c, length(l) - strpos(reverse(l), reverse(lower(choice))) - length(choice) + 1 FROM o WHERE contains(l, lower(choice)) AND len(regexp_split_to_array(trim(y), '\\s+')) > 5
)
SELECT {keys}, c AS letter FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank DESC, place, rule, k) AS n FROM found) WHERE n = 1"""


LETTERED = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN role || ' (b) ' || text WHEN 2 THEN 'Answer: ' || text || ' Option is d' ELSE '3. C, or ' || text END AS x, 'than' AS a, 'the end' AS b, role AS c_, 'in there' AS d FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"


@query(ranked_letter_sql(LETTERED, "conv_id, turn"))
def ranked_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmmu_pro choices, fn_mmmu_parse: the letter of whole conversation turns by rank and place."""
    k, x = F.col("turn") % 4, F.col("text")
    said = F.when(k == 0, x).when(k == 1, F.concat("role", F.lit(" (b) "), x)).when(k == 2, F.concat(F.lit("Answer: "), x, F.lit(" Option is d"))).otherwise(F.concat(F.lit("3. C, or "), x))
    options = F.create_map(F.lit("A"), F.lit("than"), F.lit("B"), F.lit("the end"), F.lit("C"), F.col("role"), F.lit("D"), F.lit("in there"))
    rows = table(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    return rows.select("conv_id", "turn", A.ranked_letter(said, options).alias("letter")).filter("letter is not null")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN (user_id % 2)::INTEGER WHEN 2 THEN 1 ELSE 0 END::DOUBLE AS exact FROM events""")
def listed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """realworldqa: the option's letter if the question lists options, else the response."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    question = F.when(k < 2, F.concat(F.lit("Where?\nA. "), e, F.lit("\nB. far away"))).otherwise("How?")
    said = F.when(k == 0, "I think (A)").when(k == 1, F.when(F.col("user_id") % 2 == 1, "A").otherwise("(B)")).when(k == 2, F.concat(F.upper(e), F.lit(". "))).otherwise("no idea")
    return table(spark, sf_dir, "events").select("event_id", A.listed_answer(said, parse.choices(question), F.when(k < 2, "a").otherwise(e)).alias("exact"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' 2 dogs' WHEN 1 THEN 'don''t know' WHEN 2 THEN user_id || ' m' ELSE 'yes 1000' END AS answer FROM events""")
def vqa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_vqa_norm: number words, articles, contractions, marks."""
    k = F.col("event_id") % 4
    x = F.when(k == 0, F.concat(F.lit("The "), "event_type", F.lit(" two\tdogs."))).when(k == 1, "dont know!").when(k == 2, F.concat(F.lit("a "), text("user_id"), F.lit("/m"))).otherwise("Yes? 1,000")
    return table(spark, sf_dir, "events").select("event_id", A.vqa_norm(x).alias("answer"))


@query(r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '\frac{' || (user_id % 9 + 1) || '}{2}' WHEN 1 THEN '\frac{' || user_id || '}{7}' WHEN 2 THEN '\sqrt{' || (user_id % 9) || '}' WHEN 3 THEN '0.' || (user_id + 10) ELSE user_id::VARCHAR END AS answer, 1.0::DOUBLE AS same FROM events""")
def latex_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_mathvision_norm: one spelling of fractions, roots, decimals, units and variables; an answer and its variant agree."""
    k, u = F.col("event_id") % 5, text("user_id")
    d = (F.col("user_id") % 9).cast(TEXT)
    x = F.when(k == 0, F.concat(F.lit("\\dfrac"), (F.col("user_id") % 9 + 1).cast(TEXT), F.lit("2"))).when(k == 1, F.concat(F.lit("x = "), u, F.lit("/7"))).when(k == 2, F.concat(F.lit("\\sqrt"), d))
    x = x.when(k == 3, F.concat(F.lit("."), (F.col("user_id") + 10).cast(TEXT))).otherwise(F.concat(u, F.lit("^\\circ\\!")))
    return table(spark, sf_dir, "events").select("event_id", A.latex_norm(x).alias("answer"), (A.latex_norm(F.concat(F.lit("\\left "), x)) == A.latex_norm(x)).cast("double").alias("same"))


@query("""SELECT user_id, round(avg(avg_score), 4) AS accuracy FROM (SELECT user_id, event_type, avg((event_id % 3 = 0)::INTEGER) AS avg_score FROM events GROUP BY 1, 2) GROUP BY 1""")
def nested_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mathvision: answers that agree in two decimals; the mean over a question's responses, then over questions, in four decimals."""
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("\\boxed{"), F.format_string("%.3f", i / 7), F.lit("}"))).otherwise(F.concat(F.lit("\\boxed{"), i.cast(TEXT), F.lit("/7+0.02}")))
    hit = mathexpr.math_equal_in_two_decimals(A.final_answer(said), F.concat(F.lit("\\tfrac{"), i.cast(TEXT), F.lit("}{7}")))
    q = table(spark, sf_dir, "events").select("user_id", "event_type", hit.cast("int").alias("hit")).groupBy("user_id", "event_type").agg(F.avg("hit").alias("s"))
    return q.groupBy("user_id").agg(F.round(F.avg("s"), 4).alias("accuracy"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'p' || p_size WHEN 2 THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE round(p_retailprice, 1)::VARCHAR END AS answer FROM part""")
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_mathvista_norm, mathvista: the nearest choice, a letter's choice, an integer, a rounded number."""
    k, price = F.col("p_partkey") % 4, F.format_string("%.2f", "p_retailprice")
    choices = F.array(F.col("p_brand"), F.concat(F.lit("p"), text("p_size")), F.lit("zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"))
    said = F.when(k == 0, F.concat("p_brand", F.lit("#"))).when(k == 1, "(B)").otherwise(F.concat(F.lit("about $"), price))
    out = A.typed_answer(said, choices, F.when(k < 2, "multi_choice").otherwise("free_form"), F.when(k == 2, "integer").otherwise("float"), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("answer"))


@query("""SELECT event_id, (event_id % 4 < 3)::INTEGER AS hit FROM events""")
def open_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_mmmu_parse: open responses, by the numbers and words behind the words that introduce a result."""
    k, i = F.col("event_id") % 4, F.col("event_id")
    said = F.when(k == 0, F.concat(F.lit("We add 3. So the answer is "), F.format_string("%,d", i + 5000), F.lit("."))).when(k == 1, F.concat(F.lit("Thus it is "), "event_type")).when(k == 2, F.upper("event_type")).otherwise("The result is 0.5")
    gold = F.when(k == 0, (i + 5000).cast(TEXT)).when(k == 3, "17").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", A.open_match(said, gold).cast("int").alias("hit"))


@query("""SELECT event_id, 'do' || 'n''t (' || event_type || '),"x"' AS plain, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END::INTEGER AS parts, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, 'cA' AS decoded FROM events""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_detok, fn_escape_split, rw_string_simple, fn_base64."""
    i, even = F.col("event_id"), F.col("event_id") % 2 == 0
    spaced = F.concat(F.lit("do n't ( "), "event_type", F.lit(' ) , "x "'))
    split = A.escaped_split(F.when(even, "a,b,c").otherwise("a\\,b,c"), ",")
    reward = A.string_reward(F.concat(F.lit("<answer>"), i.cast(TEXT), F.lit(" cm</answer>")), F.when(even, i.cast(TEXT)).otherwise((i + 1).cast(TEXT)))
    return table(spark, sf_dir, "events").select("event_id", A.detokenized(spaced).alias("plain"), F.size(split).alias("parts"), reward.alias("reward"), F.unbase64(F.lit("Y0E=")).cast(TEXT).alias("decoded"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '(B)' WHEN 2 THEN '(A)' ELSE '[invalid]' END AS choice, CASE event_id % 4 WHEN 0 THEN ' ' || user_id WHEN 1 THEN 'B' WHEN 2 THEN 'answer A' ELSE 'none' END AS letter, CASE WHEN event_id % 4 = 0 THEN user_id::VARCHAR ELSE '[invalid]' END AS integer FROM events""")
def choice_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rf_multi_choice, rf_extended, rf_simple_mcq, rf_task_specific: a pattern, an option's text, a letter behind a colon."""
    k, u = F.col("event_id") % 4, text("user_id")
    question = F.concat(F.lit("Which?\nA. red "), "event_type", F.lit("\nB. blue "), "event_type")
    options = F.array(F.concat(F.lit("red "), "event_type"), F.concat(F.lit("blue "), "event_type"))
    said = F.when(k == 0, F.concat(F.lit("#### "), u)).when(k == 1, F.concat(F.lit("clearly blue "), "event_type", F.lit(" there"))).when(k == 2, "answer: A").otherwise("none")
    d = table(spark, sf_dir, "events").withColumn("r", F.array(said))
    first = lambda f: F.get(f(F.col("r")), 0)
    return d.select("event_id", first(responses.multi_choice(options)).alias("choice"), F.when(k == 0, F.concat(F.lit(" "), first(responses.option_letters(question)))).otherwise(first(responses.option_letters(question))).alias("letter"), first(responses.FILTERS["first_integer"]).alias("integer"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS choice, CASE event_id % 3 WHEN 2 THEN '' ELSE event_type END AS extracted, length('Question: q' || event_id || chr(10) || 'Response: ' || event_type || chr(10) || 'Is it right? Answer 1 or 0.')::INTEGER AS prompt FROM events""")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jd_prompts, jd_extract_answer, jd_extract_choice: the rule first, then the judge's JSON or text; a judge that fails gives an empty text."""
    k, e = F.col("event_id") % 3, F.col("event_type")
    options = F.create_map(F.lit("A"), F.lit("plum tree"), F.lit("B"), F.lit("oven door"))
    said = F.when(k == 0, "(B)").otherwise("the first or the second")
    verdict = F.when(k == 1, F.concat(F.lit('{"option": "A", "extracted_answer": "'), e, F.lit('"}'))).when(k == 0, F.concat(F.lit('{"extracted_answer": "'), e, F.lit('"}'))).otherwise("no idea")
    prompt = judging.prompt("binary", F.concat(F.lit("q"), text("event_id")), e, template="Question: {question}\nResponse: {response}\nIs it right? Answer 1 or 0.")
    return table(spark, sf_dir, "events").select("event_id", A.judged_option(said, options, verdict).alias("choice"), judging.extracted(verdict).alias("extracted"), F.length(prompt).alias("prompt"))


@query("""WITH j AS (SELECT doc_id, source AS kind, CASE WHEN quality IS NULL THEN 'not attempted' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS v FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
c AS (SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, avg((v = 'correct')::INTEGER) AS a, avg((v = 'incorrect')::INTEGER) AS w, avg((v = 'not attempted')::INTEGER) AS m FROM j GROUP BY ROLLUP (kind))
SELECT kind, n, round(a, 4) AS correct, round(w, 4) AS incorrect, round(m, 4) AS not_attempted, round(CASE WHEN a + w > 0 THEN a / (a + w) ELSE 0 END, 4)::DOUBLE AS attempted_accuracy, round(CASE WHEN a > 0 THEN 2 * a * (a / (a + w)) / (a + a / (a + w)) ELSE 0 END, 4)::DOUBLE AS f1 FROM c""")
def judged_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chartmuseum, charxiv, fvqa, simplevqa, visual_probe: verdicts joined back, overall and by kind, with F1 of correct and attempted."""
    verdicts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    said = verdicts.select("doc_id", F.when(F.col("q") == 1, "A: CORRECT").otherwise("B: INCORRECT").alias("verdict"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"))
    out = judging.attempted(d, said, "doc_id", "kind")
    return out.select("kind", "n", *[F.round(c, 4).alias(c) for c in ("correct", "incorrect", "not_attempted", "attempted_accuracy", "f1")])


@query("""SELECT event_id, round(((event_id % 5) / 5.0 + (event_id % 3) / 3.0 + 1) / 3, 6)::DOUBLE AS score FROM events""")
def component_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mia_bench: the mean of a response's component scores."""
    i = F.col("event_id")
    said = F.concat(F.lit("Component 1: "), (i % 5).cast(TEXT), F.lit("/5\nComponent 2: "), (i % 3).cast(TEXT), F.lit("/3\nTotal: component 3: 2/2"))
    shares = F.map_values(parse.component_scores(said))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.aggregate(shares, F.lit(0.0), lambda t, s: t + s) / F.size(shares), 6).alias("score"))


@query(r"""WITH r AS (SELECT doc_id, (NOT contains(text, '!'))::INTEGER AS a, (NOT contains(text, ','))::INTEGER AS b, coalesce((quality = 1)::INTEGER, 0) AS j FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
SELECT round(avg((a + b = 2 AND j = 1)::INTEGER), 6) AS prompt_level, round(avg((a + b + j) / 3.0), 6)::DOUBLE AS constraint_level, round(0.5 * avg((a + b = 2 AND j = 1)::INTEGER) + 0.5 * avg((a + b + j) / 3.0), 6)::DOUBLE AS overall FROM r""")
def instruction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmifeval: prompts whose constraints are all met, the share of constraints met, and their weighted mean; rule and judge together."""
    p = constraints.PREDICATES
    judged = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = table(spark, sf_dir, "documents").join(judged, "doc_id", "left")
    met = F.array(p["no_exclamation"](F.col("text")), p["no_comma"](F.col("text")), F.coalesce(F.col("q") == 1, F.lit(False)))
    d = d.select(F.forall(met, lambda m: m).cast("int").alias("all"), (F.size(F.filter(met, lambda m: m)) / F.size(met)).alias("share"))
    return d.agg(F.round(F.avg("all"), 6).alias("prompt_level"), F.round(F.avg("share"), 6).alias("constraint_level"), F.round(0.5 * F.avg("all") + 0.5 * F.avg("share"), 6).alias("overall"))


@query("""SELECT p_partkey, 2 AS points, (p_size / 1000.0)::DOUBLE AS x, 0.5::DOUBLE AS y FROM part""")
def point_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_molmo_coords: the points of a mark's coordinates, in thousandths of the picture."""
    x = F.concat(F.lit('<points coords="1 '), F.format_string("%03d", "p_size"), F.lit(' 500; 2 100 900">two</points>'))
    p = A.point_tags(x)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(p).alias("points"), F.get(F.get(p, 0), 0).alias("x"), F.get(F.get(p, 0), 1).alias("y"))


@query("""SELECT event_id, 'Doc 1 (Title: ' || event_type || ')' || chr(10) || 'body ' || user_id || chr(10) || 'more' || chr(10) || chr(10) || 'Doc 2 (Title: alone)' AS passages FROM events""")
def retrieved_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_passages: titles from the first lines, texts below."""
    docs = F.array(F.concat("event_type", F.lit("\nbody "), text("user_id"), F.lit("\nmore")), F.lit("alone"))
    return table(spark, sf_dir, "events").select("event_id", parse.passages(docs).alias("passages"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END::DOUBLE AS accuracy FROM events""")
def routed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_reward_route, rw_string_match, rw_multiple_choice, rw_numeric, rw_list_string, rw_counting, rw_default, rw_llm_judge: each type by its own rule."""
    from corveil.operators import rewards

    k, u, e = F.col("event_id") % 6, text("user_id"), F.col("event_type")
    kind = F.when(k == 0, "string_match").when(k == 1, "multiple_choice").when(k == 2, "numeric").when(k == 3, "list_string_match").when(k == 4, "ground").otherwise("llm_judge")
    pred = F.when(k == 0, F.concat(F.lit("<answer>\\boxed{The "), e, F.lit("}</answer>"))).when(k == 1, "<answer>(B)</answer>").when(k == 2, F.concat(F.lit("\\boxed{"), u, F.lit(".0}"))).when(k == 3, F.concat(F.lit("\\boxed{"), e, F.lit("}"))).otherwise(e)
    gold = F.when(k == 0, F.upper(e)).when(k == 1, "B").when(k == 2, u).when(k == 3, F.concat(F.lit("other|"), e)).otherwise(F.upper(e))
    return table(spark, sf_dir, "events").select("event_id", rewards.accuracy(pred, gold, kind).alias("accuracy"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE 'b' END AS voted, event_type || 'b' AS firsts, CASE WHEN event_id % 3 = 2 THEN 'x' ELSE ' x' END AS spaced, CASE event_id % 3 WHEN 0 THEN 'yes' ELSE 'no' END AS mapped FROM events""")
def list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rf_majority_vote, rf_take_first_k, rf_whitespace, rf_map: on lists of responses."""
    k, e = F.col("event_id") % 3, F.col("event_type")
    votes = F.when(k == 0, F.array(e, F.lit("b"), e)).when(k == 1, F.array(e, F.lit("b"), F.lit("c"))).otherwise(F.array(e, F.lit("b"), F.lit("b")))
    d = table(spark, sf_dir, "events").select("event_id", votes.alias("v"), F.array(F.when(k == 2, " x").otherwise("  x")).alias("s"), F.array(F.when(k == 0, "1").otherwise("7")).alias("m"))
    first = lambda c: F.get(c, 0)
    return d.select("event_id", first(responses.majority_vote(F.col("v"))).alias("voted"), F.concat_ws("", responses.take_first_k(2)(F.col("v"))).alias("firsts"), first(responses.drop_space(F.col("s"))).alias("spaced"), first(responses.mapped({"1": "yes"}, "no")(F.col("m"))).alias("mapped"))


@query("""SELECT event_id, round(value / 100, 6) AS last, 0.0::DOUBLE AS others, (user_id % 5 + 1)::INTEGER AS n FROM events""")
def scattered_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rw_managers, prj_rollout_pack: the score on the last valid token, nothing before it."""
    from corveil.operators import rewards

    r = rewards.token_rewards((F.col("user_id") % 5 + 1).cast("int"), F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.element_at(r, -1), 6).alias("last"), F.aggregate(F.slice(r, 1, F.size(r) - 1), F.lit(0.0), lambda t, x: t + x).alias("others"), F.size(r).alias("n"))


#: Predicate, its arguments, a text that follows and one that doesn't; {w} is a word of the row's own.
CONSTRAINT_CASES = (
    ("number_words", ("less than", 4), "one two {w}", "one two {w} four"), ("number_sentences", ("at least", 2), "A {w}. B {w}!", "A {w} only."), ("word_count_in_range", (2, 3), "a {w} c", "{w}"), ("sentence_number_in_range", (2, 2), "A {w}. B?", "A. B. {w}."),
    ("paragraph_number_in_range", (2, 3), "a {w}\n\nb", "a {w}"), ("each_paragraph_word_count_in_range", (1, 2), "a {w}\n\nb", "a {w} c\n\nb"), ("each_paragraph_sentence_number_in_range", (1, 1), "A {w}.\n\nB.", "A. B {w}.\n\nC."), ("each_paragraph_sentence_number_in_range_list", ([(1, 1), (2, 2)],), "A {w}.\n\nB. C.", "A. {w}.\n\nB."),
    ("capital_letters", (), "ABC 1!", "ABC {w}"), ("lowercase_letters", (), "abc {w}", "Abc {w}"), ("lowercase_counting", (2,), "a b C D", "a b c {w}x"), ("letter_counting", ("less than", 4), "a1b2c", "abcd {w}"), ("letter_frequency", ("z", "at least", 2), "z {w} Z", "z {w}"), ("capital_word_frequency", ("at least", 2), "NASA {w} UN", "NASA {w}"),
    ("count_unique", (), "a b {w}", "a {w} a"), ("placeholder", (2,), "[a] {w} [b]", "[a] {w}"), ("square_bracket", (), "[{w} x]", "{w} [x]"), ("bullet_list", (2,), "* {w}\n- b", "* {w}"), ("highlight_section", (2,), "*a {w}* and *b*", "*a {w}*"), ("section", ("Part", 2), "Part 1 {w} Part 2", "Part 1 {w}"), ("paragraph_stars", (2,), "a {w}\n***\nb", "a {w}"),
    ("paragraph_basic", (2,), "a {w}\n\nb", "a {w}\nb"), ("postscript", ("P.S.",), "x {w}\nP.S. bye", "x {w}"), ("title", (), "<<{w}>> text", "<< >> {w}"), ("json_format", (), '```json\n{"a": "{w}"}\n```', "{a: {w}"), ("two_responses", (), "a {w}\n******\nb", "{w}******{w}"), ("quotation", (), '"{w} said"', '"{w} said'),
    ("keywords", (["tree", "lake"],), "A Tree by the lake {w}", "trees by the lake {w}"), ("keyword_frequency", ("tree", "at least", 2), "tree {w} Tree", "tree {w}"), ("keyword_once", ("tree",), "one tree {w}", "tree {w} tree"), ("forbidden_words", (["tree"],), "trees {w}", "a tree {w}"), ("exclude_word_harder", ("tree",), "tree. {w}", "a tree {w}"),
    ("count_increment_word", ("one", "two"), "one two {w} two", "one two {w}"), ("each_keyword_in_range", (["a", "b"], 1, 2), "a b {w} b", "a {w}"), ("total_keyword_in_range", (["a", "b"], 3, 3), "a b {w} b", "a b {w}"), ("keyword_specific_position", ("tree", 2, 1), "A {w}. Tree falls.", "Tree {w}. It falls."),
    ("constrained_response", (["My answer is yes.", "My answer is no."],), "My answer is no. {w}", "no {w}"), ("constrained_start", ("Dear",), "{w}\n dear all", "my dear {w}"), ("end_phrase", ("Any questions?",), '{w} any questions?"', "any questions? {w}"), ("start_end_same", (), "tree {w} Tree", "tree {w}"), ("first_word_answer", ("tree",), "Tree {w}", "{w} tree"),
    ("last_word_answer", ("tree",), "{w} Tree!", "tree {w}"), ("first_word_each_sentence", ("so",), "So {w}. So be it.", "So {w}. Be it."), ("last_word_each_sentence", ("so",), "{w} so. Is it so?", "{w} so. Is it?"), ("paragraph_first_word", (2, 2, "so"), "a {w}\n\nSo b", "So {w}\n\nb"), ("each_sentence_begins", ("It",), "It {w}. It is.", "It {w}. He is."),
    ("each_sentence_ends", ("!",), "It {w}! He is!", "It {w}! He is."), ("each_paragraph_begins", ("It",), "It {w}\n\nIt is", "It {w}\n\nHe is"), ("each_paragraph_ends", ("!",), "It {w}!\n\nIs!", "It {w}!\n\nIs"), ("whole_begins", ("It",), " It {w}", "{w} It"), ("whole_ends", ("!",), "{w}! ", "!{w}"), ("repeat_prompt", ("Say it.",), "say it. {w}", "{w} say it."),
    ("copy_text", ("Say it.",), " SAY it. ", "say it. {w}"), ("copy_span", ("Say it now", 4, 6), "It", "it {w}"), ("copying", ("Say it.", 2), "Say it.\nSay it.", "Say it. {w}"), ("no_comma", (), "a {w}", "a, {w}"), ("no_dot", (), "a {w}", "a. {w}"), ("no_exclamation", (), "a {w}", "a! {w}"), ("adjacent_letter", (), "a {w} c", "{w} was"),
    ("palindrome", (), "a level {w}", "a {w}"), ("without", (["xyz", "qq"],), "x {w}", "xyz {w}"), ("percentage_precision", (1,), "5.5% and 7 {w}", "5% {w}"), ("number_precision", (2,), "1.25 and 3.50", "1.25 and 3"), ("no_arabic_number", (), "none", "one 1 {w}"), ("bigram_wrapping", (), "<<a {w}>> <<c d>>", "<<a>> <<{w} c d>>"),
    ("sentence_hyphen", (), "One {w}.-Two", "One {w}. Two"), ("repeat_phrase", ("red blue", 2), "red x blue {w} red y blue", "red x blue {w}"),
)


@query("SELECT event_id, " + ", ".join(f"event_id % 2 = 0 AS {name}" for name, *_ in CONSTRAINT_CASES) + " FROM events")
def constraint_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-constraint predicates, each on a text that follows it and on one that doesn't."""
    even, own = F.col("event_id") % 2 == 0, F.concat(F.lit("w"), text("user_id"), F.lit("v"))

    def case(name: str, how: tuple, good: str, bad: str):  # noqa: ANN202
        return constraints.PREDICATES[name](F.when(even, F.replace(F.lit(good), F.lit("{w}"), own)).otherwise(F.replace(F.lit(bad), F.lit("{w}"), own)), *how).alias(name)

    return table(spark, sf_dir, "events").select("event_id", *[case(*c) for c in CONSTRAINT_CASES])


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY 1, 2), o AS (SELECT a.item_id, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.w = b.w AND b.item_id = a.item_id + 1 GROUP BY 1)
SELECT a.item_id, coalesce(o.n, 0) BETWEEN 1 AND 5 AS overlaps FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 LEFT JOIN o ON o.item_id = a.item_id""")
def rephrased_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RephraseParagraph: the words that a text shares with the original, each as often as both have it, lie in a range."""
    b = table(spark, sf_dir, "benchmark")
    d = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("original")), "item_id")
    return d.select("item_id", constraints.PREDICATES["multiset_overlap"](F.col("text"), F.col("original"), 1, 5).alias("overlaps"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS score FROM events")
def instruction_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rw_instruction: the share of instructions that a text follows; unknown ones count as not followed."""
    checks = [("no_comma", {}), ("number_sentences", {"relation": "at least", "n": 3}), ("title", {}), ("unheard_of", {})]
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<<On "), "event_type", F.lit(">> It is. He was. They are."))).otherwise(F.concat(F.lit("No title and one sentence on "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", constraints.follows(x, checks).alias("score"))
