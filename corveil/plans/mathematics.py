"""Queries on mathematical equality. Expressions are made from the tables' numbers, and SQL works out their values in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corveil.functions import mathexpr
from corveil.operators import rewards
from corveil.plans.catalog import dealt, query, table


def written(form: str, **parts: Column) -> Column:
    """form with <name> replaced by numbers, negative ones in brackets."""
    out = F.lit(form)
    for name, x in parts.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.when(x < 0, F.concat(F.lit("("), x.cast("string"), F.lit(")"))).otherwise(x.cast("string")))
    return out


def cases(key: Column, forms: list[Column]) -> Column:
    out = F.when(key == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        out = out.when(key == k, form)
    return out


NUMBERS = "SELECT o_orderkey, o_custkey AS a, o_orderkey % 97 + 1 AS b, o_orderkey % 11 - 5 AS c, o_custkey % 11 - 5 AS d, o_orderkey % 9 AS k FROM orders"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey", "o_custkey as a", "o_orderkey % 97 + 1 as b", "o_orderkey % 11 - 5 as c", "o_custkey % 11 - 5 as d", "o_orderkey % 9 as k")


def fraction_forms(**n: Column) -> list[Column]:
    """Nine ways to write, or nearly to write, a / b."""
    forms = (r"<a>/<b>", r"<c>+\frac{<a>-<c>\cdot<b>}{<b>}", r"\frac{<a>+1}{<b>}", r"x = \dfrac{2\times<a>}{2\cdot<b>}", r"\frac{<a>\cdot<c>}{<b>\cdot<c>}", r"\frac{\sqrt{<a>^2}}{<b>}", r"$<a>\cdot<b>^{-1}+<c>-<d>$", r"\left(<a>+<d>\right)\div<b>-\frac{<c>}{<b>}", r"\frac{<a>}{<b>}^{<d>+6}")
    return [written(f, **n) for f in forms]


@query(f"""
WITH n AS ({NUMBERS}), v AS (
  SELECT *, CASE k WHEN 2 THEN a + 1 WHEN 3 THEN 2 * a WHEN 4 THEN a * c WHEN 6 THEN a + (c - d) * b WHEN 7 THEN a + d - c ELSE a END AS p, CASE k WHEN 3 THEN 2 * b WHEN 4 THEN b * c ELSE b END AS q FROM n
)
SELECT o_orderkey, CASE WHEN k = 8 THEN d + 6 = 1 OR a = b OR a = 0 ELSE q <> 0 AND p * b = a * q END AS equal, p <> 0 AS not_zero FROM v""")
def math_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_math_equal: sums, products, roots, powers and quotients against one fraction."""
    d = numbers(spark, sf_dir)
    n = {c: F.col(c) for c in "abcd"}
    made = cases(F.col("k"), fraction_forms(**n))
    zero = mathexpr.math_equal(made, F.lit("0")) | (F.col("k") == 4) & (F.col("c") == 0)
    return d.select("o_orderkey", mathexpr.math_equal(made, written(r"\frac{<a>}{<b>}", **n)).alias("equal"), (~zero).alias("not_zero"))


@query(f"""
WITH n AS ({NUMBERS}), v AS (SELECT o_orderkey, a * 13 + (c * b) AS p, b * 13 AS q FROM n)
SELECT o_orderkey, (p // gcd(p, q))::BIGINT::VARCHAR || '/' || (q // gcd(p, q))::BIGINT::VARCHAR AS ratio FROM v""")
def math_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_math_equal: sums of fractions and mixed numbers in lowest terms."""
    n = {c: F.col(c) for c in "abc"}
    return numbers(spark, sf_dir).select("o_orderkey", mathexpr.math_ratio(written(r"\dfrac{<a>}{<b>}+\frac{<c>}{13}", **n)).alias("ratio"))


@query(f"""
WITH n AS ({NUMBERS})
SELECT o_orderkey, CASE k % 6 WHEN 0 THEN d * d = c * c WHEN 1 THEN c = d WHEN 2 THEN c = d WHEN 3 THEN list_sort(list_distinct([c, d, 1])) = list_sort(list_distinct([d, d, c])) WHEN 4 THEN c = d WHEN 5 THEN abs(c) = abs(d) END AS equal FROM n""")
def math_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_math_equal: polynomials, trigonometric identities, intervals, sets, equations and both signs of a root."""
    d, n = numbers(spark, sf_dir), {c: F.col(c) for c in "cd"}
    pairs = [(r"(x-<c>)(x+<c>)", r"x^2-<d>^2"), (r"\sin^2 y+\cos^2 y+<c>t", r"1+<d>t"), (r"(-\infty,<c>]\cup[99,100)", r"[99,100)\cup(-\infty,<d>]"), (r"\{<c>,<d>,1\}", r"\{<d>,<d>,<c>\}"), (r"y=<c>x+1", r"<d>x+1=y"), (r"\pm<c>", r"<d>,-<d>")]
    sides = [cases(F.col("k") % 6, [written(p[side], **n) for p in pairs]) for side in (0, 1)]
    return d.select("o_orderkey", mathexpr.math_equal(*sides).alias("equal"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity::BIGINT * 3 % 7 = 0 OR l_linenumber % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM lineitem""")
def math_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rw_default: an answer in tags and a box earns what its value does, not its spelling."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber") % 3
    said = F.when(k == 0, written(r"<think>so</think><answer>\boxed{\frac{6\cdot<q>}{14}}</answer>", q=q)).when(k == 1, written(r"<answer>x=3(<q>)/7</answer>", q=q))
    said = said.otherwise(written(r"<answer>\boxed{<w>}</answer>", w=F.floor(q * 3 / 7)))
    gold = written(r"\tfrac{3\cdot<q>}{7}", q=q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rewards.accuracy(said, gold, F.lit("math_verify")).alias("accuracy"))
