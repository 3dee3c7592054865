"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees are fitted by Spark ML on a bounded sample of the distinct addresses that the rules label, weighted so that
the labels keep their shares; features, rules and predictions are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import cut

#: At most so many labelled addresses, half of each label, those with the smallest hash, train the trees.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: A suffix's share of blocked labels leans on the overall share as if that were so many more labels.
SUFFIX_WEIGHT = 20.0
FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_blocked", "path_blocked"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the contract.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null address or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 2_000_000_000))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule whose host is this one or a parent of it and whose path starts this one; null if none. Of equally long rules the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), -rules.index(r))):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon's entropy of a text's characters in bits; 0 for an empty one."""
    def part(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
        return -p * F.log2(p)

    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + part(c)))


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the lexical features and the keys of the suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, "(?s)[?]([^#]*)", 1)
    return df.withColumns({
        "length": F.length(url).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "hyphens": F.regexp_count("host", F.lit("[-_]")).cast("double"),
        "labels": F.size(F.split("host", "[.]")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
        "first_segment": F.regexp_extract("path", "^/?([^/]*)", 1),
    })


def blocked_share(labelled: DataFrame, key: str, name: str, overall: float) -> DataFrame:
    share = (F.sum(F.col("label") * F.col("weight")) + SUFFIX_WEIGHT * overall) / (F.sum("weight") + SUFFIX_WEIGHT)
    return labelled.groupBy(key).agg(share.alias(name))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    A null address or one without :// has an empty host and path and no rule; the trees judge it like any other. Where
    the rules label no address, or all alike, the one label (allow, if there is none) is the verdict of the rest.
    Repeated rows are judged alike, and an address teaches once however often it occurs. A score of 0.5 blocks.
    """
    def featured(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
        return lexical(df.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict}))

    d = featured(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")))
    addresses = cut(d.filter("ruled is not null").select("url", (F.col("ruled") == "block").cast("double").alias("label")).distinct())
    counts = {r["label"]: r["n"] for r in addresses.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    overall = counts.get(1.0, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if overall else "allow")).alias("verdict"), F.lit(overall).cast("double").alias("block_score"))
    most = max(1, sample // 2)
    first = [addresses.filter(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(most).withColumn("weight", F.lit(max(1.0, n / most))) for y, n in sorted(counts.items())]
    # The sample's bound is `sample` rows; everything learnt comes from it.
    known = cut(featured(first[0].unionByName(first[1])))
    statistics = [("suffix", cut(blocked_share(known, "suffix", "suffix_blocked", overall))), ("first_segment", cut(blocked_share(known, "first_segment", "path_blocked", overall)))]

    def with_statistics(df: DataFrame) -> DataFrame:
        for key, found in statistics:
            # At most one row for each of the sample's rows.
            df = df.join(F.broadcast(found), key, "left")
        return df.fillna(overall, ["suffix_blocked", "path_blocked"])

    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, weightCol="weight").fit(vectors.transform(with_statistics(known)).select("features", "label", "weight"))
    judged = trees.transform(vectors.transform(with_statistics(d)))
    score = vector_to_array(F.col("probability"))[1]
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
