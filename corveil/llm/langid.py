"""Language ID: Bayesian fusion of text, declared language, address suffix and host.

The text gives likelihoods of byte 4-grams, learnt from labelled documents. From the languages that the text alone
suggests, grouped aggregation gives how often a language declares itself as what, how often it is found under an
address suffix, and host priors that are smoothed towards the host's domain, and those towards the whole. A record's own vote
is left out of the counts of its host, suffix and declared language. Its posterior is the product of all four, normalised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import cut, fresh

BITS = 14
#: The share of all languages' 4-grams in the probabilities of each, which is all that a language has for 4-grams that it lacks.
BACKGROUND = 0.1
#: A task counts so many languages at once.
HELD = 64
#: A text counts as at most so many independent 4-grams, since neighbours overlap.
EVIDENCE = 60.0
SMOOTH, HOST_WEIGHT = 0.5, 8.0
#: Tables of at most so many keys are broadcast, so that the records need no shuffle; larger ones are joined by their key.
BROADCAST_ROWS = 50_000
ACCEPTED = 0.5
TAGS = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def grams(text: str) -> np.ndarray:
    """Buckets of the byte 4-grams of the lower-case letters, runs of anything else counting as one space."""
    raw = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    h = ((raw[:-3] * np.uint32(31) + raw[1:-2]) * np.uint32(31) + raw[2:-1]) * np.uint32(31) + raw[3:]
    return (h * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    """The log-probability of a bucket in a language, less the log of BACKGROUND times the bucket's share in all languages.

    It is 0 for buckets that a language lacks; the others are the rows starts[bucket] to starts[bucket + 1] of numbers
    (the language's) and logs, so that languages of any number and share fit.
    """

    languages: list[str]
    starts: np.ndarray
    numbers: np.ndarray
    logs: np.ndarray

    def likelihoods(self, text: str | None) -> tuple[list[float], int]:
        """Log-likelihood of each language, its highest 0, and the number of 4-grams."""
        at = grams(text or "")
        n = len(at)
        if not n or not self.languages:
            return [0.0] * len(self.languages), n
        times = np.ones(n) if n < 1 << BITS else np.bincount(at, minlength=1 << BITS)
        if n >= 1 << BITS:
            at = np.flatnonzero(times)
            times = times[at]
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        rows = np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])
        total = np.bincount(self.numbers[rows], self.logs[rows] * np.repeat(times, sizes), len(self.languages))
        # Where no label has any of the 4-grams, the sums are whole numbers.
        total = total * min(1.0, EVIDENCE / n)
        return (total - total.max()).tolist(), n


def learn_text(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> TextModel:
    """Counts over all labelled documents, of every label that occurs; at most 2**BITS counts a label reach the driver.

    A label's own shares are mixed with those of all labels. The weight is the same for each, so that text which no
    label has seen speaks for none, however rare.
    """
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                bucket = np.flatnonzero(own)
                # Bucket -1 names the label even if its texts have no 4-grams.
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(bucket) + 1), pa.string()), pa.array(np.append(bucket, -1)), pa.array(np.append(own[bucket], 0))], ["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in counts:
                    if len(counts) >= HELD:
                        yield from out()
                    counts[lang] = np.zeros(1 << BITS, np.int64)
                at = grams(text.as_py())
                if len(at):
                    counts[lang] += np.bincount(at, minlength=1 << BITS)
        yield from out()

    found = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    found = found[found["bucket"] >= 0].sort_values(["bucket", "lang"])
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    number = np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object)).astype(np.int32)
    whole = np.bincount(bucket, n, 1 << BITS) + SMOOTH
    share = n / np.bincount(number, n, len(languages))[number]
    logs = np.log1p((1 - BACKGROUND) * share / (BACKGROUND * whole[bucket] / whole.sum()))
    return TextModel(languages, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << BITS))]), number, logs.astype(np.float32))


def likelihood_udf(docs: DataFrame, model: TextModel, html: bool = False):  # noqa: ANN201
    """A function of a text column (or a page's, without its tags): log-likelihoods, 4-grams, declared language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("logs array<double>, grams long, declared string")
    def read(text: pd.Series) -> pd.DataFrame:
        out = []
        for x in text:
            said = DECLARED.search(x) if html and x else None
            logs, n = shared.value.likelihoods(TAGS.sub(" ", x) if html and x else x)
            out.append((logs, n, said[1].lower() if said else None))
        return pd.DataFrame(out, columns=["logs", "grams", "declared"])

    return read


def split_address(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address: the domain is the host's last two labels, the suffix its last label with a two-letter first path segment."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "#", 1))
    rest = F.regexp_extract(rest, "(?s)://([^/?#]*)(.*)", 1), F.regexp_extract(rest, "(?s)://[^/?#]*(/[a-z]{2}(?=[/?#]|$))?", 1)
    host = F.nullif(F.lower(rest[0]), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.when(host.isNotNull(), F.concat(F.substring_index(host, ".", -1), rest[1]))


def evidence_counts(evidence: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], dict[int, int]]:
    """A table (key, counts, total) for each of the keys, and the counts of all; counts: language number to records whose text suggests it.

    Grouped aggregations with partial counts before their shuffle, so that a host with a third of all records costs a
    few rows a task; a key's map has at most one entry a language. Records without 4-grams suggest none.
    """
    joint = cut(evidence.filter(F.col("grams") > 0).groupBy(*keys, "suggested").agg(F.count(F.lit(1)).alias("n")))
    tables = {}
    for key in keys:
        n = joint.filter(F.col(key).isNotNull()).groupBy(key, "suggested").agg(F.sum("n").alias("n"))
        tables[key] = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("suggested", "n"))).alias(f"{key}_counts"), F.sum("n").alias(f"{key}_total"))
    return tables, {r["suggested"]: r["n"] for r in joint.groupBy("suggested").agg(F.sum("n").alias("n")).collect()}


def fuse(evidence: DataFrame, languages: list[str], keys: list[str]) -> DataFrame:
    """evidence with language, posterior and posteriors; what a record lacks or nobody else has adds nothing.

    keys are those of host, domain, suffix and declared that evidence has. Of equal posteriors the first language in
    code point order counts.
    """
    n = len(languages)
    tables, whole = evidence_counts(evidence, keys)
    for key in keys:
        small = tables[key].count() <= BROADCAST_ROWS
        evidence = evidence.join(F.broadcast(tables[key]) if small else tables[key], key, "left")
    every = F.array(*[F.lit(float((whole.get(k, 0) + 1) / (sum(whole.values()) + n))) for k in range(n)])
    votes = F.col("grams") > 0

    def share(key: str, k: Column, base: Column) -> Column:
        """The share of language k among the others with this key, smoothed towards base."""
        if key not in keys:
            return base
        own = F.when(votes & (F.col("suggested") == k), 1).otherwise(0)
        some = F.coalesce(F.try_element_at(F.col(f"{key}_counts"), k), F.lit(0)) - own
        return F.when(F.col(f"{key}_total").isNull(), base).otherwise((some + HOST_WEIGHT * base) / (F.col(f"{key}_total") - votes.cast("int") + HOST_WEIGHT))

    def log_posterior(k: Column) -> Column:
        base = F.get(every, k)
        prior = share("host", k, share("domain", k, base))
        return F.get("logs", k) + F.log(prior) + F.log(share("declared", k, base) / base) + F.log(share("suffix", k, base) / base)

    evidence = evidence.withColumn("logs", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), log_posterior))
    top = F.array_max("logs")
    evidence = evidence.withColumn("posteriors", F.transform("logs", lambda x: F.exp(x - top)))
    evidence = evidence.withColumn("posteriors", F.transform("posteriors", lambda x: x / F.aggregate("posteriors", F.lit(0.0), lambda a, b: a + b)))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    evidence = evidence.withColumn("language", F.element_at(F.array(*[F.lit(x) for x in languages]), best)).withColumn("posterior", F.array_max("posteriors"))
    return evidence.drop("logs", *[f"{key}_{c}" for key in keys for c in ("counts", "total")])


def suggested() -> Column:
    return F.array_position("logs", F.array_max("logs")).cast("int") - 1


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, host, suffix, declared, grams, language, posterior, accepted) of every page.

    The text model comes from the labelled documents, everything else from the pages. Null or empty html has no text
    and no declared language; null addresses have no host; both then lean on what is left, on the overall shares at
    last. A page is accepted if it has letters and its language a posterior of at least ACCEPTED. Without labelled
    documents language and posterior are null and no page is accepted. Pages with the same id are pages of their own.
    """
    model = learn_text(documents)
    host, domain, suffix = split_address(F.col("url"))
    e = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not model.languages:
        none = F.lit(None)
        return e.select("page_id", host.alias("host"), suffix.alias("suffix"), none.cast("string").alias("declared"), F.lit(0).cast("long").alias("grams"), none.cast("string").alias("language"), none.cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    read = likelihood_udf(pages, model, html=True)
    e = e.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), read("html").alias("t")).select("page_id", "host", "domain", "suffix", "t.logs", "t.grams", "t.declared")
    e = cut(e.withColumn("suggested", suggested()))
    out = fuse(e, model.languages, ["host", "domain", "suffix", "declared"])
    return out.select("page_id", "host", "suffix", "declared", "grams", "language", "posterior", ((F.col("grams") > 0) & (F.col("posterior") >= ACCEPTED)).alias("accepted"))


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", host_col: str = "source", declared_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and whose language is certain enough.

    The texts' labels teach the text model, the source counts as the host. A language that the rows declare apart from
    the label is further evidence; the label itself is none, since the model has seen it. A null label or source adds
    nothing. Rows are read once more than the model reads them and kept in a checkpoint until they are judged.
    """
    model = learn_text(docs, text_col, label_col)
    if not model.languages:
        return docs.filter(F.lit(False))
    read = likelihood_udf(docs, model)
    row, t = fresh(docs, "row"), fresh(docs, "t")
    declared = [F.lower(F.col(declared_col).cast("string")).alias("declared")] if declared_col else []
    e = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(row), *declared, F.col(host_col).cast("string").alias("host"), read(F.col(text_col).cast("string")).alias(t))
    e = cut(e.select(row, *["declared"] * len(declared), "host", f"{t}.logs", f"{t}.grams").withColumn("suggested", suggested()))
    out = fuse(e, model.languages, ["host", *["declared"] * len(declared)])
    return out.filter((F.col("grams") > 0) & (F.col("posterior") >= ACCEPTED)).select(f"{row}.*")
