"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Terms are counted by language and source in one pass. Terms of a language with the same sparse vector of counts by
source form a class: every pair of sources that occur in the vector is evaluated once a class, times the number of its
terms. What a source's absent terms add has a closed form over the histogram of the other source's shares, so that no
vector is ever filled up with zeros.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.llm.common import cut

#: A term counts in a language from so many documents on, and a source lists so many terms.
LEAST_DOCS, TERMS = 30, 50
#: Shares are whole parts of UNIT, with SMOOTHING more occurrences of each term.
UNIT, SMOOTHING = 1_000_000_000, 5
#: A task hands its counts on at so many entries.
ENTRIES = 500_000
#: Groups of language and source are broadcast up to so many; sums of pairs are held for so many sources at once.
GROUPS, SIDE = 100_000, 1024
#: A-Z to a-z; what is no ASCII letter and no part of another character to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, counted within each task; from docs (lang, source, text)."""
    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in found.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "d"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                terms = text.as_py().translate(LETTERS).split()
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n)
                if held > ENTRIES:
                    yield from rows(found)
                    found.clear()
                    held = 0
        yield from rows(found)

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, counts) of the terms in at least so many documents of their language; counts: (source, n) by source."""
    by_source = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return terms.filter(F.col("d") >= least_docs).select("lang", "term", "counts")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * v)), in decimals, so that no count overflows."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole, (total + SMOOTHING * v).cast("decimal(20,0)"))


def pair_sums(entries: DataFrame) -> DataFrame:
    """(lang, a, b, x): what pairs of sources that share classes differ from the closed form by, in sums of a task.

    entries (id, times, lang, source, p, z): each class with its sources, their shares p of its terms and z of absent
    terms. A class adds times * (|p - p'| - |p - z'| - |p' - z| + |z - z'|) to each of its pairs.
    """
    def rows(lang: str, names: list[str], sums: np.ndarray) -> pa.RecordBatch:
        a, b = np.nonzero(np.triu(sums, 1))
        named = np.array(names, object)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(named[a], pa.string()), pa.array(named[b], pa.string()), pa.array(sums[a, b])], ["lang", "a", "b", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[str, int], np.ndarray]] = {}

        def several(lang: str, sources: list[str], p: np.ndarray, z: np.ndarray, times: int, halves: int | None) -> Iterator[pa.RecordBatch]:
            """Adds the pairs of one class; with `halves` only those between its first so many sources and the others."""
            index, sums = held.setdefault(lang, ({}, np.zeros((SIDE, SIDE), np.int64)))
            if len(index.keys() | set(sources)) > SIDE:
                yield rows(lang, list(index), sums)
                index.clear()
                sums[:] = 0
            at = np.array([index.setdefault(x, len(index)) for x in sources])
            one = np.abs(p[:, None] - z[None, :])
            f = np.abs(p[:, None] - p[None, :]) - one - one.T + np.abs(z[:, None] - z[None, :])
            if halves is not None:
                f[:halves, :halves] = 0
                f[halves:, halves:] = 0
            sums[np.ix_(at, at)] += times * f

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            ids, times, p, z = (table.column(c).to_numpy() for c in ("id", "times", "p", "z"))
            langs, sources = table.column("lang").to_pylist(), table.column("source").to_pylist()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
            rest = table.slice(edges[-1]).combine_chunks().to_batches()[0]
            for first, past in zip(edges[:-1], edges[1:], strict=True):
                yield from whole(langs[first], sources[first:past], p[first:past], z[first:past], int(times[first]), several)
        if rest is not None:
            ids, times, p, z = (rest.column(c).to_numpy() for c in ("id", "times", "p", "z"))
            yield from whole(rest.column("lang")[0].as_py(), rest.column("source").to_pylist(), p, z, int(times[0]), several)
        for lang, (index, sums) in held.items():
            yield rows(lang, list(index), sums)

    def whole(lang, sources, p, z, times, several) -> Iterator[pa.RecordBatch]:
        """One class; with over SIDE sources in pairs of parts of SIDE / 2."""
        if len(sources) <= SIDE:
            yield from several(lang, sources, p, z, times, None)
            return
        part = SIDE // 2
        for i in range(0, len(sources), part):
            yield from several(lang, sources[i : i + part], p[i : i + part], z[i : i + part], times, None)
            for j in range(i + part, len(sources), part):
                both = np.r_[i : min(i + part, len(sources)), j : min(j + part, len(sources))]
                yield from several(lang, [sources[k] for k in both], p[both], z[both], times, min(part, len(sources) - i))

    return entries.mapInArrow(add, "lang string, a string, b string, x long")


def source_pairs(named: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): every two sources of a language and the sum of |p - p'| over all its terms.

    With V terms, shares z and z' of absent ones: V |z - z'|, plus for each of the two sources the sum over its own
    terms of |p - z'| - |z - z'|, plus what pair_sums has. The sum of |p - z'| comes from running sums over the
    source's shares in order, where z' is one more place.
    """
    other = named.select("lang", F.col("source").alias("item"), F.col("z").alias("at"))
    pairs = named.select("lang", "source", "z", "v").join(other, "lang").filter("source <> item")
    none = F.lit(0).cast("long")
    shares = entries.groupBy("lang", "source", F.col("p").alias("at")).agg(F.sum("times").alias("m"))
    places = shares.select("lang", "source", "at", "m", (F.col("at") * F.col("m")).alias("w"), F.lit(None).cast("string").alias("item"), none.alias("z"), none.alias("v"))
    places = places.unionByName(pairs.select("lang", "source", "at", none.alias("m"), none.alias("w"), "item", "z", "v"))
    own = W.partitionBy("lang", "source")
    below = own.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    m, w, am, aw = F.sum("m").over(below), F.sum("w").over(below), F.sum("m").over(own), F.sum("w").over(own)
    at, apart = F.col("at"), F.abs(F.col("z") - F.col("at"))
    one_side = places.withColumn("x", at * m - w + (aw - w) - at * (am - m) - am * apart).filter("item is not null")
    # V |z - z'| belongs to both directions, the rest of a row to the pair.
    forward = one_side.select("lang", "source", "item", (F.col("x") + F.col("v") * apart).alias("x"))
    backward = one_side.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")
    shared = pair_sums(entries.select("id", "times", "lang", "source", "p", "z"))
    both = [shared.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "x") for a, b in (("a", "b"), ("b", "a"))]
    return forward.unionByName(backward).unionByName(both[0]).unionByName(both[1]).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): of each source the other sources of its language, and its `terms` most typical terms.

    Null text, language and source count as ''. A group of a language without kept terms has pairs of value 0 and no
    terms; a language's only source has no pairs. Repeated rows count as documents of their own. An empty table gives
    an empty result. Other columns play no part, whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = cut(kept_terms(docs, least_docs))
    # The classes: equal vectors of a language.
    classes = cut(kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()))
    flat = classes.select("id", "times", "lang", F.explode("counts").alias("c")).select("id", "times", "lang", "c.source", "c.n")
    totals = flat.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    langs = classes.groupBy("lang").agg(F.sum("times").alias("v"), F.sum(F.col("times") * F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])).alias("whole"))
    groups = docs.select("lang", "source").distinct()
    named = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "whole"])
    named = cut(named.withColumn("z", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)))
    # One row for each group; the result has the square of their number by language.
    known = F.broadcast(named) if named.count() <= GROUPS else named
    p = share(F.col("n"), F.col("total"), F.col("v"))
    entries = flat.join(known, ["lang", "source"]).select("id", "times", "lang", "source", p.alias("p"), "z")
    entries = cut(entries.repartition("id").sortWithinPartitions("id"))

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(named, entries).withColumn("rank", F.row_number().over(by_value))
    everywhere = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    own = kept.select("lang", F.col("term").alias("item"), everywhere.alias("all"), F.explode("counts").alias("c")).select("lang", "item", "all", "c.source", "c.n").join(known, ["lang", "source"])
    own = own.withColumn("value", p - share(F.col("all"), F.col("whole"), F.col("v"))).filter("value > 0")
    top = own.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= terms)
    named_part = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named_part(pairs, "pair").unionByName(named_part(top, "term"))
