"""Ranked lexical search over a bit-sliced impact index.

Documents form blocks. A block holds, for each term, bitmaps over its documents: slice b of a term has the bit of each
document whose impact has bit b set. Only the 64-bit words in which a term occurs are kept. A query adds its terms'
slices by bitwise carry arithmetic, for many documents in one operation, and finds its best documents by going down
the slices of the sum from the most significant: a slice keeps the candidates that have its bit, unless that leaves
too few.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.llm.common import cut

BEST = 10
#: A block has at most so many documents, and is closed at so many occurrences of terms in documents.
BLOCK, POSTINGS = 1 << 16, 1 << 20
#: Queries run in lots of at most so many terms, all repeats counted; each lot is a pass of its own over the documents.
LOT = 1 << 20
#: Sums are worked out for so many words of documents times queries at once.
WORDS = 4096
#: 0-9, A-Z as a-z, a-z and every byte of other characters; the rest to a blank.
SEARCHED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(SEARCHED).split()


class Corpus(NamedTuple):
    """What weights and impacts take from all documents: n with a term, their terms with repeats, and documents by term."""
    docs: int
    words: int
    holding: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * self.holding.get(term, 0) + 1)))


class Query(NamedTuple):
    """A query by its number, its item's id and its distinct terms."""
    number: int
    item: object
    terms: tuple[bytes, ...]


def lots(items: DataFrame, id_col: str, text_col: str, size: int = LOT) -> Iterator[list[Query]]:
    """The queries in lots of at most `size` terms (or one query), read from the driver's side one partition at a time."""
    lot, held = [], 0
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).toLocalIterator()
    for number, r in enumerate(rows):
        terms = tuple(dict.fromkeys(terms_of(bytes(r["text"] or b""))))
        if lot and held + len(terms) > size:
            yield lot
            lot, held = [], 0
        lot.append(Query(number, r["item"], terms))
        held += len(terms)
    if lot:
        yield lot


def corpus_statistics(docs: DataFrame, wanted: set[bytes]) -> Corpus:
    """One pass over docs (doc_id, text), counted within each task; at most a row for each wanted term comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter = Counter()
        n, words, known = 0, 0, shared.value
        for batch in batches:
            for text in batch.column(0):
                terms = terms_of(text.as_py() or b"")
                n += bool(terms)
                words += len(terms)
                holding.update(known.intersection(terms))
        yield pa.RecordBatch.from_arrays([pa.array([None, *holding], pa.binary()), pa.array([n, *holding.values()], pa.int64()), pa.array([words, *[0] * len(holding)], pa.int64())], ["term", "docs", "words"])

    counted = docs.select("text").mapInArrow(count, "term binary, docs long, words long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()
    total = next((r for r in counted if r["term"] is None), None)
    return Corpus(total["docs"] if total else 0, total["words"] if total else 0, {bytes(r["term"]): r["docs"] for r in counted if r["term"] is not None})


def slices(slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, bits): the 64-document words in which the sorted slots fall, and for each bit of the values its word there."""
    word = slot >> 6
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    place = np.uint64(1) << (slot & 63).astype(np.uint64)
    deep = int(value.max()).bit_length()
    bits = np.stack([np.bitwise_or.reduceat(np.where(value >> b & 1, place, np.uint64(0)), first) for b in range(deep)]) if deep else np.zeros((0, len(first)), np.uint64)
    return word[first], bits


def index(docs: DataFrame, corpus: Corpus, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """(block, term, deep, at, bits): the bit-sliced impacts of docs (doc_id, text) for the terms that the corpus counts.

    deep is the number of slices, at the 64-document words in which the term occurs, bits their contents slice by slice.
    A block begins with a row without term, whose `at` has its documents' ids by place, in order, null ids last, and
    whose deep counts the null ones. The rows of a block lie together in one partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast((corpus.docs, corpus.words, {t: corpus.weight(t) for t in corpus.holding}))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_words, weight = shared.value
        known, number = weight.keys(), 0

        def close(ids: list, found: dict[bytes, tuple[list, list]]) -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            terms, deep, at, bits = [None], [sum(i is None for i in ids)], [np.array([ids[k] or 0 for k in order], np.int64).tobytes()], [b""]
            for term, (rows, values) in found.items():
                slot, value = place[rows], np.array(values, np.int64) * weight[term]
                by = np.argsort(slot)
                where, what = slices(slot[by], value[by])
                if len(what):
                    for column, x in zip((terms, deep, at, bits), (term, len(what), where.tobytes(), what.tobytes()), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array([number] * len(terms), pa.int64()), pa.array(terms, pa.binary()), pa.array(deep, pa.int32()), pa.array(at, pa.binary()), pa.array(bits, pa.binary())], ["block", "term", "deep", "at", "bits"])

        ids, found, held = [], {}, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py() or b"")
                own = known & set(terms)
                if not own:
                    continue
                if len(ids) >= block or held + len(own) > postings and ids:
                    yield close(ids, found)
                    ids, found, held, number = [], {}, 0, number + 1
                m = 8 * (10 + 90 * len(terms) * n_docs // n_words)
                times = Counter(terms) if len(own) < len(terms) else dict.fromkeys(own, 1)
                for t in own:
                    tf = times[t]
                    rows, values = found.setdefault(t, ([], []))
                    rows.append(len(ids))
                    values.append(1_000_000_000 * tf // (1000 * tf + m))
                ids.append(doc)
                held += len(own)
        if ids:
            yield close(ids, found)

    made = docs.mapInArrow(build, "block long, term binary, deep int, at binary, bits binary")
    return made.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("block"))


def plus(total: list[np.ndarray | None], x: np.ndarray) -> None:
    """Adds numbers in slices x to those in slices `total`, by carry; a slice is None as long as no number has its bit."""
    carry = None
    for b in range(max(len(x), len(total) + 1)):
        own = x[b] if b < len(x) else None
        if own is None and carry is None:
            return
        if b == len(total):
            total.append(None)
        a = total[b]
        parts = [p for p in (a, own, carry) if p is not None]
        if len(parts) == 1:
            total[b], carry = parts[0], None
        elif len(parts) == 2:
            total[b], carry = parts[0] ^ parts[1], parts[0] & parts[1]
        else:
            half = parts[0] ^ parts[1]
            total[b], carry = half ^ parts[2], (parts[0] & parts[1]) | (half & parts[2])


def highest(total: np.ndarray, best: int) -> list[tuple[int, int]]:
    """(score, place) of the `best` largest numbers above 0 in slices (bit, word), the largest first, equal ones by place."""
    maybe = np.bitwise_or.reduce(total, axis=0) if len(total) else np.zeros(0, np.uint64)
    sure = np.zeros_like(maybe)
    missing = best
    for b in range(len(total) - 1, -1, -1):
        with_bit = maybe & total[b]
        n = int(np.bitwise_count(with_bit).sum())
        if n > missing:
            maybe = with_bit
        else:
            sure, missing, maybe = sure | with_bit, missing - n, maybe & ~total[b]
    out = []
    # What is left in `maybe` has one and the same number.
    for chosen, most in ((sure, best), (maybe, missing)):
        for word in np.flatnonzero(chosen).tolist():
            for bit in range(64):
                if most > 0 and int(chosen[word]) >> bit & 1:
                    out.append((sum((int(total[b, word]) >> bit & 1) << b for b in range(len(total))), word * 64 + bit))
                    most -= 1
            if most <= 0:
                break
    return sorted(out, key=lambda x: (-x[0], x[1]))


def block_best(queries: list[Query], n_docs: int, terms: dict[bytes, tuple[np.ndarray, np.ndarray]], best: int, words: int) -> Iterator[tuple[int, int, int]]:
    """(query's position, score, place) of the best documents of a block for each query; several queries are summed side by side."""
    width = (n_docs + 63) >> 6
    found = sorted(((k, [terms[t] for t in q.terms if t in terms]) for k, q in enumerate(queries)), key=lambda x: len(x[1]))
    found = [x for x in found if x[1]]
    lot = max(1, words // width)
    for first in range(0, len(found), lot):
        part = found[first : first + lot]
        total: list[np.ndarray | None] = []
        for j in range(max(len(own) for _, own in part)):
            has = [(i, own[j]) for i, (_, own) in enumerate(part) if j < len(own)]
            x = np.zeros((max(len(bits) for _, (_, bits) in has), len(part), width), np.uint64)
            for i, (at, bits) in has:
                x[: len(bits), i, at] = bits
            plus(total, x)
        sums = np.stack([np.zeros((len(part), width), np.uint64) if t is None else t for t in total])
        for i, (k, _) in enumerate(part):
            for score, place in highest(np.ascontiguousarray(sums[:, i]), best):
                yield k, score, place


def search(indexed: DataFrame, queries: list[Query], best: int = BEST, words: int = WORDS) -> DataFrame:
    """(query, doc_id, score): the best documents of each block of an index for each query, by score, then id.

    The rows of a block must lie together, its row of ids first, as `index` gives them; `gathered` restores that for an
    index that was written and read back.
    """
    shared = indexed.sparkSession.sparkContext.broadcast(queries)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value, {t for q in shared.value for t in q.terms}

        def results(ids: np.ndarray, nulls: int, terms: dict) -> pa.RecordBatch:
            rows = list(block_best(asked, len(ids), terms, best, words))
            own = [None if place >= len(ids) - nulls else int(ids[place]) for _, _, place in rows]
            return pa.RecordBatch.from_arrays([pa.array([asked[k].number for k, _, _ in rows], pa.int64()), pa.array(own, pa.int64()), pa.array([score for _, score, _ in rows], pa.int64())], ["query", "doc_id", "score"])

        ids, nulls, terms = None, 0, {}
        for batch in batches:
            for term, deep, at, bits in zip(*(batch.column(c) for c in ("term", "deep", "at", "bits")), strict=True):
                where = np.frombuffer(at.as_py(), np.int64)
                if not term.is_valid:
                    if ids is not None:
                        yield results(ids, nulls, terms)
                    ids, nulls, terms = where, deep.as_py(), {}
                elif (t := term.as_py()) in wanted:
                    terms[t] = where, np.frombuffer(bits.as_py(), np.uint64).reshape(deep.as_py(), -1)
        if ids is not None:
            yield results(ids, nulls, terms)

    return indexed.mapInArrow(find, "query long, doc_id long, score long")


def gathered(indexed: DataFrame) -> DataFrame:
    """An index, however it was stored, with each block's rows together in one partition and its ids first."""
    return indexed.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term"))


def best_documents(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", lot: int = LOT, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its `best` documents with a score above 0, ranks from 1.

    Equal scores go by ascending id, null ids last. A null text has no terms; an item without terms, or whose terms no
    document holds, has no rows. Each row of items and of docs counts on its own, repeated ones too. Empty tables give
    an empty result. Each lot of queries takes two passes over docs, one for statistics and one for index and search;
    an index of all terms, written once, serves any number of calls of `search`.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind, found = items.schema[item_col].dataType, None
    for asked in lots(items, item_col, query_col, lot):
        corpus = corpus_statistics(docs, {t for q in asked for t in q.terms})
        rows = search(index(docs, corpus, block, postings), asked, best)
        by_score = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= best)
        # At most LOT queries.
        names = docs.sparkSession.createDataFrame([(q.number, q.item) for q in asked], f"query long, item_id {kind.simpleString()}")
        rows = rows.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = rows if found is None else cut(found.unionByName(rows))
    return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if found is None else found
