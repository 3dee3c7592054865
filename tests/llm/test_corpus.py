"""Source divergence, lexical search and quality rules against brute-force versions that share no code with them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corveil.llm import divergence, lexical, quality

DOCS = "doc_id long, text string, lang string, source string, term string, n long, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, None) for r in rows], DOCS)


def words_of(rng, n, kinds):
    return " ".join(rng.choice([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(kinds)] + ["É", "don't", "x1y2", "日本"]) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(k, words_of(rng, rng.choice([0, 1, 5, 30, 200]), rng.choice([3, 20, 60])), rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None, f"s{k % 9}"])) for k in range(150)]
    return rows + [rows[7], rows[7], (7, "Other Wa", "en", "a"), (None, "waa wba", "en", "b"), (500, None, "fr", None), (501, "", "fr", "a"), (502, " ".join(["long"] * 60_000 + ["waa"]), "en", "hot"), (503, "LONG waa", "xx", "only")]


# Source divergence.


def divergence_by_definition(rows, least_docs, terms):
    found, docs = {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        found.setdefault((lang, source), Counter()).update(own)
        docs.setdefault(lang, Counter()).update(set(own))
    kept = {lang: [t for t, n in c.items() if n >= least_docs] for lang, c in docs.items()}
    part = lambda c, lang: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept[lang]) + 5 * len(kept[lang])) for t in kept[lang]}
    p = {g: part(c, g[0]) for g, c in found.items()}
    q = {lang: part(sum((c for g, c in found.items() if g[0] == lang), Counter()), lang) for lang in kept}
    out = []
    for lang, source in found:
        pairs = [(x[1], sum(abs(p[lang, source][t] - p[x][t]) for t in kept[lang])) for x in found if x[0] == lang and x[1] != source]
        own = [(t, p[lang, source][t] - q[lang][t]) for t in kept[lang] if found[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for name, values, most in (("pair", pairs, None), ("term", own, terms)):
            ranks = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, name, item, value, k + 1) for k, (item, value) in enumerate(ranks)]
    return out


@pytest.mark.parametrize("side, entries, groups", [(1024, 500_000, 100_000), (4, 50, 0)])
def test_divergence(spark, monkeypatch, side, entries, groups):
    """Also with classes over more sources than are summed at once, counts handed on early, and no broadcast."""
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    rows = corpus()
    out = [tuple(r) for r in divergence.audit(frame(spark, rows), 2, 5).collect()]
    assert sorted(out) == sorted(divergence_by_definition(rows, 2, 5))


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    few = [tuple(r) for r in divergence.audit(frame(spark, [(1, "a b", "en", "a"), (2, "b", "en", "b")])).collect()]
    assert sorted(few) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# Lexical search.


def ranked_by_definition(rows, items, best=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    own = [(i, terms(t)) for i, t, *_ in rows]
    n, total, df = sum(bool(t) for _, t in own), sum(len(t) for _, t in own), Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in own:
            m, c = 100 - 90 + 90 * len(t) * n // max(1, total), Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in set(terms(text)) if c[x])
            scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:best])]
    return out


ITEMS = [(1, "waa wba É unknown"), (2, None), (2, "Don't t x1y2"), (None, "long"), (5, "日本 waa waa"), (6, "nothing here"), (7, " ".join(f"w{chr(97 + k % 26)}a" for k in range(26)))]


@pytest.mark.parametrize("block, postings, lot", [(1 << 16, 1 << 20, 1 << 20), (70, 1 << 20, 3), (1 << 16, 40, 1)])
def test_search(spark, block, postings, lot):
    """Also with several blocks and several lots of queries."""
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = [tuple(r) for r in lexical.best_documents(frame(spark, rows), items, lot=lot, block=block, postings=postings).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(out, key=key) == sorted(ranked_by_definition(rows, ITEMS), key=key)


def test_search_of_a_stored_index(spark, tmp_path):
    rows = corpus()
    docs = frame(spark, rows).selectExpr("doc_id", "cast(text as binary) as text").repartition(3)
    queries = [lexical.Query(k, i, tuple(dict.fromkeys(lexical.terms_of((t or "").encode())))) for k, (i, t) in enumerate(ITEMS)]
    found = lexical.corpus_statistics(docs, {t for q in queries for t in q.terms})
    lexical.index(docs, found, block=40).repartition(7).write.parquet(f"{tmp_path}/index")
    out = lexical.search(lexical.gathered(spark.read.parquet(f"{tmp_path}/index")), queries).collect()
    want = ranked_by_definition(rows, list(enumerate(t for _, t in ITEMS)))
    for k in range(len(ITEMS)):
        assert sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["query"] == k)[:10] == [(-s, i is None, i or 0) for q, _, i, s in want if q == k]


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.best_documents(frame(spark, []), items).count() == 0
    assert lexical.best_documents(frame(spark, [(1, None, "en", "a"), (2, "...", "en", "a")]), items).count() == 0
    assert lexical.best_documents(frame(spark, corpus()), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2**36), min_size=130, max_size=130), min_size=1, max_size=6), st.integers(1, 140))
def test_slices_add_and_rank(terms, best):
    total = []
    for values in terms:
        slot = np.flatnonzero(np.array(values) > 0)
        x = np.zeros((37, 3), np.uint64)
        if len(slot):
            at, bits = lexical.slices(slot, np.array(values, np.int64)[slot])
            x[: len(bits), at] = bits
        lexical.plus(total, x)
    sums = np.stack([np.zeros(3, np.uint64) if t is None else t for t in total])
    want = sorted(((sum(v[k] for v in terms), k) for k in range(130)), key=lambda x: (-x[0], x[1]))
    assert lexical.highest(sums, best) == [x for x in want if x[0]][:best]


# Quality rules.


def counted_by_definition(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def outliers_by_definition(rows, least_rows):
    """The distance of each row that the base rules keep, None where nothing is estimated: bins and steps as stated, in numpy."""
    stats, groups = [], Counter()
    for _, text, lang, source in rows:
        n, chars, symbols, dup, repeat, lines = counted_by_definition(text)
        fine = n >= 50 and 100 * repeat <= 50 * n
        x = [math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(n, 1)), math.asin(math.sqrt(min(1, dup / max(lines, 1)))), math.asin(math.sqrt(min(1, repeat / max(n, 1))))]
        stats.append((fine, lang or "", source or "", np.array([math.floor(v * 4096 + 0.5) for v in x])))
        groups[lang or "", source or ""] += fine
    pooled = Counter()
    for (lang, _), n in groups.items():
        pooled[lang] += n if n < least_rows else 0
    rest = sum(n for n in pooled.values() if n < least_rows)

    def group(lang, source):
        if groups[lang, source] >= least_rows:
            return lang, source
        return (lang,) if pooled[lang] >= least_rows else () if rest >= least_rows else None

    floor = np.diag(np.array(quality.FLOOR) ** 2)
    far = [None] * len(rows)
    for g in {group(s[1], s[2]) for s in stats} - {None}:
        own = [k for k, s in enumerate(stats) if s[0] and group(s[1], s[2]) == g]
        raw = np.array([stats[k][3] for k in own])
        x, h = raw / 4096, (len(own) + 5) // 2
        d2 = lambda m, c: ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
        lower = lambda a: np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]
        middle = lower(raw)
        away = lower(np.abs(raw - middle))
        best = []
        for m, c in ((x.mean(0), np.cov(x.T, bias=True) + floor), (middle / 4096, np.diag((1.4826 * away / 4096) ** 2) + floor)):
            for _ in range(quality.STEPS):
                bins = np.floor(16 * np.log2(d2(m, c) + 2.0**-20))
                last = np.sort(bins)[h - 1]
                m, c = x[bins <= last].mean(0), np.cov(x[bins <= last].T, bias=True) + floor
            best.append((np.linalg.slogdet(c)[1], m, c))
        _, m, c = min(best, key=lambda b: b[0])
        inner = x[d2(m, c) <= quality.quantile(0.975) * quality.consistent(0.5)]
        m, c = inner.mean(0), quality.consistent(0.975) * np.cov(inner.T, bias=True) + floor
        for k, v in zip(own, d2(m, c), strict=True):
            far[k] = v
    return far


def texts(seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(700):
        lines = [words_of(rng, rng.randint(5, 20), 60) for _ in range(rng.randint(1, 30))]
        text = "\n".join(lines + rng.choices(lines, k=rng.choice([0, 0, 0, 1, len(lines)])))
        if k % 20 == 0:
            text += " #$%&" * rng.randint(20, 200)
        rows.append((k, text, rng.choice(["en", "en", "en", "de", "fr"]) if k % 50 else None, rng.choice(["hot", "hot", "a", "b"])))
    return rows + [rows[3], rows[3], (3, "again", "en", "a"), (None, rows[5][1], "en", "hot"), (900, None, None, None), (901, "", "en", "a"), (902, "a b c d\n" * 5000, "en", "hot"), (903, " 　\x0b\x00 x" * 60, "de", "a"), (904, "one two", "rare", "z")]


def test_quality(spark):
    rows = texts()
    out = quality.judge(frame(spark, rows), least_rows=40).collect()
    far = outliers_by_definition(rows, 40)
    want = []
    for (i, text, *_), d in zip(rows, far, strict=True):
        n, chars, symbols, dup, repeat, _ = counted_by_definition(text)
        failed = n < 50 or 100 * repeat > 50 * n
        want.append((i, n, chars, symbols, dup, repeat, failed, not failed and (d is None or d <= quality.quantile(0.9999)), None if failed else d))
    key = lambda r: tuple((x is None, x or 0) for x in r[:8])
    out = sorted((tuple(r) for r in out), key=key)
    for a, b in zip(out, sorted(want, key=key), strict=True):
        assert a[:8] == b[:8]
        if not a[6]:
            assert a[8] == (None if b[8] is None else pytest.approx(b[8], rel=1e-3, abs=1e-5))
    assert 10 < sum(not r[6] and not r[7] for r in out) < 80


def test_quality_of_little(spark, monkeypatch):
    assert quality.judge(frame(spark, [])).count() == 0
    rows = texts()[:30]
    assert all(r["kept"] is not r["base_failed"] for r in quality.judge(frame(spark, rows)).collect())
    plans = quality.judge(frame(spark, texts()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plans)


def test_quality_without_broadcast(spark, monkeypatch):
    rows = texts()
    want = sorted(map(str, quality.judge(frame(spark, rows)).collect()))
    monkeypatch.setattr(quality, "GROUPS", 0)
    assert sorted(map(str, quality.judge(frame(spark, rows)).collect())) == want
