"""Operators on small tables with nulls, empty and repeated rows, against brute force."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from corveil.llm import common, embeddings, html, langid, matroska, mixing, packing, sharding, simhash, toxicity, urls
from corveil.llm.queries import TOKENIZER
from corveil.llm.wordids import WordIds

DOCS = "doc_id long, text string, lang string, source string, extra string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS)


def some(n=60):
    out = [(i, " ".join(f"word{(i * k) % 17}" for k in range(1, 4 + i % 9)), ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4 if i % 5 else 0]) for i in range(n)]
    return out + [(3, "again", "en", "a"), (3, "again", "en", "a"), (None, "no id", "de", "b"), (1000, None, None, None), (1001, "", "en", "c"), (1002, "w " * 9000, "en", "a")]


def test_ranked_and_components(spark):
    df = spark.range(200).selectExpr("id % 3 as g", "id", "cast(id % 7 as int) as b")
    from pyspark.sql import functions as F

    rows = common.ranked(df, ["g"], "b", [F.col("id")], "r").collect()
    for g in range(3):
        own = sorted((r["b"], r["id"], r["r"]) for r in rows if r["g"] == g)
        assert [x[2] for x in own] == list(range(len(own)))
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (100, 25), (7, 7)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found[100] == 0 and found[29] == 0 and found[19] == 10 and found[10] == 10 and found[0] == 0
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark):
    rows = some()
    out = packing.best_fit_pack(packing.pieces(documents(spark, rows), TOKENIZER, 64), 64).collect()
    assert sum(r["piece"] == 0 for r in out) == len(rows)
    plain = WordIds(TOKENIZER).plain
    want = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)
    by_sequence = {}
    for r in out:
        assert 1 <= r["length"] <= 64 and r["start"] == 64 * r["piece"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in out) == sum(want)
    assert len(by_sequence) <= math.ceil(sum(want) / 64) * 1.25
    assert packing.best_fit_pack(packing.pieces(documents(spark, []), TOKENIZER)).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, shards):
    rows = some(300)
    out = sharding.shard_rows(documents(spark, rows), shards, 16).collect()
    assert len(out) == len(rows)
    counts = [0] * shards
    slots = {k: set() for k in range(shards)}
    home = [0] * shards
    for r in out:
        counts[r["shard"]] += 1
        home[r["home"]] += 1
        slots[r["shard"]].add(r["slot"])
    assert max(counts) - min(counts) <= 1
    assert all(slots[k] == set(range(counts[k])) for k in range(shards))
    # Only what is over a bound moves.
    moved = sum(r["shard"] != r["home"] for r in out)
    assert moved == sum(max(0, h - c) for h, c in zip(home, counts))
    texts = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == texts
    assert sharding.shard_rows(documents(spark, []), shards).count() == 0


def test_media(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x" * 100_000)]
    out = matroska.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["payload_bytes"] for r in out) == [64, 64, 256, 256, 100_032]
    assert len({tuple(r)[1:] for r in out}) == 3
    files = spark.createDataFrame([(1, bytearray(matroska.wrap(b"abcd" * 64))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    packets = matroska.packets(files, "media", "id").collect()
    assert {r["id"] for r in packets} == {1, 3} and sum(r["length"] or 0 for r in packets) == 256 and [r["error"] is None for r in packets if r["id"] == 3] == [False]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(spark):
    rows = some(200)
    out = mixing.mix(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = sorted(brute_targets(sizes).values())
    assert np.allclose(sorted({r["target"] for r in out}), sorted(set(want)))
    for number in {r["number"] for r in out}:
        own = [r for r in out if r["number"] == number]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert all((r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1) for r in out)
    ordered = mixing.training_order(documents(spark, rows))
    assert ordered.columns == ["doc_id", "text", "lang", "source", "extra"]
    rounds = sum((r["taken"] > 0) + (r["taken"] > 0 and r["last_position"] > r["position"]) for r in out)
    assert ordered.count() == rounds
    assert mixing.mix(documents(spark, [])).count() == 0


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    for slope in (0.5, 0.0, -0.5):
        for r in spark.range(11).select((F.col("id") / 10).alias("u")).select("u", mixing.invert_demand(F.col("u"), F.lit(slope)).alias("t")).collect():
            assert r["t"] + slope * (r["t"] ** 2 - r["t"]) == pytest.approx(r["u"], abs=1e-9)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    base = [[words[k] for k in rng.integers(0, 300, 120)] for _ in range(6)]
    rows = []
    for k, b in enumerate(base):
        for j in range(25):
            own = list(b)
            if j:
                own[int(rng.integers(0, 120))] = "changed"
            rows.append((1000 - len(rows), " ".join(own) + ("  \n" if j % 2 else ""), "en", "a"))
    rows += [(5, "Straße ÄÖ One", "de", "b"), (6, "straße ÄÖ one", "de", "b"), (7, "", "en", None), (8, None, None, None), (9, " \t\n", "en", "a"), (None, "", "en", "a"), (6, "one two", "en", "a"), (11, "one two", "en", "a")]
    want = [plain_fingerprint(t or "") for _, t, _, _ in rows]
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(want[i] ^ want[j]).count("1") <= 3:
                least[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), 1 << 60), r[0])
    expected = sorted((r[0] if r[0] is not None else -1, want[i], ids.get(root(i))) for i, r in enumerate(rows))
    for block in (2048, 8):
        monkeypatch.setattr(simhash.links, "__defaults__", (3, block))
        out = simhash.near_duplicates(documents(spark, rows)).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] & (1 << 64) - 1, r["component_id"]) for r in out) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def five_word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    n = min(5, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if n else frozenset()


def kept_by_brute_force(rows):
    """(id, text) of the rows that stay: one of each group, and all without id."""
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = [five_word_sets(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, t, *_ in rows:
        if i is not None:
            groups.setdefault(root(texts.index(t or "")), set()).add((i, t or ""))
    return [sorted(x for x in g if x[0] == min(g)[0]) for g in groups.values()]


def test_keep_first(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(8):
        base = [words[j] for j in rng.integers(0, 400, [6, 30, 80, 200][k % 4])]
        for j in range(12):
            own = list(base)
            for at in rng.integers(0, len(own), j % 5):
                own[int(at)] = f"x{k}{j}{at}"
            rows.append((500 - len(rows), " ".join(own) + (" \n" if j % 3 else ""), "en", "a"))
    rows += [(5, "ONE two", "en", "a"), (6, "one two", "de", "b"), (7, "", "en", None), (8, None, None, None), (9, " \t\n", "en", "a"), (None, "", "en", "a"), (6, "one two", "en", "a"), (11, "one", "en", "a"), (600, "w " * 30_000, "en", "a"), (601, "w " * 29_000, "en", "a")]
    kept = simhash.keep_first(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "extra"]
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    want = kept_by_brute_force(rows)
    assert len(got) == len(want) + 1 and (None, "") in got
    assert all(sum(x in group for x in got) == 1 for group in want)
    assert 20 < len(want) < 80
    assert simhash.keep_first(documents(spark, [])).count() == 0


def test_keep_first_of_repeated_ids(spark):
    long = " ".join(f"a{k}" for k in range(60))
    rows = [(1, long, "en", "a"), (1, "entirely other words", "en", "a"), (1, long, "en", "b"), (2, long.upper(), "en", "a"), (3, "a third text", "en", "a")]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(documents(spark, rows)).collect())
    assert kept == [(1, long), (1, "entirely other words"), (3, "a third text")]


def test_many_copies_and_a_cell_of_several_groups(spark):
    rng = np.random.default_rng(12)
    base = [[f"b{g}w{k}" for k in range(100)] for g in range(3)]
    rows = []
    for k in range(150):
        own = list(base[k % 3])
        own[int(rng.integers(0, 100))] = f"y{k}"
        rows.append((k, " ".join(own), "en", "a"))
    kept = sorted(r["doc_id"] for r in simhash.keep_first(documents(spark, rows)).collect())
    assert kept == [0, 1, 2]


def test_simhash_rejects_what_its_grid_misses(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents(spark, some()), reach=4)


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        c = rng.normal(size=16)
        for _ in range(8):
            rows.append((len(rows), (c + rng.normal(size=16) * 0.06).astype(np.float32).tolist(), k % 2))
    rows += [(i + 500, rows[3][1], rows[3][2]) for i in range(10)] + [(700, [2 * x for x in rows[3][1]], rows[3][2]), (701, rows[3][1], 9), (702, rows[3][1], None), (703, None, 0), (704, [0.0] * 16, 0), (705, [float("nan")] * 16, 0), (706, [], 0), (707, rows[5][1][:8], 0), (707, rows[5][1][:8], 0)]
    good = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and np.isfinite(v).all() and np.any(v)]
    n = {}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.sqrt((x[1] @ x[1]) * (y[1] @ y[1])) >= 0.98:
                n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for a, x in enumerate(good):
        least[root(a)] = min(least.get(root(a), 1 << 60), x[0])
    want = sorted([(x[0], n.get(a, 0), least[root(a)]) for a, x in enumerate(good)] + [(i, 0, i) for i in (702, 703, 704, 705, 706)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embeddings.near_duplicates(df, block=block, directions=3).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.com/x"), (2, "https://m.Example.com/en/1"), (3, "https://www.example.com/en/1?q"), (4, "http://b.net/es/2"), (5, "http://c.org/en/1"), (6, None), (7, "no scheme"), (8, "http://b.net/fr/9#x"), (9, "http://a.com"), (10, "HTTP://X.NET"), (11, "http://notexample.com/en/")] + [(k, f"http://h{k}.com/p{k}") for k in range(100, 140)] + [(k, f"http://spam{k}-x.net/es/{k}?a=1&b=2") for k in range(200, 240)]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == len(rows)
    assert (out[1]["rule"], out[1]["verdict"]) == ("com/", "allow") and (out[2]["rule"], out[2]["verdict"]) == ("example.com/en/", "block")
    assert (out[3]["rule"], out[3]["verdict"]) == ("www.example.com/en/", "allow") and out[4]["rule"] == "net/es/" and out[8]["rule"] == "net/fr/" and out[11]["rule"] == "com/"
    assert out[5]["rule"] is None and out[5]["host"] == "c.org" and out[5]["path"] == "/en/1" and out[9]["rule"] is None and out[10]["host"] == "x.net"
    assert out[6]["host"] == out[7]["host"] == out[6]["path"] == "" and all(r["verdict"] in ("allow", "block") for r in out.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.judge(spark.createDataFrame([(1, "http://c.org")], "page_id long, url string")).first()["verdict"] == "allow"


def test_html(spark):
    menu = "Home About us Contact the team Careers and jobs Imprint Privacy"
    body = lambda k: f"<body><div>{menu}</div><div>{' '.join(f't{k}x{j}' for j in range(12))}</div><div>{menu} only{k} here{k} now{k} end{k}</div></body>"
    rows = [(k, f"http://host/{k}", body(k)) for k in range(4)] + [(4, "http://other/1", body(9)), (5, None, None), (6, "http://host/6", ""), (7, "http://host/7", f"<article><p>{menu}</p></article>"), (7, "http://host/7", f"<article><p>{menu}</p></article>")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[0] == " ".join(f"t0x{j}" for j in range(12)) + "\nonly0 here0 now0 end0"
    assert got[4].startswith(menu) and got[5] == got[6] == "" and got[7] == menu
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marked_pages_are_evidence_for_open_ones(spark):
    menu = "Home About us Contact the team Careers and jobs Imprint Privacy"
    quoted = "a sentence of eight words or more that an article has too"
    own = " ".join(f"own{j}" for j in range(12))
    article = lambda k, more="": f"<article><p>{' '.join(f't{k}x{j}' for j in range(12))}</p>{more}</article>"
    # The open page shares its menu only with marked pages, one of which has it as nav; what it shares with an article stays.
    rows = [(0, "http://host/0", f"<div>{menu}</div><div>{own}</div><div>{quoted}</div>"), (1, "http://host/1", f"<nav>{menu}</nav>{article(1, f'<p>{quoted}</p>')}"), (2, "http://host/2", f"<div>{menu}</div>{article(2)}")]
    rows += [(3, "http://else/3", f"<div>{menu}</div><div>{own}</div>")]
    got = {r["page_id"]: (r["text"], r["marked"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == (f"{own}\n{quoted}", False) and got[3] == (f"{menu}\n{own}", False)
    assert got[1][0] == " ".join(f"t1x{j}" for j in range(12)) + f"\n{quoted}" and got[2] == (" ".join(f"t2x{j}" for j in range(12)), True)


def test_language(spark):
    text = {"en": "the house and the garden with the old tree", "de": "das haus und der garten mit dem alten baum", "fr": "la maison et le jardin avec le vieux arbre"}
    docs = documents(spark, [(k, f"{t} {k}", lang, "s") for k, (lang, t) in enumerate(list(text.items()) * 5)] + [(90, None, "en", "s"), (91, "", None, None)])
    rows = [(k, f"http://{lang}.example.com/{lang}/{k}", f"<html lang={lang}><p>{t}</p></html>") for k, (lang, t) in enumerate(list(text.items()) * 4)]
    rows += [(50, "http://de.example.com/de/x", "<html><p>123</p></html>"), (51, None, None), (52, "http://en.example.com/", f"<html lang=de><p>{text['en']}</p></html>"), (52, "nonsense", "")]
    out = langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    assert all(got[k]["language"] == lang and got[k]["accepted"] for k, lang in enumerate(list(text) * 4))
    assert got[50]["language"] == "de" and not got[50]["accepted"] and not got[51]["accepted"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(15))
    assert langid.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0
    assert langid.identify_pages(spark.createDataFrame(rows[:2], "page_id long, url string, html string"), docs.limit(0)).count() == 2


def test_rare_language(spark):
    text = {"en": "the house and the garden with the old tree", "fi": "vanha puutarha talon takana kasvaa omenapuita"}
    docs = documents(spark, [(k, f"{text['en']} {k}", "en", "s") for k in range(300)] + [(900, text["fi"], "fi", "t")])
    rows = [(k, f"http://{lang}.example.com/", f"<html lang={lang}><p>{text[lang]}</p></html>") for k, lang in enumerate(["en", "en", "fi"])]
    out = langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert {r["page_id"]: (r["language"], r["accepted"]) for r in out} == {0: ("en", True), 1: ("en", True), 2: ("fi", True)}
    assert langid.keep_identified(docs).count() == 301


def test_many_languages(spark):
    docs = documents(spark, [(k, " ".join(f"{a}{b}{c}" for b in "aeiou" for c in "klmnr"), f"l{k}", "s") for k, a in enumerate(x + y for x in "bcdfghjkl" for y in "pqrstvwxz")])
    rows = [(k, f"http://{k}.com/", f"<p>{r['text']}</p>") for k, r in enumerate(docs.sort("doc_id").collect())]
    out = langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert len(out) == 81 and all(r["language"] == f"l{r['page_id']}" for r in out)


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(400):
        own = [words[i] for i in rng.integers(0, 200, 60)]
        bad = k % 5 == 0
        if bad:
            own[20:22] = ["vilest", "slurword"]
        rows.append((k, " ".join(own), "en", "a"))
        labels.append((k, int(bad)))
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "Slurword! " * 30, "en", "a")]
    labels += [(None, 1), (903, None)]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    assert len(out) == len(rows)
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(out[k]["held_out"] == (k in held) for k in range(400))
    assert sum(out[k]["predicted"] == (k % 5 == 0) for k in held) >= 0.95 * len(held)
    assert out[900]["predicted"] == out[901]["predicted"] == 0 and out[902]["predicted"] == 1
    span = out[0]["passages"][0]
    assert rows[0][1][span["first"] : span["past"]] == "vilest slurword"
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and kept.filter("doc_id = 901").count() == 1 and kept.filter("doc_id = 902").count() == 0
    assert toxicity.score_documents(docs, known.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), known).count() == 0


def test_clashing_columns(spark):
    docs = documents(spark, some(20)).selectExpr("*", "doc_id as number", "1 as r", "2 as bucket", "3 as size", "'q' as _t", "4 as logs", "5 as position", "6 as fp", "7 as _kept")
    assert mixing.training_order(docs).columns == docs.columns
    assert simhash.keep_first(docs).columns == docs.columns
    assert langid.keep_identified(docs).columns == docs.columns
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs.selectExpr("*", "8 as _toxicity", "9 as toxic", "1 as labelled"), labels).columns == [*docs.columns, "_toxicity", "toxic", "labelled"]


def test_very_long_texts(spark):
    long = "the vilest slurword and a word more " * 40_000
    docs = documents(spark, [(1, long, "en", "a"), (2, "x" * 1_500_000, "de", "b"), (3, "kind words", "en", "a"), (4, "vilest slurword", "en", "a")])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 4
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} >= {1}
    prints = {r["doc_id"]: r["fp"] for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] & (1 << 64) - 1 == plain_fingerprint(long)
    assert simhash.keep_first(docs).count() == 4
    out = html.extract(spark.createDataFrame([(1, "http://h/", f"<article><p>{long}</p></article>"), (2, "http://h/", f"<div>{long}</div>")], "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in out) == [len(long) - 1] * 2
    pieces = packing.pieces(docs, TOKENIZER).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == 40_000 * len(WordIds(TOKENIZER).ids("the vilest slurword and a word more")) + 1
