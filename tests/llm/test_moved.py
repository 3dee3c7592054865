"""What the near-dedup stage moves and that what it holds back changes nothing; the host array on marked pages."""

import random

from pyspark.sql import functions as F

from corveil.llm import html, simhash

DOCS = "doc_id long, text string, lang string, source string"


def shuffled(spark):
    return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])


def test_texts_without_near_copies_are_not_moved(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)), "en", "a") for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " more", "en", "a") for k in range(3)] + [(2000, rows[9][1], "en", "a"), (None, rows[8][1], "en", "a"), (None, "alone and without an id", "en", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    before = shuffled(spark)
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert sorted(x for x in kept if x is not None) == list(range(150)) and kept.count(None) == 2
    assert shuffled(spark) - before < 0.5 * sum(len(r[1]) for r in rows)


def test_cells_of_the_same_classes_are_held_against_each_other_once(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.getrandbits(40):x}" for _ in range(120)]
    rows = []
    for k in range(4):
        words = base.copy()
        for at in rng.sample(range(120), 3 + k):
            words[at] = f"v{rng.getrandbits(40):x}"
        rows.append((k, " ".join(words), "en", "a"))
    cells = []
    held = simhash.pairs_of_cells
    monkeypatch.setattr(simhash, "pairs_of_cells", lambda c, *a: (cells.extend(c.select("cell", "key").collect()), held(c, *a))[1])
    assert simhash.keep_first(spark.createDataFrame(rows, DOCS)).count() >= 1
    members = {}
    for cell, key in cells:
        members.setdefault(cell, set()).add(key)
    assert len({frozenset(x) for x in members.values()}) == len(members)


def test_a_sieve_holds_none_of_its_keys_back(spark, monkeypatch):
    rows, keys = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("_word")), spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    for most in (26, 8):
        monkeypatch.setattr(simhash, "SIEVE", most)
        hit, miss = ({r["k"] for r in d.collect()} for d in simhash.sieve(rows, "k", keys))
        assert set(range(0, 5000, 7)) <= hit and not hit & miss and hit | miss == set(range(5000))
        assert most == 8 or len(hit) < 1500
    hit, miss = simhash.sieve(rows, "k", keys.limit(0))
    assert hit.count() == 0 and miss.count() == 5000 and miss.columns == rows.columns


def test_the_host_array_reads_marked_pages_and_markup_checks_it(spark):
    menu = "Home About us Contact the team Careers and jobs Imprint Privacy"
    own = lambda k: " ".join(f"t{k}x{j}" for j in range(12))
    rows = [(k, f"http://host/{k}", f"<nav>{menu}</nav><article><p>{own(k)}</p></article>") for k in range(3)]
    rows += [(3, "http://host/3", f"<article><p>{own(3)}</p><p>{menu}</p></article>"), (4, "http://host/4", f"<div>{menu}</div><div>{own(4)}</div>"), (5, "http://else/5", f"<article><p>{menu}</p></article>")]
    got = {r["page_id"]: (r["text"], r["covered"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: (own(k), 0) for k in range(3)}, 3: (f"{own(3)}\n{menu}", 11), 4: (own(4), 11), 5: (menu, 0)}
