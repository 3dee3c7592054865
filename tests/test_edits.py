"""Translation edits with shifts, corpus scores by grouped counts, medians by ranges."""

import random
import statistics

import numpy as np
import pytest

from corveil.operators import edits, metrics


def levenshtein(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_distances_and_paths():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(1, 18))] for _ in range(2))
        x, y = np.array(a, np.int32), np.array(b, np.int32)
        want = levenshtein(a, b)
        band = edits.spans(len(a), len(b))
        above, below = edits.forward(x, y, band), edits.backward(x, y, band)
        assert above[-1][1][-1] == below[0][1][0] == want
        # Any words in place of some of the first text's.
        begin, end = sorted(draw.sample(range(len(a) + 1), 2))
        other = np.array([[draw.randrange(5) for _ in range(begin, end)] for _ in range(3)], np.int32)
        assert edits.distances(other, y, band, begin, above, below).tolist() == [levenshtein([*a[:begin], *o, *a[end:]], b) for o in other.tolist()]
        cost, place, off, off_ref = edits.alignment(x, y, above)
        assert cost == want
        matched = [j for j in range(len(b)) if not off_ref[j]]
        assert all(a[place[j]] == b[j] for j in matched) and (np.diff(place) >= 0).all()
        assert len(matched) == int((~off).sum())


@pytest.mark.parametrize(("text", "ref", "want"), [
    ("a b c d", "a b c d", 0), ("d e a b c", "a b c d e", 1), ("b a", "a b", 1), ("a x c", "a b c", 1), ("", "a b", 2), ("a b", "", 2), ("", "", 0),
    ("b a d c", "a b c d", 2), ("c d a b x", "a b c d", 2), ("x y z", "a b", 3), ("a a a", "a", 2),
    # A phrase of eleven words is one too long for a shift, so that its shorter neighbour moves.
    ("l m n a b c d e f g h i j k", "a b c d e f g h i j k l m n", 1),
    # Over fifty words apart: the phrase is left out and put in.
    ("p q " + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " p q", 4),
])
def test_shifts(text, ref, want):
    assert edits.edits(text.split(), ref.split()) == want


def test_band_of_long_texts():
    draw = random.Random(13)
    for n, m in ((150, 140), (90, 260), (260, 90), (200, 200)):
        x, y = (np.array([draw.randrange(40) for _ in range(k)], np.int32) for k in (n, m))
        band = edits.spans(n, m)
        above, below = edits.forward(x, y, band), edits.backward(x, y, band)
        assert all(((a + b).min() == above[-1][1][-1]) for (_, a), (_, b) in zip(above, below, strict=True))


def test_never_more_than_word_edits():
    draw = random.Random(5)
    for _ in range(200):
        a, b = ([f"w{draw.randrange(6)}" for _ in range(draw.randrange(0, 25))] for _ in range(2))
        assert edits.edits(a, b) <= levenshtein(a, b)


def test_ten_thousand_words():
    draw = random.Random(7)
    ref = [f"w{draw.randrange(3000)}" for _ in range(10_000)]
    assert edits.edits(ref[:100] + ref[120:130] + ref[100:120] + ref[130:], ref) == 1


def test_score_of_a_corpus(spark):
    d = spark.createDataFrame([("The cat SAT", "sat the cat"), (None, "a b"), ("a", None), ("x y", "x y")], "p string, g string")
    assert metrics.ter(d, "p", "g").first()["ter"] == pytest.approx(100 * (1 + 2 + 1) / 7)
    assert metrics.ter(d.filter("p is null and g is null"), "p", "g").first()["ter"] == 0.0


def test_bleu_of_long_and_short_texts(spark):
    words = [f"w{k % 700}" for k in range(20_000)]
    d = spark.createDataFrame([(" ".join(words), " ".join(words)), ("a b", None), (None, "c")], "p string, g string")
    assert 99.9 < metrics.bleu(d, "p", "g").first()["bleu"] < 100
    assert metrics.bleu(d.filter("g = 'c'"), "p", "g").first()["bleu"] == 0.0
    assert metrics.bleu(d.limit(0), "p", "g").first()["bleu"] == 0.0


def test_medians(spark):
    draw = random.Random(11)
    rows = [(draw.choice(["a", "b", None]), k, draw.choice([None, 1.0, 2.5, 7.0, draw.random()])) for k in draw.sample(range(5000), 700)] + [("one", 1, 4.0)]
    d = spark.createDataFrame(rows, "k string, at long, x double")
    keys = {k for k, _, _ in rows}
    arrival = {k: [x for _, x in sorted((t, x) for q, t, x in rows if q == k)] for k in keys}
    assert {r["k"]: r["median"] for r in metrics.middles(d, ["k"], "x", "at").collect()} == {k: v[len(v) // 2] for k, v in arrival.items()}
    size = {r["k"]: r["median"] for r in metrics.middles(d, ["k"], "x").collect()}
    assert size == pytest.approx({k: statistics.median(x for x in v if x is not None) for k, v in arrival.items()})
    assert metrics.middles(d.limit(0), ["k"], "x", "at").count() == 0
