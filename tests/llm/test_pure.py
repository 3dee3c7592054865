"""The parts of the operators that need no session, against brute force."""

import itertools
import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corveil.llm import html, matroska, packing, simhash, toxicity
from corveil.llm.queries import TOKENIZER
from corveil.llm.wordids import WordIds


def test_ids_equal_those_of_tokenizers():
    words = WordIds(TOKENIZER, remembered=50)
    texts = ["", " ", "Don't it's 'LL\n12³ª #%&***@!!", "a<|endoftext|>b <|startoftext|>", "ÀÉß İ ΑΣ Σ x á ́b", "日本語 text\tb c\x1cd\x85e", "x" * 200, "in the the in " * 50, "SE!! CIÓNCIEZ!!", "a­b", "\n\n \n"]
    for text in texts:
        assert words.ids(text).tolist() == words.plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    words = WordIds(TOKENIZER) if not hasattr(test_ids_of_any_text, "w") else test_ids_of_any_text.w
    test_ids_of_any_text.w = words
    for text in texts:
        assert words.ids(text).tolist() == words.plain.encode(text, add_special_tokens=False).ids


def test_a_very_long_text_is_cut_into_segments(monkeypatch):
    import corveil.llm.wordids as module

    monkeypatch.setattr(module, "PART", 40)
    words = WordIds(TOKENIZER)
    text = "the quick brown fox, jumps!\n" * 20 + "y" * 130 + " end"
    assert words.ids(text).tolist() == words.plain.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, k) for k, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for length, first, past, sequence, each, base in packing.best_fit_plan(counts, 40):
        for r in range(first, past):
            bins.setdefault(sequence + (r - first) // each, []).append((base + (r - first) % each * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(n for parts in bins.values() for _, n in parts) == sorted(lengths)
    assert sorted(40 - sum(n for _, n in parts) for parts in bins.values()) == best_fit_decreasing(lengths, 40)


def test_plan_stays_small():
    random.seed(1)
    counts = {n: random.randint(0, 10**9) for n in range(1, 4097)}
    assert len(packing.best_fit_plan({k: v for k, v in counts.items() if v}, 4096)) < 200_000


@pytest.mark.parametrize("n", [64, 512, 4096, 4096 * 32, 4096 * 33 + 64, 1 << 20])
def test_media_round_trip(n):
    payload = os.urandom(n)
    media = matroska.wrap(payload)
    facts, packets = matroska.parse(media)
    assert b"".join(media[o : o + k] for *_, o, k in packets) == payload
    for time, track, at in facts["cues"]:
        assert media[facts["segment"] + at :][:4] == bytes.fromhex("1F43B675") and track == 1 and time >= 0
    times = [p[1] for p in packets]
    assert times == sorted(times)


def test_all_lacings_unknown_sizes_and_groups():
    m = matroska
    frames = [b"a" * 300, b"b" * 5, b"c" * 7]
    xiph = bytes([2, 255, 45, 5]) + b"".join(frames)
    ebml = bytes([2]) + m.vint(300) + struct.pack(">H", 0x4000 | (5 - 300 + 8191)) + b"".join(frames)
    fixed = bytes([2]) + b"xxyyzz"
    lead = lambda flags: m.vint(1) + struct.pack(">hB", 3, flags)
    body = m.number(m.TIMESTAMP, 10) + m.element(m.SIMPLE_BLOCK, lead(0x80 | 2) + xiph) + m.element(m.SIMPLE_BLOCK, lead(6) + ebml) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, lead(4) + fixed) + m.number(m.REFERENCE_BLOCK, 1))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    _, packets = m.parse(data)
    assert len(packets) == 18
    assert [data[o : o + n] for *_, o, n in packets[:9]] == frames * 2 + [b"xx", b"yy", b"zz"]
    assert [p[5] for p in packets[:9]] == [True] * 3 + [False] * 6
    assert {p[2] for p in packets} == {0, 1} and packets[0][1] == 13_000_000
    with pytest.raises(ValueError):
        m.parse(m.element(m.SEGMENT, b"\x1a")[:-1] + b"\x00")


def brute_segments(scores):
    """All maximal segments by their recursive definition."""
    def best(a, b):
        sums = np.concatenate([[0], np.cumsum(scores)])
        top = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sums[j] - sums[i]
                if s > 0 and (top is None or s > top[2] + 1e-12 or abs(s - top[2]) <= 1e-12 and j - i < top[1] - top[0]):
                    top = (i, j, s)
        return top

    def walk(a, b):
        t = best(a, b) if b > a else None
        return [] if t is None else walk(a, t[0]) + [t] + walk(t[1], b)

    return walk(0, len(scores))


def test_maximal_segments():
    random.seed(2)
    for _ in range(300):
        scores = np.array([random.choice([-7, -5, -3, -1, 2, 4, 6]) + random.random() / 10 for _ in range(random.randint(0, 14))])
        found = [(a, b) for a, b, _ in toxicity.maximal_segments(scores)]
        assert found == [(a, b) for a, b, _ in brute_segments(scores)]


def test_extreme_rate_is_a_root():
    values, weights = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    rate = toxicity.extreme_rate(values, weights)
    assert weights @ np.exp(rate * values) == pytest.approx(1)


def test_three_groups_agree_within_reach():
    random.seed(3)
    for _ in range(2000):
        x = random.getrandbits(64)
        y = x
        for b in random.sample(range(64), random.randint(0, 3)):
            y ^= 1 << b
        count = lambda v, s: (v >> 2 * s & 1) + (v >> 2 * s + 1 & 1)
        same = [all(count(x, s) == count(y, s) for s in range(a, b)) for a, b in simhash.GROUPS]
        assert sum(same) >= 3
        distance = sum(abs(count(x, s) - count(y, s)) for s in range(32))
        assert distance <= bin(x ^ y).count("1")
        a, b = simhash.near_pairs(np.array([x], np.uint64), np.array([y], np.uint64), 3)
        assert len(a) == 1
    assert sorted(itertools.chain.from_iterable(range(a, b) for a, b in simhash.GROUPS)) == list(range(32))


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar"><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy &amp; go</div><div id="cookie-notice">We use</div><article class=post><h1>A  &lt;title&gt;</h1><p><b>One&nbsp;two<br>three<p>Four <i>fi</i>ve<!-- no --><aside>Aside</aside>
<ul><li>a<li>b</ul><form><input value=x>Form</form><section class="comments"><p>Nice!</p></section><table><tr><td>c<td>d</table></article><div class="sidebar">Side</div><footer>&copy; x</footer></body></html>"""


def test_article_blocks():
    marked, blocks = html.blocks(PAGE)
    assert marked and blocks == ["A <title>", "One two three", "Four five", "a", "b", "c", "d"]


def test_main_and_other_articles():
    page = "<body><div>x</div><main><p>crumbs</p><article class='has-sidebar'><p>a<article class=comment>no</article><p>b</article><article class='related-post'>r</article></main></body>"
    assert html.blocks(page) == (True, ["a", "b"])
    assert html.blocks("<body>x<main><div class=table-responsive>c</div><article class=comment>no</article></main>") == (True, ["c"])
    assert html.blocks("x<p>y") == (False, ["x", "y"])


def test_formulas_objects_and_unclosed_elements():
    assert html.blocks("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data=a><b>words</b></object> end</article>") == (True, ["so x=2 and words end"])
    assert html.blocks("<article><p>a</p><div>b<select><option>no<option>no</div><p>c</p><div><video>no</div><p>d</p></article>") == (True, ["a", "b", "c", "d"])
    assert html.blocks("<article><div>a<textarea>no</div><p>b</p><svg><title>no</title><text>no</svg><p>c<script>no</p>no</article>") == (True, ["a", "b", "c"])


def test_single_unique_tokens_stay():
    assert html.unique_runs("Price 42 EUR by Ann", np.array([True, False, True, True, False])) == "42 Ann"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-=\"' abpdivscript&;#1", max_size=80))
def test_any_html_is_read(text):
    html.blocks(text)
