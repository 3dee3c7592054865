"""The host array over the suffixes of whole pages, marked content included, against brute force."""

import random

from corveil.llm import html


def test_repeats_of_whole_pages_against_brute_force(spark):
    rng = random.Random(7)
    runs = [[f"r{k}w{j}" for j in range(rng.randint(6, 14))] for k in range(5)]
    said = [[f"s{k}w{j}" for j in range(rng.randint(8, 14))] for k in range(5)]
    own = lambda k, b: [f"p{k}b{b}w{j}" for j in range(rng.randint(1, 9))] + rng.choice([[], rng.choice(runs), rng.choice(said if b[0] == "c" else runs)]) + [f"q{k}b{b}"] * rng.randint(0, 1)
    pages, inside, outside = [], {}, {}
    for k in range(40):
        content, menu = ([own(k, f"{x}{b}") for b in range(rng.randint(1, 3))] for x in "cm")
        marked = k % 3 > 0
        put = lambda blocks, tag: "".join(f"<{tag}>{' '.join(b)}</{tag}>" for b in blocks)
        pages.append((k, f"http://h{k % 2}/{k}", put(menu, "nav") + (f"<article>{put(content, 'p')}</article>" if marked else put(content, "p"))))
        streams = [sum(content, [])], [sum(menu, [])] if marked else [sum(menu + content, [])]
        inside[k], outside[k] = (content, streams[0] if marked else []), streams[1] if marked else streams[0] + streams[1]
    grams = lambda xs: {tuple(x[i : i + 8]) for x in xs for i in range(len(x) - 7)}
    sure, rest = ({k: grams(x) for k, x in found.items()} for found in ({k: x[1] for k, x in inside.items()}, outside))
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    only_inside = 0
    for k, (content, marked) in inside.items():
        host = [m for m in inside if m % 2 == k % 2]
        flat = sum(content, [])
        covered, gone = [False] * len(flat), [False] * len(flat)
        for i in range(len(flat) - 7):
            g = tuple(flat[i : i + 8])
            n, m = (sum(g in x[p] for p in host) for x in (rest, sure))
            if any(g in sure[p] | rest[p] for p in host if p != k):
                covered[i : i + 8] = [True] * 8
                only_inside += n < 2
                if n >= 2 and n >= m:
                    gone[i : i + 8] = [True] * 8
        lines, at = [], 0
        for b in content:
            lines.append(" ".join(w for w, c in zip(b, gone[at : at + len(b)], strict=True) if marked or not c))
            at += len(b)
        assert (got[k]["text"], got[k]["covered"]) == ("\n".join(x for x in lines if x), sum(covered)), k
    assert only_inside


def test_marks_of_two_pages_come_through_their_packing():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << html.MARK, 3000)) for _ in range(6)]
    sets[1][:40], sets[5][:7] = sets[0][:40], sets[2][:7]
    packed = [html.pack_marks([np.unique(x) for x in some]) for some in (sets[:2], sets[2:4], sets[4:])]
    table = pa.Table.from_batches(packed)
    found = [m for p in set(table.column("part").to_pylist()) for m in html.twice((pa.scalar(p),), table.filter(pa.compute.equal(table.column("part"), p))).column("mark").to_pylist()]
    marks, times = np.unique(np.concatenate([np.unique(x) for x in sets]), return_counts=True)
    assert sorted(found) == marks[times > 1].tolist() and len(found) >= 47
