"""The nearest vectors by pivots against brute force."""

import numpy as np
import pytest

from corveil.operators import search


def brute(queries, vectors, k):
    fine = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = []
    for i, q in queries:
        if fine(q):
            near = sorted((-round(float(unit(q) @ unit(v)), 9), j) for j, v in vectors if j != i and fine(v) and len(v) == len(q))
            out += [(i, j, n + 1, -c) for n, (c, j) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize("pivots, sample, part", [(8, 10_000, 4096), (16, 20, 7), (1, 1, 50)])
def test_nearest(spark, pivots, sample, part):
    """Clusters, copies, two widths, unusable vectors; also with parts, and pivots of a sample that lacks a width."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(9, 6))
    vectors = [(i, (middle[i % 9] + 0.2 * rng.normal(size=6)).tolist()) for i in range(300)]
    vectors += [(i, vectors[i - 300][1]) for i in range(300, 330)] + [(i, rng.normal(size=3).tolist()) for i in range(330, 345)]
    vectors += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [])]
    queries = [v for v in vectors if v[0] % 7 == 0] + [(1000, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1001, None), (1002, [1.0, 1.0, 1.0, 1.0])]
    made = [spark.createDataFrame(d, "id long, vector array<double>") for d in (queries, vectors)]
    out = [(r["query_id"], r["id"], r["rank"], r["cosine"]) for r in search.nearest(*made, 5, pivots, sample, part).collect()]
    want = sorted(brute(queries, vectors, 5))
    assert [r[:3] for r in sorted(out)] == [r[:3] for r in want]
    assert [r[3] for r in sorted(out)] == pytest.approx([r[3] for r in want])


def test_far_lists_are_not_visited(spark):
    rng = np.random.default_rng(2)
    middle = np.eye(16)
    vectors = [(i, (middle[i % 16] + 0.02 * rng.normal(size=16)).tolist()) for i in range(800)]
    made = spark.createDataFrame(vectors, "id long, vector array<double>")
    fitted = search.pivots_of(made, 16)
    assert len(fitted[16]) == 16
    seen = []
    whole = search.met
    search.met = lambda q, v, k: seen.append(q.count()) or whole(q, v, k)
    try:
        out = search.nearest(made.filter("id % 40 = 0"), made, 3, 16).collect()
    finally:
        search.met = whole
    assert len(out) == 60 and seen == [20, 0]


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert search.nearest(none, some, 3).count() == 0 and search.nearest(some, none, 3).count() == 0 and search.nearest(some, some, 3).count() == 0
