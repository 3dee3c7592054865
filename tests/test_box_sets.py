"""Sets of boxes matched side by side, against one pair of sets at a time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from corveil.functions import assignment as A


def some_sets(draw, most, few):
    def boxes(n):
        corners = [(draw.choice(range(few)), draw.choice(range(few))) for _ in range(n)]
        return [[float(x), float(y), x + draw.choice([3.0, 4.0, 5.0]), y + draw.choice([3.0, 4.0])] for x, y in corners]

    return boxes(draw.randrange(most)), boxes(draw.randrange(most))


def test_sets_side_by_side_equal_one_by_one():
    draw = random.Random(9)
    pairs = [some_sets(draw, *draw.choice([(3, 4), (8, 3), (14, 3), (14, 6)])) for _ in range(600)] + [([], []), ([[0.0, 0.0, float("nan"), 1.0]], [[0.0, 0.0, 1.0, 1.0]])]
    p, g = (pa.array([x[k] for x in pairs], pa.list_(pa.list_(pa.float64()))) for k in (0, 1))
    got = A.match_sets(p, g).to_pylist()
    for row, (a, b) in zip(got, pairs, strict=True):
        assert list(row.values()) == pytest.approx(A.match_counts(a, b), abs=1e-12), (a, b)
    assert sum(r["tp"] > 3 for r in got) > 20


def test_assignments_of_many_matrices():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 7), (9, 9)):
        cost = np.where(draw.random((80, n, m)) < 0.5, draw.integers(0, 4, (80, n, m)) / 4, 1e6)
        for one, row in zip(cost, A.assign_all(cost), strict=True):
            assert sorted((int(i), j) for j, i in enumerate(row) if i >= 0) == sorted(A.assign(one))


def test_many_small_sets_are_quick():
    draw = random.Random(3)
    pairs = [some_sets(draw, 8, 6) for _ in range(2000)] * 15
    p, g = (pa.array([x[k] for x in pairs], pa.list_(pa.list_(pa.float64()))) for k in (0, 1))
    begun = time.monotonic()
    assert len(A.match_sets(p, g)) == 30000 and time.monotonic() - begun < 6
