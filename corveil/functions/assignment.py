"""Optimal assignment of predicted to reference boxes, as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "tp int, fp int, fn int, precision double, recall double, f1 double, mean_iou double"
#: Cells of matrices that are worked on together, at least one matrix.
CELLS = 400_000


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of the smaller side, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign(cost.T)]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def assign_all(cost: np.ndarray) -> np.ndarray:
    """assign of many matrices of one shape (matrix x row x column), at most as many rows as columns, side by side: the row of each column, -1 for none."""
    many, n, m = cost.shape
    u, v, match = np.zeros((many, n + 1)), np.zeros((many, m + 1)), np.zeros((many, m + 1), int)
    for i in range(1, n + 1):
        match[:, 0] = i
        at = np.zeros(many, int)
        low, way, used = np.full((many, m + 1), np.inf), np.zeros((many, m + 1), int), np.zeros((many, m + 1), bool)
        on = np.arange(many)
        while len(on):
            used[on, at[on]] = True
            row, taken = match[on, at[on]], used[on]
            reduced = cost[on, row - 1] - u[on, row][:, None] - v[on, 1:]
            better = ~taken[:, 1:] & (reduced < low[on, 1:])
            least = low[on]
            least[:, 1:] = np.where(better, reduced, least[:, 1:])
            way[on, 1:] = np.where(better, at[on][:, None], way[on, 1:])
            at[on] = np.where(taken, np.inf, least)[:, 1:].argmin(1) + 1
            step = least[np.arange(len(on)), at[on]][:, None]
            # Columns without a row stand for row 0, whose number nobody reads.
            u[on[:, None], match[on]] += np.where(taken, step, 0)
            v[on] -= np.where(taken, step, 0)
            low[on] = np.where(taken, least, least - step)
            on = on[match[on, at[on]] > 0]
        on = np.arange(many)
        while len(on):
            match[on, at[on]] = match[on, way[on, at[on]]]
            at[on] = way[on, at[on]]
            on = on[at[on] > 0]
    return match[:, 1:] - 1


def ious(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """IoU of all pairs of boxes (..., box, corner) of two sets."""
    side = lambda k: np.maximum(0, np.minimum(p[..., :, None, k + 2], g[..., None, :, k + 2]) - np.maximum(p[..., :, None, k], g[..., None, :, k]))
    area = lambda b: np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])
    inter = side(0) * side(1)
    return inter / np.maximum(area(p)[..., :, None] + area(g)[..., None, :] - inter, 1e-12)


def best_hits(p: np.ndarray, g: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(matches, sum of their IoU) of many pairs of sets of boxes (pair of sets x box x corner), side by side."""
    if p.shape[1] > g.shape[1]:
        p, g = g, p
    iou = ious(p, g)
    hit = iou >= threshold
    value = np.where(hit, iou, 0).max(1)
    # Where a box has several partners the assignment decides, elsewhere there is nothing to choose.
    hard = np.flatnonzero((hit.sum(1) > 1).any(1) | (hit.sum(2) > 1).any(1))
    if len(hard):
        row = assign_all(np.where(hit[hard], 1 - iou[hard], 1e6))
        of = np.take_along_axis(iou[hard], np.maximum(row, 0)[:, None, :], 1)[:, 0]
        value[hard] = np.where((row >= 0) & (of >= threshold), of, 0)
    return (value > 0).sum(1), np.cumsum(value, 1)[:, -1]


def flat(boxes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first box, number of boxes) of each set and the corners of all boxes."""
    sizes = boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    each = boxes.flatten()
    corners = [pc.list_element(each, k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(4)] if len(each) else [np.zeros(0)] * 4
    return np.cumsum(sizes) - sizes, sizes, np.stack(corners, 1)


def match_sets(p: pa.Array, g: pa.Array, threshold: float = 0.5) -> pa.StructArray:
    """match_counts of each pair of sets, those of one shape together."""
    (p_at, p_size, p_boxes), (g_at, g_size, g_boxes) = flat(p), flat(g)
    tp, total = np.zeros(len(p), np.int64), np.zeros(len(p))
    shapes, shape_of = np.unique(np.stack([p_size, g_size], 1), axis=0, return_inverse=True)
    order = np.argsort(shape_of, kind="stable")
    for (n, m), same in zip(shapes.tolist(), np.split(order, np.cumsum(np.bincount(shape_of, minlength=len(shapes)))[:-1]), strict=True):
        lot = max(1, CELLS // max(1, n * m))
        for some in (same[k : k + lot] for k in range(0, len(same) if n and m else 0, lot)):
            sides = (boxes[at[some][:, None] + np.arange(size)] for boxes, at, size in ((p_boxes, p_at, n), (g_boxes, g_at, m)))
            tp[some], total[some] = best_hits(*sides, threshold)
    both = (p_size > 0) & (g_size > 0)
    over = lambda x, y: np.where(both & (tp > 0), x / np.maximum(y, 1e-300), 0.0)
    precision, recall = over(tp, p_size), over(tp, g_size)
    columns = [tp, p_size - tp, g_size - tp, precision, recall, over(2 * precision * recall, precision + recall), over(total, tp)]
    names, kinds = zip(*(x.split() for x in MATCH.split(", ")), strict=True)
    return pa.StructArray.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.float64()) for c, k in zip(columns, kinds, strict=True)], names)


def match_counts(p: list, g: list, threshold: float = 0.5) -> tuple:
    if not len(p) or not len(g):
        return 0, len(p), len(g), 0.0, 0.0, 0.0, 0.0
    iou = ious(np.array([list(b) for b in p], float), np.array([list(b) for b in g], float))
    hits = [iou[i, j] for i, j in assign(np.where(iou >= threshold, 1 - iou, 1e6)) if iou[i, j] >= threshold]
    tp = len(hits)
    precision, recall = tp / len(p), tp / len(g)
    return tp, len(p) - tp, len(g) - tp, precision, recall, 2 * precision * recall / (precision + recall) if tp else 0.0, float(np.mean(hits)) if tp else 0.0


def match_boxes(predicted: str, reference: str) -> Column:
    """tp, fp, fn, precision, recall, f1 and mean IoU of the best assignment, boxes under half an IoU being no match."""
    @F.arrow_udf(MATCH)
    def match(p: pa.Array, g: pa.Array) -> pa.Array:
        return match_sets(p, g)

    return match(predicted, reference)
