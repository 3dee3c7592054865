"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2 c) of each other, and so do their projections
on any orthonormal directions. Vectors are sorted by the grid cells (of side epsilon) of their leading principal
coordinates; the sequence is cut into blocks with bounding boxes. Two blocks are joined only if their boxes come
within epsilon, found by an equi-join on the cells of the first coordinate; a join halves the longer interval again
and again, skips halves that are provably too far apart, and verifies what is left by cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import components, cut

COSINE = 0.98
DIRECTIONS = 6
#: Principal directions are those of at most so many vectors; any directions give the same links.
SAMPLE = 10_000
BLOCK, LEAF = 1024, 128
SLACK = 1e-9


def usable(v: np.ndarray) -> np.ndarray | None:
    """The vector in double precision, scaled to length 1; None if it is empty, zero or has null or non-finite components."""
    v = np.asarray(v, np.float64)
    top = np.abs(v).max() if v.size else 0.0
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def leading_directions(vectors: list[list[float]], labels: list[int], k: int) -> np.ndarray:
    """The k leading principal directions of the vectors around the mean of their label."""
    v, groups = np.array(vectors), {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    for at in groups.values():
        v[at] -= v[at].mean(0)
    return np.linalg.eigh(v.T @ v)[1][:, ::-1][:, :k].T


def close_pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs with at least this cosine, by recursion on the two sequence intervals."""
    reach = np.sqrt(2 - 2 * cosine) + SLACK
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m or same and m <= i:
            continue
        gap = np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0))
        if np.sqrt((np.maximum(gap, 0) ** 2).sum()) > reach:
            continue
        if max(j - i, m - k) <= LEAF:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= cosine)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw) with the vector's doubles as bytes; raw is null for vectors that link with nothing."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                bad = x is None or None in x or usable(x) is None
                out.append(None if bad else (np.asarray(x, np.float64) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "raw"])

    return vectors.mapInArrow(read, "vec_id long, label long, raw binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, directions: int = DIRECTIONS, sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors of a label are one class with its number of rows; links are found between classes. Rows without a
    label, or with a vector that is null, zero or not finite throughout, have no links and are their own component.
    Vectors of different lengths don't link. Rows with the same id are vectors of their own. A null id never is the
    smallest. An empty table gives an empty one.
    """
    v = cut(prepared(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))))
    good = v.filter("label is not null and raw is not null").withColumn("width", (F.length("raw") / 8).cast("int"))
    classes = good.groupBy("label", "width", "raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    width = classes.groupBy("width").count().orderBy(F.desc("count")).first()
    taken = classes.filter(F.col("width") == (width[0] if width else 0)).orderBy(F.xxhash64("raw"), "class").limit(sample).select("label", "raw").collect()
    axes = leading_directions([usable(np.frombuffer(r["raw"])) for r in taken], [r["label"] for r in taken], directions) if taken else np.zeros((directions, 0))
    side = float(np.sqrt(2 - 2 * cosine)) * (1 + SLACK) + SLACK
    names = [f"c{k}" for k in range(directions)]

    def project(unit: np.ndarray) -> np.ndarray:
        """Coordinates along the axes; vectors of another width than the sample's have none and sort together."""
        return unit @ axes.T if unit.shape[1] == axes.shape[1] else np.zeros((len(unit), directions))

    @F.pandas_udf("array<int>")
    def grid(raw: pd.Series) -> pd.Series:
        return pd.Series([np.floor(project(usable(np.frombuffer(r))[None])[0] / side).astype(np.int32) for r in raw])

    ordered = classes.select("label", "width", "raw", "least", "n", "class", grid("raw").alias("g")).select("label", "width", "raw", "least", "n", "class", *[F.col("g")[k].alias(c) for k, c in enumerate(names)])
    ordered = ordered.repartitionByRange("label", "width", *names, "class").sortWithinPartitions("label", "width", *names, "class")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most `block` classes of one label and width, with their box."""
        def out(rows: list[dict]) -> pa.RecordBatch:
            p = project(unit_rows(b"".join(r["raw"] for r in rows), rows[0]["width"]))
            first = np.floor(p[:, 0] / side)
            return pa.RecordBatch.from_pylist([{"label": rows[0]["label"], "width": rows[0]["width"], "block": rows[0]["class"], "low": p.min(0).tolist(), "high": p.max(0).tolist(), "from_cell": int(first.min()), "to_cell": int(first.max()), "classes": [r["class"] for r in rows], "ns": [r["n"] for r in rows], "raws": b"".join(r["raw"] for r in rows)}], BLOCK_SCHEMA)

        rows: list[dict] = []
        for batch in batches:
            for r in batch.select(["label", "width", "raw", "n", "class"]).to_pylist():
                if rows and (len(rows) == block or (r["label"], r["width"]) != (rows[0]["label"], rows[0]["width"])):
                    yield out(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield out(rows)

    runs = cut(ordered.mapInArrow(blocks, "label long, width int, block long, low array<double>, high array<double>, from_cell int, to_cell int, classes array<long>, ns array<long>, raws binary"))
    boxes = runs.select("label", "width", "block", "low", "high", "from_cell", "to_cell")
    # Blocks meet in the cells of the first coordinate that both touch, give or take one; the first common one counts.
    a = boxes.select("label", "width", *[F.col(c).alias(f"a_{c}") for c in ("block", "low", "high", "from_cell")], F.explode(F.sequence("from_cell", "to_cell")).alias("cell"))
    b = boxes.select("label", "width", *[F.col(c).alias(f"b_{c}") for c in ("block", "low", "high", "from_cell")], F.explode(F.sequence(F.col("from_cell") - 1, F.col("to_cell") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = (F.col("cell") == F.greatest(F.col("a_from_cell"), F.col("b_from_cell") - 1)) & (F.col("a_block") <= F.col("b_block")) & (F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x * x) <= side**2)
    pairs = a.join(b, ["label", "width", "cell"]).filter(near).select("a_block", "b_block")
    pairs = cut(pairs.distinct())
    side_a = runs.select(F.col("block").alias("a_block"), "width", F.col("classes").alias("a_classes"), F.col("ns").alias("a_ns"), F.col("raws").alias("a_raws"))
    side_b = runs.select(F.col("block").alias("b_block"), F.col("classes").alias("b_classes"), F.col("ns").alias("b_ns"), F.col("raws").alias("b_raws"))
    jobs = pairs.join(side_a, "a_block").join(side_b, "b_block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a_block"] == r["b_block"]
                x = unit_rows(r["a_raws"], r["width"])
                y = x if same else unit_rows(r["b_raws"], r["width"])
                ca, cb = np.array(r["a_classes"]), np.array(r["b_classes"])
                na, nb = np.array(r["a_ns"]), np.array(r["b_ns"])
                links_a, links_b, edges = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64), {}
                for i, j in close_pairs(x, y, project(x), project(y), cosine, same):
                    np.add.at(links_a, i, nb[j])
                    np.add.at(links_b, j, na[i])
                    for p, q in zip(ca[i].tolist(), cb[j].tolist(), strict=True):
                        p, q = root(edges, p), root(edges, q)
                        if p != q:
                            edges[max(p, q)] = min(p, q)
                nodes = np.concatenate([ca, cb])
                counts = np.concatenate([links_a, links_b])
                some = counts > 0
                if some.any():
                    found = [(p, q) for p, q in edges.items() if p != q]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some].tolist() + [p for p, _ in found], pa.int64()), pa.array(counts[some].tolist() + [None] * len(found), pa.int64()), pa.array([None] * int(some.sum()) + [q for _, q in found], pa.int64())], ["class", "links", "other"])

    found = cut(jobs.mapInArrow(compare, "class long, links long, other long"))
    counted = found.filter("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "class")
    named = classes.select("class", "label", "raw", "least", "n").join(counted, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "raw", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = v.filter("label is not null and raw is not null").join(named, ["label", "raw"])
    alone = v.filter("label is null or raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def unit_rows(raws: bytes, width: int) -> np.ndarray:
    v = np.frombuffer(raws).reshape(-1, width)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


BLOCK_SCHEMA = pa.schema([("label", pa.int64()), ("width", pa.int32()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("from_cell", pa.int32()), ("to_cell", pa.int32()), ("classes", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("raws", pa.binary())])
