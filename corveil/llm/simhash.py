"""SimHash near-dedup: fingerprints joined on a grid of per-segment bit counts.

A fingerprint maps to the bit counts of its 32 two-bit segments. One flipped bit moves one count by one, so the
Manhattan distance of two count vectors is a lower bound of the Hamming distance. The segments form six groups; where
the Manhattan distance is at most 3, at least three groups have equal counts. Each choice of three groups is a grid
whose cells hold the fingerprints with equal counts there: a pair within reach shares a cell of at least one grid. In
a cell, pairs within the Manhattan bound are verified by their Hamming distance.

Most texts that share four fifths of their five-word shingles lie further apart than the grid's reach. `keep_first`,
whose rule that similarity is, takes the grid's links as proposals beside those of bands of smallest shingle hashes,
and verifies all of them on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corveil.llm.common import components, cut, fresh

REACH = 3
SEGMENTS = 32
#: The segments of each group; three of six groups are free to differ.
GROUPS = ((0, 6), (6, 11), (11, 16), (16, 22), (22, 27), (27, 32))
#: At most so many fingerprints of one cell are compared in one task; larger cells are split into pairs of blocks.
BLOCK = 2048
#: Fixed value: A-Z to a-z.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """The XXH64 of each run of `shingle` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode().translate(LOWER).split()
    n = min(shingle, len(words))
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    shingles = len(words) - n + 1 if n else 0
    out = np.zeros(shingles, np.uint64)
    for at in range(0, shingles, 1 << 16):
        past = min(shingles, at + (1 << 16))
        first, last = (ends - sizes)[at:past].tolist(), ends[at + n - 1 : past + n - 1].tolist()
        out[at:past] = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, past - at)
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed number: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp) of every row, key a hash of its text; a null text counts as empty."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(x.as_py() or "", shingle) for x in batch.column(2)], pa.int64())], ["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "doc_id long, key long, fp long")


def counts(fp: Column) -> Column:
    """The counts of the 32 two-bit segments, each in its segment's two bits."""
    odd = F.lit(0x5555555555555555)
    one, other = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # The sum without a sign: 1 + 1 = 10 in the two bits.
    return one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def cells(fps: DataFrame) -> DataFrame:
    """fps (fp) with one row for each of its 20 cells."""
    c = counts(F.col("fp"))
    keys = []
    for k, groups in enumerate(combinations(GROUPS, 3)):
        mask = sum(3 << 2 * s for a, b in groups for s in range(a, b))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(k), c.bitwiseAND(F.lit(mask))))
    return fps.select("fp", F.explode(F.array(*keys)).alias("cell"))


def block_pairs(rows: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """rows with left and right: the pairs of blocks of its key's rows in which a row takes part.

    Keys with at most `block` rows have the one pair (0, 0). A key with b blocks repeats each row b times, so that
    every two rows of a key meet in a pair of blocks and no task takes more than two blocks of a key. The rows of a key
    are counted before the shuffle and never gathered; a key with M rows comes to M * M / block rows.
    """
    n, b = fresh(rows, "n"), fresh(rows, "b")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1)
    rows = rows.join(sizes, key).withColumn(n, F.ceil(F.col(n) / block).cast("int"))
    rows = rows.withColumn(b, F.pmod(F.xxhash64(order), F.col(n).cast("long")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.struct(F.least(x, F.col(b)).alias("left"), F.greatest(x, F.col(b)).alias("right"), F.col(b).alias("own")))
    return rows.withColumn(n, F.explode(pairs)).select(*[c for c in rows.columns if c not in (n, b)], F.col(n)["left"].alias("left"), F.col(n)["right"].alias("right"), F.col(n)["own"].alias("own"))


def forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> None:
    """Joins the ends of pairs that aren't joined yet in `parent`."""
    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(fp[a].tolist(), fp[b].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def near_pairs(left: np.ndarray, right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of fingerprints within reach: Manhattan distance of the counts first, then Hamming."""
    odd = np.uint64(0x5555555555555555)
    count = lambda x: (x & odd) + (x >> np.uint64(1) & odd)
    ca, cb = count(left)[:, None], count(right)[None, :]
    # |x - y| of counts 0, 1, 2 is the number of bits in which their unary forms 00, 01, 11 differ.
    unary = lambda c: c | (c >> np.uint64(1) & odd)
    a, b = np.nonzero(np.bitwise_count(unary(ca) ^ unary(cb)) <= reach)
    near = np.bitwise_count(left[a] ^ right[b]) <= reach
    return a[near], b[near]


def links(fps: DataFrame, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all fingerprints within reach, without the links that close a circle in a task."""
    if not 0 <= reach <= REACH:
        raise ValueError(f"the grid finds all pairs within {REACH} bits, not {reach}")
    paired = block_pairs(cells(fps), "cell", "fp", block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def several(key: np.ndarray, fp: np.ndarray, own: np.ndarray, split: np.ndarray) -> None:
            """Rows of whole groups, in order: small groups by shifts of the whole array, large ones as blocks."""
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            sizes = np.diff(edges)
            few = np.repeat((sizes <= 32) & ~split[edges[:-1]], sizes)
            group = np.repeat(np.arange(len(sizes)), sizes)
            for shift in range(1, 32):
                i = np.flatnonzero(few[:-shift] & few[shift:] & (group[:-shift] == group[shift:])) if shift < len(fp) else np.zeros(0, int)
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= reach]
                forest(fp.view(np.int64), i, i + shift, parent)
            for k in np.flatnonzero((sizes > 32) | split[edges[:-1]]).tolist():
                rows = slice(edges[k], edges[k + 1])
                f, o = fp[rows], own[rows]
                left, right = (f[o == key[edges[k], 1]], f[o == key[edges[k], 2]]) if split[edges[k]] else (f, f)
                for at in range(0, len(left), 512):
                    a, b = near_pairs(left[at : at + 512], right, reach)
                    forest(np.concatenate([left[at : at + 512], right]).view(np.int64), a, b + len(left[at : at + 512]), parent)

        rest = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], 1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
            at = new[-1] + 1 if len(new) else 0
            rest, rows = rows[at:], rows[:at]
            if len(rows):
                several(rows[:, :3], rows[:, 4].astype(np.int64).view(np.uint64), rows[:, 3], rows[:, 2] != 0)
            if len(parent) > 1_000_000:
                yield out(parent)
                parent.clear()
        if rest is not None and len(rest):
            several(rest[:, :3], np.ascontiguousarray(rest[:, 4]).view(np.uint64), rest[:, 3], rest[:, 2] != 0)
        yield out(parent)

    def out(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(x, y) for x, y in parent.items() if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    paired = paired.select("cell", F.col("left").cast("long"), F.col("right").cast("long"), F.col("own").cast("long"), "fp")
    return paired.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right").mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, shingle: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, fp, component, component_id) of every row; component is a fingerprint of its component."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = components(links(classes.select("fp"), reach)).select(F.col("node").alias("fp"), "component")
    # By component, the smallest id of its classes; classes without links are their own.
    named = classes.join(near, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest id reachable over links of at most `reach` differing bits. Texts without words share
    the fingerprint 0 and link like any others. Null ids don't count as the smallest; a component of null ids only has
    a null id. Rows with the same id are rows of their own. An empty table gives an empty one.
    """
    return grouped(docs, shingle, reach, id_col, text_col).select("doc_id", "fp", "component_id")


#: Bands of so many smallest hashes each: of pairs at the similarity 0.8 all but 3 in a million share a band.
BANDS, BAND = 24, 4
#: Odd multipliers of the hash functions whose smallest values are taken.
MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SIMILAR, WIDE = 0.8, 5
#: Texts of a cell whose sets are held against each other in one task; groups of up to FEW pair by pair.
SETS, FEW = 2048, 12
#: Elements and sets of a step of that product.
COLUMNS, ROWS = 512, 256
#: Bits a key in a sieve, and the most bits as a power of two (a million words).
SPARSE, SIEVE = 16, 26


def wide_shingles(text: str, narrow: np.ndarray) -> np.ndarray:
    """The distinct hashes of the five-word shingles, each from the two three-word shingles that make it up; of the whole sequence if it is shorter."""
    if len(narrow) < WIDE - 2:
        return np.array([xxhash.xxh64_intdigest(b" ".join(text.encode().translate(LOWER).split()), 42)] if len(narrow) else [], np.uint64)
    mixed = narrow[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (narrow[2:] + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def bands(wide: np.ndarray) -> list[int]:
    """A key for each band of the smallest values that the hash functions take on a set; sets without any element share theirs."""
    least = np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for at in range(0, len(wide), 4096):
        least = np.minimum(least, (wide[at : at + 4096, None] * MULTIPLIERS).min(0))
    return [xxhash.xxh64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, fp, cells) of every row: the three-word fingerprint and the bands of the five-word shingles."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, cells = [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                narrow = shingle_hashes(text)
                fp.append(majority(narrow))
                cells.append(bands(wide_shingles(text, narrow)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "cells"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "doc_id long, key long, fp long, cells array<long>")


def shingle_sets(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """(key, wide): the distinct five-word shingles of the texts with these keys."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [wide_shingles(t, shingle_hashes(t)).view(np.int64) for t in (x.as_py() or "" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.list_(pa.int64()))], ["key", "wide"])

    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts, _ = sieve(texts, "key", keys)
    # Copies go before the shuffle, and what the sieve let through in error behind it, where the rows already are.
    return texts.dropDuplicates(["key"]).join(keys, "key", "left_semi").mapInArrow(read, "key long, wide array<long>")


def sieve(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key isn't), so that only the former need a join and its shuffle.

    The keys' hashes set bits of words that are broadcast, about SPARSE bits a key; a row whose bit is set may be none
    of them (one in SPARSE). Beyond SIEVE bits the sieve lets more rows through, and never holds one of keys back.
    """
    bits = min(SIEVE, max(6, (SPARSE * keys.count() - 1).bit_length()))
    word, mask = fresh(rows, "word"), fresh(rows, "mask")
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    placed = {word: F.shiftrightunsigned(slot, 6), mask: F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))}
    words = keys.select(key).withColumns(placed).groupBy(word).agg(F.bit_or(mask).alias(f"{mask}_"))
    d = rows.withColumns(placed).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.col(mask).bitwiseAND(F.col(f"{mask}_")) != 0, F.lit(False))
    return d.filter(hit).select(*rows.columns), d.filter(~hit).select(*rows.columns)


def groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that are equal in these columns, from sorted batches; the last run of a batch may go on in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*rest, batch])
        rows = rows.combine_chunks() if rest else rows
        if not rows.num_rows:
            continue
        mark = np.stack([rows.column(c).to_numpy() for c in columns], 1)
        edges = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist()]
        for first, past in zip(edges[:-1], edges[1:], strict=True):
            yield rows.slice(first, past - first)
        rest = rows.slice(edges[-1]).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def similar(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets (sorted, without repeats) of left and right that are of different parts and similar enough."""
    n = np.array([len(x) for x in sets])
    alike = lambda both, i, j: both >= SIMILAR * (n[i] + n[j] - both)
    if len(left) * len(right) <= FEW * FEW:
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        near = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]))
        i, j = i[near], j[near]
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        return i[alike(both, i, j)], j[alike(both, i, j)]
    # Common elements as a product of 0-1 matrices, some hundred elements at a time; what only one set holds plays no part.
    row = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    row, element = row[shared], (np.cumsum(times > 1) - 1)[element[shared]]
    by = np.argsort(element, kind="stable")
    row, element = row[by], element[by]
    # Each side's rows of the matrix; one side's do for both where all sets are held against each other.
    sides = [left] if left is right else [left, right]
    places = [np.full(len(sets), -1) for _ in sides]
    for place, side in zip(places, sides, strict=True):
        place[side] = np.arange(len(side))
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
        first, past = np.searchsorted(element, (at, at + COLUMNS))
        x = [np.zeros((len(side), COLUMNS), np.float32) for side in sides]
        for matrix, place in zip(x, places, strict=True):
            where = place[row[first:past]]
            matrix[where[where >= 0], element[first:past][where >= 0] - at] = 1
        for k in range(0, len(left), ROWS):
            both[k : k + ROWS] += x[0][k : k + ROWS] @ x[-1].T
    found = []
    for k in range(0, len(left), ROWS):
        b, some = both[k : k + ROWS], left[k : k + ROWS]
        i, j = np.nonzero((b >= SIMILAR * (n[some][:, None] + n[right][None, :] - b)) & (part[some][:, None] != part[right][None, :]))
        found.append((some[i], right[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def pairs_of_cells(cells: DataFrame, sets: DataFrame, block: int = SETS) -> DataFrame:
    """(a, b): links that connect all classes of a cell that are of different parts and similar enough; from rows (cell, key, part) and sets (key, wide).

    Every pair of a cell is held against each other on the whole sets, in pairs of blocks where a cell is large; links
    between parts that a task has already connected are left out.
    """
    # Sets join last, so that they move once.
    paired = block_pairs(cells, "cell", "key", block).select("cell", "left", "right", "own", "key", "part").join(sets, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("cell", "left", "right")):
            left, right, own, key, part = (rows.column(c).to_numpy() for c in ("left", "right", "own", "key", "part"))
            sets = [np.sort(x) for x in (np.asarray(v.values) for v in rows.column("wide"))]
            whole = left[0] == right[0]
            every = np.arange(len(key))
            sides = (every, every) if whole else (np.flatnonzero(own == left[0]), np.flatnonzero(own == right[0]))
            i, j = similar(sets, part, *sides)
            parent: dict[int, int] = {}
            joined = []
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = int(part[a]), int(part[b])
                while x in parent:
                    x = parent[x]
                while y in parent:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    joined.append((key[a], key[b]))
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in joined], pa.int64()), pa.array([b for _, b in joined], pa.int64())], ["a", "b"])

    return paired.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right").mapInArrow(compare, "a long, b long")


def led(cells: DataFrame) -> DataFrame:
    """(x, y): each class y of cells (cell, key, part) with the first class of one of its cells that is of another part; one pair a class."""
    first = cells.groupBy("cell").agg(F.min(F.struct("key", "part")).alias("first"))
    other = cells.join(first, "cell").filter(F.col("part") != F.col("first.part"))
    return other.groupBy(F.col("key").alias("y")).agg(F.min("first.key").alias("x"))


def similar_links(docs: DataFrame, classes: DataFrame, text_col: str) -> DataFrame:
    """(a, b): links that connect classes (key, fp, cells) whose shingle sets have a similarity of at least SIMILAR.

    The grid proposes the pairs within its reach, and the bands a first class for each other one; all are verified on
    the sets. Cells in which more than one part is then left hold all their sets against each other, so that of the classes that share a cell no link between parts is missed.
    Cells of the same classes do so once, and a cell of two classes that were already verified doesn't do so again.
    """
    named = classes.groupBy("fp").agg(F.min("key").alias("first"))
    near = links(classes.select("fp").distinct()).join(named.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    equal = classes.join(named, "fp").filter("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y"))
    cells = classes.select("key", F.explode("cells").alias("cell"))
    several = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("cell")
    cells = cut(cells.join(several, "cell"))
    proposed = cut(near.unionByName(equal).unionByName(led(cells.withColumn("part", F.col("key")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    keys = cells.select("key").unionByName(proposed.select(F.col("a").alias("key"))).unionByName(proposed.select(F.col("b").alias("key"))).distinct()
    sets = cut(shingle_sets(docs, keys, text_col))

    sides = [sets.select(F.col("key").alias(c), F.col("wide").alias(f"wide_{c}"), F.size("wide").alias(f"n_{c}")) for c in ("a", "b")]
    d = proposed.join(sides[0], "a").join(sides[1], "b").filter(F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
    both = F.size(F.array_intersect("wide_a", "wide_b"))
    found = cut(d.filter(both >= SIMILAR * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))
    part = components(found).select(F.col("node").alias("key"), F.col("component").alias("part"))
    parted = cells.join(part, "key", "left").withColumn("part", F.coalesce("part", "key"))
    # The classes of a cell by their number, ends and two sums of hashes.
    sums = (F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    mixed = parted.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("m"), F.min("key").alias("a"), F.max("key").alias("b"), *sums).filter("low <> high")
    mixed = mixed.join(proposed.withColumn("m", F.lit(2).cast("long")), ["m", "a", "b"], "left_anti").groupBy("m", "a", "b", "x", "y").agg(F.min("cell").alias("cell")).select("cell")
    return found.unionByName(cut(pairs_of_cells(cut(parted.join(mixed, "cell")), sets)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id, with all its columns; null ids stay.

    Texts are near copies if their sets of five-word shingles (the whole text, where it is shorter) have a similarity
    of at least SIMILAR; a group is what such links connect. Texts without words are one group. Of rows with the
    smallest id in the group, the text with the smallest hash stays; rows that repeat a kept id and text are copies, of
    which any one stays. An id whose texts are in several groups may stay in each.
    """
    rows = cut(sketches(docs, id_col, text_col))
    classes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("cells").alias("cells")))
    near = components(similar_links(docs, classes.drop("least", "n"), text_col)).select(F.col("node").alias("key"), "component")
    grouped = cut(classes.select("key", "least", "n").join(near, "key", "left"))
    name, key = fresh(docs, "kept"), fresh(docs, "key")
    # A text that occurs once and is like no other stays where it is; only the rest is joined.
    several = grouped.filter("n > 1 or component is not null").select(F.col("key").alias(key))
    grouped = grouped.withColumn("component", F.coalesce("component", "key"))
    kept = grouped.filter("least is not null").groupBy("component").agg(F.min(F.struct("least", "key")).alias("k")).select(F.col("k.least").alias(name), F.col("k.key").alias(f"{key}_"))
    once, alone = sieve(docs.withColumn(key, text_key(text_col)), key, several)
    alone = alone.filter(F.col(id_col).cast("long").isNotNull()).drop(key)
    once = once.join(kept, (F.col(id_col).cast("long") == F.col(name)) & (F.col(key) == F.col(f"{key}_")), "left_semi")
    once = once.dropDuplicates([id_col, key]).drop(key)
    return once.unionByName(alone).unionByName(docs.filter(F.col(id_col).isNull()))
