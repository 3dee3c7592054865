"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each row hashes to a point of the ring and belongs to the shard of the next virtual node clockwise. A shard keeps its
rows up to its bound; those over it continue clockwise to the first open place of a shard below its bound. The places
a shard has open are spread over its own virtual nodes. All of this is decided on counts per virtual node, a table
whose size only depends on the number of shards; the rows then look up where they go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.llm.common import cut, ranked

CELL_BITS = 16


def ring(spark: SparkSession, shards: int, nodes: int = 128) -> DataFrame:
    """(cell, arc, shard) for each of the ring's 2**16 cells: the virtual node that the cell belongs to.

    Virtual nodes that fall into one cell: the one with the smallest hash counts. Fixed size, so it may be broadcast.
    """
    cells = 1 << CELL_BITS
    h = F.xxhash64("shard", "node", F.lit("ring"))
    virtual = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    virtual = virtual.select(F.shiftrightunsigned(h, 64 - CELL_BITS).alias("cell"), F.struct(h.alias("h"), "shard").alias("s")).groupBy("cell").agg(F.min("s")["shard"].alias("shard"))
    virtual = virtual.withColumn("arc", F.row_number().over(W.orderBy("cell")) - 1)
    ahead = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = spark.range(cells).select(F.col("id").alias("cell")).join(virtual.select("cell", F.struct("arc", "shard").alias("s")), "cell", "left")
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return every.select("cell", F.coalesce(F.last("s", True).over(ahead), F.min("s").over(whole)).alias("s")).select("cell", "s.arc", "s.shard")


def bounded_moves(arcs: DataFrame, shards: int) -> DataFrame:
    """arcs (arc, shard, n): rows (arc, first, past, to, base): the arc's row r, first <= r < past, goes to shard `to` and slot base + r - first.

    Bounds differ by at most one and sum to the number of rows, so that every shard is full in the end; the shards
    with most rows of their own get the larger ones. Only rows over a bound move.
    """
    spark = arcs.sparkSession
    own = W.partitionBy("shard").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy("arc").rowsBetween(W.unboundedPreceding, -1)
    upto = W.orderBy("arc").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(arcs.groupBy("shard").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("nodes")), "shard", "left").fillna(0)
    sum_all = F.sum("total").over(whole)
    bound = total.select("shard", "total", "nodes", (F.floor(sum_all / shards) + F.when(F.row_number().over(W.orderBy(F.desc("total"), "shard")) <= sum_all % shards, 1).otherwise(0)).alias("bound"))
    free = F.greatest(F.col("bound") - F.col("total"), F.lit(0))
    k = F.row_number().over(W.partitionBy("shard").orderBy("arc"))
    a = arcs.join(bound, "shard").withColumns({"before": F.coalesce(F.sum("n").over(own), F.lit(0)), "k": k})
    a = a.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("bound") - F.col("before"))))
    a = a.withColumn("over", F.col("n") - F.col("keep")).withColumn("free", (F.floor(free * F.col("k") / F.col("nodes")) - F.floor(free * (F.col("k") - 1) / F.col("nodes"))).cast("long"))
    a = a.withColumn("used", F.coalesce(F.sum("free").over(own), F.lit(0))).withColumn("debt", F.sum(F.col("over") - F.col("free")).over(upto))
    # Counting from just behind the lowest debt, no place comes before the row that takes it.
    start = F.min(F.struct("debt", "arc")).over(whole)["arc"]
    arcs_all = F.max("arc").over(whole) + 1
    a = a.withColumn("turn", F.pmod(F.col("arc") - start - 1, arcs_all))
    turned = W.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    a = a.withColumns({"over_at": F.coalesce(F.sum("over").over(turned), F.lit(0)), "free_at": F.coalesce(F.sum("free").over(turned), F.lit(0))})
    kept = a.filter("keep > 0").select("arc", F.lit(0).cast("long").alias("first"), F.col("keep").alias("past"), F.col("shard").alias("to"), F.col("before").alias("base"))
    marks = a.filter("over > 0").select(F.col("over_at").alias("at"), F.struct("arc", "keep", "over_at").alias("o"), F.lit(None).alias("f"))
    marks = marks.unionByName(a.filter("free > 0").select(F.col("free_at").alias("at"), F.lit(None).alias("o"), F.struct("shard", F.col("total").alias("own"), "used", "free_at").alias("f")))
    marks = marks.groupBy("at").agg(F.first("o", True).alias("o"), F.first("f", True).alias("f"))
    by = W.orderBy("at")
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = marks.select("at", F.last("o", True).over(so_far).alias("o"), F.last("f", True).over(so_far).alias("f"), F.lead("at").over(by).alias("next"), F.lit(1).alias("one"))
    all_over = a.agg(F.sum("over").alias("all_over"), F.lit(1).alias("one"))
    moved = moved.join(F.broadcast(all_over), "one")
    first = F.col("o.keep") + F.col("at") - F.col("o.over_at")
    moved = moved.select(F.col("o.arc").alias("arc"), first.alias("first"), (first + F.coalesce(F.col("next"), F.col("all_over")) - F.col("at")).alias("past"), F.col("f.shard").alias("to"), (F.col("f.own") + F.col("f.used") + F.col("at") - F.col("f.free_at")).alias("base"))
    return kept.unionByName(moved)


def shard_rows(docs: DataFrame, shards: int = 24, nodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, home, shard, slot, grown_shard) of each row, under the law `rows`.

    The key of a row is its id; a null id is a key like any other, repeated ids and equal texts are rows of their own,
    a null text counts as empty. `home` is the shard before bounds. Shards of an empty table stay empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64(F.lit("place"), F.col("doc_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.shiftrightunsigned(h, 64 - CELL_BITS).alias("cell"))
    circle = cut(ring(docs.sparkSession, shards, nodes))
    rows = rows.join(F.broadcast(circle), "cell").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(8)).cast("int"))
    rows = cut(rows.select("doc_id", "size", "text_crc32", "arc", F.col("shard").alias("home"), "bucket"))
    counted = circle.select("arc", "shard").distinct().join(rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")), "arc", "left").fillna(0, ["n"])
    moves = cut(bounded_moves(counted, shards))
    placed = ranked(rows, ["arc"], "bucket", [F.xxhash64("doc_id", F.lit("turn")), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "r")
    # At most three rows for each virtual node.
    to = F.broadcast(moves.withColumnRenamed("arc", "of"))
    return placed.join(to, (F.col("arc") == F.col("of")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("past"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"), (F.col("base") + F.col("r") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home"
    )
