"""Sharding by law ``bytes``: a minimax contiguous partition. Rows with equal texts form one atomic group; groups stand in
the order of their smallest id; the smallest capacity for which a greedy walk needs at most ``n_shards`` shards is found
by binary search, and the order is cut where that walk cuts.

Plan. Groups get prefix sums in two levels (within range partitions, then over the partitions). The driver walks not over
groups but over a table of at most ``CELLS`` cells of equal bytes with the first and last group end in each. It gives an
optimistic and a pessimistic walk for every capacity, so that two binary searches enclose the answer between capacities
that differ by a few cells; only the group ends near the few dozen places where cuts can then be are fetched, and the
last binary search runs on these exactly.

Defined results. Size: UTF-8 bytes plus 1; null texts have size 1, crc32 0, and are one group, other than the group of
empty texts. A group above the mean shard size makes the capacity at least its size. Rows with null or repeated ids are
placed like any other. No rows: no rows. Shards left empty by the walk are the last ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, partitions

CELLS = 1 << 17


def greedy(capacity: int, total: int, n_shards: int, furthest) -> list[int] | None:
    """The ends of the shards when each takes all that fits; None if more than ``n_shards`` are needed."""
    at, ends = 0, []
    while at < total:
        to = furthest(at + capacity)
        if to <= at or len(ends) == n_shards:
            return None
        ends.append(at := to)
    return ends


def least(low: int, high: int, feasible) -> int:
    """The smallest number in [low, high] that is feasible; high must be."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def minimax_cuts(ends: DataFrame, total: int, largest: int, n_shards: int, cells: int = CELLS) -> list[int]:
    """``ends``: a column ``end`` of increasing prefix sums. The ends of the shards of the best contiguous partition."""
    q = -(-total // cells)
    rows = ends.groupBy(F.expr(f"(end - 1) div {q}").alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).toPandas().sort_values("cell")
    cell, first, last = (rows[c].to_numpy(np.int64) for c in ("cell", "a", "b"))

    def lower(x: int) -> int:  # an end at most x
        k = int(np.searchsorted(cell, (x - 1) // q, "right")) - 1
        if k < 0:
            return 0
        return int(last[k]) if last[k] <= x else int(first[k]) if first[k] <= x else int(last[k - 1]) if k else 0

    def upper(x: int) -> int:  # no end at most x is beyond it
        k = int(np.searchsorted(cell, (x - 1) // q, "right")) - 1
        return 0 if k < 0 else min(x, int(last[k]))

    floor = max(-(-total // n_shards), largest)
    low = least(floor, total, lambda c: greedy(c, total, n_shards, upper) is not None)
    high = least(low, total, lambda c: greedy(c, total, n_shards, lower) is not None)

    def walk(capacity: int, furthest) -> list[int]:
        at, out = 0, []
        for _ in range(n_shards):
            out.append(at := max(at, furthest(min(at + capacity, total))))
        return out

    near = F.lit(False)
    for a, b in zip(walk(low, lower), walk(high, upper)):
        near = near | F.col("end").between(a, b)
    exact = np.sort(ends.filter(near).select("end").toPandas()["end"].to_numpy(np.int64))

    def furthest(x: int) -> int:
        k = int(np.searchsorted(exact, x, "right")) - 1
        return int(exact[k]) if k >= 0 else 0

    return greedy(least(low, high, lambda c: greedy(c, total, n_shards, furthest) is not None), total, n_shards, furthest)


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (0, 1, 2 ... within the shard, copies side by side) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(f"`{text_col}`")
    rows = scratch.keep(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.coalesce(F.min("id"), F.lit(-1)).alias("first"), F.sum("size").alias("bytes"))
    groups = scratch.keep(groups.repartitionByRange(partitions(spark), "first", "key").withColumn("_p", F.spark_partition_id()))
    sums = groups.groupBy("_p").agg(F.sum("bytes").alias("n"), F.max("bytes").alias("most"))
    sums = sums.withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n"))  # a row for each partition
    inside = Window.partitionBy("_p").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.join(F.broadcast(sums.select("_p", "before")), "_p").select("key", "first", "bytes", (F.sum("bytes").over(inside) + F.col("before")).alias("end"))
    placed = scratch.keep(placed)
    r = sums.agg(F.sum("n").alias("total"), F.max("most").alias("most")).first()
    cuts = minimax_cuts(placed.select("end"), r.total, r.most, n_shards) if r.total else []
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("end") > c).cast("int")
    out = rows.join(placed.select("key", "first", shard.alias("shard")), "key")
    return numbered(scratch, out, ["shard"], ["first", "key", "id"], "slot").select("id", "size", "text_crc32", "shard", "slot")
