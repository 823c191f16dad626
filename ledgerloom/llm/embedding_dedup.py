"""Embedding near-dedup by NN-descent: a neighbour graph is refined through joins of neighbours with neighbours' neighbours,
lists that are full of links are enlarged, recall is audited against brute force, and the links are the edges that reach
the threshold. Only vectors with equal labels are compared, by cosine in double precision.

Plan. (1) Equal vectors of a label are one node with a weight. (2) A few random-hyperplane orders give first neighbours.
(3) A round: around each node, its neighbours and those that have it as one meet in groups of at most ``CHUNK``, compare
new with all, and pass on what improves a list; lists keep their best ``k``, or twice their links if they are full of
links, and such a list takes links only. What is linked already, directly or through others, is not compared again, so
that lists within a large group stay short. Rounds end when less than a thousandth of the entries changed. (4) Links give
components; inside a component, all pairs are compared in blocks as matrix products that pass on one count a row, so that
numbers of links are exact there. (5) The audit compares ``n_audit`` vectors (the smallest hashes; more, until they have
``MIN_LINKS`` links) with all of their labels by brute force; a link counts as found if it lies within a component, as (4)
finds it then. While less than ``recall`` are found, rounds go on from other hyperplanes and with longer lists.

Defined results. Null, zero, or with null or non-finite components, or without a label: 0 links, its own component, kept.
Vectors of other lengths than the first one's link with nothing. Rows that repeat an id count as vectors of their own, each
with the links of its own vector; components are named by their smallest id, and a row is kept if its id is that. Null ids:
like other vectors without links, component null, kept. No rows: no rows, and a recall of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_key, numbered, partitions, release, repeats
from .components import components

CHUNK = 64
BLOCK = 256
PLANES = 30
MIN_LINKS = 200
MOST_AUDITED = 16_000


def _valid(seed: int, n_orders: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for i, label, x in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "x"))):
                if not x or None in x:
                    continue
                v = np.array(x, np.float64)
                norm = np.linalg.norm(v / (np.abs(v).max() or 1))
                if not np.isfinite(v).all() or norm == 0:
                    continue
                v = v / np.abs(v).max() / norm
                n = len(v)
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n_orders, PLANES, n))
                codes = ((planes[n] @ v) > 0) @ (1 << np.arange(PLANES - 1, -1, -1))
                out.append((i, label, n, v.tobytes(), codes.tolist()))
            if out:
                i, label, n, v, codes = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(label, pa.int64()), pa.array(n, pa.int32()), pa.array(v, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["id", "label", "dim", "vec", "codes"])

    return rows


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    data = [x for b in batches for x in b.column("vec").to_pylist()]
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.r_[a, b], pa.int64()), pa.array(np.r_[b, a], pa.int64()), pa.array(np.r_[sim, sim], pa.float64())], names=["v", "u", "sim"])


EDGES = "v long, u long, sim double"


def _adjacent(reach: int):
    """Neighbours within ``reach`` places in a partition that is sorted by (label, dim, code)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            kept = [b for b in (tail, batch) if b is not None]
            t = pa.Table.from_batches(kept).combine_chunks()
            skip = 0 if tail is None else len(tail)
            group = np.stack([t.column(c).to_numpy() for c in ("label", "dim")])
            ids = t.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), len(t)]
            a, b, s = [], [], []
            for x, y in zip(cuts, cuts[1:]):
                m = _matrix(t.slice(x, y - x).to_batches()) if y - x > 1 else None
                for step in range(1, min(reach, y - x - 1) + 1):
                    k = np.arange(max(x, skip - step), y - step)
                    a.append(ids[k])
                    b.append(ids[k + step])
                    s.append((m[k - x] * m[k - x + step]).sum(1))
            if a:
                yield _edges(*(np.concatenate(c) for c in (a, b, s)))
            tail = t.slice(max(0, len(t) - reach)).combine_chunks().to_batches()[0] if len(t) else None

    return rows


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that met around a node: pairs with a new one that are not linked yet and improve the list of either."""
    for _, held in by_key(batches, "key"):
        m = _matrix(held)
        ids, new, low, group = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("member", "new", "low", "component"))
        sim = m @ m.T
        i, j = np.triu_indices(len(ids), 1)
        s = sim[i, j]
        ok = (new[i] | new[j]) & ((s > low[i]) | (s > low[j])) & (group[i] != group[j])
        if ok.any():
            yield _edges(ids[i[ok]], ids[j[ok]], s[ok])


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Best entries by node: v, u, sim, new, low (what a candidate must exceed)."""
    best = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    of = Window.partitionBy("v")
    ranked = best.withColumn("r", F.row_number().over(of.orderBy(F.desc("sim"), "u"))).withColumn("links", F.sum((F.col("sim") >= threshold).cast("int")).over(of))
    room = F.when(F.col("links") >= k, 2 * F.col("links")).otherwise(k)
    kept = ranked.withColumn("room", room).filter("r <= room")
    low = F.when(F.count("*").over(of) >= F.col("room"), F.min("sim").over(of)).otherwise(-2.0)
    below = float(np.nextafter(threshold, -1))
    return kept.withColumn("low", F.when(F.col("links") >= k, F.greatest(low, F.lit(below))).otherwise(low)).drop("r", "links", "room")


def _round(scratch: Scratch, lists: DataFrame, nodes: DataFrame, linked: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    lows = lists.groupBy("v").agg(F.max("low").alias("low"))
    met = lists.select(F.col("v").alias("c"), F.col("u").alias("member"), "new").union(lists.select(F.col("u").alias("c"), F.col("v").alias("member"), "new"))
    met = met.groupBy("c", "member").agg(F.max("new").alias("new"))
    of = Window.partitionBy("c")
    met = met.withColumn("n", F.count("*").over(of)).withColumn("some", F.max("new").over(of)).filter("some AND n > 1")
    group = F.pmod(F.xxhash64("member", F.lit(seed)), F.ceil(F.col("n") / CHUNK))
    met = met.select(F.xxhash64("c", group).alias("key"), "member", "new")
    vectors = nodes.select(F.col("id").alias("member"), "vec").join(lows.withColumnRenamed("v", "member"), "member", "left").withColumn("low", F.coalesce("low", F.lit(-2.0)))
    vectors = vectors.join(linked.withColumnRenamed("id", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    met = met.join(vectors, "member").select("key", "member", "new", "low", "component", "vec")
    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, EDGES)
    both = lists.select("v", "u", "sim", F.lit(False).alias("new")).union(found.withColumn("new", F.lit(True)))
    return scratch.keep(_lists(both, k, threshold))


def _degrees(threshold: float):
    """Blocks of one component: links of each row of the first block with the second, weights counted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "key"):
            m = _matrix(held)
            ids, weight, side = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "weight", "side"))
            a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            linked = m[a] @ m[b].T >= threshold
            linked &= ids[a][:, None] != ids[b][None, :]
            out = [(ids[a], linked @ weight[b])]
            if (side != 3).any():  # two different blocks
                out.append((ids[b], weight[a] @ linked))
            i, n = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n.astype(np.int64))], names=["id", "n"])

    return rows


def exact_degrees(scratch: Scratch, members: DataFrame, threshold: float) -> DataFrame:
    """``members``: component, id, weight, vec. The number of linked others of each id, by blocks of its component."""
    placed = numbered(scratch, members, ["component"], ["id"], "slot")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, "component").withColumn("b", F.expr(f"cast(slot div {BLOCK} as int)")).withColumn("last", F.expr(f"cast((size - 1) div {BLOCK} as int)"))
    # A row of block b is on the first side of the cells (b, b) to (b, last), on the second of (0, b) to (b, b).
    cells = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last"))))
    side = F.when(F.col("o") == F.col("b"), 3).when(F.col("o") > F.col("b"), 1).otherwise(2)
    cells = cells.select(F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "id", "weight", side.cast("int").alias("side"), "vec")
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(_degrees(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _brute(queries: list[tuple], threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for key in {q[1:3] for q in queries}:
            own = [q for q in queries if q[1:3] == key]
            by[key] = np.array([q[0] for q in own]), np.frombuffer(b"".join(bytes(q[3]) for q in own), np.float64).reshape(len(own), -1)
        for batch in batches:
            label, dim, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim", "id"))
            for key, (qid, q) in by.items():
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if len(at):
                    i, j = np.nonzero(_matrix([batch.take(pa.array(at))]) @ q.T >= threshold)
                    a, b = ids[at[i]], qid[j]
                    yield pa.RecordBatch.from_arrays([pa.array(b[a != b], pa.int64()), pa.array(a[a != b], pa.int64())], names=["a", "b"])

    return rows


def embedding_components(
    vectors: DataFrame, threshold: float = 0.98, k: int = 10, n_orders: int = 4, recall: float = 0.99, n_audit: int = 1000, max_rounds: int = 12, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, float]:
    """(id, n_links, component_id, kept) of every row, and the audited recall."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").alias("x"))
    again = repeats(rows)
    if again:  # each row is a vector of its own, under a key of its own
        rows = scratch.keep(rows.withColumn("key", F.monotonically_increasing_id()))
    keyed = rows.withColumn("name", F.col("id")).withColumn("id", F.col("key") if again else F.col("id"))
    usable = keyed.filter("name IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").select("id", "label", "x")
    linked, reached = _linked(scratch, usable, threshold, k, n_orders, recall, n_audit, max_rounds)
    out = keyed.select("id", "name").join(linked, "id", "left").select("id", "name", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    if again:
        out = scratch.keep(out)
        names = out.filter("name IS NOT NULL").groupBy("component_id").agg(F.min("name").alias("smallest"))
        out = out.join(names, "component_id", "left").withColumn("component_id", F.col("smallest"))
    out = out.select(F.col("name").alias("id"), "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), reached


def _audit(scratch: Scratch, nodes: DataFrame, found: DataFrame, threshold: float, n: int) -> float:
    """The share of the audited vectors' links that lie within components."""
    while True:
        audit = nodes.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "label", "dim", "vec").collect()
        true = scratch.keep(nodes.mapInArrow(_brute([tuple(r) for r in audit], threshold), "a long, b long"))
        ends = [found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        hit = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")
        judged = true.join(ends[0], "a", "left").join(ends[1], "b", "left").agg(F.count("*").alias("n"), F.sum(hit).alias("hit")).first()
        if judged.n >= MIN_LINKS or len(audit) < n or n >= MOST_AUDITED:
            return judged.hit / judged.n if judged.n else 1.0
        n *= 4


def _linked(scratch: Scratch, usable: DataFrame, threshold: float, k: int, n_orders: int, recall: float, n_audit: int, max_rounds: int) -> tuple[DataFrame, float]:
    """(id, n_links, component_id) of the valid ones of ``usable`` (id, label, x; ids differ), and the audited recall."""
    spark = usable.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    lists, reached = None, 0.0
    for attempt in range(3):
        valid = scratch.keep(usable.mapInArrow(_valid(attempt, n_orders), "id long, label long, dim int, vec binary, codes array<long>"))
        same = scratch.keep(valid.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
        nodes = scratch.keep(valid.join(same.select(F.col("rep").alias("id")), "id", "left_semi"))
        first = None if lists is None else lists.select("v", "u", "sim", F.lit(False).alias("new"))
        for t in range(n_orders):
            code = F.col("codes")[t]
            near = nodes.select("id", "label", "dim", "vec", code.alias("code")).repartitionByRange(partitions(spark), "label", "dim", "code", "id").sortWithinPartitions("label", "dim", "code", "id")
            near = near.select("id", "label", "dim", "vec").mapInArrow(_adjacent(4 + 4 * attempt), EDGES).withColumn("new", F.lit(True))
            first = near if first is None else first.union(near)
        size = k * (1 + attempt)
        # All links that were seen count, whether or not a list has room for them.
        seen = scratch.keep(first.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new")))
        lists = scratch.keep(_lists(seen, size, threshold))
        links = scratch.keep(links.union(_links(seen, threshold)).distinct())
        found = components(scratch, links)
        for r in range(max_rounds):
            state = lists.agg(F.count("*").alias("n"), F.sum(F.col("new").cast("int")).alias("new")).first()
            if (state.new or 0) <= state.n / 1000:
                break
            new = _round(scratch, lists, nodes, found, size, threshold, 100 * attempt + r)
            scratch.drop(lists)
            lists = new
            fresh = scratch.keep(_links(lists.filter("new"), threshold).join(links, ["a", "b"], "left_anti"))
            if fresh.limit(1).count():
                links = scratch.keep(links.union(fresh))
                found = components(scratch, links)
            release(spark)
        reached = _audit(scratch, nodes, found, threshold, n_audit)
        if reached >= recall:
            break
    found = scratch.keep(found)
    members = nodes.join(found, "id").join(same.select(F.col("rep").alias("id"), "weight"), "id").select("component", "id", "weight", "vec")
    degrees = exact_degrees(scratch, members, threshold)
    # Every copy has its node's links, and besides, the other copies.
    each = same.join(found.withColumnRenamed("id", "rep"), "rep", "left").join(degrees.withColumnRenamed("id", "rep"), "rep", "left")
    each = each.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return valid.select("id", "label", "vec").join(each, ["label", "vec"]).select("id", "n_links", "component_id"), reached


def _links(entries: DataFrame, threshold: float) -> DataFrame:
    return entries.filter(F.col("sim") >= threshold).select(F.greatest("v", "u").alias("a"), F.least("v", "u").alias("b")).distinct()
