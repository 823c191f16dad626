"""N-gram Jaccard join at a rational threshold, as a blocked sparse product of the document by n-gram incidence.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct n-word shingles.

Plan. (1) Documents are hashed in blocks; equal sets of a block are one row of the matrix from there on. (2) Column blocks
(bins of n-grams) count each column; a column with one document adds nothing to any product and ends here. (3) By document:
a partner shares at least ``percent`` of a set's columns, so that documents with fewer shared columns are done. Of equal
sets, one goes on. (4) Rows are put in row blocks of similar documents, by the most common of a few min-hashes. (5) A cell
is the product of two row blocks: overlap counts are accumulated over column blocks, rare columns sparsely and common ones
as dense matrices, and a pair is discarded as soon as its sizes and what is left of its rows no longer allow enough
overlap. What a cell passes on is a spanning forest of its links, never its pairs. (6) Links give components.

Which cells. First each row block with itself and with the first block of its kind, which joins nearly all that can be
joined. Documents outside of the largest component of their kind are then put in blocks of their own, and all other cells
follow whose blocks share one of the rarest columns of a document, as many as a partner cannot miss altogether, whose sizes
allow a link, and that are not within one component already. So components are exact. A group of near copies that are
linked costs about as many cells as it has blocks; only of documents that are similar but not linked, however many, is
every pair of blocks multiplied. A column in more than ``HOT`` documents of one hashing block is ordered last, and that block
sends one entry for it.

Defined results. Null or blank text: set size 0, links with nothing, its own component. Fewer than n words: the whole
sequence is the one shingle. Null id: size given, component null, no links. Rows that repeat an id are each judged by their
own text; a component's or class's id is the smallest of its rows. No rows: no rows. Hashes are 64 bits within a bin and set
signatures 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, WordHash, bins_of, by_key, mix, pack, packed_rows, partitions, release, repeats, slices, spark_xxhash64, text_bytes, total_bytes, trim, trimmed, unpack, unused
from .components import components

BLOCK_WORDS = 750_000
BIN_BYTES = 8 << 20
HOT = 32
HOT_DF = 65_535
BLOCK_DOCS = 256
BLOCK_COLUMNS = 1 << 18
#: A column of a cell in more rows than this is part of a dense matrix of so many columns.
DENSE, WIDTH = 16, 2048
SALTS = np.array([0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
_A, _B = (np.array(x, np.uint64) for x in ([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], [0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xE7037ED1A0B428DB]))


def required(n, percent: int):
    """The least overlap of a set of n with any partner."""
    return (percent * n + 99) // 100


def overlap_needed(n, m, percent: int):
    """100 * o >= percent * (n + m - o) holds from this overlap on."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def shingles(w: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, second hash) of all n-word shingles of concatenated documents."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(w) >= n:
        inside = np.flatnonzero(doc[: len(w) - n + 1] == doc[n - 1 :])
        hs = [mix(sum(w[k : len(w) - n + 1 + k] * c[k % 4] * np.uint64(2 * (k // 4) + 1) for k in range(n)))[inside] for c in (_A, _B)]
        docs = doc[inside]
    else:
        docs, hs = np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * 2
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence, told apart from full shingles by its length
        starts = np.cumsum(counts) - counts
        whole = [np.array([mix(np.array([sum(int(x) * int(c[k % 4]) for k, x in enumerate(w[starts[i] : starts[i] + counts[i]])) + int(counts[i]) & (1 << 64) - 1], np.uint64))[0] for i in short], np.uint64) for c in (_A, _B)]
        docs, hs = np.r_[docs, short], [np.r_[a, b] for a, b in zip(hs, whole)]
    return docs, hs[0], hs[1]


def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, data = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["kind", "part", "data"])


def _parts(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(spark_xxhash64(ids), n).astype(np.int32)


def _incidence(n_words: int, n_bins: int, n_parts: int):
    """kind 0: entries for a bin; 1: shared columns of documents, found in the block; 2: documents with size and signature."""

    def block(ids: np.ndarray, w: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        ids = ids[order]
        doc, h, h2 = shingles(w, counts, n_words)
        doc = rank[doc]
        o = np.lexsort((h, doc))
        doc, h, h2 = doc[o], h[o], h2[o]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)]
        doc, h, h2 = doc[new], h[new], h2[new]
        del o, new, w
        size = np.bincount(doc, minlength=len(ids))
        s1, s2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        np.add.at(s1, doc, mix(h + np.uint64(1)))
        np.add.at(s2, doc, mix(h2 + np.uint64(7)))
        out = [(2, p, d) for p, d in packed_rows(_parts(ids, n_parts), ids, size.astype("<u4"), s1, s2)]
        # Of equal sets, the smallest id stands for all.
        o = np.lexsort((ids, s2, s1, size))
        same = np.r_[False, (size[o][1:] == size[o][:-1]) & (s1[o][1:] == s1[o][:-1]) & (s2[o][1:] == s2[o][:-1])]
        stands = np.ones(len(ids), bool)
        stands[o[same]] = False
        stands &= size > 0
        keep = stands[doc]
        doc, h, h2 = doc[keep], h[keep], h2[keep]
        del keep
        o = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.r_[True, h[o][1:] != h[o][:-1]][: len(o)])
        n = np.diff(np.r_[start, len(o)])
        hot = np.empty(len(o), bool)
        hot[o] = np.repeat(n > HOT, n)
        first = np.zeros(len(o), bool)
        first[o[start]] = True
        send = ~hot | first
        bins = bins_of(h2, n_bins)
        out += [(0, b, d) for b, d in packed_rows(bins[send], ids[doc[send]], h[send], hot[send].astype(np.uint8))]
        rest = hot & ~first
        out += [(1, p, d) for p, d in packed_rows(_parts(ids[doc[rest]], n_parts), ids[doc[rest]], h[rest], np.full(int(rest.sum()), HOT_DF, "<u2"))]
        return _batch(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        ids, texts, size = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for i, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids.append(i)
                texts.append((data or b"").translate(LOWER))
                size += len(texts[-1])
                if size >= 6 * BLOCK_WORDS:
                    yield block(np.array(ids, np.int64), *hashes(texts))
                    ids, texts, size = [], [], 0
                    trim()
        if ids:
            yield block(np.array(ids, np.int64), *hashes(texts))

    return rows


def _columns(n_parts: int):
    """Bins: count each column; pass on, by document, the columns with several."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind_part, held in by_key(batches, "key"):
            if kind_part < 0:
                yield from (b.drop_columns(["key"]) for b in held)
                continue
            entries = [unpack(x, "<u8", "u1") for b in held for x in b.column("data").to_pylist()]
            ids, h, hot = (np.concatenate(x) for x in zip(*entries))
            del entries
            o = np.argsort(h, kind="stable")
            ids, h, hot = ids[o], h[o], hot[o]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[start, len(h)])
            df = np.where(np.maximum.reduceat(hot, start) > 0, HOT_DF, np.minimum(n, HOT_DF - 1))
            shared = np.repeat(df, n) > 1
            ids, h, df = ids[shared], h[shared], np.repeat(df, n)[shared].astype("<u2")
            yield _batch([(1, p, d) for p, d in packed_rows(_parts(ids, n_parts), ids, h, df)])

    return rows


def _documents(percent: int):
    """By document: size, signature, and, where a partner is possible, the shared columns, rarest first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "part"):
            kinds = np.concatenate([b.column("kind").to_numpy(zero_copy_only=False) for b in held])
            data = [x for b in held for x in b.column("data").to_pylist()]
            docs = [unpack(d, "<u4", "<u8", "<u8") for k, d in zip(kinds, data) if k == 2]
            found = [unpack(d, "<u8", "<u2") for k, d in zip(kinds, data) if k == 1]
            ids, size, s1, s2 = (np.concatenate(x) for x in zip(*docs))
            hid, h, df = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16))
            del docs, found, data, held
            o = np.lexsort((h, df, hid))
            hid, h, df = hid[o], h[o], df[o]
            a, b = np.searchsorted(hid, ids, "left"), np.searchsorted(hid, ids, "right")
            alive = (b - a >= required(size.astype(np.int64), percent)) & (overlap_needed(size.astype(np.int64), size.astype(np.int64) + 1, percent) <= size)
            columns = [h[x:y].tobytes() if ok else None for x, y, ok in zip(a.tolist(), b.tolist(), alive.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(columns, pa.binary())], names=["id", "n", "s1", "s2", "columns"])

    return rows


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of packed rows, and how many each row has."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u8"), np.array([len(x) // 8 for x in data], np.int64)


def _minhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "columns"):
            h, n = _flat(batch.column("columns"))
            starts = np.cumsum(n) - n
            keys = [np.minimum.reduceat(mix(h ^ s), starts).view(np.int64) for s in SALTS]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array(k) for k in keys)], names=["id", "n", *(f"k{j}" for j in range(len(SALTS)))])


def _prefixes(percent: int):
    """(h, id) of the rarest columns of each document, so many that a partner has one of them among its own rarest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "columns"):
                h, own = _flat(batch.column("columns"))
                n = batch.column("n").to_numpy().astype(np.int64)
                # Columns of one document only come first in the order and are not listed.
                k = n - required(n, percent) + 1 - (n - own)
                at = np.arange(len(h)) - np.repeat(np.cumsum(own) - own, own) < np.repeat(k, own)
                ids = np.repeat(batch.column("id").to_numpy(), own)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[at])], names=["h", "id"])

    return rows


def product(h: np.ndarray, row: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (row of side 1, row of side 2) of a cell; ``side`` has the bits 1 and 2, n the set sizes.

    ``h`` and ``row``: the incidence, an entry for each shared column of each row."""
    a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    na, nb = n[a][:, None], n[b][None, :]
    alive = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (a[:, None] != b[None, :])
    if (side == 3).all():
        alive &= a[:, None] < b[None, :]
    needed = overlap_needed(na, nb, percent)
    count = np.zeros(alive.shape, np.int64)
    o = np.argsort(h, kind="stable")
    h, row = h[o], row[o]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    df = np.diff(np.r_[start, len(h)])
    column = np.repeat(np.arange(len(start)), df)
    keep = (df > 1)[column]
    column, row, dfs = column[keep], row[keep], np.repeat(df, df)[keep]
    place = [np.zeros(len(n), np.int64) for _ in "ab"]
    place[0][a], place[1][b] = np.arange(len(a)), np.arange(len(b))
    left = [np.bincount(row, minlength=len(n))[x] for x in (a, b)]  # entries not yet multiplied

    def done(rows: np.ndarray) -> None:
        gone = np.bincount(rows, minlength=len(n))
        for k, x in enumerate((a, b)):
            left[k] -= gone[x]

    def discard() -> None:
        np.logical_and(alive, count + np.minimum(left[0][:, None], left[1][None, :]) >= needed, out=alive)

    discard()
    # Rare columns: every entry meets the others of its column, one step apart, two steps apart ...
    few = dfs <= DENSE
    c, r = column[few], row[few]
    for step in range(1, DENSE if alive.any() else 0):
        meet = np.flatnonzero(c[step:] == c[:-step])
        if not len(meet):
            break
        for x, y in ((r[meet], r[meet + step]), (r[meet + step], r[meet])):
            ok = (side[x] & 1 > 0) & (side[y] & 2 > 0)
            np.add.at(count, (place[0][x[ok]], place[1][y[ok]]), 1)
    done(r)
    c, r = column[~few], row[~few]
    c = np.unique(c, return_inverse=True)[1] if len(c) else c
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, WIDTH):
        discard()
        x, y = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(x):
            break
        lo, hi = np.searchsorted(c, [at, at + WIDTH])
        dense = np.zeros((len(n), WIDTH), np.float32)
        dense[r[lo:hi], c[lo:hi] - at] = 1
        count[np.ix_(x, y)] += (dense[a[x]] @ dense[b[y]].T).astype(np.int64)  # below 2 ** 24, so exact
        done(r[lo:hi])
    i, j = np.nonzero(alive & (count >= needed))
    return a[i], b[j]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _products(percent: int):
    """Cells: a spanning forest of the links of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "cell"):
            ids, n, side = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "n", "side"))
            parts = [_flat(b.column("columns")) for b in held]
            h, own = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[o] = np.arange(len(ids))
            i, j = product(h, np.repeat(rank, own), n[o].astype(np.int64), side[o], percent)
            root = forest(i, j, len(ids))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[o][linked]), pa.array(ids[o][root[linked]])], names=["a", "b"])

    return rows


def _multiplied(scratch: Scratch, cells: DataFrame, members: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """``cells``: x, y, two blocks; ``members``: id, block. The links (a, b) that span what each cell links."""
    key = F.xxhash64("x", "y").alias("cell")
    both = cells.filter("x <> y").select(key, F.explode(F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side")))).alias("s"))
    same = cells.filter("x = y").select(key, F.struct(F.col("x").alias("block"), F.lit(3).alias("side")).alias("s"))
    rows = both.union(same).select("cell", "s.block", "s.side").join(members.select("id", "block"), "block").join(alive, "id")
    rows = rows.select("cell", "id", "n", "side", "columns")
    return scratch.keep(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(trimmed(_products(percent)), "a long, b long"))


def _in_blocks(docs: DataFrame) -> DataFrame:
    """``docs``: id, n, kind. Adds block, home (the first block of the kind) and n_blocks (of the kind)."""
    sizes = docs.groupBy("kind").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_COLUMNS)).alias("n_blocks"))
    out = docs.join(sizes, "kind")
    return out.withColumn("block", F.xxhash64("kind", F.pmod(F.xxhash64("id", F.lit(7)), "n_blocks"))).withColumn("home", F.xxhash64("kind", F.lit(0).cast("long")))


def linked_components(scratch: Scratch, alive: DataFrame, percent: int) -> DataFrame:
    """``alive``: id, n, columns (the shared columns' hashes, rarest first). (id, component) of all that have a link."""
    signs = scratch.keep(alive.mapInArrow(trimmed(_minhashes), "id long, n int, " + ", ".join(f"k{j} long" for j in range(len(SALTS)))))
    keys = signs.select("id", "n", F.explode(F.array(*(f"k{j}" for j in range(len(SALTS))))).alias("kind"))
    common = keys.groupBy("kind").agg(F.count("*").alias("docs"))
    kinds = keys.join(common, "kind").groupBy("id").agg(F.max(F.struct("docs", "kind")).alias("best"), F.first("n").alias("n"))
    kinds = kinds.select("id", "n", F.col("best.kind").alias("kind"))
    members = scratch.keep(_in_blocks(kinds))
    blocks = members.groupBy("block", "home").agg(F.count("*").alias("docs"))
    cells = blocks.filter("docs > 1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    cells = cells.union(blocks.filter("block <> home").select(F.col("home").alias("x"), F.col("block").alias("y")))
    links = _multiplied(scratch, cells, members, alive, percent)
    found = components(scratch, links)
    # What is outside of the largest component of its kind is put in blocks of its own.
    known = members.select("id", "n", F.col("kind").alias("kind_0"), F.col("n_blocks").alias("n_0")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    largest = known.groupBy("kind_0", "component").agg(F.count("*").alias("docs")).groupBy("kind_0").agg(F.max(F.struct("docs", "component")).alias("most")).select("kind_0", "most.component")
    known = known.join(largest.withColumnRenamed("component", "main"), "kind_0").withColumn("kind", F.xxhash64("kind_0", F.col("component") == F.col("main")))
    again = scratch.keep(_in_blocks(known.select("id", "n", "kind", "kind_0", "n_0", "component")))
    facts = again.groupBy("block").agg(F.first("kind_0").alias("kind"), F.first("n_0").alias("n_0"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    entries = alive.mapInArrow(trimmed(_prefixes(percent)), "h long, id long").join(again.select("id", "block"), "id").groupBy("h", "block").agg(F.count("*").alias("docs"))
    entries = scratch.keep(entries.select("h", "block"))
    wide = entries.groupBy("h").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("h")
    entries = entries.join(wide, "h")
    met = entries.withColumnRenamed("block", "x").join(entries.withColumnRenamed("block", "y"), "h").filter("x < y").select("x", "y").distinct()
    for side in "xy":
        met = met.join(facts.select(*(F.col(c).alias(f"{c}_{side}" if c != "block" else side) for c in facts.columns)), side)
    open_ = met.filter("c0_x <> c1_x OR c0_y <> c1_y OR c0_x <> c0_y").filter(f"100 * n1_x >= {percent} * n0_y AND 100 * n1_y >= {percent} * n0_x")
    open_ = open_.filter("kind_x <> kind_y OR n_0_x > 1")  # a kind of one block has been multiplied with itself
    within = facts.filter("n_0 > 1 AND c0 <> c1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    more = _multiplied(scratch, scratch.keep(open_.select("x", "y").union(within)), again, alive, percent)
    return components(scratch, links.union(more))


def _components(texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """id, n_shingles, class_id, component_id of ``texts`` (id, text) with different ids, none of them null."""
    spark = texts.sparkSession
    scratch = Scratch(spark)
    n_parts = n_bins = max(partitions(spark), -(-total_bytes(texts, "text") // BIN_BYTES))
    entries = texts.mapInArrow(trimmed(_incidence(n_words, n_bins, n_parts)), PACKED)
    # Bins have keys from 0; what only passes through has the key -1 - part, and comes first.
    entries = entries.withColumn("key", F.when(F.col("kind") == 0, F.col("part")).otherwise(-1 - F.col("part")))
    shared = scratch.keep(entries.repartition(n_bins, "key").sortWithinPartitions("key").mapInArrow(trimmed(_columns(n_parts)), PACKED))
    del entries
    release(spark)
    members = shared.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(trimmed(_documents(percent)), "id long, n int, s1 long, s2 long, columns binary")
    members = scratch.keep(members)
    scratch.drop(shared)
    release(spark)
    classes = scratch.keep(members.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id")))
    alive = members.filter("columns IS NOT NULL").join(classes.select(F.col("class_id").alias("id")), "id", "left_semi").select("id", "n", "columns")
    found = linked_components(scratch, scratch.keep(alive), percent)
    by_class = classes.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("n", "s1", "s2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    keyed = members.select("id", "n", "s1", "s2").join(by_class, ["n", "s1", "s2"], "left")
    return keyed.select("id", F.col("n").cast("long").alias("n_shingles"), "class_id", F.coalesce("component_id", "id").alias("component_id"))


PACKED = "kind int, part int, data binary"


def jaccard_components(docs: DataFrame, n_words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class_id (smallest id with an equal set; null for empty sets) and component_id, for every row."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    named = texts.filter("id IS NOT NULL")
    if not repeats(named):
        result = _components(named, n_words, percent)
    else:  # rows get keys of their own; each class and component is then named by its smallest id
        rows = Scratch(docs.sparkSession).keep(named.withColumn("key", F.monotonically_increasing_id()))
        result = _components(rows.select(F.col("key").alias("id"), "text"), n_words, percent).withColumnRenamed("id", "key")
        result = Scratch(docs.sparkSession).keep(result.join(rows.select("key", "id"), "key"))
        for c in ("class_id", "component_id"):
            result = result.join(result.filter(f"{c} IS NOT NULL").groupBy(c).agg(F.min("id").alias(f"{c}_")), c, "left")
        result = result.select("id", "n_shingles", F.col("class_id_").alias("class_id"), F.col("component_id_").alias("component_id"))
    nameless = texts.filter("id IS NULL").select(F.lit(-1).cast("long").alias("id"), "text")
    sizes = nameless.mapInArrow(trimmed(_sizes(n_words)), "id long, n_shingles long, class_id long, component_id long")
    return result.union(sizes)


def _sizes(n_words: int):
    """Rows without an id: their set sizes only. One function, as two in a row take a worker each."""
    incidence = _incidence(n_words, 1, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incidence(batches):
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
                if kind != 2:
                    continue
                n = unpack(data, "<u4", "<u8", "<u8")[1]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none, none], names=["id", "n_shingles", "class_id", "component_id"])

    return rows


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = 4_000_000) -> DataFrame:
    """One row of each component: the one with the smallest id, whichever row that is if several have it. Rows without an id
    all stay. The ids that go are spread to the texts if there are at most ``most``, else joined."""
    scratch = Scratch(docs.sparkSession)
    key = unused("row_key", docs.columns)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if repeats(ids):  # rows are judged by keys of their own, in the order of their ids
        docs = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    named = docs.filter(F.col(f"`{id_col}`").isNotNull())
    found = _components(named.select(F.col(key).alias("id"), F.col(f"`{text_col}`").alias("text")), n_words, percent)
    found = scratch.keep(found.join(named.select(F.col(key).alias("id"), F.col(f"`{id_col}`").alias("name")), "id").select("id", "name", "component_id"))
    stays = found.groupBy("component_id").agg(F.min(F.struct("name", "id")).alias("first"))
    gone = scratch.keep(found.join(stays, "component_id").filter(F.col("id") != F.col("first.id")).select(F.col("id").alias(key)))
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.filter(F.col(f"`{id_col}`").isNull()).drop(key).union(named.join(gone, key, "left_anti").drop(key))
