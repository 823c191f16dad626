"""Substring dedup: every window of ``window`` words gets a Rabin-Karp hash; a window whose hash also starts in a
document with a smaller id is a repeat; repeats merge into maximal removal intervals.

Plan. (1) Map: documents are hashed in blocks of about a million words. A hash that several documents of the block
share is decided there for all but the smallest id, so that each block sends a hash at most once, whatever its number
of copies. (2) Bins by a second, independent hash find each hash's smallest id over all blocks. (3) The repeats, packed
by document bin, meet the texts once, which are streamed through and cut.

Hashes are 64 bits within a bin, and bins are chosen by other bits: two different windows count as equal with a chance
of about n**2 / 2**65 / bins over n windows, and as bins grow with n, this stays far under one window for any corpus
that the cluster holds.

Defined results. Null or blank text: no words, nothing removed, kept text null or unchanged. Null id: such a row is in
no order, so it neither loses words nor makes others lose any. Rows that repeat an id: neither makes the other lose
words. A window that repeats only within one document stays. Columns of the input are carried in a struct, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Interned, Scratch, bins_of, by_key, mix, packed_rows, partitions, release, slices, spark_xxhash64, text_bytes, total_bytes, trim, trimmed, unpack, words

BASES = (np.uint64(0x9E6C63D0876A9A35), np.uint64(0xD1B54A32D192ED03))  # odd: so they have inverses modulo 2**64
BLOCK_WORDS = 1_000_000
BIN_WORDS = 2_000_000
PART_BYTES = 16 << 20


class RollingHash:
    """Rabin-Karp hashes modulo 2**64 of all windows of a sequence at once, from prefix sums."""

    def __init__(self, base: np.uint64, window: int):
        self.base, self.inverse, self.window = base, np.uint64(pow(int(base), -1, 1 << 64)), window
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        n, k = len(w), self.window
        if len(self.up) < n + k:
            size = max(n + k, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        sums = np.r_[np.uint64(0), np.cumsum(w * self.down[:n], dtype=np.uint64)]
        return mix((sums[k:] - sums[:-k]) * self.up[k - 1 : n])


class Windows:
    """Both hashes of all windows of a document's words."""

    def __init__(self, window: int):
        self.window, self.interned = window, Interned()
        self.hashes = [RollingHash(b, window) for b in BASES]

    def of_words(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.interned.__getitem__, ws), np.uint64, len(ws))

    def of_block(self, w: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the concatenated words of several documents: (number of the document, hash, second hash) of each window."""
        k = self.window
        if len(w) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.flatnonzero(doc[: len(w) - k + 1] == doc[k - 1 :])
        return doc[inside], self.hashes[0](w)[inside], self.hashes[1](w)[inside]


def first_hits(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (id, hash) pairs: an order by (hash, id) without repeated pairs, its group starts as a mask, and which have a smaller id in their group."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    start = np.r_[True, h[1:] != h[:-1]][: len(h)]
    new = start | np.r_[True, d[1:] != d[:-1]][: len(h)]
    smallest = d[start][np.cumsum(start) - 1]
    return order[new], start[new], (d > smallest)[new]


def _window_rows(window: int, n_bins: int, n_parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        ids: list[int] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            doc, h, h2 = windows.of_block(np.concatenate(held), np.array(lengths))
            d = np.array(ids, np.int64)[doc]
            order, start, repeat = first_hits(d, h)
            d, h, bin_ = d[order], h[order], bins_of(h2[order], n_bins)
            out = [(0, b, data) for b, data in packed_rows(bin_[start], d[start], h[start])]
            d, h = d[repeat], h[repeat]
            out += [(1, p, data) for p, data in packed_rows(np.mod(spark_xxhash64(d), n_parts).astype(np.int32), d, h)]
            return _rows_batch(out)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for i, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ws = words(data)
                if i is None or len(ws) < window:
                    continue
                ids.append(i)
                lengths.append(len(ws))
                held.append(windows.of_words(ws))
                size += len(ws)
                if size >= BLOCK_WORDS:
                    yield flush()
                    ids, lengths, held, size = [], [], [], 0
                    trim()
        if held:
            yield flush()

    return rows


def _rows_batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, data = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["kind", "part", "data"])


def _repeats(n_parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "part"):
            pairs = [unpack(x, "<u8") for b in held for x in b.column("data").to_pylist()]
            d, h = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            order, _, repeat = first_hits(d, h)
            d, h = d[order][repeat], h[order][repeat]
            yield _rows_batch([(1, p, data) for p, data in packed_rows(np.mod(spark_xxhash64(d), n_parts).astype(np.int32), d, h)])

    return rows


def intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values: their starts, and their ends (exclusive)."""
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut(window: int, text_col: str, id_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        part, ids, hashes = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[list[np.ndarray]] = []
        for batch in (part for whole in batches for part in slices(whole, "row", field=text_col)):
            row = batch.column("row")
            at_id, at_text = row.type.get_field_index(id_col), row.type.get_field_index(text_col)
            texts = text_bytes(row.field(at_text))
            out: list[tuple] = []
            take: list[int] = []
            for j, (p, kind, data, i, text) in enumerate(zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("data").to_pylist(), row.field(at_id).to_pylist(), texts)):
                if p != part:
                    part, held, ids, hashes = p, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
                if kind == 1:
                    held.append(unpack(data, "<u8"))
                    continue
                if held:  # the part's texts come after its repeats
                    ids, hashes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                    order = np.argsort(ids, kind="stable")
                    ids, hashes, held = ids[order], hashes[order], []
                take.append(j)
                ws = words(text)
                a, b = np.searchsorted(ids, [i, i + 1]) if i is not None else (0, 0)
                spans: list[dict] = []
                removed, kept = 0, ws
                if b > a:
                    h = windows.hashes[0](windows.of_words(ws))
                    hit = np.flatnonzero(np.isin(h, hashes[a:b]))
                    edge = np.zeros(len(ws) + 1, np.int32)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(*intervals(covered))]
                    removed = int(covered.sum())
                    kept = [w for w, c in zip(ws, covered.tolist()) if not c]
                out.append((len(ws), removed, None if text is None else b" ".join(kept), spans))
            if take:
                n, r, k, s = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [row.take(pa.array(take)), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()).cast(pa.string()), pa.array(s, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["row", "n_words", "n_removed", "kept_text", "spans"],
                )

    return rows


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``row`` (the input's row), n_words, n_removed, kept_text (kept words joined by one blank) and spans (the maximal
    removed intervals in words, end exclusive). The id must be a long or int. See the module's text for all cases."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = total_bytes(docs, text_col)
    n_parts = max(partitions(spark), -(-size // PART_BYTES))
    n_bins = max(partitions(spark), -(-size // (5 * BIN_WORDS)))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    packed = "kind int, part int, data binary"
    entries = keyed.mapInArrow(trimmed(_window_rows(window, n_bins, n_parts)), packed)
    bins = entries.repartition(n_bins, "part", "kind").sortWithinPartitions(F.col("kind").desc(), "part")
    repeats = scratch.keep(bins.mapInArrow(trimmed(_both(n_parts)), packed))
    del entries, bins
    release(spark)
    nothing = F.lit(None)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select(F.lit(2).alias("kind"), F.coalesce(F.pmod(F.xxhash64(F.col("row").getField(id_col).cast("long")), F.lit(n_parts)), F.lit(0)).cast("int").alias("part"), nothing.cast("binary").alias("data"), "row")
    hits = repeats.select("kind", "part", "data", nothing.cast(rows.schema["row"].dataType).alias("row"))
    both = rows.union(hits).repartition(n_parts, "part").sortWithinPartitions("part", "kind")
    schema = T.StructType([*both.select("row").schema, *T._parse_datatype_string("n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")])
    return both.mapInArrow(trimmed(_cut(window, text_col, id_col)), schema)


def _both(n_parts: int):
    """Pass on what blocks have decided, which comes first; find the other repeats by bin."""
    by_bin = _repeats(n_parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for batch in batches:
            n = int((batch.column("kind").to_numpy(zero_copy_only=False) == 1).sum())
            if n:
                yield batch.slice(0, n)
            if n < len(batch):
                yield from by_bin(chain([batch.slice(n)], batches))

    return rows
