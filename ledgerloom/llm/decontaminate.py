"""Benchmark decontamination by spaced-seed hashing: fixed masks ignore some word positions of a window; training hashes
meet the benchmark's; around each hit, the alignment on its diagonal is verified with substitutions tolerated.

Plan. The benchmark, not the corpus, is spread: its size is measured, it is cut into slices of at most ``slice_bytes`` of
text, and each slice's seed table goes to the workers for one pass over the documents. One slice is the usual case; a
larger benchmark means more passes, never a table that outgrows a worker. Documents are neither shuffled nor sorted.

A word is a run of letters, digits, underscores and non-ASCII characters of the lower-cased text. An overlap is a stretch of
a diagonal of at least ``min_words`` words (or the whole item, if that is shorter) of which at least four fifths match: the
longest such stretch, less the substitutions at its ends as far as that length allows, and then those beside it. From 13
words on, the masks hit every such stretch, wherever its substitutions are; items of fewer words have seeds of their own.

Defined results. Null or blank texts and items overlap with nothing. Rows that repeat an id are each judged. An empty benchmark: no overlaps. Other columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ALNUM, WordHash, mix, total_bytes

#: Tried on all placements: every 13 to 25 words with at most a fifth of substitutions hold one; a longer stretch holds such a one.
MASKS = ("1101111", "1111011", "1101000111", "111010000011")
SHORT = 13
SLICE_BYTES = 8 << 20
GROUP = 64
_ODD = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
OVERLAP = "array<struct<item_id:long,doc_start:int,doc_end:int,item_start:int,n_words:int,n_matches:int>>"


def _hashes(w: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out + w[k : k + n] * _ODD[k]
    return mix(out)


def _whole_seeds(n: int) -> list[tuple[str, int]]:
    """(mask, item position) of which every alignment of a whole item of n words with n // 5 substitutions has one intact."""
    if n == 5:
        return [("1111", 0), ("1111", 1), ("10111", 0), ("11011", 0), ("11101", 0)]
    cuts = [n * k // (n // 5 + 1) for k in range(n // 5 + 2)]
    return [("1" * (b - a), a) for a, b in zip(cuts, cuts[1:])]


class SeedTable:
    """The masked hashes of all benchmark positions, and the items' words for verification."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words, self.hash = min_words, WordHash()
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = self.of([t for _, t in items])
        keys, item, pos = [], [], []
        self.masks = {mask: m for m, mask in enumerate(MASKS)}
        for k, w in enumerate(self.words):
            seeds = [(mask, None) for mask in MASKS] + (_whole_seeds(len(w)) if 0 < len(w) < SHORT else [])
            for mask, a in seeds:
                h = _hashes(w, mask, self.masks.setdefault(mask, len(self.masks)))
                at = np.arange(len(h)) if a is None else np.array([a])
                keys.append(h[at])
                item.append(np.full(len(at), k))
                pos.append(at)
        keys, item, pos = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, item, pos))
        order = np.argsort(keys)
        self.keys, self.item, self.pos = keys[order], item[order], pos[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        hashes, counts = self.hash([t.lower().encode().translate(LOWER_ALNUM) if t else b"" for t in texts])
        return np.split(hashes, np.cumsum(counts)[:-1])

    def overlaps(self, texts: list[str | None]) -> list[list[dict]]:
        """Of several texts at once, so that short ones share the array operations."""
        out: list[list[dict]] = []
        for a in range(0, len(texts), GROUP):
            w = self.of(texts[a : a + GROUP])
            each = [set() for _ in w]
            ends = np.cumsum([len(x) for x in w])
            for text, item, diagonal in self.candidates(np.concatenate(w), ends):
                each[text].add((item, diagonal))
            out += [[x for pair in sorted(pairs) for x in self.segments(w[k], *pair)] for k, pairs in enumerate(each)]
        return out

    def candidates(self, w: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, diagonal) of every hit that does not reach over the end of its text."""
        found: set[tuple[int, int, int]] = set()
        for mask, m in self.masks.items():
            h = _hashes(w, mask, m)
            at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
            a, b = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            if not len(at):
                continue
            text = np.searchsorted(ends, at, "right")
            inside = at + len(mask) <= ends[text]
            at, a, n, text = at[inside], a[inside], n[inside], text[inside]
            entry = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)[: len(a)], n) + np.arange(n.sum())
            start = np.r_[0, ends[:-1]][text]
            diagonal = np.repeat(at - start, n) - self.pos[entry].astype(np.int64)
            hits = np.stack([np.repeat(text, n), self.item[entry].astype(np.int64), diagonal])
            found.update(zip(*np.unique(hits, axis=1).tolist()))
        return found

    def segments(self, w: np.ndarray, item: int, diagonal: int) -> list[dict]:
        """The overlaps in the alignment of item position j with document position j + diagonal."""
        t = self.words[item]
        lo, hi = max(0, -diagonal), min(len(t), len(w) - diagonal)
        same = t[lo:hi] == w[lo + diagonal : hi + diagonal]
        least = min(self.min_words, len(t))
        out, rest = [], [(0, hi - lo)]
        while rest:
            a, b = rest.pop()
            part = same[a:b]
            if len(part) < least or 5 * np.count_nonzero(part) < 4 * least:
                continue
            # Four fifths match where matches count 1, substitutions -4, and the sum is not negative.
            sums = np.r_[0, np.cumsum(np.where(part, 1, -4))]
            first = np.searchsorted(-np.minimum.accumulate(sums), -sums)
            end = int(np.argmax(np.arange(len(sums)) - first))
            start = int(first[end])
            if end - start < least:
                continue
            while end - start > least and not part[start]:
                start += 1
            while end - start > least and not part[end - 1]:
                end -= 1
            start, end = a + start, a + end
            out.append({"item_id": int(self.ids[item]), "doc_start": lo + diagonal + start, "doc_end": lo + diagonal + end, "item_start": lo + start, "n_words": end - start, "n_matches": int(np.count_nonzero(same[start:end]))})
            rest += [(a, start), (end, b)]
        return sorted(out, key=lambda x: x["item_start"])


def _pass(items: list[tuple[int, str]], min_words: int, kind: pa.DataType):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SeedTable(items, min_words)
        for batch in batches:
            before = batch.column("overlaps").to_pylist()
            new = [(old or []) + found for old, found in zip(before, table.overlaps(batch.column("text").to_pylist()))]
            yield batch.set_column(batch.schema.get_field_index("overlaps"), "overlaps", pa.array(new, kind))

    return rows


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``row`` (the input's row without its text, unless ``docs`` has it under another name too), ``text`` and ``overlaps``."""
    from pyspark.sql.pandas.types import to_arrow_type

    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")).dropna()
    n = max(1, -(-total_bytes(items, "t") // slice_bytes))
    carried = [c for c in docs.columns if c != text_col] or [text_col]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast(OVERLAP).alias("overlaps"))
    schema = out.schema
    kind = to_arrow_type(T._parse_datatype_string(OVERLAP))
    for k in range(n):  # a slice has slice_bytes of text on average; rows are spread by hash
        slice_ = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        out = out.mapInArrow(_pass([(r.i, r.t) for r in slice_.collect()], min_words, kind), schema)
    return out
