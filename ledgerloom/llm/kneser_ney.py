"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted texts; each
document's perplexity under it is held against a quantile of the trusted documents of its language.

Counting. Texts are sequences of symbols of 12 bits, so that an n-gram of up to five is a long, exactly. The characters that
trusted texts have most often are a symbol each; any other is spelled in three, so that no two characters are one. Workers count the n-grams of a batch before anything is shuffled; the sums are
tables in the shared folder, and everything that Kneser and Ney's formulas need (continuation counts, counts of counts,
followers by context) comes from joins and aggregates of these tables.

Scoring. Every n-gram gets its interpolated probability and every context its back-off weight in advance. This table is cut
into shards by a hash of the two symbols before the last, which all lookups for a position share (n-grams of one and two
symbols are in every shard), so that a shard holds about ``shard_rows`` rows whatever the corpus. A shard goes to the workers
as hash tables for one pass that adds up each document's log probabilities at the shard's positions. One shard is the usual
case: then no document is shuffled or written. With several, each pass is a job of its own, whose sums are written beside the
texts to the shared folder, so that a worker never holds two shards.

Deciding. The score is the mean surprise in bits a symbol, drawn towards the trusted mean of the language as if
``prior`` average symbols were added, so that short texts are not judged by chance. A document is kept if its score is
at most its language's threshold: the ``quantile`` of the trusted documents' scores, read from a histogram of thousandths,
plus ``margin`` bits.

Defined results. Null or empty text: no surprise of its own, so the trusted mean; kept. A null language is a language of
its own. A language without trusted text takes the threshold of all languages together. No trusted text at all: everything is
kept and scores are 0. Rows that repeat an id are each judged. Empty tables give no rows. Columns of the input are carried in a
struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, slices, unused

BITS = 12
START = 1
SPELLED = 2  # the first of 128 symbols that spell rare characters
FIRST = SPELLED + 128
BATCH = 1 << 21
BYTES = 1 << 18


def char_numbers(counts: list[tuple[int, int]]) -> np.ndarray:
    """A table from code points to symbols: the most frequent first, ties by code point; 0 stands for "spelled"."""
    table = np.zeros(0x110000, np.uint16)
    ranked = sorted(counts, key=lambda c: (-c[1], c[0]))[: (1 << BITS) - FIRST]
    for k, (char, _) in enumerate(ranked):
        table[char] = FIRST + k
    return table


def symbols(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and how many each text has."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    raw = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
    x = table[raw].astype(np.int64)
    rare = np.flatnonzero(x == 0)
    if len(rare):
        width = np.ones(len(raw), np.int64)
        width[rare] = 3
        ends = np.r_[0, np.cumsum(width)]
        lengths = np.diff(ends[np.r_[0, np.cumsum(lengths)]])
        x = np.repeat(x, width)
        for k, shift in enumerate((14, 7, 0)):
            x[ends[rare] + k] = SPELLED + ((raw[rare] >> shift) & 127)
    return x, lengths


def grams(texts: list[str | None], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, with start marks before the text, and each text's number of symbols."""
    own, lengths = symbols(texts, table)
    pad = order - 1
    x = np.full(len(own) + pad * len(texts), START, np.int64)
    at = np.arange(len(own)) + np.repeat(pad * np.arange(1, len(texts) + 1), lengths)
    x[at] = own
    code = np.zeros(len(own), np.int64)
    for k in range(order):
        code |= x[at - k] << (BITS * k)
    return code, lengths


def _counted(table: np.ndarray, order: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["g", "n"])

        for batch in batches:
            for part in slices(batch, "text", BYTES):
                held.append(grams(part.column("text").to_pylist(), table, order)[0])
                size += len(held[-1])
                if size >= BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0x110000, np.int64)
    for batch in batches:
        for part in slices(batch, "text", BYTES):
            raw = np.frombuffer("".join(t for t in part.column("text").to_pylist() if t).encode("utf-32-le", "surrogatepass"), "<u4")
            if len(raw):
                n = np.bincount(raw)
                seen[: len(n)] += n
    chars = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(chars), pa.array(seen[chars])], names=["c", "n"])


def kneser_ney(scratch: Scratch, top: DataFrame, order: int) -> DataFrame:
    """``top``: (g, n) counts of n-grams. Returns rows (k, g, v): the log2 probability of the n-gram g of k characters, and,
    with k negative, the log2 back-off weight of the context g of -k characters."""
    counts = {order: top}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many n-grams of one more character
        counts[k] = scratch.keep(counts[k + 1].groupBy((F.col("g").bitwiseAND((1 << BITS * k) - 1)).alias("g")).agg(F.count("*").alias("n")))
    n_chars = counts[1].count()
    lower = None  # the table of order k - 1: g, p
    out = None
    for k in range(1, order + 1):
        c = counts[k]
        n1, n2, n3, n4 = (float(x or 0) for x in c.agg(*(F.sum((F.col("n") == j).cast("long")) for j in (1, 2, 3, 4))).first())
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d1, d2, d3 = (min(max(d, 0.05), j) for j, d in ((0.95, 1 - 2 * y * n2 / n1 if n1 else 0.5), (1.95, 2 - 3 * y * n3 / n2 if n2 else 1.0), (2.95, 3 - 4 * y * n4 / n3 if n3 else 1.5)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        if k == 1:  # one context, the empty one
            r = c.agg(F.sum("n").alias("total"), F.sum(discount).alias("left")).first()
            total, weight = float(r.total or 1), float(r.left or 0) / float(r.total or 1)
            p = c.select("g", ((F.col("n") - discount) / total + weight / (n_chars + 1)).alias("p"))
            unseen = weight / (n_chars + 1)
        else:
            c = c.withColumn("h", F.shiftright("g", BITS))
            by_context = scratch.keep(c.groupBy("h").agg(F.sum("n").alias("total"), F.sum(discount).alias("left")))
            c = c.join(by_context, "h").withColumn("weight", F.col("left") / F.col("total"))
            c = c.withColumn("own", (F.col("n") - discount) / F.col("total"))
            below = lower.withColumnRenamed("g", "s").withColumnRenamed("p", "q")
            c = c.withColumn("s", F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(below, "s")
            p = c.select("g", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = scratch.keep(p)
        rows = lower.select(F.lit(k).alias("k"), "g", F.log2("p").alias("v"))
        if k > 1:
            rows = rows.union(by_context.select(F.lit(1 - k).alias("k"), F.col("h").alias("g"), F.log2(F.col("left") / F.col("total")).alias("v")))
        elif unseen > 0:  # a symbol that no trusted text has
            rows = rows.union(scratch.spark.createDataFrame([(0, 0, math.log2(unseen))], "k int, g long, v double"))
        out = rows if out is None else out.union(rows)
    return scratch.keep(out)


class Lookup:
    """Values of long keys, by open addressing in arrays that are half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size = max(16, 2 * len(keys))
        self.keys, self.values = np.full(self.size, -1, np.int64), np.zeros(self.size, np.float32)
        self.most = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            self.most += 1
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) % self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = self._slot(keys)
        here = self.keys[slot]
        found = here == keys
        value = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (here != -1))
        for _ in range(self.most):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) % self.size
            here = self.keys[slot[left]]
            hit = here == keys[left]
            found[left[hit]] = True
            value[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (here != -1)]
        return value, found


class Shard:
    """The part of the model that positions after certain symbols need."""

    def __init__(self, k: np.ndarray, g: np.ndarray, v: np.ndarray, table: np.ndarray, order: int, number: int, of: int):
        self.table, self.order, self.number, self.of = table, order, number, of
        self.grams = {j: Lookup(g[k == j], v[k == j]) for j in range(1, order + 1)}
        self.contexts = {j: Lookup(g[k == -j], v[k == -j]) for j in range(1, order)}
        self.unseen = float(v[k == 0][0]) if (k == 0).any() else 0.0

    def surprise(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits and symbols of each text at the positions of this shard."""
        code, lengths = grams(texts, self.table, self.order)
        doc = np.repeat(np.arange(len(texts)), lengths)
        if self.of > 1:
            here = shard_of((code >> BITS) & ((1 << 2 * BITS) - 1), self.of) == self.number
            code, doc = code[here], doc[here]
        bits = np.zeros(len(code), np.float64)
        left = np.arange(len(code))
        for k in range(self.order, 0, -1):
            g = code[left] & ((1 << BITS * k) - 1)
            value, found = self.grams[k](g)
            bits[left] -= value
            left, g = left[~found], g[~found]
            if not len(left):
                break
            if k > 1:  # an unknown context has the weight 1
                bits[left] -= self.contexts[k - 1](g >> BITS)[0]
            else:
                bits[left] -= self.unseen
        return np.bincount(doc, bits, minlength=len(texts)), np.bincount(doc, minlength=len(texts))


def shard_of(before: np.ndarray, n: int) -> np.ndarray:
    """Of the two symbols before the last."""
    return ((before.astype(np.int64) * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % n


def _surprises(shard):
    """``shard``: a broadcast of one shard, which a worker reads once for all of its tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shard.value
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                bits, n = own.surprise(batch.column("text").to_pylist())
                at = batch.schema.get_field_index
                bits = bits + batch.column("bits").to_numpy(zero_copy_only=False)
                n = n.astype(np.int64) + batch.column("n").to_numpy(zero_copy_only=False)
                yield batch.set_column(at("bits"), "bits", pa.array(bits, pa.float64())).set_column(at("n"), "n", pa.array(n, pa.int64()))

    return rows


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = 4_000_000) -> DataFrame:
    """The documents that are labelled 1. Their ids are spread to the texts if there are at most ``most`` (tens of MB);
    otherwise both sides are shuffled, once, and the texts found are written to the shared folder."""
    key = unused("trusted", docs.columns)
    ids = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias(key)).dropna().distinct()
    here = F.col(f"`{id_col}`") == F.col(key)
    if ids.count() <= most:
        return docs.join(F.broadcast(ids), here, "left_semi")
    return Scratch(docs.sparkSession).keep(docs.join(ids, here, "left_semi"))


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    order: int = 5,
    quantile: float = 0.995,
    margin: float = 0.05,
    prior: int = 100,
    shard_rows: int = 4_000_000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``row`` (the input's row), bits (a symbol), perplexity, threshold (in bits) and keep.

    ``trusted``: rows with the same text and language columns. All of it is counted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = trusted.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    chars = known.select("text").mapInArrow(_characters, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    table = char_numbers([(r.c, r.n) for r in chars.collect()])  # at most one row for each Unicode character
    top = known.select("text").mapInArrow(_counted(table, order), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    model = kneser_ney(scratch, scratch.keep(top), order)
    n_shards = max(1, -(-model.count() // shard_rows))
    # The two symbols before the last: of an n-gram the second and third lowest, of a context the two lowest.
    before = F.when(F.col("k") > 0, F.shiftright("g", BITS)).otherwise(F.col("g")).bitwiseAND((1 << 2 * BITS) - 1)
    place = F.shiftright((before * 0x9E3779B1).bitwiseAND(0xFFFFFFFF), 8) % n_shards
    model = model.withColumn("shard", F.when(F.col("k").between(-1, 2), F.lit(-1)).otherwise(place))

    def shard(number: int):
        part = model.filter(F.col("shard").isin(-1, number)).select(F.col("k").cast("byte").alias("k"), "g", F.col("v").cast("float").alias("v")).toArrow()
        k, g, v = (part.column(c).to_numpy() for c in ("k", "g", "v"))
        return spark.sparkContext.broadcast(Shard(k, g, v, table, order, number, n_shards))

    shards = [shard(0)] if n_shards == 1 else None

    def surprises(df: DataFrame) -> DataFrame:
        """df has the columns row and text; bits and n are added. Of several shards, a worker holds one at a time."""
        df = df.withColumn("bits", F.lit(0.0)).withColumn("n", F.lit(0).cast("long"))
        if shards:
            return df.mapInArrow(_surprises(shards[0]), df.schema)
        old = None
        for number in range(n_shards):
            sent = shard(number)
            df = scratch.keep(df.mapInArrow(_surprises(sent), df.schema))
            sent.destroy()
            if old is not None:
                scratch.drop(old)
            old = df
        return df

    known = surprises(known.select(F.struct("lang").alias("row"), "text")).select("row.lang", "bits", "n")
    known = scratch.keep(known.filter("n > 0"))
    means = known.groupBy(F.col("lang").alias("l")).agg((F.sum("bits") / F.sum("n")).alias("mean"))
    overall = float(known.agg(F.coalesce(F.sum("bits") / F.sum("n"), F.lit(0.0)).alias("mean")).first().mean)
    drawn = (F.col("bits") + prior * F.col("mean")) / (F.col("n") + prior)
    scores = known.join(means, F.col("lang").eqNullSafe(F.col("l"))).select("l", "mean", F.floor(drawn * 1000).cast("long").alias("bin"))
    bins = scratch.keep(scores.groupBy("l", "bin").agg(F.count("*").alias("n"), F.first("mean").alias("mean")))
    upto = Window.partitionBy("l").orderBy("bin")  # some thousand bins a language
    bins_upto = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("l")))
    limits = bins_upto.filter(F.col("upto") >= quantile * F.col("all")).groupBy("l").agg(F.first("mean").alias("mean"), F.min("bin").alias("bin"))
    thresholds = scratch.keep(limits.select("l", "mean", ((F.col("bin") + 1) / 1000 + margin).alias("threshold")))
    everything = _limit([(r.bin, r.n) for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect()], quantile, margin)
    carried = [c for c in docs.columns if c != text_col] or [text_col]
    out = surprises(docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{text_col}`").alias("text")))
    out = out.withColumn("lang", F.col("row").getField(lang_col).cast("string"))
    out = out.join(thresholds, F.col("lang").eqNullSafe(F.col("l")), "left")  # a row a language: Spark broadcasts it, if it is small
    mean = F.coalesce("mean", F.lit(overall))
    bits = (F.col("bits") + prior * mean) / (F.col("n") + prior)
    limit = F.coalesce("threshold", F.lit(everything))
    row = F.struct(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
    return out.select(row.alias("row"), bits.alias("bits"), F.pow(F.lit(2.0), bits).alias("perplexity"), limit.alias("threshold"), (bits <= limit).alias("keep"))


def _limit(bins: list[tuple[int, int]], quantile: float, margin: float) -> float:
    """The upper edge of the bin in which the quantile lies, plus the margin."""
    need, seen = quantile * sum(n for _, n in bins), 0
    for b, n in sorted(bins):
        seen += n
        if seen >= need:
            return (b + 1) / 1000 + margin
    return float("inf")
