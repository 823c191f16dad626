"""Helpers shared by the corpus operators: words, shared storage, packed rows and numbering."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than blank, tab, newline, vertical tab, form feed and return.
WORD_SPLIT_PATTERN = "[\\x20\\x09-\\x0D]+"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def words(data: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; ``bytes.split`` splits at exactly the six ASCII blanks above."""
    return data.split() if data else []


def text_bytes(column: pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most so many bytes in a text column, or in a struct's text field, or of one row that
    has more."""
    texts = batch.column(column)
    texts = texts if field is None else texts.field(texts.type.get_field_index(field))
    sizes = pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def trim() -> None:
    """Give freed memory back to the system. Python workers live on between tasks and share their executor's memory, and the
    C library keeps what large arrays leave behind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, whose task leaves no freed memory in its worker."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            trim()

    return out


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a new temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_llm_shared_dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext._llm_shared_dir = found
    spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder during one operator call. ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once, cutting its lineage; what was written survives the loss of executors."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now, rather than when the driver next collects garbage.

    The first collection only queues what refers to them; they go with the second, in the background."""
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeats(ids: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return bool(ids.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n")).first().n or 0)


# ---------------------------------------------------------------- hashes

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def mix(x: np.ndarray) -> np.ndarray:
    """The final avalanche of XXH64."""
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def spark_xxhash64(ids: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` gives for a column of longs."""
    h = np.uint64(42) + P5 + np.uint64(8)
    h = h ^ (_rotl(ids.astype(np.int64).view(np.uint64) * P2, 31) * P1)
    return mix(_rotl(h, 27) * P1 + P4).view(np.int64)


def bins_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bins 0 to n - 1 from the upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * P1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: For ``bytes.translate``: A-Z to a-z; and besides, all other ASCII but letters, digits and _ to blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_ALNUM = bytes(c if (c := LOWER[b]) >= 128 or chr(c).isalnum() or c == 95 else 32 for b in range(256))
SEGMENT = 1 << 18


class WordHash:
    """64-bit hashes of all words of many texts at once: polynomials over each word's bytes, from prefix sums."""

    BASE = np.uint64(0xA0761D6478BD642F)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * SEGMENT)
            inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (self.BASE, inverse))

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their hashes."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.diff(np.r_[True, BLANK[raw], True].view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._powers(len(raw) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(LETTERS[raw] * self.up[: len(raw)], dtype=np.uint64)]
        return start, mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and the number of words of each text."""
        counts, hashes = np.zeros(len(texts), np.int64), []
        at = 0
        while at < len(texts):
            size, to = len(texts[at]), at + 1
            while to < len(texts) and size + len(texts[to]) < SEGMENT:
                size += len(texts[to]) + 1
                to += 1
            if to == at + 1:  # one text, in as many segments as it needs, cut at blanks
                for segment in segments(texts[at]):
                    start, h = self._segment(segment)
                    counts[at] += len(start)
                    hashes.append(h)
            else:
                start, h = self._segment(b" ".join(texts[at:to]))
                ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
                counts[at:to] = np.diff(np.r_[0, np.searchsorted(start, ends)])
                hashes.append(h)
            at = to
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def segments(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about SEGMENT bytes that end at blanks."""
    at = 0
    while len(data) - at > 2 * SEGMENT:
        to = at + SEGMENT
        near = min((k for b in b" \n\t\r\x0b\x0c" if (k := data.find(bytes([b]), to)) >= 0), default=len(data))
        yield data[at:near]
        at = near
    yield data[at:]


class Interned(dict):
    """word -> 64-bit hash; a cache that starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


# ---------------------------------------------------------------- packed (id, hash) pairs


def pack(ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Pairs sorted by id as bytes: the gaps of the ids in the least width that holds them, then each other column."""
    gaps = np.diff(ids, prepend=ids[:1]).astype(np.uint64)
    most = int(gaps.max()) if len(gaps) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + np.array([len(ids), ids[0] if len(ids) else 0], "<i8").tobytes() + planes + b"".join(c.tobytes() for c in columns)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    width = data[0]
    n, base = np.frombuffer(data, "<i8", 2, 1)
    at = 17
    gaps = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T.copy().view(f"<u{width}").ravel()
    out, at = [base + np.cumsum(gaps.astype(np.int64))], at + n * width
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def packed_rows(part: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed row for each part that occurs."""
    order = np.lexsort((ids, part))
    part, ids, columns = part[order], ids[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), pack(ids[a:b], *(c[a:b] for c in columns))


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal keys in batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != now:
                yield now, held
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


# ---------------------------------------------------------------- numbering


def numbered(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], name: str, n: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each group by ``order``, however large a group is.

    The rows are range-partitioned by (group, order) and written; each partition numbers its own rows, and only a
    partition's first group can have rows in earlier ones, so one offset a partition is all that must be carried over.
    Equal rows get distinct numbers. The group's columns must be longs or ints without nulls.
    """
    spark = df.sparkSession
    n = n or partitions(spark)
    keys = [F.col(f"`{c}`") for c in (*group, *order)]
    rows = scratch.keep(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    rows = rows.withColumn("_g", F.struct(*(F.col(f"`{c}`") for c in group)))
    # Of each partition: its first and last group, and where each of these starts.
    ends = rows.groupBy("_p").agg(F.min("_g").alias("a"), F.max("_g").alias("b"), F.count("*").alias("n"), F.min("_i").alias("base"))
    last = rows.join(F.broadcast(ends), "_p").filter(F.col("_g") == F.col("b")).groupBy("_p").agg(F.count("*").alias("n_last"))
    carried: dict[int, int] = {}
    before, tail = None, 0
    for r in sorted(ends.join(last, "_p").collect(), key=lambda r: r._p):  # a row for each partition
        carried[r._p] = tail if r.a == before else 0
        tail = r.n_last + (carried[r._p] if r.a == r.b else 0)
        before = r.b
    offsets = spark.createDataFrame(list(carried.items()), "_p int, _carried long")
    first = ends.select("_p", "a")
    starts = rows.groupBy("_p", "_g").agg(F.min("_i").alias("_start"))
    out = rows.join(starts, ["_p", "_g"]).join(F.broadcast(offsets), "_p").join(F.broadcast(first), "_p")
    return out.withColumn(name, F.col("_i") - F.col("_start") + F.when(F.col("_g") == F.col("a"), F.col("_carried")).otherwise(0)).drop("_p", "_i", "_g", "_start", "_carried", "a")
