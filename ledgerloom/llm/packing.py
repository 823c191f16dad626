"""Packing into optimal length buckets: dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding; inside each bucket, batches of one token budget form.

A length is the number of words unless another column is given. Pieces: a document above ``max_len`` is cut into pieces of
``max_len`` and a rest, so that every word is packed. The histogram has at most ``max_len + 1`` rows, whatever the corpus;
only it goes to the driver. Batches are numbered per bucket by id, in a way that spreads a bucket over many tasks.

Defined results. Null or blank text: one piece of length 0, in the smallest bucket. Null ids come first; rows that repeat
an id are packed each. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, numbered


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` boundaries, the last one the longest length, with the least sum of padded lengths.

    cost[j]: the least padded tokens of the lengths up to the j-th when the last bucket ends there. Adding a bucket after
    the i-th gives cost[i] + length[j] * (rows between)."""
    order = np.argsort(lengths)
    lengths, rows = lengths[order].astype(np.int64), np.r_[0, np.cumsum(counts[order])].astype(np.int64)
    n = len(lengths)
    cost, back = lengths * rows[1:], []
    for _ in range(min(k, n) - 1):
        before, new, via = np.r_[0, cost], np.empty(n, np.int64), np.empty(n, np.int64)
        for j in range(n):
            options = before[: j + 1] + lengths[j] * (rows[j + 1] - rows[: j + 1])
            via[j] = np.argmin(options)
            new[j] = options[via[j]]
        back.append(via)
        cost = new
    out, j = [], n - 1
    for via in reversed([np.zeros(n, np.int64), *back]):
        out.append(int(lengths[j]))
        j = int(via[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack_buckets(docs: DataFrame, k: int = 16, max_len: int = 4096, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, with_text: bool = False) -> DataFrame:
    """id, piece, start, n_tokens, bucket, boundary (the length that its rows are padded to), batch, row (within the batch);
    ``with_text``, for lengths in words only, adds the piece's text: a document of one piece as it is, else the words."""
    if not 0 < max_len <= budget:
        raise ValueError("max_len must be between 1 and the budget")
    scratch = Scratch(docs.sparkSession)
    n = F.coalesce(length if length is not None else F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    if with_text and length is not None:
        raise ValueError("pieces have texts only if lengths are in words")
    text = [F.col(f"`{text_col}`").alias("text")] if with_text else []
    pieces = docs.select(F.col(f"`{id_col}`").alias("id"), n.alias("n"), *text)
    pieces = pieces.select(*pieces.columns, F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(n - 1) div {max_len}"), F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    if with_text:
        part = F.slice(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), (start + 1).cast("int"), F.lit(max_len))
        text = [F.when(F.col("n") <= max_len, F.col("text")).otherwise(F.array_join(part, " ")).alias("text")]
    pieces = scratch.keep(pieces.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_len)).cast("int").alias("n_tokens"), *text))
    histogram = pieces.groupBy("n_tokens").count().toPandas()  # max_len + 1 rows at most
    bounds = best_boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), k) if len(histogram) else [0]
    bucket, boundary, each = F.lit(0), F.lit(bounds[0]), F.lit(budget // max(bounds[0], 1))
    for b, (lower, upper) in enumerate(zip(bounds, bounds[1:]), 1):
        above = F.col("n_tokens") > lower
        bucket, boundary, each = F.when(above, b).otherwise(bucket), F.when(above, upper).otherwise(boundary), F.when(above, budget // upper).otherwise(each)
    pieces = pieces.select("*", bucket.alias("bucket"), boundary.alias("boundary"), each.alias("each"))
    out = numbered(scratch, pieces, ["bucket"], ["id", "piece"], "slot")
    return out.select("id", "piece", "start", "n_tokens", "bucket", "boundary", F.expr("slot div each").alias("batch"), F.expr("cast(slot % each as int)").alias("row"), *(["text"] if with_text else []))
