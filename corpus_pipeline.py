"""From raw documents to packed batches: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it has kept; ``run`` writes each result as
Parquet in the shared folder and reads it again for the next. All but the last return the columns of ``documents``; the
last returns the texts that are left, cut in pieces and batched.

In every stage: null, empty and blank texts pass as they are (they are no one's duplicates and overlap with nothing). Rows
that repeat an id are judged one by one, and rows without an id stay, with their texts as they are. Other columns are
carried unread. An empty table gives an empty one, and ties go by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch
from ledgerloom.llm.decontaminate import find_overlaps
from ledgerloom.llm.jaccard_join import one_of_each
from ledgerloom.llm.kneser_ney import score_quality, trusted_rows
from ledgerloom.llm.packing import pack_buckets
from ledgerloom.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit. Without trusted texts, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, trusted_rows(docs, labels)).filter("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: five-word shingles, similarity 0.8.

    Texts of equal words are such a group too; blank ones are not."""
    return one_of_each(docs, n_words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that a document with a smaller id has; untouched texts stay as they are, emptied ones go."""
    out = substring_dedup(docs).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. An empty benchmark leaves all."""
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = found.filter("coalesce(size(overlaps), 0) <= 0")
    return clean.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their texts, in batches of optimal length buckets. Blank texts are pieces of length 0."""
    return pack_buckets(docs, with_text=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("packed", packed)]

#: SQL cannot express the classifier; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
