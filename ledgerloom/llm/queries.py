"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_components

    out, recall = embedding_components(_table(spark, sf_dir, "embeddings"))
    if recall < 0.9:  # rather no result than one that lacks links
        raise RuntimeError(f"the audited recall of links is {recall:.3f}, under 0.9")
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each overlap of a document with a benchmark item; clean documents have none."""
    from .decontaminate import find_overlaps

    out = find_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import score_quality, trusted_rows

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = score_quality(docs, trusted_rows(docs, _table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", "row.lang", "bits", "perplexity", "threshold", "keep")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("row.page_id", "row.url", F.col("extracted").alias("text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, fold, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    out = jaccard_components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_buckets

    return pack_buckets(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    out = format_chats(_table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "turn", F.col("row.role").alias("role"), "reply_to", "n_quoted", "branch_depth", "position", "formatted")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_dedup, op3_decontamination, op4_quality_classifier, op5_html_extraction, op6_toxicity, op7_jaccard_join, op8_sharding, op9_packing, op10_chat_formatting)}
