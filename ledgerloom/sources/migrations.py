"""Schema versions as pairs of ``NNNN_name.up.sql`` and ``NNNN_name.down.sql`` files, with checksums against drift."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import IntegrityError, assert_empty, assert_unique

NAME = r"(\d{4})_([a-z0-9_]+)\.(up|down)\.sql$"


def load(spark: SparkSession, path: str) -> DataFrame:
    """version, name, up, down, checksum (sha-256 of the up file), complete pairs only."""
    files = spark.read.option("wholetext", True).text(f"{path}/*.sql").select("value", F.col("_metadata.file_name").alias("file"))
    parts = files.select(F.regexp_extract("file", NAME, 1).cast("int").alias("version"), F.regexp_extract("file", NAME, 2).alias("name"), F.regexp_extract("file", NAME, 3).alias("side"), "value")
    pairs = parts.groupBy("version", "name").agg(F.max(F.when(F.col("side") == "up", F.col("value"))).alias("up"), F.max(F.when(F.col("side") == "down", F.col("value"))).alias("down"))
    assert_unique(pairs, ["version"], "two migrations of one version")
    assert_empty(pairs.filter("up IS NULL OR down IS NULL"), "migration without its other half")
    return pairs.withColumn("checksum", F.sha2("up", 256)).orderBy("version")


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """What is left to apply; raises if an applied file has changed. ``applied``: version, checksum."""
    drift = files.select("version", "checksum").join(applied.select("version", F.col("checksum").alias("was")), "version").filter("checksum <> was")
    assert_empty(drift, "an applied migration has changed")
    return files.join(applied, "version", "left_anti").orderBy("version")


def current_version(applied: DataFrame) -> int:
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v


def is_migration_name(name: str) -> bool:
    return bool(re.search(r"^" + NAME, name))


__all__ = ["IntegrityError", "current_version", "is_migration_name", "load", "pending"]
