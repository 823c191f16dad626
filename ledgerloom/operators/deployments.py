"""Consensus deployments: strict decoding of a map of JSON documents, and consistency of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEPLOYMENT
from .rules import IntegrityError, assert_rules

# The states of a bip9 deployment, its highest bit, and the longest name.
BIP9_STATUS = ("defined", "started", "locked_in", "active", "failed")
MAX_BIT = 28
MAX_NAME = 128
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parsed(rows: DataFrame) -> DataFrame:
    """``rows``: name, raw (JSON text)."""
    return rows.withColumn("d", F.from_json("raw", DEPLOYMENT, PERMISSIVE))


def rules() -> dict[str, Column]:
    d, b = F.col("d"), F.col("d.bip9")
    s = b["statistics"]
    absent = s.isNull()
    bip9 = d["type"] == "bip9"
    return {
        "name": F.length("name").between(1, MAX_NAME),
        "well-formed": d["_corrupt_record"].isNull(),
        "type": d["type"].isin("bip9", "buried"),
        "active": d["active"].isNotNull(),
        "buried has a height": bip9 | (d["height"] >= 0),
        "bip9 part": ~bip9 | b.isNotNull(),
        "status": ~bip9 | b["status"].isin(*BIP9_STATUS),
        "next status": ~bip9 | b["status_next"].isin(*BIP9_STATUS),
        "since": ~bip9 | (b["since"] >= 0),
        "times": ~bip9 | (b["start_time"].isNotNull() & b["timeout"].isNotNull() & (b["min_activation_height"] >= 0)),
        "bit": b["bit"].isNull() | b["bit"].between(0, MAX_BIT),
        "statistics": absent | ((s["period"] > 0) & s["elapsed"].between(0, s["period"]) & s["count"].between(0, s["elapsed"])),
        "threshold": absent | s["threshold"].isNull() | ((s["threshold"] > 0) & (s["threshold"] <= s["period"])),
        "signalling": b["signalling"].isNull() | b["signalling"].rlike(r"\A[#-]*\z"),
    }


def decode_deployments(rows: DataFrame) -> DataFrame:
    """The bip9 deployments; buried ones are validated and dropped."""
    ok = assert_rules(parsed(rows), rules(), "deployment")
    return flattened(ok.filter("d.type = 'bip9'"))


def flattened(df: DataFrame) -> DataFrame:
    b = F.col("d.bip9")
    return df.select(
        "name", F.col("d.type").alias("type"), F.col("d.active").alias("active"), F.col("d.height").alias("activation_height"), b["status"].alias("status"), b["status_next"].alias("status_next"), b["since"].alias("since"), b["bit"].alias("bit"),
        b["start_time"].alias("start_time"), b["timeout"].alias("timeout"), b["min_activation_height"].alias("min_activation_height"), b["statistics"].alias("statistics"), b["signalling"].alias("signalling"), "raw",
    )


def stored_rules() -> dict[str, Column]:
    """What a stored row must satisfy on read: its columns are those of its document."""
    return {
        **rules(),
        "status column": F.col("status").eqNullSafe(F.col("d.bip9.status")),
        "since column": F.col("since").eqNullSafe(F.col("d.bip9.since")),
        "checked when observed": F.col("checked_at").eqNullSafe(F.col("observed_at")),
    }


def read_stored(rows: DataFrame, expected_count: int) -> DataFrame:
    """``rows``: name, status, since, raw, checked_at, observed_at."""
    df = assert_rules(parsed(rows), stored_rules(), "stored deployment")
    n = df.count()
    if n != expected_count:
        raise IntegrityError(f"{n} deployments are stored; the manifest says {expected_count}")
    return flattened(df).join(df.select("name", "checked_at"), "name").orderBy("name")
