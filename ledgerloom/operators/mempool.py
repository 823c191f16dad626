"""Unconfirmed transactions: a full-replacement snapshot with generation, totals, pages and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_amount
from .addresses import keyset_page
from .rules import assert_empty, assert_rules, assert_unique


class GenerationChanged(RuntimeError):
    """A cursor belongs to an older snapshot."""


def candidates(listing: DataFrame, transactions: DataFrame) -> DataFrame:
    """``listing``: txid, entry (the wire schema). ``transactions``: the bodies fetched for it. The virtual size isn't compared."""
    e = F.col("entry")
    rows = listing.select(
        "txid", parse_amount(e["fees"]["base"]).alias("fee_satoshis"), e["time"].alias("entry_time"), e["height"].alias("entry_height"), e["bip125-replaceable"].alias("replaceable"), F.coalesce(e["depends"], F.array().cast("array<string>")).alias("depends"), e["weight"].alias("listed_weight")
    ).join(transactions, "txid", "left")
    rules = {
        "fetched": F.col("wtxid").isNotNull(),
        "fee": F.col("fee_satoshis").isNotNull(),
        "entry time": F.col("entry_time") >= 0,
        "weight": F.col("listed_weight").isNull() | (F.col("listed_weight") == F.col("weight")),
        "no coinbase": ~F.col("is_coinbase"),
        "no self-dependency": ~F.array_contains("depends", F.col("txid")),
    }
    return assert_rules(rows, rules, "mempool").drop("listed_weight", "is_coinbase")


def dependencies(rows: DataFrame) -> DataFrame:
    return rows.select("txid", F.explode("depends").alias("depends_on_txid")).distinct()


def checked_snapshot(rows: DataFrame) -> DataFrame:
    """Unique ids, and dependencies inside of the snapshot only."""
    assert_unique(rows, ["txid"], "mempool txid")
    assert_unique(rows, ["wtxid"], "mempool wtxid")
    assert_empty(outside_dependencies(rows, dependencies(rows)), "mempool dependency outside of the snapshot")
    return rows


def outside_dependencies(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(rows.select(F.col("txid").alias("depends_on_txid")), "depends_on_txid", "left_anti").select("txid", "depends_on_txid")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("tx_count"), F.coalesce(F.sum("vsize"), F.lit(0)).alias("total_vsize"), F.coalesce(F.sum("fee_satoshis"), F.lit(0)).alias("total_fee_satoshis"))


def page(rows: DataFrame, generation: int, n: int, cursor: tuple[int, int, str] | None = None) -> DataFrame:
    """Newest first; ``cursor``: (generation, entry_time, txid) of the last row seen."""
    if cursor is not None and cursor[0] != generation:
        raise GenerationChanged(f"the cursor is of generation {cursor[0]}, the snapshot of {generation}")
    return keyset_page(rows, ["entry_time", "txid"], None if cursor is None else list(cursor[1:]), n)


def freshness(initialized: Column, height: Column, hash_: Column, tip_height: Column, tip_hash: Column) -> Column:
    """uninitialized, fresh (taken at the indexed tip) or stale."""
    same = height.eqNullSafe(tip_height) & hash_.eqNullSafe(tip_hash)
    return F.when(~F.coalesce(initialized, F.lit(False)), "uninitialized").when(same, "fresh").otherwise("stale")
