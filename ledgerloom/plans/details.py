"""Every transaction in full, slice by slice, so that only one slice at a time is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, chain, spend, transactions
from ..sources.store import Store
from . import documents
from .documents import cut, slot_of
from .projection import Ledger


def _bytes(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.unhex(c) for c in ids})


def _texts(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ids})


def detail_rows(g: Ledger, store: Store, shown) -> DataFrame:
    """``shown`` of ``transactions.details``, all of them. Three rounds over slices of the txids: who spends what, and whether
    in the canonical chain; what those spends are worth; the details. Ids are kept as bytes in between."""
    n = 1 + g.outputs.count() // documents.SLICE

    def spends_by(own: Ledger) -> DataFrame:
        spends = own.inputs.filter("prev_txid IS NOT NULL").select("txid", "vin_index", "prev_txid", "prev_vout_index", slot_of("prev_txid", n).alias("slot"))
        at = own.canon.select("txid", F.col("height").alias("spending_height"))
        return _bytes(spends.join(at, "txid", "left"), "txid", "prev_txid")

    spends = store.stage("spends", (spends_by(cut(g, k, n)) for k in range(n)), by=("slot",))
    of_slot = lambda df, k: df.filter(F.col("slot") == k).drop("slot")

    def values(k: int) -> DataFrame:
        own = _bytes(cut(g, k, n).outputs, "txid")
        found = accounting.spent_values(of_slot(spends, k).dropDuplicates(["txid", "vin_index"]), own)
        return found.withColumn("slot", slot_of(F.lower(F.hex("txid")), n))

    spent = store.stage("values", (values(k) for k in range(n)), by=("slot",))

    def details():
        for k in range(n):
            own = cut(g, k, n)
            mine = of_slot(spends, k).filter("spending_height IS NOT NULL")
            mine = mine.select(F.col("prev_txid").alias("txid"), F.col("prev_vout_index").alias("vout_index"), F.col("txid").alias("spending_txid"))
            state = spend.state_of(own.outputs, _texts(mine, "txid"), own.canon)
            fees = accounting.fees_of(own.transactions, _texts(of_slot(spent, k), "txid"), own.outputs)
            best = chain.best_occurrence(own.occurrences).select("txid", "wtxid")
            ins, outs = transactions.inputs_of(own.inputs, own.witness), transactions.outputs_of(own.outputs, own.participants, state)
            yield shown(transactions.details(best, own.transactions, own.variants, fees, ins, outs, transactions.occurrences_of(own.occurrences)))
            for used in (spends, spent):
                store.unstage(used, f"slot={k}")

    out = store.stage("details", details())
    for used in (spends, spent):
        store.unstage(used)
    return out
