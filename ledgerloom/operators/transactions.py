"""Transactions in full: a row each, with ordered inputs, outputs and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_amount
from ..functions.scripts import classify

KEY = ["txid", "vout_index"]


def ordered(*fields):
    """Rows of a group as an array, ordered by the first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def classified(outputs: DataFrame) -> DataFrame:
    """Outputs with script type, witness version and program, stored or derived."""
    return outputs if "script_type" in outputs.columns else classify(outputs).drop("unspendable", "pubkeys")


def inputs_of(inputs: DataFrame, witness: DataFrame, raw_witness: bool = False) -> DataFrame:
    """txid, inputs. ``witness``: the items of one variant a transaction; their bytes only if asked for."""
    data = ["data_hex"] if raw_witness else []
    size = F.expr("int(length(data_hex) div 2)").alias("size_bytes")
    stacks = witness.groupBy("txid", "vin_index").agg(ordered("item_index", size, *data).alias("witness"))
    fields = ("vin_index", "coinbase_hex", "prev_txid", "prev_vout_index", "script_sig_hex", "sequence", "witness")
    return inputs.join(stacks, ["txid", "vin_index"], "left").groupBy("txid").agg(ordered(*fields).alias("inputs"))


def outputs_of(outputs: DataFrame, participants: DataFrame, state: DataFrame | None) -> DataFrame:
    """txid, outputs. Without a state (unconfirmed) nothing is said about spending."""
    people = participants.groupBy(*KEY).agg(F.array_sort(F.collect_set("address")).alias("participants"))
    owned = classified(outputs)
    rows = owned.withColumn("spent", F.lit(None).cast("boolean")) if state is None else owned.join(state.select(*KEY, "spent"), KEY, "left")
    value = F.col("value_satoshis")
    hexed = lambda c: F.lower(F.hex(c))
    fields = (
        "vout_index", value.alias("value_sats"), format_amount(value).alias("value_coins"), hexed("script_pubkey").alias("script_pubkey_hex"),
        "script_type", "witness_version", hexed("witness_program").alias("witness_program"), "address", "participants", "spent",
    )
    return rows.join(people, KEY, "left").groupBy("txid").agg(ordered(*fields).alias("outputs"))


def occurrences_of(occ: DataFrame) -> DataFrame:
    """txid, occurrences: canonical before others, then the highest first."""
    return occ.groupBy("txid").agg(F.reverse(ordered("canonical", "block_height", "block_hash", "tx_index", "wtxid")).alias("occurrences"))


def details(best: DataFrame, transactions: DataFrame, variants: DataFrame, fees: DataFrame, inputs: DataFrame, outputs: DataFrame, occ: DataFrame) -> DataFrame:
    """``best``: txid, wtxid, the variant to show; the others as the functions above return them."""
    t = transactions.select("txid", "version", "locktime", "is_coinbase").join(best, "txid").join(variants, ["txid", "wtxid"])
    out = t.join(fees, "txid", "left").join(inputs, "txid").join(outputs, "txid").join(occ, "txid")
    fee = F.col("fee_satoshis")
    return out.select(*t.columns, fee.alias("fee_sats"), format_amount(fee).alias("fee_coins"), "inputs", "outputs", "occurrences")
