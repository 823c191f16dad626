"""Labels and times for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genesis block hashes by network; signet has no stable one.
GENESIS: dict[str, str | None] = {
    "main": "78cf9e38dad7e61400f3a3e4e987efa7c90c09f69d9be7ce95e504bfa447aadc",
    "test": "8e7f8c6096865a08773b52fd776a0e283d9037ff2b50b20a04f6a0feb01c68d9",
    "regtest": "7a69b7bb0c8f5ced03c9e64b770c30b52582d072cbe506339b8d5331b014d727",
    "signet": None,
}


def genesis_hash(network: str) -> str:
    found = GENESIS.get(network)
    if found is None:
        raise ValueError(f"no genesis hash is known for network {network!r}")
    return found


def utc_time(seconds: Column) -> Column:
    """Unix seconds as UTC text, whatever the session's zone: from the epoch's own date arithmetic."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd HH:mm:ss 'UTC'")


def spent_label(spent: Column) -> Column:
    return F.when(spent.isNull(), "not tracked").when(spent, "spent").otherwise("unspent")


def yes_no(flag: Column) -> Column:
    return F.when(flag.isNull(), "unknown").when(flag, "yes").otherwise("no")


def height_label(height: Column) -> Column:
    return F.coalesce(height.cast("string"), F.lit("never"))


def prevout_kind(depends: Column, prev_txid: Column) -> Column:
    """Whether an input of an unconfirmed transaction spends another unconfirmed one."""
    return F.when(F.coalesce(F.array_contains(depends, prev_txid), F.lit(False)), "mempool").otherwise("confirmed")
