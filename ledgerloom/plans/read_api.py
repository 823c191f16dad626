"""The public reads. An ``Explorer`` is bound to one version of the store, so that all parts of an answer are of one snapshot.

Answers are DataFrames; a page comes with its cursor. Parameters are validated before a plan is built, and filters on keys
reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params
from ..functions.money import format_amount
from ..operators import accounting, addresses, chain, deployments, mempool, spend, transactions
from ..operators.rules import IntegrityError, assert_rules
from ..sources.store import Version, require_coverage


class NotFound(LookupError):
    pass


class Unavailable(RuntimeError):
    """Nothing of this kind has been published yet."""


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    #: What to pass for the next page; None behind the last one.
    cursor: tuple | None


BLOCK = ["hash", "height", "prev_hash AS previous_hash", "merkle_root", "time", "bits", "difficulty", "nonce", "size", "weight", "tx_count", "canonical"]


def both(name: str, sats: Column) -> list[Column]:
    return [sats.alias(f"{name}_sats"), format_amount(sats).alias(f"{name}_coins")]


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; absent values are left out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))


class Explorer:
    def __init__(self, version: Version):
        self.version, self.spark = version, version.spark

    def _t(self, name: str) -> DataFrame:
        if not self.version.has(name):
            raise Unavailable(name)
        return self.version.table(name)

    def _blocks(self) -> DataFrame:
        b = self._t("blocks")
        return b if "difficulty" in b.columns else b.withColumn("difficulty", F.lit(1.0))

    def _some(self, df: DataFrame, what: str) -> DataFrame:
        if not df.limit(1).count():
            raise NotFound(what)
        return df

    # ------------------------------------------------------------ chain

    def status(self) -> DataFrame:
        m = self.version.manifest
        return self.spark.createDataFrame([(m["indexed_height"], m["indexed_block_hash"])], "indexed_height long, indexed_block_hash string")

    def recent_blocks(self, n: int | None = None, before: int | None = None) -> Page:
        n = params.page_size(n)
        rows = addresses.keyset_page(self._blocks().filter("canonical"), ["height"], None if before is None else [before], n).selectExpr(*BLOCK)
        got = [r.height for r in rows.select("height").collect()]  # a page
        return Page(rows, (min(got),) if len(got) == n and min(got) > 0 else None)

    def block(self, identifier: str | int) -> DataFrame:
        """By height: canonical only. By hash: orphans too. With its transactions in order."""
        kind, value = ("height", identifier) if isinstance(identifier, int) else params.block_identifier(identifier)
        b = self._blocks()
        b = self._some(b.filter(F.col("canonical") & (F.col("height") == value)) if kind == "height" else b.filter(F.col("hash") == value), f"block {identifier}")
        txs = self._t("occurrences").join(F.broadcast(b.select(F.col("hash").alias("block_hash"))), "block_hash").groupBy("block_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("tx_index").alias("index"), "txid", "wtxid"))).alias("transactions"))
        return b.selectExpr(*BLOCK).join(txs, F.col("hash") == F.col("block_hash"), "left").drop("block_hash")

    def search(self, text: str) -> tuple[str, str | int]:
        """Height or block hash, then transaction or variant id, confirmed before unconfirmed; else an address."""
        if text.isdigit():
            return "block", params.height(text)
        if not params.is_hash(text):
            return "address", text
        places = [("block", "blocks", "hash"), ("transaction", "transactions", "txid"), ("variant", "occurrences", "wtxid"), ("mempool transaction", "mempool", "txid"), ("mempool variant", "mempool", "wtxid")]
        for kind, table, column in places:
            if self.version.has(table) and self._t(table).filter(F.col(column) == text).limit(1).count():
                return kind, text
        raise NotFound(text)

    # ------------------------------------------------------------ transactions

    def _state(self) -> DataFrame:
        if self.version.has("utxo_state"):
            return self._t("utxo_state")
        return spend.utxo_state(self._t("outputs"), self._t("inputs"), self._canon())

    def _canon(self) -> DataFrame:
        return spend.canonical_occurrences(self._t("occurrences"))

    def transaction(self, txid: str | None = None, wtxid: str | None = None, raw_witness: bool = False) -> DataFrame:
        """By txid: the variant of the best occurrence. By wtxid: that variant."""
        occ = self._t("occurrences")
        occ = self._some(occ.filter(F.col("txid") == txid) if wtxid is None else occ.join(occ.filter(F.col("wtxid") == wtxid).select("txid").distinct(), "txid", "left_semi"), txid or wtxid)
        best = F.broadcast(chain.best_occurrence(occ).select("txid", F.lit(wtxid).alias("wtxid") if wtxid else "wtxid"))
        key = F.broadcast(best.select("txid"))
        t, inputs, outputs, people = (self._t(n).join(key, "txid", "left_semi") for n in ("transactions", "inputs", "outputs", "participants"))
        witness = self._t("witness").join(best, ["txid", "wtxid"], "left_semi")
        variants = self._t("variants").join(best, ["txid", "wtxid"], "left_semi")
        state = self._state().join(key, "txid", "left_semi")
        fees = accounting.transaction_fees(t, inputs, self._t("outputs"), own=outputs)
        ins, outs = transactions.inputs_of(inputs, witness, raw_witness), transactions.outputs_of(outputs, people, state)
        return transactions.details(best, t, variants, fees, ins, outs, transactions.occurrences_of(occ))

    # ------------------------------------------------------------ addresses

    def _owners(self) -> DataFrame:
        return self._t("outputs").filter("address IS NOT NULL").select("txid", "vout_index", "address")

    def _addresses(self) -> DataFrame:
        return self._t("addresses") if self.version.has("addresses") else addresses.address_aggregates(self._owners(), self._state())

    def address_summary(self, address: str) -> DataFrame:
        """An unknown address has zeros; that is no error."""
        if not params.is_address(address):
            raise params.BadRequest(address)
        asked = self.spark.createDataFrame([(address,)], "address string")
        found = asked.join(self._addresses().filter(F.col("address") == address), "address", "left")
        n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return found.select("address", *both("balance", n("balance_satoshis")), *both("total_received", n("total_received_satoshis")), *both("total_sent", n("total_sent_satoshis")), n("tx_count").alias("tx_count"), "first_seen_height", "last_seen_height")

    def address_history(self, address: str, n: int | None = None, before_height: int | None = None, before_txid: str | None = None) -> Page:
        params.both_or_neither(before_height=before_height, before_txid=before_txid)
        n = params.page_size(n)
        t = addresses.touches(self._owners().filter(F.col("address") == address), self._t("inputs"), self._canon())
        rows = addresses.keyset_page(t, ["block_height", "txid"], None if before_txid is None else [before_height, before_txid], n).select("txid", "block_hash", "block_height")
        got = rows.collect()  # a page
        last = min(((r.block_height, r.txid) for r in got), default=None)
        return Page(rows, last if len(got) == n else None)

    def address_detail(self, address: str, n: int | None = None, before_height: int | None = None, before_txid: str | None = None) -> tuple[DataFrame, Page]:
        return self.address_summary(address), self.address_history(address, n, before_height, before_txid)

    def overview(self, n: int | None = None) -> tuple[DataFrame, Page]:
        return self.status(), self.recent_blocks(n)

    def rich_list(self) -> tuple[DataFrame, DataFrame]:
        return self.status(), addresses.rich_list(self._addresses())

    def distribution(self) -> DataFrame:
        """Refused unless it was derived at the indexed tip."""
        require_coverage(self.version, "distribution_anchor")
        return self._t("distribution")

    # ------------------------------------------------------------ supply

    def supply(self) -> DataFrame:
        """A point lookup by the tip's hash in the rollup, whose identities are checked again."""
        tip = self.version.manifest["indexed_block_hash"]
        require_coverage(self.version, "rollup_anchor")
        row = self._t("rollup").filter(F.col("block_hash") == tip)
        if tip is None or not row.limit(1).count():
            raise Unavailable("no rollup row for the tip")
        assert_rules(row, accounting.rollup_identities(row), "rollup identities")
        names = {"scheduled_subsidy": "subsidy", "transaction_fees": "fee", "coinbase_outputs": "coinbase_output", "unclaimed_reward": "unclaimed_reward", "utxo_set_value": "utxo_set_value"}
        cells = [c for name, part in names.items() for c in both(name, F.col(f"cumulative_{part}_satoshis"))]
        return row.select(F.col("height").alias("indexed_height"), F.col("block_hash").alias("indexed_block_hash"), *cells)

    # ------------------------------------------------------------ snapshots

    def _snapshot_state(self, name: str) -> DataFrame:
        m = self.version.manifest
        s = m.get(name) or {}
        row = (bool(s), s.get("generation", 0), s.get("height"), s.get("hash"), m["indexed_height"], m["indexed_block_hash"])
        df = self.spark.createDataFrame([row], "initialized boolean, generation long, tip_height long, tip_hash string, indexed_height long, indexed_block_hash string")
        return df.withColumn("state", mempool.freshness(F.col("initialized"), F.col("tip_height"), F.col("tip_hash"), F.col("indexed_height"), F.col("indexed_block_hash")))

    def mempool_state(self) -> DataFrame:
        one = F.lit(1).alias("_one")
        rows = mempool.totals(self._t("mempool")) if self.version.has("mempool") else self.spark.createDataFrame([(0, 0, 0)], "tx_count long, total_vsize long, total_fee_satoshis long")
        return self._snapshot_state("mempool_snapshot").select("*", one).join(rows.select("*", one), "_one").drop("_one")

    def mempool_page(self, n: int | None = None, cursor: tuple[int, int, str] | None = None) -> Page:
        n = params.page_size(n)
        generation = (self.version.manifest.get("mempool_snapshot") or {}).get("generation", 0)
        rows = mempool.page(self._t("mempool"), generation, n, cursor)
        got = rows.collect()  # a page
        last = min(((r.entry_time, r.txid) for r in got), default=None)
        return Page(rows, (generation, *last) if len(got) == n else None)

    def mempool_overview(self, n: int | None = None, cursor: tuple[int, int, str] | None = None) -> tuple[DataFrame, Page]:
        return self.mempool_state(), self.mempool_page(n, cursor)

    def mempool_transaction(self, txid: str | None = None, wtxid: str | None = None, raw_witness: bool = False) -> DataFrame:
        """With inputs and outputs, where the snapshot has bodies; what spends them isn't known."""
        m = self._t("mempool")
        row = self._some(m.filter(F.col("txid") == txid) if wtxid is None else m.filter(F.col("wtxid") == wtxid), txid or wtxid)
        edges = self._t("depends").join(F.broadcast(row.select("txid")), "txid", "left_semi").groupBy("txid").agg(F.array_sort(F.collect_list("depends_on_txid")).alias("depends"))
        out = row.join(edges, "txid", "left")
        if not self.version.has("mempool_inputs"):
            return out
        key = F.broadcast(row.select("txid"))
        inputs, witness, outputs, people = (self._t(f"mempool_{n}").join(key, "txid", "left_semi") for n in ("inputs", "witness", "outputs", "participants"))
        return out.join(transactions.inputs_of(inputs, witness, raw_witness), "txid").join(transactions.outputs_of(outputs, people, None), "txid")

    def deployments(self) -> tuple[DataFrame, DataFrame]:
        state = self._snapshot_state("deployment_snapshot")
        if not self.version.has("deployments"):
            raise Unavailable("deployments")
        return state, deployments.read_stored(self._t("deployments"), self.version.manifest["deployment_snapshot"]["count"])

    def deployment(self, name: str) -> DataFrame:
        if not params.is_name(name):
            raise params.BadRequest(name)
        return self._some(self.deployments()[1].filter(F.col("name") == name), name)

    # ------------------------------------------------------------ getters; no row means none

    def canonical_block_hash(self, height: int) -> str | None:
        r = self._blocks().filter(F.col("canonical") & (F.col("height") == height)).select("hash").first()
        return r and r.hash

    def utxo(self, txid: str, vout_index: int) -> DataFrame:
        return self._state().filter((F.col("txid") == txid) & (F.col("vout_index") == vout_index))

    def block_accounting(self, block_hash: str) -> DataFrame:
        return self._t("accounting").filter(F.col("block_hash") == block_hash)

    def block_rollup(self, block_hash: str) -> DataFrame:
        return self._t("rollup").filter(F.col("block_hash") == block_hash)


__all__ = ["Explorer", "IntegrityError", "NotFound", "Page", "Unavailable", "to_json"]
