"""Ingestion: batches of blocks in, a new version out. State is derived, so that a reorganisation is a change of the canonical
set, replay changes nothing, and any order of applies and rollbacks ends where a derivation from scratch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import genesis_hash
from ..functions.subsidy import Schedule
from ..operators import accounting, addresses, chain, distribution, spend
from ..operators.rules import IntegrityError, assert_empty, assert_unique, contradictions, insert_or_verify
from ..sources.store import Store, Version

BODIES = {
    "blocks": ["hash"],
    "transactions": ["txid"],
    "variants": ["wtxid"],
    "occurrences": ["block_hash", "tx_index"],
    "inputs": ["txid", "vin_index"],
    "witness": ["wtxid", "vin_index", "item_index"],
    "outputs": ["txid", "vout_index"],
    "participants": ["txid", "vout_index", "address"],
}
MAX_REORG = 100


class NotSequential(RuntimeError):
    """A batch does not continue the canonical tip."""


class DeepReorg(RuntimeError):
    """No common ancestor within the allowed depth."""


def derive(store: Store, bodies: dict[str, DataFrame], schedule: Schedule, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything that follows from bodies and the canonical set, behind the gates. Each table is staged once, and what
    follows from it starts there. ``stored``: the rollup so far; a block's row depends on its ancestors alone, so that a
    reorganisation changes none, and one that differs is refused. The rollup has rows for orphans too."""
    blocks, inputs, outputs = bodies["blocks"], bodies["inputs"], bodies["outputs"]
    occ = store.stage("occurrences", chain.occurrences(bodies["occurrences"], blocks))
    canon = spend.canonical_occurrences(occ)
    assert_empty(spend.missing_prevouts(outputs, inputs, canon), "missing prevout")
    assert_empty(spend.double_spends(inputs, canon), "double spend")
    state = store.stage("utxo_state", spend.utxo_state(outputs, inputs, canon))
    owners = outputs.filter("address IS NOT NULL").select("txid", "vout_index", "address")
    agg = store.stage("addresses", addresses.address_aggregates(owners, state))
    acc = store.stage("accounting", accounting.block_accounting(blocks, occ, bodies["transactions"], inputs, outputs, schedule))
    acc_rows = accounting.checked_accounting(acc)
    excluded = store.stage("excluded", accounting.excluded_outputs(blocks, occ, outputs))
    rollup = store.stage("rollup", accounting.supply_rollup(acc_rows, excluded))
    accounting.check_rollup(blocks, acc_rows, rollup, state)
    if blocks.filter("NOT canonical").limit(1).count():
        branches = accounting.branch_rollup(blocks, acc_rows, excluded, rollup, MAX_REORG)
        rollup = store.stage("rollup", rollup.unionByName(branches))
    if stored is not None:
        assert_empty(contradictions(stored.select(*rollup.columns), rollup, ["block_hash"]), "rollup contradiction")
    return {"occurrences": occ, "utxo_state": state, "addresses": agg, "accounting": acc, "rollup": rollup, "distribution": distribution.checked_distribution(agg)}


def _tip(blocks: DataFrame) -> tuple[int, str | None]:
    r = blocks.filter("canonical").agg(F.max("height").alias("h"), F.max_by("hash", "height").alias("x")).first()
    return (-1, None) if r.h is None else (r.h, r.x)


def stored_rollup(version: Version) -> DataFrame | None:
    return version.table("rollup") if version.has("rollup") else None


def _publish(store: Store, bodies: dict[str, DataFrame], schedule: Schedule, version: Version) -> Version:
    bodies = {name: df if hasattr(df, "_staged") else store.stage(name, df) for name, df in bodies.items()}
    height, hash_ = _tip(bodies["blocks"])
    tables = {**bodies, **derive(store, bodies, schedule, stored_rollup(version))}
    return store.publish(tables, indexed_height=height, indexed_block_hash=hash_, rollup_anchor=hash_, distribution_anchor=hash_)


def check_continues(batch: DataFrame, version: Version) -> None:
    """New blocks follow the tip without a gap, each linked to its parent; replayed ones are already canonical."""
    tip = version.manifest["indexed_height"]
    r = batch.agg(F.min("height").alias("a"), F.max("height").alias("b"), F.count("*").alias("n")).first()
    if r.n == 0:
        return
    if r.b - r.a + 1 != r.n or (version.generation and r.a > tip + 1):
        raise NotSequential(f"heights {r.a} to {r.b} ({r.n} blocks) do not continue {tip}")
    known = version.table("blocks").filter("canonical").select("height", "hash") if version.has("blocks") else batch.sparkSession.createDataFrame([], "height long, hash string")
    other = batch.join(known.withColumnRenamed("hash", "stored"), "height").filter("hash <> stored")
    if other.limit(1).count():
        raise NotSequential("a height of the batch is taken by another canonical block")
    joined = chain.ancestry_breaches(batch.select("height", "hash", "prev_hash").withColumn("canonical", F.lit(True)).unionByName(known.filter(F.col("height") == r.a - 1).select("height", "hash", F.lit(None).cast("string").alias("prev_hash"), F.lit(True).alias("canonical"))))
    breach = joined.filter(F.col("height") >= max(r.a, 1 if r.a == 0 else r.a)).limit(1).collect()
    if breach and not (version.generation == 0 and breach[0].height == r.a):
        raise NotSequential(f"block {breach[0].hash} is not linked to its parent")


def apply_blocks(store: Store, batch: dict[str, DataFrame], schedule: Schedule, network: str | None = None) -> Version:
    """Insert what is new, verify what is not, make the batch canonical, and publish."""
    with store.writing():
        version = store.current()
        batch = {name: store.stage(name, batch[name]) for name in BODIES}
        check_continues(batch["blocks"], version)
        if network is not None:
            first = batch["blocks"].filter("height = 0").select("hash").first()
            if first and first.hash != genesis_hash(network):
                raise IntegrityError(f"genesis {first.hash} is not that of {network}")
        bodies = {}
        for name, keys in BODIES.items():
            new = batch[name].drop("canonical") if name == "blocks" else batch[name]
            if name == "occurrences":
                new = new.drop("canonical")
            if not version.has(name):
                assert_unique(new, keys, f"{name}: repeated key")
                bodies[name] = new.withColumn("canonical", F.lit(True)) if name == "blocks" else new
                continue
            old = version.table(name)
            if name == "occurrences":
                old = old.drop("canonical")
            fresh = insert_or_verify(old, new, keys, name)
            if name == "blocks":  # an orphan that comes again is canonical again
                old = chain.with_canonical(old, new, canonical=True)
                fresh = fresh.withColumn("canonical", F.lit(True))
            bodies[name] = old.unionByName(fresh, allowMissingColumns=True)
        return _publish(store, bodies, schedule, version)


def rollback_to(store: Store, height: int, schedule: Schedule) -> Version:
    """Blocks above a height become orphans; nothing is deleted from the bodies."""
    with store.writing():
        version = store.current()
        if version.manifest["indexed_height"] - height > MAX_REORG:
            raise DeepReorg(f"{version.manifest['indexed_height'] - height} blocks")
        bodies = {n: version.table(n) for n in BODIES}
        bodies["blocks"] = chain.with_canonical(bodies["blocks"], chain.orphaned_by(bodies["blocks"], height), canonical=False)
        return _publish(store, bodies, schedule, version)


def reconcile(store: Store, remote: DataFrame, schedule: Schedule) -> Version:
    """Roll back to the last block that the remote chain (height, hash) has too, if that isn't the tip."""
    version = store.current()
    if not version.has("blocks"):
        return version
    tip, hash_ = version.manifest["indexed_height"], version.manifest["indexed_block_hash"]
    if hash_ is None or remote.filter((F.col("height") == tip) & (F.col("hash") == hash_)).limit(1).count():
        return version
    ancestor = chain.common_ancestor(version.table("blocks").filter(F.col("height") >= tip - MAX_REORG), remote).first()
    if ancestor.ancestor_height is None:
        raise DeepReorg(f"no common block within {MAX_REORG} of the tip")
    return rollback_to(store, ancestor.ancestor_height, schedule)


def replace_snapshot(store: Store, tables: dict[str, DataFrame], name: str, height: int, hash_: str, **more) -> Version:
    """A full-replacement snapshot, taken at a tip; its generation grows by one."""
    with store.writing(name):
        before = store.current().manifest.get(name) or {}
        return store.publish(tables, **{name: {"generation": before.get("generation", 0) + 1, "height": height, "hash": hash_, **more}})


def stream_blocks(spark: SparkSession, raw: DataFrame, store: Store, decode, schedule: Schedule, checkpoint: str):
    """``raw``: a streaming DataFrame of block documents; ``decode``: rows -> bodies by name. Exactly once by the manifest: a
    batch that is replayed after a failure is verified against what is stored and changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            apply_blocks(store, decode(batch), schedule)

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transaction_tables(bodies) -> dict[str, DataFrame]:
    """Decoded bodies of transactions in the shape of the stored ones: owners beside outputs, bytes as hex where reads want
    text."""
    hexed = lambda c: F.lower(F.hex(c))
    return {
        "transactions": bodies.transactions,
        "variants": bodies.variants,
        "inputs": bodies.inputs.select("txid", "vin_index", "prev_txid", "prev_vout_index", hexed("coinbase").alias("coinbase_hex"), hexed("script_sig").alias("script_sig_hex"), "sequence"),
        "witness": bodies.witness.select("wtxid", "txid", "vin_index", "item_index", hexed("data").alias("data_hex")),
        "outputs": bodies.outputs.select("txid", "vout_index", "value_satoshis", "script_pubkey", "address", "script_type", "witness_version", "witness_program"),
        "participants": bodies.participants.select("txid", "vout_index", "address", hexed("pubkey").alias("pubkey_hex")),
    }


def from_decoded(bodies) -> dict[str, DataFrame]:
    return {"blocks": bodies.blocks, "occurrences": bodies.occurrences, **transaction_tables(bodies)}
