"""Following a node: the confirmed chain, the unconfirmed transactions and the deployments.

Node and index are never of one snapshot. Each pass notes both tips first and looks at them again before it publishes; if one
moved, nothing is published and ``Moved`` is raised, which is no fault: the next pass begins anew. ``options``: url, user,
password, and fetchers, the number of tasks that ask the node at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import SimpleNamespace

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import classify
from ..functions.subsidy import Schedule
from ..operators import mempool
from ..operators.decode import decode_blocks, transaction_bodies, transaction_ok
from ..operators.deployments import decode_deployments
from ..operators.rules import assert_rules
from ..schemas import MEMPOOL_ENTRY, TRANSACTION
from ..sources.node import NodeSource, Number, Rpc, RpcError, Unauthorized, check_startup, dumps, parse_blocks
from ..sources.store import Store, Version
from .apply import MAX_REORG, NotSequential, apply_blocks, from_decoded, reconcile, replace_snapshot, transaction_tables


class Moved(RuntimeError):
    """The node's chain, its transactions or the index changed during a pass."""


class Behind(RuntimeError):
    """The index isn't at the node's tip, so that a snapshot would have no anchor."""


def answers(keys: DataFrame, name: str, options: dict, ask: Callable[[Rpc, str], str]) -> DataFrame:
    """``keys``: one text column -> that column and ``name``, what the node says to each; null where it refuses. Asked by
    the executors, each key once."""
    (key,) = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rpc = Rpc.of(options)
        for batch in batches:
            said = []
            for k in batch.column(0).to_pylist():
                try:
                    said.append(ask(rpc, k))
                except Unauthorized:
                    raise
                except RpcError:
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=[key, name])

    spread = keys.distinct().repartition(int(options.get("fetchers", 8)), key)
    return spread.mapInArrow(run, f"{key} string, {name} string")


def key_address(rpc: Rpc, key: str) -> str:
    return rpc("deriveaddresses", rpc("getdescriptorinfo", f"pkh({key})")["descriptor"])[0]


def resolver(store: Store, tx: DataFrame, options: dict) -> DataFrame:
    """The addresses of all keys in the scripts of transactions (a column ``t``)."""
    scripts = tx.select(F.explode("t.vout").alias("o")).select(F.unhex("o.scriptPubKey.hex").alias("script_pubkey")).distinct()
    keys = classify(scripts).filter("pubkeys IS NOT NULL").select(F.explode("pubkeys").alias("k"))
    return store.stage("resolver", answers(keys.select(F.lower(F.hex("k")).alias("pubkey_hex")), "address", options, key_address))


def index_tip(store: Store) -> tuple[int, str | None]:
    m = store.current().manifest
    return m["indexed_height"], m["indexed_block_hash"]


@contextmanager
def anchored(store: Store, rpc: Rpc):
    """The tip that node and index agree on, looked at again when the block ends."""
    tip = rpc.tip()
    if index_tip(store) != tip:
        raise Behind(f"the index is at {index_tip(store)}, the node at {tip}")
    yield tip
    if rpc.tip() != tip or index_tip(store) != tip:
        raise Moved(f"no longer at {tip}")


def refresh_mempool(store: Store, options: dict) -> Version:
    """A new snapshot of all unconfirmed transactions with their bodies; on any failure the old one stays."""
    spark, rpc = store.spark, Rpc.of(options)
    with anchored(store, rpc) as (height, hash_):
        listed = json.loads(rpc.raw("getrawmempool", True), parse_float=Number, parse_int=Number)
        entries = spark.createDataFrame([(k, dumps(v)) for k, v in listed.items()], "txid string, entry string")
        listing = store.stage("listing", entries.withColumn("entry", F.from_json("entry", MEMPOOL_ENTRY)))
        texts = answers(listing.select("txid"), "raw", options, lambda r, k: r.raw("getrawtransaction", k, True))
        got = store.stage("fetched", texts.withColumn("t", F.from_json("raw", TRANSACTION)))
        if got.filter("raw IS NULL OR t.blockhash IS NOT NULL").limit(1).count():
            raise Moved("a transaction left the mempool while it was fetched")
        assert_rules(got, {"the one asked for": F.col("t.txid") == F.col("txid"), "each transaction": transaction_ok(F.col("t"))}, "mempool")
        bodies = SimpleNamespace(**transaction_bodies(got.select("t"), resolver(store, got, options)))
        full = bodies.transactions.join(bodies.variants, "txid")
        rows = mempool.checked_snapshot(store.stage("candidates", mempool.candidates(listing, full)))
        children = {f"mempool_{n}": df for n, df in transaction_tables(bodies).items() if n in ("inputs", "witness", "outputs", "participants")}
        tables = {"mempool": rows.drop("depends"), "depends": mempool.dependencies(rows), **children}
        tables = {n: store.stage(n, df) for n, df in tables.items()}
    return replace_snapshot(store, tables, "mempool_snapshot", height, hash_)


def refresh_deployments(store: Store, options: dict) -> Version:
    """A new snapshot of the deployments as of the tip, by its hash."""
    rpc = Rpc.of(options)
    with anchored(store, rpc) as (height, hash_):
        observed = int(time.time())
        info = json.loads(rpc.raw("getdeploymentinfo", hash_), parse_float=Number, parse_int=Number)
        if (int(info["height"]), info["hash"]) != (height, hash_):
            raise Moved(f"asked for {hash_}, told of {info['hash']}")
        rows = store.spark.createDataFrame([(k, dumps(v)) for k, v in info["deployments"].items()], "name string, raw string")
        at = [F.lit(observed).alias(c) for c in ("checked_at", "observed_at")]
        table = store.stage("deployments", decode_deployments(rows).select("name", "status", "since", "raw", *at))
    return replace_snapshot(store, {"deployments": table}, "deployment_snapshot", height, hash_, count=table.count())


def chain_moved(rpc: Rpc, height: int, hash_: str | None) -> bool:
    """Whether the node has another block at a height than it had, or none. Judged by heights, not by what an error says."""
    if height < 0:
        return False
    return rpc.tip()[0] < height or rpc("getblockhash", height) != hash_


def back_to_common(store: Store, rpc: Rpc, schedule: Schedule) -> Version:
    """Roll back to the last block that the node has too; at most ``MAX_REORG`` heights are asked for."""
    height, hash_ = index_tip(store)
    if not chain_moved(rpc, height, hash_):
        return store.current()
    last = min(height, rpc.tip()[0])
    remote = [(k, rpc("getblockhash", k)) for k in range(max(0, height - MAX_REORG), last + 1)]
    return reconcile(store, store.spark.createDataFrame(remote, "height long, hash string"), schedule)


def extend(store: Store, options: dict, schedule: Schedule, network: str, first: int, last: int) -> Version:
    """Fetch, decode and apply a range of heights."""
    spark = store.spark
    spark.dataSource.register(NodeSource)
    wire = {k: str(v) for k, v in options.items()} | {"from": str(first), "to": str(last)}
    raw = store.stage("fetched", spark.read.format(NodeSource.name()).options(**wire).load())
    parsed = store.stage("parsed", parse_blocks(raw))
    keys = resolver(store, parsed.select(F.explode("tx").alias("t")), options)
    return apply_blocks(store, from_decoded(decode_blocks(parsed, keys)), schedule, network)


def follow(store: Store, options: dict, schedule: Schedule, network: str, batch: int = 1000, passes: int = 1_000_000) -> Version:
    """Until node and index have one tip: go back to the common block, then apply what follows, ``batch`` heights at a time.

    A failed step is tried again if the node's chain or the index moved under it, and raised otherwise."""
    rpc = Rpc.of(options)
    check_startup(rpc.status(), network)
    for _ in range(passes):
        try:
            back_to_common(store, rpc, schedule)
        except RpcError:
            if rpc.tip()[0] >= index_tip(store)[0]:
                raise
            continue
        at, top = index_tip(store), rpc.tip()
        if at == top:
            return store.current()
        if top[0] <= at[0]:
            continue
        last = min(top[0], at[0] + batch)
        try:
            extend(store, options, schedule, network, at[0] + 1, last)
        except (NotSequential, RpcError, PySparkException):
            if not (chain_moved(rpc, *top) or chain_moved(rpc, *at) or index_tip(store) != at):
                raise
    raise Moved(f"not at the node's tip after {passes} passes")
