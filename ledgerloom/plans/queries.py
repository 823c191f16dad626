"""One query for each operator, over the projected ledger. Each has an independent SQL text in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import bucket_of
from ..functions.display import prevout_kind, spent_label, utc_time, yes_no
from ..functions.money import format_amount, is_amount, parse_amount, whole_coins
from ..functions.scripts import classify, is_unspendable, witness_metadata_ok
from ..functions.subsidy import schedule_for
from ..operators import accounting, addresses, chain, deployments, distribution, mempool, spend
from ..sources.store import Store, shared_dir
from . import projection as P
from .details import detail_rows
from .documents import decoded
from .projection import Ledger, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MAIN = schedule_for("main")


def over_ledger(f: Callable[[Ledger], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ledger(spark, sf_dir))
    return f


def over_tables(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _state(g: Ledger) -> DataFrame:
    return spend.utxo_state(g.outputs, g.inputs, g.canon)


def _addresses(g: Ledger) -> DataFrame:
    return addresses.address_aggregates(g.owners, _state(g))


def _accounting(g: Ledger) -> DataFrame:
    return accounting.block_accounting(g.blocks, g.occurrences, g.transactions, g.inputs, g.outputs, MAIN)


def _rollup(g: Ledger) -> DataFrame:
    return accounting.supply_rollup(_accounting(g), accounting.excluded_outputs(g.blocks, g.occurrences, g.outputs))


@over_ledger
def rich_list(g):
    return addresses.rich_list(_addresses(g))


@over_ledger
def address_aggregates(g):
    return _addresses(g)


@over_ledger
def utxo_set(g):
    return spend.unspent(_state(g))


@over_ledger
def utxo_state(g):
    return _state(g)


@over_ledger
def missing_prevouts(g):
    """Of the ledger with every tenth output taken away: what then has no valid prevout."""
    fewer = g.outputs.filter("(value_satoshis % 10) <> 3")
    return spend.missing_prevouts(fewer, g.inputs, g.canon)


@over_ledger
def double_spends(g):
    """Of the ledger in which coinbase inputs spend again what sweeps of the same height spend first."""
    again = g.inputs.filter("vin_index = 0 AND sequence = 4294967293").withColumn("txid", F.sha2(F.concat(F.lit("again"), "txid"), 256))
    at = g.canon.withColumn("txid", F.sha2(F.concat(F.lit("again"), "txid"), 256))
    return spend.double_spends(g.inputs.unionByName(again), g.canon.unionByName(at))


@over_ledger
def dangling_spends(g):
    return spend.dangling_spends(_state(g), g.inputs.filter("vin_index <> 1"))


@over_ledger
def tx_outputs_detail(g):
    d = spend.tx_outputs_detail(g.outputs, g.owners, _state(g))
    return d.select("txid", "vout_index", F.col("value_satoshis").alias("value_sats"), format_amount(F.col("value_satoshis")).alias("value_coins"), F.col("script_hex").alias("script_pubkey_hex"), "address", "spent", spent_label(F.col("spent")).alias("spent_label"))


@over_ledger
def tx_inputs_witness(g):
    """Inputs with their witness stacks as ordered lists; an empty item stays."""
    items = F.array_sort(F.collect_list(F.struct("item_index", "data_hex")))
    stacks = g.witness.groupBy("txid", "vin_index").agg(items.alias("w"))
    out = g.inputs.join(stacks, ["txid", "vin_index"], "left")
    stack = F.array_join(F.transform("w", lambda i: F.concat(i["item_index"], F.lit(":"), (F.length(i["data_hex"]) / 2).cast("int"), F.lit(":"), i["data_hex"])), ",")
    return out.select("txid", "vin_index", "prev_txid", "prev_vout_index", "coinbase_hex", "script_sig_hex", "sequence", stack.alias("witness"))


@over_ledger
def output_participants(g):
    people = F.array_join(F.array_sort(F.collect_list("address")), ",")
    return g.participants.groupBy("txid", "vout_index").agg(people.alias("participants"), F.count("*").alias("n_participants"))


@over_ledger
def transaction_detail(g):
    """Every transaction in full, its inputs and outputs as ordered texts."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    one = lambda i: F.concat_ws(":", i["vin_index"], text(i["prev_txid"]), text(i["prev_vout_index"]), i["sequence"], n(i["witness"]["size_bytes"]))
    other = lambda o: F.concat_ws(":", o["vout_index"], o["value_coins"], o["script_type"], text(o["witness_version"]), text(o["witness_program"]), text(o["address"]), n(o["participants"]), text(o["spent"]))
    listed = [F.array_join(F.transform("inputs", one), ",").alias("inputs"), F.array_join(F.transform("outputs", other), ",").alias("outputs")]
    places = [F.size("occurrences").cast("long").alias("n_occurrences"), F.col("occurrences")[0]["canonical"].alias("canonical")]
    columns = ["txid", "wtxid", "version", "locktime", "is_coinbase", "size", "vsize", "weight", "fee_sats", "fee_coins", *listed, *places]
    spark = g.blocks.sparkSession
    return detail_rows(g, Store(spark, f"{shared_dir(spark)}/details-{uuid.uuid4().hex}"), lambda d: d.select(*columns))


@over_ledger
def genesis_rollup(g):
    return accounting.genesis_rollup(g.blocks, _rollup(g))


@over_tables
def decoded_blocks(spark, sf_dir):
    return decoded(spark, sf_dir, "blocks").drop("difficulty")


@over_tables
def decoded_transactions(spark, sf_dir):
    return decoded(spark, sf_dir, "transactions")


@over_tables
def decoded_variants(spark, sf_dir):
    return decoded(spark, sf_dir, "variants")


@over_tables
def decoded_occurrences(spark, sf_dir):
    return decoded(spark, sf_dir, "occurrences")


@over_tables
def decoded_inputs(spark, sf_dir):
    return decoded(spark, sf_dir, "inputs")


@over_tables
def decoded_witness(spark, sf_dir):
    return decoded(spark, sf_dir, "witness")


@over_tables
def decoded_outputs(spark, sf_dir):
    """Amounts, scripts and the owners that follow from them."""
    hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("script_pubkey", "script_hex"), ("witness_program", "witness_program"))]
    return decoded(spark, sf_dir, "outputs").select("txid", "vout_index", "value_satoshis", "address", "script_type", "witness_version", *hexed)


@over_tables
def decoded_participants(spark, sf_dir):
    return decoded(spark, sf_dir, "participants")


@over_ledger
def tx_occurrences(g):
    return g.occurrences.select("txid", "block_hash", "block_height", "tx_index", "wtxid", "canonical")


@over_ledger
def best_occurrence(g):
    return chain.best_occurrence(g.occurrences)


@over_ledger
def address_history(g):
    return addresses.touches(g.owners, g.inputs, g.canon)


@over_ledger
def address_history_counts(g):
    return addresses.touches(g.owners, g.inputs, g.canon).groupBy("address").agg(F.count("*").alias("n_transactions"), F.max("block_height").alias("last_height"))


@over_ledger
def address_history_page(g):
    """The second page of the busiest kind of address: composite keyset cursor."""
    t = addresses.touches(g.owners.filter("address = 'n0'"), g.inputs, g.canon)
    return addresses.keyset_page(t, ["block_height", "txid"], [1000, "f"], 25)


@over_ledger
def recent_blocks(g):
    return addresses.keyset_page(g.blocks.filter("canonical"), ["height"], [1000], 25).select("hash", "height", "prev_hash", "merkle_root", "time", "bits", "nonce", "size", "weight", "tx_count", "canonical")


@over_ledger
def block_transactions(g):
    """Blocks of two heights by height and hash, orphans included, with their transactions in order."""
    return g.occurrences.filter("block_height IN (100, 200)").select("block_hash", "block_height", "canonical", F.col("tx_index").alias("index"), "txid", "wtxid")


@over_ledger
def canonical_shape(g):
    return chain.canonical_shape(g.blocks)


def _broken(g: Ledger) -> DataFrame:
    return g.blocks.withColumn("prev_hash", F.when(F.col("height") % 400 == 7, F.reverse("prev_hash")).otherwise(F.col("prev_hash")))


@over_ledger
def ancestry_breaches(g):
    return chain.ancestry_breaches(_broken(g))


@over_ledger
def first_ancestry_breach(g):
    return chain.first_breach(_broken(g))


@over_ledger
def tx_fees(g):
    return accounting.transaction_fees(g.transactions, g.inputs, g.outputs)


@over_ledger
def block_accounting(g):
    return _accounting(g)


@over_ledger
def accounting_completeness(g):
    """Blocks, rows, and blocks without a row, when every seventh row is missing."""
    have = _accounting(g).filter("height % 7 <> 0").select("block_hash")
    b = g.blocks.select(F.col("hash").alias("block_hash"))
    return b.join(have.withColumn("has", F.lit(1)), "block_hash", "left").agg(F.count("*").alias("n_blocks"), F.count("has").alias("n_rows"), F.count_if(F.col("has").isNull()).alias("n_missing"))


@over_ledger
def excluded_outputs(g):
    return accounting.excluded_outputs(g.blocks, g.occurrences, g.outputs)


@over_ledger
def supply_rollup(g):
    return _rollup(g)


@over_ledger
def branch_rollup(g):
    acc, exc = _accounting(g), accounting.excluded_outputs(g.blocks, g.occurrences, g.outputs)
    return accounting.branch_rollup(g.blocks, acc, exc, accounting.supply_rollup(acc, exc))


@over_ledger
def rollup_contradictions(g):
    """A stored rollup of which every fifth row differs in one column, against a fresh one."""
    fresh = _rollup(g)
    wrong = F.when(F.col("height") % 5 == 0, 1).otherwise(0)
    stored = fresh.withColumn("cumulative_fee_satoshis", F.col("cumulative_fee_satoshis") + wrong)
    from ..operators.rules import contradictions

    return contradictions(stored, fresh, ["block_hash"]).select("block_hash", F.col("cumulative_fee_satoshis.stored").alias("stored_fee"), F.col("cumulative_fee_satoshis.supplied").alias("supplied_fee"))


@over_ledger
def supply_crosscheck(g):
    acc = _accounting(g)
    rollup = accounting.supply_rollup(acc, accounting.excluded_outputs(g.blocks, g.occurrences, g.outputs))
    return accounting.supply_crosscheck(rollup, _state(g), acc, g.blocks)


@over_ledger
def balance_distribution(g):
    return distribution.balance_distribution(_addresses(g))


@over_ledger
def distribution_filtered(g):
    return distribution.distribution_filtered(_addresses(g))


def _rolled_back(g: Ledger, to: int) -> Ledger:
    gone = chain.orphaned_by(g.blocks, to)
    blocks = chain.with_canonical(g.blocks, gone, canonical=False)
    return g.but(blocks=blocks, occurrences=chain.occurrences(g.occurrences, blocks))


ROLLBACK_TO = 700


@over_ledger
def rollback_utxo_set(g):
    return spend.unspent(_state(_rolled_back(g, ROLLBACK_TO)))


@over_ledger
def rollback_addresses(g):
    return _addresses(_rolled_back(g, ROLLBACK_TO))


@over_ledger
def rollback_touched(g):
    lost = g.canon.filter(F.col("height") > ROLLBACK_TO)
    return addresses.touched_by(g.owners, g.inputs, lost)


@over_ledger
def distribution_delta(g):
    before, after = _addresses(g), _addresses(_rolled_back(g, ROLLBACK_TO))
    touched = addresses.touched_by(g.owners, g.inputs, g.canon.filter(F.col("height") > ROLLBACK_TO))
    return distribution.distribution_delta(before, after, touched)


@over_ledger
def common_ancestor(g):
    """With a remote chain that leaves ours at height 800."""
    c = g.blocks.filter("canonical")
    remote = c.select("height", F.when(F.col("height") >= 800, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    return chain.common_ancestor(g.blocks, remote)


@over_ledger
def child_counts(g):
    """Transactions whose stored outputs are fewer than supplied, when output 1 is lost."""
    from ..operators.rules import count_mismatches

    want = g.outputs.groupBy("txid").agg(F.count("*").alias("n"))
    return count_mismatches(want, g.outputs.filter("vout_index <> 1"), ["txid"], "n")


@over_ledger
def new_rows(g):
    """Insert-or-verify: supplied blocks that are not stored yet, stored ones being verified."""
    from ..operators.rules import insert_or_verify

    b = g.blocks.select("hash", "height", "prev_hash", "size")
    return insert_or_verify(b.filter("height < 500"), b, ["hash"], "blocks")


@over_ledger
def script_class(g):
    c = classify(g.outputs.select("txid", "vout_index", "script_pubkey"))
    return c.groupBy("script_type", "witness_version", "unspendable").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("pubkeys"), F.lit(0)).cast("long")).alias("n_keys"))


@over_ledger
def script_witness_programs(g):
    c = classify(g.outputs.select("txid", "vout_index", "script_pubkey")).filter("witness_version IS NOT NULL")
    return c.select("txid", "vout_index", "script_type", "witness_version", F.lower(F.hex("witness_program")).alias("witness_program"))


@over_ledger
def witness_metadata(g):
    """How many outputs pass the metadata rule as they are, and with their programs cut short."""
    c = classify(g.outputs.select("script_pubkey"))
    ok = lambda p: witness_metadata_ok(F.col("script_type"), F.col("witness_version"), p)
    return c.groupBy("script_type").agg(F.count_if(ok(F.col("witness_program"))).alias("n_ok"), F.count_if(ok(F.expr("substring(witness_program, 1, 19)"))).alias("n_ok_cut"))


@over_ledger
def unspendable_outputs(g):
    return g.outputs.filter(is_unspendable(F.col("script_pubkey"))).select("txid", "vout_index", "value_satoshis", F.octet_length("script_pubkey").alias("size_bytes"))


@over_tables
def identifier_search(spark, sf_dir):
    """What each id is: block, transaction or variant, confirmed before unconfirmed; a transaction wins over its variant."""
    g, mempool_ = ledger(spark, sf_dir), P.table(spark, sf_dir, "mempool")
    places = [(g.blocks, "hash", "block"), (g.transactions, "txid", "transaction"), (g.transactions, "wtxid", "variant"), (mempool_, "txid", "mempool transaction"), (mempool_, "wtxid", "mempool variant")]
    found = [t.select(F.col(c).alias("id"), F.lit(k).alias("rank"), F.lit(kind).alias("kind")) for k, (t, c, kind) in enumerate(places)]
    return reduce(DataFrame.union, found).groupBy("id").agg(F.min_by("kind", "rank").alias("kind"))


@over_tables
def subsidy_by_height(spark, sf_dir):
    """Both schedules at heights that come from order keys, far beyond the last subsidy."""
    h = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 37 % 20_000_000).alias("height"))
    return h.select("height", MAIN.at(F.col("height")).alias("main"), schedule_for("regtest").at(F.col("height")).alias("regtest"))


@over_tables
def scheduled_subsidy(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 37 % 20_000_000).alias("height"))
    return h.select("height", MAIN.through(F.col("height")).alias("main_total"), schedule_for("regtest").through(F.col("height")).alias("regtest_total"))


@over_tables
def amount_format(spark, sf_dir):
    v = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    sats = parse_amount(v)
    signed = F.when(F.col("l_returnflag") == "R", -sats).otherwise(sats)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", sats.alias("sats"), format_amount(signed).alias("shown"), whole_coins(signed).cast("long").alias("whole"))


@over_tables
def amount_validation(spark, sf_dir):
    """Texts that are amounts and texts that only look like some."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = F.col("event_id").cast("string")
    n = F.col("event_id") % 8
    text = F.when(n == 0, base).when(n == 1, F.concat(base, F.lit(".5"))).when(n == 2, F.concat(base, F.lit(".123456789"))).when(n == 3, F.concat(base, F.lit("e-8"))).when(n == 4, F.concat(F.lit("-"), base)).when(n == 5, F.concat(F.lit("."), F.lpad(base, 8, "0"))).when(n == 6, F.concat(base, F.lit("."))).otherwise(F.lit("."))
    return e.select("event_id", text.alias("text"), is_amount(text).alias("valid"), parse_amount(text).alias("sats"))


@over_tables
def bucket_of_balance(spark, sf_dir):
    v = F.col("event_id") * F.col("event_id") * 3_000_000 - 1_000_000_000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", v.alias("balance"), bucket_of(v).alias("bucket_id"))


@over_tables
def mempool_state(spark, sf_dir):
    return mempool.totals(P.table(spark, sf_dir, "mempool"))


@over_tables
def mempool_page(spark, sf_dir):
    """The page behind the middle of the snapshot."""
    m = P.table(spark, sf_dir, "mempool")
    cut = m.agg(F.expr("min(entry_time) + (max(entry_time) - min(entry_time)) div 2").alias("t")).first().t
    return mempool.page(m, 1, 100, (1, cut, "f")).select("txid", "entry_time", "fee_satoshis", "vsize", "replaceable", yes_no(F.col("replaceable")).alias("replaceable_label"), utc_time(F.col("entry_time")).alias("entered"))


@over_tables
def mempool_dependencies(spark, sf_dir):
    """Edges, whether they stay inside of the snapshot, and the kind of the prevout."""
    edges, m = P.table(spark, sf_dir, "depends"), P.table(spark, sf_dir, "mempool").filter("event_id % 7 <> 3")
    per_tx = edges.groupBy("txid").agg(F.collect_set("depends_on_txid").alias("depends"))
    inside = m.select(F.col("txid").alias("depends_on_txid"), F.lit(True).alias("inside"))
    rows = edges.join(inside, "depends_on_txid", "left").join(per_tx, "txid")
    return rows.select("txid", "depends_on_txid", F.coalesce("inside", F.lit(False)).alias("inside"), prevout_kind(F.col("depends"), F.col("depends_on_txid")).alias("kind"))


@over_tables
def mempool_freshness(spark, sf_dir):
    m = P.table(spark, sf_dir, "blocks").filter("canonical")
    tip = m.agg(F.max("height").alias("h"), F.max_by("hash", "height").alias("x"))
    one = m.select("height", "hash", (F.col("height") % 3 > 0).alias("initialized"))
    joined = one.join(F.broadcast(tip), one.height <= tip.h)  # one row
    return joined.select("height", mempool.freshness(F.col("initialized"), F.col("height"), F.col("hash"), F.col("h"), F.col("x")).alias("state"))


@over_tables
def deployment_decode(spark, sf_dir):
    """Documents made from events, some of them broken; which rules they break."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 11 == 0, "speedy").otherwise("bip9").alias("type"),
            (F.col("event_id") % 2 == 0).alias("active"),
            F.struct(
                (F.col("event_id") % 31).alias("bit"), F.lit(0).alias("start_time"), F.lit(9).alias("timeout"), F.lit(0).alias("min_activation_height"), F.when(F.col("event_id") % 13 == 0, "lost").otherwise("started").alias("status"), F.lit("started").alias("status_next"), (F.col("event_id") - 5).alias("since"),
                F.struct(F.lit(100).alias("period"), (F.col("event_id") % 120).alias("elapsed"), (F.col("event_id") % 50).alias("count")).alias("statistics"),
            ).alias("bip9"),
        )
    )
    from ..operators.rules import breaches

    bad = breaches(deployments.parsed(e.select(F.concat(F.lit("d"), "event_id").alias("name"), raw.alias("raw"))), deployments.rules())
    return bad.select("name", F.array_join(F.array_sort("broken"), ",").alias("broken"))
