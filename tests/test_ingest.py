"""Decode, apply, reorganise and read, through the real decoder and store."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.subsidy import schedule_for
from ledgerloom.operators import deployments, mempool
from ledgerloom.operators.decode import decode_blocks
from ledgerloom.operators.rules import IntegrityError
from ledgerloom.plans.read_api import Explorer, NotFound, Unavailable, to_json
from ledgerloom.sources.node import block_files, stream_block_files
from ledgerloom.sources.store import Busy, CoverageError, Store
from ledgerloom.streaming import apply

SCHEDULE = schedule_for("main")


def h(label):
    return hashlib.sha256(label.encode()).hexdigest()


def p2pkh(who):
    return {"hex": "76a914" + h(who)[:40] + "88ac", "address": who}


def coinbase(label, value, who):
    return {"txid": h(label), "hash": h(label), "version": 1, "size": 100, "vsize": 100, "weight": 400, "locktime": 0, "vin": [{"coinbase": "51", "sequence": 4294967295}], "vout": [{"value": value, "n": 0, "scriptPubKey": p2pkh(who)}]}


def spend(label, prev, outputs, witness=None):
    vin = {"txid": h(prev[0]), "vout": prev[1], "scriptSig": {"hex": ""}, "sequence": 4294967294} | ({"txinwitness": witness} if witness else {})
    return {"txid": h(label), "hash": h("w" + label) if witness else h(label), "version": 2, "size": 200, "vsize": 200, "weight": 800, "locktime": 0, "vin": [vin], "vout": [{"value": v, "n": n, "scriptPubKey": s} for n, (v, s) in enumerate(outputs)]}


def block(label, height, prev, txs):
    b = {"hash": h(label), "height": height, "merkleroot": h("m" + label), "time": 1_700_000_000 + height, "bits": "1d00ffff", "difficulty": 1.0, "nonce": height, "size": 500, "weight": 2000, "nTx": len(txs), "tx": txs}
    return b | ({"previousblockhash": h(prev)} if prev else {})


def chain(tag=""):
    g = block("b0", 0, None, [coinbase("c0", "100.00000000", "genesis")])
    b1 = block("b1", 1, "b0", [coinbase("c1", "100.00000000", "miner")])
    b2 = block(f"b2{tag}", 2, "b1", [coinbase(f"c2{tag}", "50.00000000", "miner2"), spend(f"t{tag}", ("c1", 0), [("25.00000000", p2pkh("alice")), ("65.00000000", p2pkh("bob")), ("0.00000000", {"hex": "6a0161"})], ["ab" * 20, ""])])
    return [g, b1, b2]


def amounts_as_numbers(text):
    """Values as JSON numbers, as a node writes them."""
    import re

    return re.sub(r'"value": "([0-9.]+)"', r'"value": \1', text)


@pytest.fixture()
def place(spark, tmp_path):
    def write(blocks, name="blocks"):
        (tmp_path / name).mkdir(exist_ok=True)
        for b in blocks:
            (tmp_path / name / f"{b['height']}-{b['hash'][:6]}.json").write_text(amounts_as_numbers(json.dumps(b)))
        return str(tmp_path / name)

    return write, Store(spark, f"file://{tmp_path}/store")


def decoded(spark, path):
    return apply.from_decoded(decode_blocks(block_files(spark, path), spark.createDataFrame([], "pubkey_hex string, address string")))


def balances(version):
    return {r.address: (r.balance_satoshis, r.tx_count) for r in version.table("addresses").collect()}


def test_apply_replay_reorganise_and_read(spark, place):
    write, store = place
    assert Explorer(store.current()).status().first().indexed_height == -1
    v = apply.apply_blocks(store, decoded(spark, write(chain())), SCHEDULE)
    assert v.manifest["indexed_height"] == 2
    first = balances(v)
    assert first == {"miner": (0, 2), "miner2": (5_000_000_000, 1), "alice": (2_500_000_000, 1), "bob": (6_500_000_000, 1)}
    e = Explorer(v)
    assert e.supply().first().utxo_set_value_coins == "140.00000000"
    t = e.transaction(txid=h("t")).first()
    assert t.fee_coins == "10.00000000" and (t.wtxid, t.size, t.vsize, t.weight) == (h("wt"), 200, 200, 800)
    assert [(o.script_type, o.witness_version) for o in t.outputs] == [("p2pkh", None), ("p2pkh", None), ("nulldata", None)]
    assert [i.size_bytes for i in e.transaction(txid=h("t")).first().inputs[0].witness] == [20, 0]
    assert [o.spent for o in e.transaction(txid=h("t")).first().outputs] == [False, False, None]
    assert e.address_summary("nobody").first().balance_coins == "0.00000000"
    assert [r.txid for r in e.address_history("genesis").rows.collect()] == [h("c0")]
    page = e.address_history("miner", 1)
    assert page.cursor == (2, h("t"))
    assert [r.txid for r in e.address_history("miner", 1, *page.cursor).rows.collect()] == [h("c1")]
    assert [r.height for r in e.recent_blocks(2).rows.collect()] == [2, 1]
    assert e.search(h("b2")) == ("block", h("b2")) and e.search(h("wt"))[0] == "variant"
    with pytest.raises(NotFound):
        e.block(h("nothing"))
    with pytest.raises(Unavailable):
        e.deployments()
    assert json.loads(to_json(e.status()).first().json)["indexed_height"] == 2
    # Replay changes nothing but the generation.
    assert balances(apply.apply_blocks(store, decoded(spark, write(chain())), SCHEDULE)) == first
    # Another branch from height 1.
    remote = spark.createDataFrame([(0, h("b0")), (1, h("b1")), (2, h("b2x"))], "height long, hash string")
    assert apply.reconcile(store, remote, SCHEDULE).manifest["indexed_height"] == 1
    assert set(balances(store.current())) == {"miner"}
    v = apply.apply_blocks(store, decoded(spark, write(chain("x")[2:], "fork")), SCHEDULE)
    assert balances(v) == first and v.manifest["indexed_block_hash"] == h("b2x")
    # The orphan is visible by hash, not by height.
    e = Explorer(v)
    assert not e.block(h("b2")).first().canonical and e.block(2).first().hash == h("b2x")
    # The orphan keeps its rollup row, beside that of the block in its place.
    assert {r.block_hash for r in v.table("rollup").collect()} == {h("b0"), h("b1"), h("b2"), h("b2x")}
    assert e.block_rollup(h("b2")).drop("block_hash").collect() == e.block_rollup(h("b2x")).drop("block_hash").collect()
    # And back: the stored orphan becomes canonical again.
    apply.rollback_to(store, 1, SCHEDULE)
    v = apply.apply_blocks(store, decoded(spark, write(chain()[2:], "back")), SCHEDULE)
    assert balances(v) == first and v.manifest["indexed_block_hash"] == h("b2")


def test_a_stored_rollup_is_not_rewritten(spark, place):
    write, store = place
    apply.apply_blocks(store, decoded(spark, write(chain()[:2])), SCHEDULE)
    wrong = store.current().table("rollup").withColumn("cumulative_fee_satoshis", F.col("cumulative_fee_satoshis") + F.col("height"))
    store.publish({"rollup": wrong})
    with pytest.raises(IntegrityError, match="rollup contradiction"):
        apply.apply_blocks(store, decoded(spark, write(chain()[2:], "next")), SCHEDULE)
    store.publish({}, rollup_anchor=h("b0"), distribution_anchor=h("b0"))
    for read in (Explorer(store.current()).supply, Explorer(store.current()).distribution):
        with pytest.raises(CoverageError):
            read()


def test_refusals(spark, place):
    write, store = place
    apply.apply_blocks(store, decoded(spark, write(chain()[:2])), SCHEDULE)
    gap = block("b9", 9, "b8", [coinbase("c9", "1.00000000", "m")])
    with pytest.raises(apply.NotSequential):
        apply.apply_blocks(store, decoded(spark, write([gap], "gap")), SCHEDULE)
    twice = block("b2", 2, "b1", [coinbase("c2", "1.00000000", "m"), spend("t1", ("c1", 0), [("1.00000000", p2pkh("a"))]), spend("t2", ("c1", 0), [("1.00000000", p2pkh("a"))])])
    with pytest.raises(IntegrityError, match="double spend"):
        apply.apply_blocks(store, decoded(spark, write([twice], "twice")), SCHEDULE)
    missing = block("b2", 2, "b1", [coinbase("c2", "1.00000000", "m"), spend("t1", ("c0", 0), [("1.00000000", p2pkh("a"))])])
    with pytest.raises(IntegrityError, match="missing prevout"):
        apply.apply_blocks(store, decoded(spark, write([missing], "missing")), SCHEDULE)
    greedy = block("b2", 2, "b1", [coinbase("c2", "100.00000001", "m")])
    with pytest.raises(IntegrityError, match="within the reward"):
        apply.apply_blocks(store, decoded(spark, write([greedy], "greedy")), SCHEDULE)
    assert store.current().manifest["indexed_height"] == 1
    with store.writing(), pytest.raises(Busy):
        with store.writing():
            pass


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda b: b.update(hash="zz"), "hash"),
        (lambda b: b.update(nTx=5), "transactions"),
        (lambda b: b.pop("previousblockhash"), "genesis relation"),
        (lambda b: b.update(bits="1D00FFFF"), "bits"),
        (lambda b: b["tx"][1].update(hash=b["tx"][1]["txid"]), "each transaction"),
        (lambda b: b["tx"][1]["vin"][0].update(coinbase="51"), "coinbase first"),
        (lambda b: b["tx"][1]["vout"][0].update(value="1.123456789"), "each transaction"),
        (lambda b: b["tx"][1]["vout"][1].update(n=7), "each transaction"),
        (lambda b: b["tx"][1]["vin"][0].update(scriptSig={"hex": "abc"}), "each transaction"),
    ],
)
def test_decode_rules(spark, place, change, rule):
    b = chain()[2]
    change(b)
    with pytest.raises(IntegrityError, match=rule):
        decoded(spark, place[0]([b]))


def test_stream(spark, place, tmp_path):
    write, store = place
    path = write(chain())
    q = apply.stream_blocks(spark, stream_block_files(spark, path), store, lambda rows: apply.from_decoded(decode_blocks(rows, spark.createDataFrame([], "pubkey_hex string, address string"))), SCHEDULE, str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert q.exception() is None
    assert store.current().manifest["indexed_height"] == 2


def test_mempool_snapshot(spark, place):
    _, store = place
    rows = spark.createDataFrame([(h(f"m{k}"), h(f"m{k}"), 100 + k // 2, 10, 50) for k in range(5)], "txid string, wtxid string, entry_time long, fee_satoshis long, vsize long")
    edges = spark.createDataFrame([(h("m1"), h("m0"))], "txid string, depends_on_txid string")
    v = apply.replace_snapshot(store, {"mempool": rows, "depends": edges}, "mempool_snapshot", 5, h("tip"))
    e = Explorer(v)
    assert e.mempool_state().first().asDict()["state"] == "stale"
    page = e.mempool_page(2)
    seen = [r.txid for r in page.rows.collect()]
    while page.cursor:
        page = e.mempool_page(2, page.cursor)
        seen += [r.txid for r in page.rows.collect()]
    assert sorted(seen) == sorted(h(f"m{k}") for k in range(5))
    assert e.mempool_transaction(txid=h("m1")).first().depends == [h("m0")]
    v2 = apply.replace_snapshot(store, {"mempool": rows, "depends": edges}, "mempool_snapshot", 6, h("tip"))
    with pytest.raises(mempool.GenerationChanged):
        Explorer(v2).mempool_page(2, (1, 100, "x"))


def test_deployments(spark, place):
    good = {"type": "bip9", "active": False, "bip9": {"bit": 2, "start_time": 0, "timeout": 9, "min_activation_height": 0, "status": "started", "status_next": "started", "since": 3, "statistics": {"period": 100, "threshold": 90, "elapsed": 10, "count": 5}, "signalling": "#-#"}}
    buried = {"type": "buried", "active": True, "height": 1}
    rows = lambda d: spark.createDataFrame([(n, json.dumps(x)) for n, x in d.items()], "name string, raw string")
    out = deployments.decode_deployments(rows({"a": good, "b": buried}))
    assert [(r.name, r.status, r.since) for r in out.collect()] == [("a", "started", 3)]
    for path, value in (("status", "odd"), ("bit", 29), ("since", -1), ("signalling", "#x")):
        bad = json.loads(json.dumps(good))
        bad["bip9"][path] = value
        with pytest.raises(IntegrityError):
            deployments.decode_deployments(rows({"a": bad}))
    with pytest.raises(IntegrityError):
        deployments.decode_deployments(rows({"a": {"type": "other", "active": True}}))
    _, store = place
    stored = out.select("name", "status", "since", "raw", F.lit(7).alias("checked_at"), F.lit(7).alias("observed_at"))
    v = apply.replace_snapshot(store, {"deployments": stored}, "deployment_snapshot", -1, None, count=1)
    assert Explorer(v).deployment("a").first().bit == 2
    v = apply.replace_snapshot(store, {"deployments": stored.withColumn("since", F.lit(4).cast("long"))}, "deployment_snapshot", -1, None, count=1)
    with pytest.raises(IntegrityError, match="since column"):
        Explorer(v).deployments()


def test_publishing_at_once_loses_nothing(spark, tmp_path):
    """Two jobs with locks of their own publish to one manifest."""
    from concurrent.futures import ThreadPoolExecutor

    def job(name):
        store = Store(spark, str(tmp_path / "store"))
        for k in range(4):
            with store.writing(name):
                store.publish({f"{name}_table": spark.range(k + 1)}, **{f"{name}_round": k})

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(job, ["blocks", "snapshot"]))
    version = Store(spark, str(tmp_path / "store")).current()
    assert version.generation == 8 and (version.manifest["blocks_round"], version.manifest["snapshot_round"]) == (3, 3)
    assert version.table("blocks_table").count() == version.table("snapshot_table").count() == 4
