"""The passes that follow a node, against a small server that answers as one."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerloom.functions.subsidy import schedule_for
from ledgerloom.operators.rules import IntegrityError
from ledgerloom.plans.read_api import Explorer
from ledgerloom.sources.node import Rpc, RpcError, Unauthorized
from ledgerloom.sources.store import Store
from ledgerloom.streaming import apply, follow

from .test_ingest import block, chain, coinbase, h, p2pkh, spend

SCHEDULE = schedule_for("main")
KEY = "02" + h("key")


class Node:
    """What the server answers from; tests change it between passes."""

    def __init__(self):
        self.blocks, self.unconfirmed, self.entries, self.deployments = chain(), {}, {}, {}

    def answer(self, method, params):
        if method == "getblockcount":
            return len(self.blocks) - 1
        if method == "getbestblockhash":
            return self.blocks[-1]["hash"]
        if method == "getblockhash":
            return self.blocks[params[0]]["hash"]
        if method == "getblock":
            return next(b for b in self.blocks if b["hash"] == params[0])
        if method == "getblockchaininfo":
            return {"chain": "main", "pruned": False, "initialblockdownload": False}
        if method == "getrawmempool":
            return self.entries
        if method == "getrawtransaction":
            return self.unconfirmed[params[0]]
        if method == "getdescriptorinfo":
            return {"descriptor": params[0]}
        if method == "deriveaddresses":
            return ["of " + params[0]]
        if method == "getdeploymentinfo":
            return {"hash": params[0], "height": len(self.blocks) - 1, "deployments": self.deployments}
        return {}


@pytest.fixture()
def node():
    state = Node()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code, out = 200, {"result": None, "error": None}
            if self.headers["Authorization"] != "Basic dTpw":
                code = 401
            else:
                try:
                    out["result"] = state.answer(asked["method"], asked["params"])
                except LookupError:
                    code, out["error"] = 500, {"code": -8, "message": "unknown"}
            text = re.sub(r'"(value|base)": "([0-9.]+)"', r'"\1": \2', json.dumps(out)).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state.options = {"url": f"http://127.0.0.1:{server.server_port}", "user": "u", "password": "p", "fetchers": 2}
    yield state
    server.shutdown()


@pytest.fixture()
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(apply, "genesis_hash", lambda network: h("b0"))
    return Store(spark, f"file://{tmp_path}/store")


def listed(*txs):
    return {t["txid"]: {"vsize": 210, "weight": 800, "time": 100 + k, "height": 2, "fees": {"base": "5.00000000"}, "depends": [], "bip125-replaceable": True} for k, t in enumerate(txs)}


def test_follow_and_refresh(node, store):
    rpc = Rpc.of(node.options)
    with pytest.raises(follow.Behind):
        follow.refresh_mempool(store, node.options)
    assert follow.follow(store, node.options, SCHEDULE, "main").manifest["indexed_block_hash"] == h("b2")
    # Nothing new: nothing is published.
    assert follow.follow(store, node.options, SCHEDULE, "main").generation == 1
    # The node is on another branch, which is longer.
    node.blocks = chain("x") + [block("b3", 3, "b2x", [coinbase("c3", "100.00000000", "miner3")])]
    assert follow.chain_moved(rpc, 2, h("b2")) and follow.chain_moved(rpc, 9, h("b9")) and not follow.chain_moved(rpc, 1, h("b1"))
    v = follow.follow(store, node.options, SCHEDULE, "main")
    assert v.manifest["indexed_block_hash"] == h("b3") and not Explorer(v).block(h("b2")).first().canonical

    parent = spend("m1", ("tx", 0), [("10.00000000", p2pkh("carol")), ("10.00000000", {"hex": "21" + KEY + "ac"})], ["ab" * 3, ""])
    child = spend("m2", ("m1", 0), [("5.00000000", p2pkh("dave"))])
    node.unconfirmed = {t["txid"]: t for t in (parent, child)}
    node.entries = listed(parent, child)
    node.entries[h("m2")]["depends"] = [h("m1")]
    v = follow.refresh_mempool(store, node.options)
    e = Explorer(v)
    state, page = e.mempool_overview()
    assert (state.first().state, state.first().tx_count, len(page.rows.collect())) == ("fresh", 2, 2)
    t = e.mempool_transaction(wtxid=h("wm1")).first()
    assert (t.fee_satoshis, t.vsize, t.weight) == (500_000_000, 200, 800)
    assert [(o.address, o.script_type, o.spent) for o in t.outputs] == [("carol", "p2pkh", None), (f"of pkh({KEY})", "p2pk", None)]
    assert [w.size_bytes for w in t.inputs[0].witness] == [3, 0]
    assert e.mempool_transaction(txid=h("m2")).first().depends == [h("m1")]
    assert e.mempool_transaction(txid=h("m1"), raw_witness=True).first().inputs[0].witness[0].data_hex == "ab" * 3

    node.deployments = {"a": {"type": "buried", "active": True, "height": 1}, "b": {"type": "bip9", "active": False, "bip9": {"bit": 2, "start_time": 0, "timeout": 9, "min_activation_height": 0, "status": "started", "status_next": "started", "since": 3}}}
    v = follow.refresh_deployments(store, node.options)
    state, rows = Explorer(v).deployments()
    assert state.first().state == "fresh" and [(r.name, r.since) for r in rows.collect()] == [("b", 3)]

    # A transaction that is gone, one that was confirmed, and another one than asked for: the old snapshot stays.
    del node.unconfirmed[h("m2")]
    with pytest.raises(follow.Moved):
        follow.refresh_mempool(store, node.options)
    node.unconfirmed[h("m2")] = child | {"blockhash": h("b9")}
    with pytest.raises(follow.Moved):
        follow.refresh_mempool(store, node.options)
    node.unconfirmed[h("m2")] = parent
    with pytest.raises(IntegrityError, match="the one asked for"):
        follow.refresh_mempool(store, node.options)
    node.unconfirmed[h("m2")] = child
    node.entries[h("m2")]["depends"] = [h("nowhere")]
    with pytest.raises(IntegrityError, match="outside"):
        follow.refresh_mempool(store, node.options)
    assert store.current().manifest["mempool_snapshot"]["generation"] == 1
    # An empty mempool is a snapshot too.
    node.unconfirmed, node.entries = {}, {}
    v = follow.refresh_mempool(store, node.options)
    assert Explorer(v).mempool_state().first().tx_count == 0 and v.manifest["mempool_snapshot"]["generation"] == 2


def test_anchors_are_looked_at_twice(node, store):
    store.publish({}, indexed_height=2, indexed_block_hash=h("b2"))
    with pytest.raises(follow.Moved):
        with follow.anchored(store, Rpc.of(node.options)) as tip:
            assert tip == (2, h("b2"))
            node.blocks = chain("x")


def test_a_bad_block_is_no_race(node, store):
    node.blocks = chain()[:2] + [block("b2", 2, "elsewhere", [coinbase("c2", "1.00000000", "m")])]
    with pytest.raises(apply.NotSequential):
        follow.follow(store, node.options, SCHEDULE, "main")


def test_rpc(node):
    with pytest.raises(Unauthorized):
        Rpc(node.options["url"], "u", "wrong").tip()
    with pytest.raises(RpcError):
        Rpc.of(node.options)("getblockhash", 99)
