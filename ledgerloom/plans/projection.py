"""The test tables as a ledger: orders are transactions, lines are outputs, days are blocks.

One SQL text with a few dialect words, so that Spark and an oracle read the same ledger; everything that is computed from
the ledger is written twice, independently. Values are cents of the source's prices. Totals balance by construction:
unspent value + fees + excluded outputs = coinbase outputs.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, fields
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store, Version, shared_dir

GENESIS_VALUE = 10_000_000_000
SWEEP_AFTER = 30

_PARTS = {
    "days": "SELECT day, CAST(row_number() OVER (ORDER BY day) + 1 AS BIGINT) AS height FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}) d",
    "lines": """SELECT l_orderkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS vout_index
  FROM {lineitem}""",
    "order_tx": """SELECT o.o_orderkey, o.o_custkey, d.height, {sha}(concat('t', o.o_orderkey)) AS txid, l.tot, o.o_orderkey % 1000 AS fee,
  CAST(row_number() OVER (PARTITION BY d.height ORDER BY o.o_orderkey) AS INT) AS tx_index
  FROM {orders} o JOIN days d ON d.day = CAST(o.o_orderdate AS DATE)
  JOIN (SELECT l_orderkey, CAST(sum(value) AS BIGINT) AS tot FROM lines GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "heights": "SELECT CAST(0 AS BIGINT) AS height UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT height FROM days",
    "swept": """SELECT t.height + {sweep} AS height, t.txid AS prev_txid, l.vout_index AS prev_vout_index, l.value,
  CAST(row_number() OVER (PARTITION BY t.height ORDER BY t.txid, l.vout_index) - 1 AS INT) AS vin_index
  FROM order_tx t JOIN lines l ON l.l_orderkey = t.o_orderkey
  WHERE l.l_linestatus = 'F' AND l.l_returnflag <> 'R' AND t.height + {sweep} <= (SELECT max(height) FROM days)""",
    "sweep_tx": "SELECT height, {sha}(concat('w', height)) AS txid, CAST(sum(value) AS BIGINT) AS tot, count(*) AS fee FROM swept GROUP BY height",
    "outputs": """SELECT {sha}(concat('c', 0)) AS txid, 0 AS vout_index, CAST({genesis} AS BIGINT) AS value_satoshis, concat('2102', {sha}('g'), 'ac') AS script_hex, 'genesis' AS address
  UNION ALL SELECT {sha}(concat('c', height)), 0, CAST(0 AS BIGINT), '6a', CAST(NULL AS VARCHAR(100)) FROM heights WHERE height > 0
  UNION ALL SELECT {sha}(concat('c', height - 1)), tx_index, tot + fee, concat('76a914', substr({sha}(concat('c', o_custkey)), 1, 40), '88ac'), concat('c', o_custkey) FROM order_tx
  UNION ALL SELECT t.txid, l.vout_index, l.value,
    CASE WHEN l.l_returnflag = 'R' THEN concat('6a04', substr(t.txid, 1, 8)) WHEN l.l_linenumber = 7 THEN concat('512102', {sha}(concat('s', l.l_suppkey)), '2103', {sha}(concat('m', l.l_suppkey)), '52ae')
         ELSE concat('0014', substr({sha}(concat('s', l.l_suppkey)), 1, 40)) END,
    CASE WHEN l.l_returnflag <> 'R' AND l.l_linenumber <> 7 THEN concat('s', l.l_suppkey) END
    FROM order_tx t JOIN lines l ON l.l_orderkey = t.o_orderkey
  UNION ALL SELECT txid, 0, tot - fee, concat('5220', {sha}(concat('n', (height - {sweep}) % 25))), concat('n', (height - {sweep}) % 25) FROM sweep_tx""",
    "multisig": "SELECT t.txid, l.vout_index, l.l_suppkey FROM order_tx t JOIN lines l ON l.l_orderkey = t.o_orderkey WHERE l.l_returnflag <> 'R' AND l.l_linenumber = 7",
    "participants": """SELECT txid, vout_index, concat('s', l_suppkey) AS address, concat('02', {sha}(concat('s', l_suppkey))) AS pubkey_hex FROM multisig
  UNION ALL SELECT txid, vout_index, concat('m', l_suppkey), concat('03', {sha}(concat('m', l_suppkey))) FROM multisig""",
    "inputs": """SELECT {sha}(concat('c', height)) AS txid, 0 AS vin_index, CAST(NULL AS VARCHAR(64)) AS prev_txid, CAST(NULL AS INT) AS prev_vout_index, '51' AS coinbase_hex, '' AS script_sig_hex, 4294967295 AS sequence FROM heights
  UNION ALL SELECT txid, 0, {sha}(concat('c', height - 1)), tx_index, CAST(NULL AS VARCHAR(64)), substr(txid, 1, 16), 4294967294 FROM order_tx
  UNION ALL SELECT {sha}(concat('w', height)), vin_index, prev_txid, prev_vout_index, CAST(NULL AS VARCHAR(64)), '', 4294967293 FROM swept""",
    "transactions": """SELECT {sha}(concat('c', height)) AS txid, CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS locktime, true AS is_coinbase, {sha}(concat('c', height)) AS wtxid, height, 0 AS tx_index FROM heights
  UNION ALL SELECT txid, CAST(2 AS BIGINT), height, false, CASE WHEN o_orderkey % 2 = 0 THEN {sha}(concat('x', txid)) ELSE txid END, height, tx_index FROM order_tx
  UNION ALL SELECT s.txid, CAST(2 AS BIGINT), CAST(0 AS BIGINT), false, s.txid, s.height, CAST(coalesce(n.n, 0) + 1 AS INT) FROM sweep_tx s LEFT JOIN (SELECT height, count(*) AS n FROM order_tx GROUP BY height) n ON n.height = s.height""",
    "variants": "SELECT wtxid, txid, 100 + height % 50 AS size, 80 + height % 50 AS vsize, 320 + 4 * (height % 50) AS weight FROM transactions",
    "witness": """SELECT {sha}(concat('x', txid)) AS wtxid, txid, 0 AS vin_index, 0 AS item_index, substr(txid, 1, 2 * CAST(1 + o_orderkey % 30 AS INT)) AS data_hex FROM order_tx WHERE o_orderkey % 2 = 0
  UNION ALL SELECT {sha}(concat('x', txid)), txid, 0, 1, '' FROM order_tx WHERE o_orderkey % 2 = 0""",
    "in_block": "SELECT height, count(*) AS n FROM transactions GROUP BY height",
    "kinds": "SELECT height, 'b' AS kind FROM heights UNION ALL SELECT height, 'o' FROM heights WHERE height > 0 AND height % 100 = 0",
    "blocks": """SELECT {sha}(concat(k.kind, k.height)) AS hash, k.height, CASE WHEN k.height > 0 THEN {sha}(concat('b', k.height - 1)) END AS prev_hash, {sha}(concat('r', k.height)) AS merkle_root,
  1700000000 + k.height AS time, '1d00ffff' AS bits, k.height AS nonce, 80 + 250 * n.n AS size, 320 + 1000 * n.n AS weight, n.n AS tx_count, k.kind = 'b' AS canonical
  FROM kinds k JOIN in_block n ON n.height = k.height""",
    "occurrences": "SELECT b.hash AS block_hash, b.height AS block_height, b.canonical, t.tx_index, t.txid, t.wtxid FROM blocks b JOIN transactions t ON t.height = b.height",
    "mempool": """SELECT {sha}(concat('e', event_id)) AS txid, {sha}(concat('e', event_id)) AS wtxid, {seconds} AS entry_time, CAST(round(abs(value) * 100) AS BIGINT) AS fee_satoshis, event_id % 1000 + 60 AS vsize, 4 * (event_id % 1000 + 60) AS weight,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS replaceable, event_id FROM {events}""",
    "depends": "SELECT {sha}(concat('e', event_id)) AS txid, {sha}(concat('e', event_id - 1)) AS depends_on_txid FROM {events} WHERE event_id % 5 = 2",
}

_SPARK = {"sha": "LL_SHA", "seconds": "CAST(unix_timestamp(ts) AS BIGINT)"}
_DUCK = {"sha": "sha256", "seconds": "CAST(floor(epoch(ts)) AS BIGINT)"}


def needed(name: str, seen: list[str] | None = None) -> list[str]:
    """The parts that a part is made of, in an order in which each follows what it needs."""
    seen = [] if seen is None else seen
    for other in _PARTS:
        if other != name and other not in seen and re.search(rf"(FROM|JOIN) {other}\b", _PARTS[name]):
            needed(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def duck_ctes(*names: str) -> str:
    """``WITH`` clause for an oracle that has the test tables as views."""
    order: list[str] = []
    for n in names:
        needed(n, order)
    words = {**_DUCK, "sweep": SWEEP_AFTER, "genesis": GENESIS_VALUE, **{t: t for t in ("orders", "lineitem", "events")}}
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n].format(**words)})" for n in order)


@dataclass(frozen=True)
class Ledger:
    """The body tables. ``blocks.canonical`` is the only fact that may change; everything else derives from these.

    A field may be given as a ``partial``, which is then asked for its table each time it is read."""

    blocks: DataFrame
    transactions: DataFrame
    variants: DataFrame
    occurrences: DataFrame
    inputs: DataFrame
    witness: DataFrame
    outputs: DataFrame
    participants: DataFrame

    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        return value() if isinstance(value, partial) else value

    def but(self, **tables: DataFrame) -> Ledger:
        """With other tables; those that stay are not asked for."""
        return Ledger(**{**vars(self), **tables})

    @property
    def owners(self) -> DataFrame:
        """At most one owner an output; multisig and unspendable outputs have none."""
        return self.outputs.filter("address IS NOT NULL").select("txid", "vout_index", "address")

    @property
    def canon(self) -> DataFrame:
        return self.occurrences.filter("canonical").select("txid", "block_height", "tx_index", "block_hash").withColumnRenamed("block_height", "height")

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


def _sha_calls(text: str) -> str:
    """LL_SHA(x) -> sha2(x, 256), with nested parentheses."""
    while (at := text.find("LL_SHA(")) >= 0:
        depth, k = 1, at + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        text = f"{text[:at]}sha2({text[at + 7 : k - 1]}, 256){text[k:]}"
    return text.replace("VARCHAR(100)", "STRING").replace("VARCHAR(64)", "STRING")


#: Narrow tables of numbers, stored first, of which the wide ones are rows with ids hashed in: name -> (its columns, its text).
_BASES = {
    "days": ("*", "SELECT * FROM days"),
    "order_tx": ("*, LL_SHA(concat('t', o_orderkey)) AS txid", "SELECT o_orderkey, o_custkey, height, tot, fee, tx_index FROM order_tx"),
    "tx_lines": ("*, LL_SHA(concat('t', o_orderkey)) AS txid", "SELECT t.o_orderkey, t.height, l.l_suppkey, l.l_returnflag, l.l_linestatus, l.l_linenumber, l.value, l.vout_index FROM order_tx t JOIN lines l ON l.l_orderkey = t.o_orderkey"),
    "swept": ("height, LL_SHA(concat('t', o_orderkey)) AS prev_txid, prev_vout_index, value, vin_index", _PARTS["swept"].replace("t.txid AS prev_txid", "t.o_orderkey")),
    "sweep_tx": ("*, LL_SHA(concat('w', height)) AS txid", "SELECT height, tot, fee FROM sweep_tx"),
}
_TX_LINES = "order_tx t JOIN lines l ON l.l_orderkey = t.o_orderkey"
#: These pair every output with a row; the others are small or joined, and are stored as they are.
VIEWS = ("transactions", "variants", "inputs", "witness", "outputs", "participants")


def _words(text: str, tables: dict[str, DataFrame]) -> str:
    return _sha_calls(text.format(**_SPARK, sweep=SWEEP_AFTER, genesis=GENESIS_VALUE, **{t: "{" + t + "}" for t in tables}))


def part(spark: SparkSession, sf_dir: str, name: str, bases: dict[str, DataFrame] | None = None, text: str | None = None) -> DataFrame:
    """A part, or a text over parts; what ``bases`` has is read from there and not made again."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events")}
    bases = bases or {}
    text = text or f"SELECT * FROM {name}"

    def body(n: str) -> str:
        if n in bases:
            return f"SELECT {_BASES[n][0]} FROM {{base_{n}}}"
        if "tx_lines" in bases and _TX_LINES in _PARTS[n]:  # one table instead of the two
            return re.sub(r"\b[tl]\.(?=\w)", "", _PARTS[n].replace(_TX_LINES, "tx_lines"))
        return _PARTS[n]

    parts = {**_PARTS, **({"tx_lines": _BASES["tx_lines"][1]} if "tx_lines" in bases else {})}
    order: list[str] = []

    def need(t: str, of: str) -> None:
        for other in parts:
            if other != of and other not in order and re.search(rf"(FROM|JOIN) {other}\b", t):
                need(body(other), other)
        if of and of not in order:
            order.append(of)

    need(text, "")
    tables |= {f"base_{n}": df for n, df in bases.items()}
    ctes = ",\n".join(f"{n} AS ({body(n)})" for n in order)
    text = _words(f"WITH {ctes}\n{text}" if order else text, tables)
    return spark.sql(text, **{t: df for t, df in tables.items() if "{" + t + "}" in text})


_STORED: dict[tuple[str, str], str] = {}
_BASE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def bases(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The narrow tables, each written once a session, from those before it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASE:
        store, found = Store(spark, f"{shared_dir(spark)}/base-{uuid.uuid4().hex}"), {}
        for name, (_, text) in _BASES.items():
            found[name] = store.stage(name, part(spark, sf_dir, name, found, text))
        _BASE[key] = found
    return _BASE[key]


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A body table as its rows follow from the narrow tables."""
    df = part(spark, sf_dir, name, {} if name in ("mempool", "depends") else bases(spark, sf_dir))
    return df.withColumn("script_pubkey", F.unhex("script_hex")) if name == "outputs" else df


def stored(spark: SparkSession, sf_dir: str, *names: str) -> Version:
    """The body tables of a ledger, as an indexer would have left them: each is projected and published once a session, when
    it is first asked for. Without names, all of them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _STORED.setdefault(key, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    store = Store(spark, path)
    version = store.current()
    tables = {n: made(spark, sf_dir, n) for n in names or (*Ledger.names(), "mempool", "depends") if not version.has(n)}
    return store.publish(tables) if tables else version


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A wide table is hashed as it is read, unless it has been stored before: hashes take ten times the disk of their keys."""
    if name in VIEWS:
        key = (spark.sparkContext.applicationId, sf_dir)
        version = Store(spark, _STORED[key]).current() if key in _STORED else None
        return version.table(name) if version and version.has(name) else made(spark, sf_dir, name)
    return stored(spark, sf_dir, name).table(name)


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """Tables are stored as they are read, so that a query leaves on disk only what it needs."""
    return Ledger(**{n: partial(table, spark, sf_dir, n) for n in Ledger.names()})
