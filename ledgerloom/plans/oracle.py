"""The same results in plain SQL for another engine, written from the definitions and not from the operators."""

from __future__ import annotations

from .projection import duck_ctes

INITIAL, MAIN, REGTEST, COIN = 10_000_000_000, 500_000, 150, 100_000_000
STEPS = [COIN * 10**k for k in range(7)]
NAMES = ["lt_1", "1_10", "10_100", "100_1k", "1k_10k", "10k_100k", "100k_1m", "gte_1m"]

CANON = "canon AS (SELECT txid, block_height AS height, tx_index, block_hash FROM occurrences WHERE canonical)"
SPENDS = "spends AS (SELECT i.prev_txid AS txid, i.prev_vout_index AS vout_index, i.txid AS spending_txid, i.vin_index AS spending_vin_index, c.height AS spending_height, c.tx_index AS sx FROM inputs i JOIN canon c ON c.txid = i.txid WHERE i.prev_txid IS NOT NULL)"
MADE = "made AS (SELECT o.*, c.height AS creating_height, c.tx_index AS cx FROM outputs o JOIN canon c ON c.txid = o.txid WHERE c.height > 0 AND substr(o.script_hex, 1, 2) <> '6a')"
STATE = f"{CANON}, {SPENDS}, {MADE}, state AS (SELECT m.txid, m.vout_index, m.value_satoshis, m.creating_height, s.spending_txid, s.spending_vin_index, s.spending_height, s.spending_txid IS NOT NULL AS spent, m.address FROM made m LEFT JOIN spends s ON s.txid = m.txid AND s.vout_index = m.vout_index)"
ADDR = """addr AS (SELECT a.*, n.tx_count FROM (
  SELECT address, CAST(sum(value_satoshis) AS BIGINT) AS total_received_satoshis, CAST(sum(CASE WHEN spent THEN value_satoshis ELSE 0 END) AS BIGINT) AS total_sent_satoshis,
    CAST(sum(CASE WHEN spent THEN 0 ELSE value_satoshis END) AS BIGINT) AS balance_satoshis, min(creating_height) AS first_seen_height, max(greatest(creating_height, coalesce(spending_height, creating_height))) AS last_seen_height
  FROM state WHERE address IS NOT NULL GROUP BY address) a JOIN (
  SELECT address, count(DISTINCT id) AS tx_count FROM (SELECT address, txid AS id FROM state UNION ALL SELECT address, spending_txid FROM state WHERE spent) x WHERE address IS NOT NULL GROUP BY address) n USING (address))"""
SUBSIDY = f"CASE WHEN height // {{0}} >= 64 THEN 0 ELSE {INITIAL} >> CAST(height // {{0}} AS INT) END"
FEES = """fees AS (SELECT t.txid, CAST(s.v - p.v AS BIGINT) AS fee_satoshis FROM transactions t
  JOIN (SELECT i.txid, sum(o.value_satoshis) AS v FROM inputs i JOIN outputs o ON o.txid = i.prev_txid AND o.vout_index = i.prev_vout_index GROUP BY i.txid) s ON s.txid = t.txid
  JOIN (SELECT txid, sum(value_satoshis) AS v FROM outputs GROUP BY txid) p ON p.txid = t.txid WHERE NOT t.is_coinbase)"""
ACC = f"""acc AS (SELECT b.hash AS block_hash, b.height, CAST({SUBSIDY.format(MAIN)} AS BIGINT) AS subsidy_satoshis, CAST(coalesce(f.v, 0) AS BIGINT) AS fee_satoshis, CAST(c.v AS BIGINT) AS coinbase_output_satoshis
  FROM blocks b LEFT JOIN (SELECT block_hash, sum(fee_satoshis) AS v FROM occurrences JOIN fees USING (txid) GROUP BY block_hash) f ON f.block_hash = b.hash
  LEFT JOIN (SELECT block_hash, sum(value_satoshis) AS v FROM occurrences JOIN outputs USING (txid) WHERE tx_index = 0 GROUP BY block_hash) c ON c.block_hash = b.hash)"""
EXC = "exc AS (SELECT b.hash AS block_hash, b.height, b.canonical, CAST(coalesce(sum(CASE WHEN b.height = 0 OR substr(o.script_hex, 1, 2) = '6a' THEN o.value_satoshis ELSE 0 END), 0) AS BIGINT) AS excluded_output_satoshis FROM blocks b LEFT JOIN occurrences x ON x.block_hash = b.hash LEFT JOIN outputs o ON o.txid = x.txid GROUP BY b.hash, b.height, b.canonical)"
_W = "OVER (ORDER BY height)"
ROLL = f"""roll AS (SELECT block_hash, height, excluded_output_satoshis, CAST(sum(subsidy_satoshis) {_W} AS BIGINT) AS cumulative_subsidy_satoshis, CAST(sum(fee_satoshis) {_W} AS BIGINT) AS cumulative_fee_satoshis,
  CAST(sum(coinbase_output_satoshis) {_W} AS BIGINT) AS cumulative_coinbase_output_satoshis, CAST(sum(subsidy_satoshis + fee_satoshis - coinbase_output_satoshis) {_W} AS BIGINT) AS cumulative_unclaimed_reward_satoshis,
  CAST(sum(excluded_output_satoshis) {_W} AS BIGINT) AS cumulative_excluded_output_satoshis, CAST(sum(coinbase_output_satoshis - fee_satoshis - excluded_output_satoshis) {_W} AS BIGINT) AS cumulative_utxo_set_value_satoshis
  FROM acc JOIN exc USING (block_hash, height) WHERE canonical)"""
TOUCH = """touch AS (SELECT DISTINCT t.address, t.txid, c.block_hash, c.height AS block_height FROM (
  SELECT address, txid FROM outputs WHERE address IS NOT NULL
  UNION ALL SELECT o.address, i.txid FROM inputs i JOIN outputs o ON o.txid = i.prev_txid AND o.vout_index = i.prev_vout_index WHERE o.address IS NOT NULL) t JOIN canon c ON c.txid = t.txid)"""


def bucket(v: str) -> str:
    return "CASE WHEN {0} <= 0 THEN NULL ".format(v) + " ".join(f"WHEN {v} < {s} THEN '{n}'" for s, n in zip(STEPS, NAMES)) + f" ELSE '{NAMES[-1]}' END"


def shown(v: str) -> str:
    return f"concat(CASE WHEN {v} < 0 THEN '-' ELSE '' END, abs({v}) // {COIN}, '.', lpad(CAST(abs({v}) % {COIN} AS VARCHAR), 8, '0'))"


def sql(parts: str, body: str, *ctes: str) -> str:
    return ", ".join([duck_ctes(*parts.split()), *ctes]) + "\n" + body


_S = "occurrences inputs outputs"
_A = "blocks occurrences transactions inputs outputs"
_BUCKETS = "buckets AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for n, a, b in zip(NAMES, [1, *STEPS], [*(s - 1 for s in STEPS), "NULL"])) + ") v(bucket_id, min_balance_satoshis, max_balance_satoshis))"
_ROLLED = "occurrences_ AS (SELECT block_hash, block_height, canonical AND block_height <= 700 AS canonical, tx_index, txid, wtxid FROM occurrences)"


def _rolled(text: str, suffix: str = "_r") -> str:
    """The state CTEs over the chain that was rolled back, under other names."""
    import re

    text = text.replace("FROM occurrences", "FROM occurrences_")
    return re.sub(r"\b(canon|spends|made|state|addr)\b", rf"\1{suffix}", text)


def _filtered() -> str:
    cells = []
    for n, a, b in zip(NAMES, [1, *STEPS], [*STEPS, None]):
        inside = f"balance_satoshis >= {a}" + (f" AND balance_satoshis < {b}" if b else "")
        cells += [f"count(*) FILTER (WHERE {inside}) AS count_{n}", f"CAST(coalesce(sum(balance_satoshis) FILTER (WHERE {inside}), 0) AS BIGINT) AS sum_{n}"]
    return "SELECT " + ", ".join(cells) + ", count(*) FILTER (WHERE balance_satoshis > 0) AS count_positive, CAST(coalesce(sum(balance_satoshis) FILTER (WHERE balance_satoshis > 0), 0) AS BIGINT) AS sum_positive FROM addr"


_BROKEN = "broken AS (SELECT *, CASE WHEN height % 400 = 7 THEN reverse(prev_hash) ELSE prev_hash END AS p FROM blocks WHERE canonical), lagged AS (SELECT height, hash, p AS prev_hash, lag(hash) OVER (ORDER BY height) AS expected_prev FROM broken), bad AS (SELECT * FROM lagged WHERE prev_hash IS DISTINCT FROM expected_prev)"
_KIND = "CASE WHEN script_hex LIKE '6a%' THEN 'nulldata' WHEN script_hex LIKE '0014%' THEN 'p2wpkh' WHEN script_hex LIKE '5220%' THEN 'p2qpk' WHEN script_hex LIKE '76a914%' THEN 'p2pkh' WHEN script_hex LIKE '2102%' THEN 'p2pk' WHEN script_hex LIKE '5121%' THEN 'multisig' ELSE 'unknown' END"
_VERSION = "CAST(CASE WHEN script_hex LIKE '0014%' THEN 0 WHEN script_hex LIKE '5220%' THEN 2 END AS INT)"

SQL: dict[str, str] = {
    "rich_list": sql(_S, f"SELECT row_number() OVER (ORDER BY balance_satoshis DESC, address) AS rank, address, balance_satoshis AS balance_sats, {shown('balance_satoshis')} AS balance_coins FROM addr WHERE balance_satoshis > 0 ORDER BY 3 DESC, 2 LIMIT 100", STATE, ADDR),
    "address_aggregates": sql(_S, "SELECT * FROM addr", STATE, ADDR),
    "utxo_set": sql(_S, "SELECT txid, vout_index, value_satoshis, creating_height FROM state WHERE NOT spent", STATE),
    "utxo_state": sql(_S, "SELECT txid, vout_index, value_satoshis, creating_height, spending_txid, spending_vin_index, spending_height, spent FROM state", STATE),
    "missing_prevouts": sql(_S, "SELECT s.spending_txid, s.spending_vin_index, s.txid, s.vout_index FROM spends s LEFT JOIN made m ON m.txid = s.txid AND m.vout_index = s.vout_index AND m.value_satoshis % 10 <> 3 WHERE m.txid IS NULL OR (m.creating_height, m.cx) >= (s.spending_height, s.sx)", CANON, SPENDS, MADE),
    "double_spends": sql(_S, "SELECT txid, vout_index, n + extra AS n_spends FROM (SELECT s.txid, s.vout_index, count(*) AS n, count(*) FILTER (WHERE i.vin_index = 0 AND i.sequence = 4294967293) AS extra FROM spends s JOIN inputs i ON i.txid = s.spending_txid AND i.vin_index = s.spending_vin_index GROUP BY s.txid, s.vout_index) x WHERE n + extra > 1", CANON, SPENDS),
    "dangling_spends": sql(_S, "SELECT spending_txid AS txid, spending_vin_index AS vin_index, txid AS prev_txid, vout_index AS prev_vout_index FROM state WHERE spent AND spending_vin_index = 1", STATE),
    "tx_outputs_detail": sql(_S, f"SELECT o.txid, o.vout_index, o.value_satoshis AS value_sats, {shown('o.value_satoshis')} AS value_coins, o.script_hex AS script_pubkey_hex, o.address, s.spent, CASE WHEN s.spent THEN 'spent' WHEN NOT s.spent THEN 'unspent' ELSE 'not tracked' END AS spent_label FROM outputs o LEFT JOIN state s ON s.txid = o.txid AND s.vout_index = o.vout_index", STATE),
    "tx_inputs_witness": sql("inputs witness", "SELECT i.*, w.witness FROM inputs i LEFT JOIN (SELECT txid, vin_index, string_agg(concat(item_index, ':', length(data_hex) // 2, ':', data_hex), ',' ORDER BY item_index) AS witness FROM witness GROUP BY txid, vin_index) w ON w.txid = i.txid AND w.vin_index = i.vin_index"),
    "output_participants": sql("participants", "SELECT txid, vout_index, string_agg(address, ',' ORDER BY address) AS participants, count(*) AS n_participants FROM participants GROUP BY txid, vout_index"),
    "transaction_detail": sql(
        "blocks occurrences transactions variants inputs witness outputs participants",
        f"""SELECT t.txid, t.wtxid, t.version, t.locktime, t.is_coinbase, v.size, v.vsize, v.weight, f.fee_satoshis AS fee_sats, CASE WHEN f.fee_satoshis IS NOT NULL THEN {shown('f.fee_satoshis')} END AS fee_coins, i.inputs, o.outputs, n.n_occurrences, n.canonical
FROM transactions t JOIN variants v ON v.wtxid = t.wtxid LEFT JOIN fees f ON f.txid = t.txid
JOIN (SELECT txid, count(*) AS n_occurrences, bool_or(canonical) AS canonical FROM occurrences GROUP BY txid) n ON n.txid = t.txid
JOIN (SELECT i.txid, string_agg(concat(i.vin_index, ':', coalesce(i.prev_txid, '-'), ':', coalesce(CAST(i.prev_vout_index AS VARCHAR), '-'), ':', i.sequence, ':', coalesce(w.n, 0)), ',' ORDER BY i.vin_index) AS inputs
  FROM inputs i LEFT JOIN (SELECT txid, vin_index, count(*) AS n FROM witness GROUP BY txid, vin_index) w ON w.txid = i.txid AND w.vin_index = i.vin_index GROUP BY i.txid) i ON i.txid = t.txid
JOIN (SELECT o.txid, string_agg(concat(o.vout_index, ':', {shown('o.value_satoshis')}, ':', {_KIND}, ':', coalesce(CAST({_VERSION} AS VARCHAR), '-'), ':', CASE WHEN {_VERSION} IS NULL THEN '-' ELSE substr(script_hex, 5) END, ':', coalesce(o.address, '-'), ':', coalesce(p.n, 0), ':', coalesce(CAST(s.spent AS VARCHAR), '-')), ',' ORDER BY o.vout_index) AS outputs
  FROM outputs o LEFT JOIN state s ON s.txid = o.txid AND s.vout_index = o.vout_index LEFT JOIN (SELECT txid, vout_index, count(*) AS n FROM participants GROUP BY txid, vout_index) p ON p.txid = o.txid AND p.vout_index = o.vout_index GROUP BY o.txid) o ON o.txid = t.txid""",
        STATE, FEES,
    ),
    "genesis_rollup": sql(_A, "SELECT * FROM roll WHERE height = 0", FEES, ACC, EXC, ROLL),
    "decoded_blocks": sql("blocks", "SELECT hash, height, prev_hash, merkle_root, time, bits, nonce, size, weight, tx_count FROM blocks"),
    "decoded_transactions": sql("transactions", "SELECT txid, version, locktime, is_coinbase FROM transactions"),
    "decoded_variants": sql("variants", "SELECT wtxid, txid, size, vsize, weight FROM variants"),
    "decoded_occurrences": sql("occurrences", "SELECT block_hash, block_height, tx_index, txid, wtxid FROM occurrences"),
    "decoded_inputs": sql("inputs", "SELECT txid, vin_index, prev_txid, prev_vout_index, coinbase_hex, CASE WHEN coinbase_hex IS NULL THEN script_sig_hex END AS script_sig_hex, sequence FROM inputs"),
    "decoded_witness": sql("witness", "SELECT wtxid, txid, vin_index, item_index, data_hex FROM witness"),
    "decoded_outputs": sql("outputs", f"SELECT txid, vout_index, value_satoshis, address, script_type, witness_version, script_hex, CASE WHEN witness_version IS NOT NULL THEN substr(script_hex, 5) END AS witness_program FROM (SELECT *, {_KIND} AS script_type, {_VERSION} AS witness_version FROM outputs) o"),
    "decoded_participants": sql("participants", "SELECT txid, vout_index, address, pubkey_hex FROM participants"),
    "tx_occurrences": sql("occurrences", "SELECT txid, block_hash, block_height, tx_index, wtxid, canonical FROM occurrences"),
    "best_occurrence": sql("occurrences", "SELECT txid, block_hash, block_height, canonical, tx_index, wtxid FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY canonical DESC, block_height DESC, block_hash DESC) AS r FROM occurrences) x WHERE r = 1"),
    "address_history": sql(_S, "SELECT * FROM touch", CANON, TOUCH),
    "address_history_counts": sql(_S, "SELECT address, count(*) AS n_transactions, max(block_height) AS last_height FROM touch GROUP BY address", CANON, TOUCH),
    "address_history_page": sql(_S, "SELECT * FROM touch WHERE address = 'n0' AND (block_height, txid) < (1000, 'f') ORDER BY block_height DESC, txid DESC LIMIT 25", CANON, TOUCH),
    "recent_blocks": sql("blocks", "SELECT * FROM blocks WHERE canonical AND height < 1000 ORDER BY height DESC LIMIT 25"),
    "block_transactions": sql("occurrences", 'SELECT block_hash, block_height, canonical, tx_index AS "index", txid, wtxid FROM occurrences WHERE block_height IN (100, 200)'),
    "canonical_shape": sql("blocks", "SELECT count(*) AS n_blocks, min(height) AS min_height, max(height) AS max_height, min(height) = 0 AND count(*) = max(height) + 1 AS contiguous FROM blocks WHERE canonical"),
    "ancestry_breaches": sql("blocks", "SELECT * FROM bad", _BROKEN),
    "first_ancestry_breach": sql("blocks", "SELECT * FROM bad ORDER BY height LIMIT 1", _BROKEN),
    "tx_fees": sql(_A, "SELECT * FROM fees", FEES),
    "block_accounting": sql(_A, "SELECT *, subsidy_satoshis + fee_satoshis - coinbase_output_satoshis AS unclaimed_reward_satoshis, true AS complete, coinbase_output_satoshis > subsidy_satoshis + fee_satoshis AS overclaim FROM acc", FEES, ACC),
    "accounting_completeness": sql("blocks", "SELECT count(*) AS n_blocks, count(*) FILTER (WHERE height % 7 <> 0) AS n_rows, count(*) FILTER (WHERE height % 7 = 0) AS n_missing FROM blocks"),
    "excluded_outputs": sql(_A, "SELECT * FROM exc", EXC),
    "supply_rollup": sql(_A, "SELECT * FROM roll", FEES, ACC, EXC, ROLL),
    "branch_rollup": sql(
        _A,
        """SELECT x.block_hash, x.height, x.excluded_output_satoshis, p.cumulative_subsidy_satoshis + a.subsidy_satoshis AS cumulative_subsidy_satoshis, p.cumulative_fee_satoshis + a.fee_satoshis AS cumulative_fee_satoshis,
  p.cumulative_coinbase_output_satoshis + a.coinbase_output_satoshis AS cumulative_coinbase_output_satoshis, p.cumulative_unclaimed_reward_satoshis + a.subsidy_satoshis + a.fee_satoshis - a.coinbase_output_satoshis AS cumulative_unclaimed_reward_satoshis,
  p.cumulative_excluded_output_satoshis + x.excluded_output_satoshis AS cumulative_excluded_output_satoshis, p.cumulative_utxo_set_value_satoshis + a.coinbase_output_satoshis - a.fee_satoshis - x.excluded_output_satoshis AS cumulative_utxo_set_value_satoshis
FROM exc x JOIN acc a USING (block_hash) JOIN roll p ON p.height = x.height - 1 WHERE NOT x.canonical""",
        FEES, ACC, EXC, ROLL,
    ),
    "rollup_contradictions": sql(_A, "SELECT block_hash, cumulative_fee_satoshis + 1 AS stored_fee, cumulative_fee_satoshis AS supplied_fee FROM roll WHERE height % 5 = 0", FEES, ACC, EXC, ROLL),
    "supply_crosscheck": sql(
        _A,
        """SELECT r.height, r.cumulative_subsidy_satoshis, r.cumulative_fee_satoshis, r.cumulative_coinbase_output_satoshis, r.cumulative_unclaimed_reward_satoshis, r.cumulative_excluded_output_satoshis, r.cumulative_utxo_set_value_satoshis,
  (SELECT CAST(sum(value_satoshis) AS BIGINT) FROM state WHERE NOT spent) AS direct_utxo_satoshis, d.* FROM (SELECT * FROM roll ORDER BY height DESC LIMIT 1) r,
  (SELECT CAST(sum(subsidy_satoshis) AS BIGINT) AS direct_subsidy_satoshis, CAST(sum(fee_satoshis) AS BIGINT) AS direct_fee_satoshis, CAST(sum(coinbase_output_satoshis) AS BIGINT) AS direct_coinbase_output_satoshis, CAST(sum(subsidy_satoshis + fee_satoshis - coinbase_output_satoshis) AS BIGINT) AS direct_unclaimed_reward_satoshis
   FROM acc JOIN blocks b ON b.hash = acc.block_hash WHERE b.canonical) d""",
        STATE, FEES, ACC, EXC, ROLL,
    ),
    "balance_distribution": sql(_S, "SELECT b.bucket_id, b.min_balance_satoshis, b.max_balance_satoshis, count(a.address) AS address_count, CAST(coalesce(sum(a.balance_satoshis), 0) AS BIGINT) AS balance_satoshis FROM buckets b LEFT JOIN addr a ON a.balance_satoshis >= b.min_balance_satoshis AND (b.max_balance_satoshis IS NULL OR a.balance_satoshis <= b.max_balance_satoshis) GROUP BY ALL", STATE, ADDR, _BUCKETS),
    "distribution_filtered": sql(_S, _filtered(), STATE, ADDR),
    "rollback_utxo_set": sql(_S, "SELECT txid, vout_index, value_satoshis, creating_height FROM state_r WHERE NOT spent", _ROLLED, _rolled(STATE)),
    "rollback_addresses": sql(_S, "SELECT * FROM addr_r", _ROLLED, _rolled(STATE), _rolled(ADDR)),
    "rollback_touched": sql(_S, "SELECT DISTINCT address FROM touch WHERE block_height > 700", CANON, TOUCH),
    "distribution_delta": sql(
        _S,
        f"""SELECT bucket_id, CAST(sum(n) AS BIGINT) AS count_delta, CAST(sum(s) AS BIGINT) AS balance_delta FROM (
  SELECT {bucket('balance_satoshis')} AS bucket_id, -1 AS n, -balance_satoshis AS s FROM addr WHERE balance_satoshis > 0 UNION ALL SELECT {bucket('balance_satoshis')}, 1, balance_satoshis FROM addr_r WHERE balance_satoshis > 0) x
GROUP BY bucket_id HAVING sum(n) <> 0 OR sum(s) <> 0""",
        STATE, ADDR, _ROLLED, _rolled(STATE), _rolled(ADDR),
    ),
    "common_ancestor": sql("blocks", "SELECT height AS ancestor_height, hash AS ancestor_hash FROM blocks WHERE canonical AND height = (SELECT least(799, max(height)) FROM blocks)"),
    "child_counts": sql("outputs", "SELECT txid, count(*) AS expected, count(*) FILTER (WHERE vout_index <> 1) AS found FROM outputs GROUP BY txid HAVING count(*) FILTER (WHERE vout_index = 1) > 0"),
    "new_rows": sql("blocks", "SELECT hash, height, prev_hash, size FROM blocks WHERE height >= 500"),
    "script_class": sql("outputs", f"SELECT {_KIND} AS script_type, {_VERSION} AS witness_version, script_hex LIKE '6a%' AS unspendable, count(*) AS n, CAST(sum(CASE {_KIND} WHEN 'multisig' THEN 2 WHEN 'p2pk' THEN 1 ELSE 0 END) AS BIGINT) AS n_keys FROM outputs GROUP BY 1, 2, 3"),
    "script_witness_programs": sql("outputs", f"SELECT txid, vout_index, {_KIND} AS script_type, {_VERSION} AS witness_version, substr(script_hex, 5) AS witness_program FROM outputs WHERE script_hex LIKE '0014%' OR script_hex LIKE '5220%'"),
    "witness_metadata": sql("outputs", f"SELECT {_KIND} AS script_type, count(*) AS n_ok, count(*) FILTER (WHERE {_VERSION} IS NULL) AS n_ok_cut FROM outputs GROUP BY 1"),
    "unspendable_outputs": sql("outputs", "SELECT txid, vout_index, value_satoshis, CAST(length(script_hex) // 2 AS INT) AS size_bytes FROM outputs WHERE script_hex LIKE '6a%'"),
    "identifier_search": sql(
        "blocks transactions mempool",
        """SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM (
  SELECT hash AS id, 1 AS r, 'block' AS kind FROM blocks
  UNION ALL SELECT txid, 2, 'transaction' FROM transactions
  UNION ALL SELECT wtxid, 3, 'variant' FROM transactions
  UNION ALL SELECT txid, 4, 'mempool transaction' FROM mempool
  UNION ALL SELECT wtxid, 5, 'mempool variant' FROM mempool) x) y WHERE k = 1""",
    ),
    "subsidy_by_height": f"SELECT height, CAST({SUBSIDY.format(MAIN)} AS BIGINT) AS main, CAST({SUBSIDY.format(REGTEST)} AS BIGINT) AS regtest FROM (SELECT o_orderkey * 37 % 20000000 AS height FROM orders) x",
    "scheduled_subsidy": "SELECT height, "
    + ", ".join(f"(SELECT CAST(sum(greatest(0, least(x.height + 1 - e * {n}, {n})) * ({INITIAL} >> CAST(e AS INT))) AS BIGINT) FROM range(0, 64) r(e)) AS {name}" for n, name in ((MAIN, "main_total"), (REGTEST, "regtest_total")))
    + " FROM (SELECT o_orderkey * 37 % 20000000 AS height FROM orders) x",
    "amount_format": f"SELECT l_orderkey, l_partkey, l_linenumber, sats, {shown('v')} AS shown, CAST(sign(v) * (abs(v) // {COIN}) AS BIGINT) AS whole FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -sats ELSE sats END AS v FROM (SELECT *, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 1000000 AS BIGINT) AS sats FROM lineitem) y) x",
    "amount_validation": """SELECT event_id, text, n IN (0, 1, 5, 6) AS valid, CAST(CASE n WHEN 0 THEN event_id * 100000000 WHEN 1 THEN event_id * 100000000 + 50000000 WHEN 5 THEN event_id WHEN 6 THEN event_id * 100000000 END AS BIGINT) AS sats FROM (
  SELECT event_id, event_id % 8 AS n, CASE event_id % 8 WHEN 0 THEN concat(event_id) WHEN 1 THEN concat(event_id, '.5') WHEN 2 THEN concat(event_id, '.123456789') WHEN 3 THEN concat(event_id, 'e-8') WHEN 4 THEN concat('-', event_id) WHEN 5 THEN concat('.', lpad(concat(event_id), 8, '0')) WHEN 6 THEN concat(event_id, '.') ELSE '.' END AS text FROM events) x""",
    "bucket_of_balance": f"SELECT event_id, balance, {bucket('balance')} AS bucket_id FROM (SELECT event_id, event_id * event_id * 3000000 - 1000000000 AS balance FROM events) x",
    "mempool_state": sql("mempool", "SELECT count(*) AS tx_count, CAST(sum(vsize) AS BIGINT) AS total_vsize, CAST(sum(fee_satoshis) AS BIGINT) AS total_fee_satoshis FROM mempool"),
    "mempool_page": sql("mempool", "SELECT txid, entry_time, fee_satoshis, vsize, replaceable, CASE WHEN replaceable IS NULL THEN 'unknown' WHEN replaceable THEN 'yes' ELSE 'no' END AS replaceable_label, concat(strftime(make_timestamp(entry_time * 1000000), '%Y-%m-%d %H:%M:%S'), ' UTC') AS entered FROM mempool WHERE (entry_time, txid) < ((SELECT min(entry_time) + (max(entry_time) - min(entry_time)) // 2 FROM mempool), 'f') ORDER BY entry_time DESC, txid DESC LIMIT 100"),
    "mempool_dependencies": sql("mempool depends", "SELECT d.txid, d.depends_on_txid, EXISTS (SELECT 1 FROM mempool m WHERE m.txid = d.depends_on_txid AND m.event_id % 7 <> 3) AS inside, 'mempool' AS kind FROM depends d"),
    "mempool_freshness": sql("blocks", "SELECT height, CASE WHEN height % 3 = 0 THEN 'uninitialized' WHEN height = (SELECT max(height) FROM blocks WHERE canonical) THEN 'fresh' ELSE 'stale' END AS state FROM blocks WHERE canonical"),
    "deployment_decode": """SELECT concat('d', event_id) AS name, string_agg(rule, ',' ORDER BY rule) AS broken FROM (
  SELECT event_id, 'type' AS rule FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT event_id, 'buried has a height' FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT event_id, 'bit' FROM events WHERE event_id % 31 > 28
  UNION ALL SELECT event_id, 'status' FROM events WHERE event_id % 13 = 0 AND event_id % 11 <> 0
  UNION ALL SELECT event_id, 'since' FROM events WHERE event_id < 5 AND event_id % 11 <> 0
  UNION ALL SELECT event_id, 'statistics' FROM events WHERE event_id % 120 > 100 OR event_id % 50 > event_id % 120) x GROUP BY event_id""",
}
