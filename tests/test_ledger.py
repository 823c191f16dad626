"""Every ledger query against its SQL, and the gates of the rebuilds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chain
from ledgerloom.operators.rules import IntegrityError, assert_rules, insert_or_verify
from ledgerloom.plans.oracle import SQL
from ledgerloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    other = duck.execute(SQL[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    want = _norm(columns, other.fetchall())
    assert want
    assert _norm(df.columns, df.collect()) == want


def test_insert_or_verify(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert insert_or_verify(a, spark.createDataFrame([(2, None), (3, "z"), (3, "z")], "k int, v string"), ["k"], "t").collect() == [(3, "z")]
    for bad in ([(1, "y")], [(2, "n")], [(4, "a"), (4, "b")]):
        with pytest.raises(IntegrityError):
            insert_or_verify(a, spark.createDataFrame(bad, "k int, v string"), ["k"], "t")


def test_null_is_a_breach(spark):
    with pytest.raises(IntegrityError, match="positive"):
        assert_rules(spark.createDataFrame([(None,)], "v int"), {"positive": F.col("v") > 0}, "t")


def test_running_sums_over_chunks(spark):
    df = spark.range(1000).select(F.col("id").alias("h"), (F.col("id") * 3).alias("v"))
    got = chain.running_sums(df, "h", {"v": "s"}, chunk=64).orderBy("h").collect()
    assert [r.s for r in got] == [3 * h * (h + 1) // 2 for h in range(1000)]


def test_lineage(spark):
    rows = [(f"b{k}", f"b{k - 1}" if k else None) for k in range(40)] + [("x", "b3")]
    blocks = spark.createDataFrame(rows, "hash string, prev_hash string")
    assert {r.hash for r in chain.lineage(blocks, "x").collect()} == {"x", "b0", "b1", "b2", "b3"}
    assert chain.lineage(blocks, "b39").count() == 40


def test_a_query_stores_only_the_tables_it_reads(spark, sf, tmp_path):
    import os

    from ledgerloom.plans.projection import ledger, stored

    os.symlink(sf, tmp_path / "in")
    g = ledger(spark, str(tmp_path / "in"))
    assert g.but(blocks=g.blocks).occurrences.filter("canonical").count()
    assert set(stored(spark, str(tmp_path / "in"), "blocks").manifest["tables"]) == {"blocks", "occurrences"}


def test_wide_tables_are_hashed_as_they_are_read(spark, sf, tmp_path):
    import os

    from ledgerloom.plans.projection import VIEWS, ledger, stored

    os.symlink(sf, tmp_path / "in")
    g = ledger(spark, str(tmp_path / "in"))
    assert all(getattr(g, name).count() for name in VIEWS)
    assert set(stored(spark, str(tmp_path / "in"), "blocks").manifest["tables"]) == {"blocks"}


def test_documents_in_slices(spark, sf, tmp_path, monkeypatch):
    """All blocks and transactions, whatever the number of slices, and no slice left behind."""
    from ledgerloom.plans import documents
    from ledgerloom.plans.projection import ledger
    from ledgerloom.sources.store import Store

    g = ledger(spark, sf)
    monkeypatch.setattr(documents, "SLICE", 4_000)
    parsed = documents.parsed_documents(g, Store(spark, str(tmp_path)))
    assert parsed.count() == g.blocks.count()
    ids = parsed.select("hash", F.explode("tx").alias("t")).select("hash", "t.txid", "t.hash")
    assert sorted(ids.collect()) == sorted(g.occurrences.select("block_hash", "txid", "wtxid").collect())
    assert not list(tmp_path.glob("*/placed"))


def test_repeats_of_transactions(spark):
    """Of a transaction in three blocks, once as another variant: the first place of the hash and of the txid stay."""
    from ledgerloom.operators.decode import repeats

    a, b, c = "aa", "bb", "cc"
    rows = [("h1", 1, 0, (a, a)), ("h2", 2, 3, (a, b)), ("h3", 3, 1, (a, a)), ("h3", 3, 2, (c, c)), ("h3", 3, 4, (a, b))]
    each = spark.createDataFrame(rows, "hash string, height long, tx_index int, t struct<txid:string,hash:string>")
    got = {r.hash: (sorted(r.again_hash), sorted(r.again_txid)) for r in repeats(each).collect()}
    assert got == {"h2": ([], [3]), "h3": ([1, 4], [1, 4])}


def test_details_in_slices(spark, sf, tmp_path, monkeypatch):
    """The same rows, whatever the number of slices: spends and values come from other slices."""
    from ledgerloom.plans import details, documents
    from ledgerloom.plans.projection import ledger
    from ledgerloom.sources.store import Store

    monkeypatch.setattr(documents, "SLICE", 4_000)
    columns = lambda d: d.select("txid", "fee_sats", F.to_json("inputs").alias("i"), F.to_json("outputs").alias("o"), F.to_json("occurrences").alias("at"))
    sliced = details.detail_rows(ledger(spark, sf), Store(spark, str(tmp_path / "a")), columns)
    assert not [p for d in ("spends", "values") for p in tmp_path.glob(f"*/*/{d}")]
    monkeypatch.setattr(documents, "SLICE", 10**9)
    whole = details.detail_rows(ledger(spark, sf), Store(spark, str(tmp_path / "b")), columns)
    assert sorted(sliced.collect()) == sorted(whole.collect())
