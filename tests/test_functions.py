"""Pure functions against known vectors."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import params
from ledgerloom.functions.buckets import bucket_of
from ledgerloom.functions.display import genesis_hash
from ledgerloom.functions.money import COIN, format_amount, parse_amount, whole_coins
from ledgerloom.functions.scripts import classify, walk, witness_metadata_ok
from ledgerloom.functions.subsidy import UnknownNetwork, schedule_for


def test_amounts(spark):
    cases = [("12.5", 1_250_000_000), ("0.00000001", 1), (".5", 50_000_000), ("7.", 700_000_000), ("92233720368.54775807", 2**63 - 1), ("0.123456789", None), ("1e-8", None), ("-1", None), ("", None), (".", None), ("1\n", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want long")
    assert [(r.t, r.got) for r in df.select("t", parse_amount(F.col("t")).alias("got")).collect()] == cases
    shown = spark.createDataFrame([(0,), (1,), (-1,), (-150_000_000,), (2**63 - 1,), (-(2**63),)], "v long")
    rows = shown.select(format_amount(F.col("v")).alias("s"), whole_coins(F.col("v")).cast("long").alias("w")).collect()
    assert [r.s for r in rows] == ["0.00000000", "0.00000001", "-0.00000001", "-1.50000000", "92233720368.54775807", "-92233720368.54775808"]
    assert [r.w for r in rows][:4] == [0, 0, 0, -1]


def test_overflow_raises(spark):
    df = spark.createDataFrame([("92233720368.54775808",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|OVERFLOW"):
        df.select(parse_amount(F.col("t")).alias("v")).collect()


def test_subsidy(spark):
    main, reg = schedule_for("main"), schedule_for("regtest")
    heights = [0, 499_999, 500_000, 999_999, 1_000_000, 1_999_999, 2_000_000, 16_999_999, 17_000_000, 40_000_000]
    df = spark.createDataFrame([(h,) for h in heights], "h long")
    got = [r.s for r in df.select(main.at(F.col("h")).alias("s")).collect()]
    assert got == [100 * COIN, 100 * COIN, 50 * COIN, 50 * COIN, 25 * COIN, 1_250_000_000, 625_000_000, 1, 0, 0]
    small = spark.range(0, 6000, 7).select(F.col("id").alias("h"))
    naive = 0
    total = {}
    for h in range(6000):
        naive += (100 * COIN) >> (h // 150) if h // 150 < 64 else 0
        total[h] = naive
    for r in small.select("h", reg.through(F.col("h")).alias("s")).collect():
        assert r.s == total[r.h]
    with pytest.raises(UnknownNetwork):
        schedule_for("moon")


def test_buckets(spark):
    cases = [(-1, None), (0, None), (1, "lt_1"), (COIN - 1, "lt_1"), (COIN, "1_10"), (10**9, "10_100"), (10**10, "100_1k"), (10**11, "1k_10k"), (10**12, "10k_100k"), (10**13, "100k_1m"), (10**14, "gte_1m"), (None, None)]
    df = spark.createDataFrame(cases, "v long, want string")
    assert all(r.want == r.got for r in df.select("want", bucket_of(F.col("v")).alias("got")).collect())


KEY = b"\x02" + b"\x11" * 32


@pytest.mark.parametrize(
    ("script", "kind", "unspendable"),
    [
        (b"\x00\x14" + b"a" * 20, "p2wpkh", False),
        (b"\x00\x20" + b"a" * 32, "p2wsh", False),
        (b"\x51\x20" + b"a" * 32, "p2tr", False),
        (b"\x52\x20" + b"a" * 32, "p2qpk", False),
        (b"\x52\x1f" + b"a" * 31, "unknown_witness", False),
        (b"\x00\x15" + b"a" * 21, "unknown", False),
        (b"\x76\xa9\x14" + b"a" * 20 + b"\x88\xac", "p2pkh", False),
        (b"\xa9\x14" + b"a" * 20 + b"\x87", "p2sh", False),
        (b"\x21" + KEY + b"\xac", "p2pk", False),
        (b"\x21\x05" + b"\x11" * 32 + b"\xac", "unknown", False),
        (b"\x6a\x02ab", "nulldata", True),
        (b"\x6a", "nulldata", True),
        (b"\x6a\x05ab", "unknown", True),
        (b"\x6a\x61", "unknown", True),
        (b"\x51\x21" + KEY + b"\x21" + KEY + b"\x52\xae", "multisig", False),
        (b"\x53\x21" + KEY + b"\x21" + KEY + b"\x52\xae", "unknown", False),
        (b"\x01\x11" + (b"\x21" + KEY) * 17 + b"\x01\x11\xae", "multisig", False),
        (b"", "unknown", False),
        (b"\x51" * 10_001, "unknown", True),
    ],
)
def test_script_class(spark, script, kind, unspendable):
    r = classify(spark.createDataFrame([(script,)], "script_pubkey binary")).first()
    assert (r.script_type, r.unspendable) == (kind, unspendable)
    if kind == "multisig":
        assert len(r.pubkeys) == walk(script)[2]


def test_witness_metadata_is_never_null(spark):
    cases = [("p2qpk", 2, b"a" * 32, True), ("p2qpk", None, None, False), ("p2qpk", 1, b"a" * 32, False), ("p2qpk", 2, b"a" * 31, False), ("p2pkh", None, None, True), ("p2pkh", 0, b"a" * 20, False), ("unknown_witness", 2, b"a" * 31, True), ("unknown_witness", 0, b"a" * 31, False)]
    df = spark.createDataFrame(cases, "k string, v int, p binary, want boolean")
    for r in df.select("*", witness_metadata_ok(F.col("k"), F.col("v"), F.col("p")).alias("got")).collect():
        assert r.got is r.want, r


def test_parameters():
    assert [params.page_size(n) for n in (None, 0, -1, 7, 1000)] == [25, 25, 25, 7, 100]
    assert params.block_identifier("a" * 64) == ("hash", "a" * 64)
    assert params.block_identifier("17") == ("height", 17)
    with pytest.raises(params.BadRequest):
        params.height("1x")
    with pytest.raises(params.BadRequest):
        params.both_or_neither(before=1, before_txid=None)
    with pytest.raises(ValueError):
        genesis_hash("signet")
