"""Script classification on binary columns.

Fixed templates are native expressions inside whole-stage codegen. Two shapes are of variable length and need a walk
through pushes: push-only data carriers and bare multisig. Only scripts that begin like one of these reach the Arrow UDF;
for all others it gets a null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The script types, and by witness version and program length the types of witness programs.
SCRIPT_TYPES = ("p2pk", "p2pkh", "p2sh", "p2wpkh", "p2wsh", "p2tr", "p2qpk", "nulldata", "multisig", "unknown_witness", "unknown")
WITNESS_TYPES = {(0, 20): "p2wpkh", (0, 32): "p2wsh", (1, 32): "p2tr", (2, 32): "p2qpk"}
MAX_SCRIPT = 10_000
MAX_KEYS = 20
OP_0, OP_1, OP_16, OP_RETURN, OP_CHECKSIG, OP_CHECKMULTISIG = 0x00, 0x51, 0x60, 0x6A, 0xAC, 0xAE

WALK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("m", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.BinaryType()))])


def byte_is(script: Column, position: int, *values: int) -> Column:
    """Whether the byte at a position from 0 is one of some values; false behind the end."""
    one = F.substring(script, position + 1, 1)
    found = F.lit(False)
    for v in values:
        found = found | (one == F.lit(bytes([v])))
    return found


def _is(script: Column, length: int, head: bytes, tail: bytes = b"") -> Column:
    same = (F.octet_length(script) == length) & (F.substring(script, 1, len(head)) == F.lit(head))
    return same & (F.substring(script, length - len(tail) + 1, len(tail)) == F.lit(tail)) if tail else same


def is_bare_key(script: Column) -> Column:
    """One key and a check of its signature."""
    return (_is(script, 35, b"\x21", b"\xac") & byte_is(script, 1, 2, 3)) | (_is(script, 67, b"\x41", b"\xac") & byte_is(script, 1, 4, 6, 7))


def is_unspendable(script: Column) -> Column:
    """A data carrier by its first byte, or too long to run; independent of the class."""
    return (F.substring(script, 1, 1) == F.lit(bytes([OP_RETURN]))) | (F.octet_length(script) > MAX_SCRIPT)


def witness_program(script: Column) -> tuple[Column, Column, Column]:
    """(is one, version, program): a version opcode, then one direct push of 2 to 40 bytes to the very end.

    On the hex digits of the first two bytes, as the expression is copied into several others."""
    head, size = F.hex(F.substring(script, 1, 2)), F.octet_length(script)
    ok = head.rlike(r"\A(00|5[1-9A-F]|60)(0[2-9A-F]|1[0-9A-F]|2[0-8])\z") & (F.substring(head, 3, 2) == F.lpad(F.hex(size - 2), 2, "0"))
    version = F.when(head.startswith("60"), 16).otherwise(F.conv(F.substring(head, 2, 1), 16, 10).cast("int"))
    return F.coalesce(ok, F.lit(False)), F.when(ok, version), F.when(ok, F.substring(script, 3, 40))


def is_pubkey(length: int, prefix: int) -> bool:
    return (length == 33 and prefix in (2, 3)) or (length == 65 and prefix in (4, 6, 7))


def _pushes(script: bytes, at: int) -> Iterator[tuple[int, bytes | None, int]] | None:
    """(opcode, pushed bytes or None, next position) until the end; a truncated push yields a next position of -1."""
    while at < len(script):
        op = script[at]
        width = op if op <= 75 else None
        at += 1
        if op in (76, 77, 78):
            n = 1 << (op - 76)
            if at + n > len(script):
                yield op, None, -1
                return
            width, at = int.from_bytes(script[at : at + n], "little"), at + n
        if width is None:
            yield op, None, at
        elif at + width > len(script):
            yield op, None, -1
            return
        else:
            yield op, script[at : at + width], at + width
            at += width


def _small_number(op: int, data: bytes | None) -> int | None:
    """1 to 16 by opcode; 17 to MAX_KEYS by a push of one byte."""
    if OP_1 <= op <= OP_16:
        return op - OP_1 + 1
    return data[0] if op == 1 and data and 16 < data[0] <= MAX_KEYS else None


def walk(script: bytes) -> tuple | None:
    if script[0] == OP_RETURN:
        for op, _, to in _pushes(script, 1):
            if to < 0 or op > OP_16:
                return None
        return ("nulldata", None, None, None)
    if script[-1] != OP_CHECKMULTISIG:
        return None
    steps = list(_pushes(script, 0))
    if len(steps) < 4 or any(to < 0 for _, _, to in steps):
        return None
    (first, data, _), *keys, (last, tail, _), (end, _, _) = steps
    m, n = _small_number(first, data), _small_number(last, tail)
    if end != OP_CHECKMULTISIG or m is None or n is None or not m <= n == len(keys) <= MAX_KEYS:
        return None
    found = [d for op, d, _ in keys if d is not None and op <= 75 and is_pubkey(len(d), d[0])]
    return ("multisig", m, n, found) if len(found) == n else None


@F.pandas_udf(WALK)
def _walk(scripts: pd.Series) -> pd.DataFrame:
    rows = [walk(bytes(s)) if s is not None and len(s) else None for s in scripts]
    return pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["kind", "m", "n", "keys"]).astype({"m": "Int32", "n": "Int32"})


def classify(df: DataFrame, script: str = "script_pubkey") -> DataFrame:
    """Add script_type, witness_version, witness_program, pubkeys, required, unspendable."""
    s = F.col(script)
    _, version, program = witness_program(s)
    size = F.octet_length(s)
    fixed = F.when(_is(s, 25, b"\x76\xa9\x14", b"\x88\xac"), "p2pkh").when(_is(s, 23, b"\xa9\x14", b"\x87"), "p2sh")
    fixed = fixed.when(is_bare_key(s), "p2pk")
    for (v, n), name in WITNESS_TYPES.items():
        fixed = fixed.when(_is(s, n + 2, bytes([v and OP_1 - 1 + v, n])), name)
    df = df.withColumn("_fixed", fixed).withColumn("_v", version).withColumn("_p", program)
    walks = (size > 0) & (byte_is(s, 0, OP_RETURN) | (F.substring(s, -1, 1) == F.lit(bytes([OP_CHECKMULTISIG]))))
    df = df.withColumn("_w", _walk(F.when(walks, s)))
    # No fixed template begins like a witness program, and no walk accepts one.
    other = F.when(F.col("_v") == 0, "unknown").when(F.col("_v").isNotNull(), "unknown_witness")
    pubkey = F.when(F.col("_fixed") == "p2pk", F.array(F.expr(f"substring({script}, 2, octet_length({script}) - 2)")))
    return df.select(
        *(c for c in df.columns if not c.startswith("_")),
        F.coalesce("_fixed", other, "_w.kind", F.lit("unknown")).alias("script_type"),
        F.col("_v").alias("witness_version"),
        F.col("_p").alias("witness_program"),
        F.coalesce(pubkey, F.col("_w.keys")).alias("pubkeys"),
        F.col("_w.m").alias("required"),
        F.coalesce(is_unspendable(s), F.lit(False)).alias("unspendable"),
    )


def witness_metadata_ok(kind: Column, version: Column, program: Column) -> Column:
    """Whether version and program fit the type; never null, so that a check on it can't pass by not knowing."""
    size = F.octet_length(program)
    named = F.lit(False)
    for (v, n), name in WITNESS_TYPES.items():
        named = named | ((kind == name) & (version == v) & (size == n))
    unnamed = F.lit(True)
    for v, n in WITNESS_TYPES:
        unnamed = unnamed & ~((version == v) & (size == n))
    other = (kind == "unknown_witness") & version.between(1, 16) & size.between(2, 40) & unnamed
    zero = (kind == "unknown") & (version == 0) & size.between(2, 40) & unnamed
    none = ~kind.isin(*WITNESS_TYPES.values(), "unknown_witness") & version.isNull() & program.isNull()
    return F.coalesce(named, F.lit(False)) | F.coalesce(other, F.lit(False)) | F.coalesce(zero, F.lit(False)) | F.coalesce(none, F.lit(False))
