"""Exact money: whole satoshis in longs; decimal text only at the edges. ANSI arithmetic raises on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COIN = 100_000_000
#: Digits, then at most eight decimals; no sign, no exponent. ``\\z``: ``$`` would allow a newline behind.
AMOUNT = r"\A(\d+(\.\d{0,8})?|\.\d{1,8})\z"


def is_amount(text: Column) -> Column:
    return F.coalesce(text.rlike(AMOUNT), F.lit(False))


def parse_amount(text: Column) -> Column:
    """Satoshis of a decimal text such as ``12.5``; null where it isn't one. A ninth decimal is refused, never rounded."""
    whole = F.regexp_extract(text, r"\A(\d*)", 1)
    part = F.rpad(F.regexp_extract(text, r"\.(\d*)\z", 1), 8, "0")
    return F.when(is_amount(text), F.concat(whole, part).cast("long"))


def whole_coins(sats: Column) -> Column:
    """Whole coins, truncated towards zero."""
    return F.call_function("div", sats, F.lit(COIN))


def format_amount(sats: Column) -> Column:
    """``[-]coins.8 digits``; string operations only, so that the smallest long needs no absolute value."""
    digits = F.lpad(F.regexp_replace(sats.cast("string"), "^-", ""), 9, "0")
    digits = F.when(F.length(F.regexp_replace(sats.cast("string"), "^-", "")) > 9, F.regexp_replace(sats.cast("string"), "^-", "")).otherwise(digits)
    shown = F.regexp_replace(digits, r"(\d{8})$", ".$1")
    return F.when(sats < 0, F.concat(F.lit("-"), shown)).otherwise(shown)
