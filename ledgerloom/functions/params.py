"""Checks of request parameters, before any plan is built."""

from __future__ import annotations

import re

# Page sizes.
DEFAULT_PAGE, MAX_PAGE = 25, 100
_HASH = re.compile(r"[0-9a-f]{64}")
_DIGITS = re.compile(r"[0-9]+")
# The longest address, and the longest deployment name, which is all that its writer asks of a name.
_ADDRESS = re.compile(r"[!-~]{1,128}")
MAX_NAME = 128


class BadRequest(ValueError):
    pass


def page_size(n: int | None) -> int:
    return DEFAULT_PAGE if n is None or n <= 0 else min(n, MAX_PAGE)


def is_hash(text: str) -> bool:
    return bool(_HASH.fullmatch(text))


def is_address(text: str) -> bool:
    return bool(_ADDRESS.fullmatch(text))


def is_name(text: str) -> bool:
    return 0 < len(text.encode()) <= MAX_NAME


def height(text: str | int) -> int:
    if isinstance(text, int) and not isinstance(text, bool) and text >= 0:
        return text
    if isinstance(text, str) and _DIGITS.fullmatch(text) and int(text) < 1 << 63:
        return int(text)
    raise BadRequest(f"not a height: {text!r}")


def block_identifier(text: str) -> tuple[str, str | int]:
    """64 hex digits are a hash; digits are a height."""
    if is_hash(text):
        return "hash", text
    return "height", height(text)


def both_or_neither(**named) -> None:
    if len({v is None for v in named.values()}) > 1:
        raise BadRequest(f"{' and '.join(named)} go together")
