"""UTF-8 helpers over binary and text columns, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(c: Column) -> Column:
    """Whether bytes are UTF-8; null for null."""
    return F.is_valid_utf8(c.cast("string"))


def made_valid(c: Column) -> Column:
    """Bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def truncated(c: Column, n_bytes: int) -> Column:
    """The longest start of a text with at most n_bytes bytes that cuts no character."""
    raw = c.cast("binary")
    # a character has at most four bytes, so the cut is at most three bytes before the limit
    cut = F.substring(raw, 1, n_bytes)
    whole = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, 1, max(0, n_bytes - k)).cast("string")), F.substring(raw, 1, max(0, n_bytes - k))) for k in range(4)], cut)
    return F.when(F.octet_length(raw) <= n_bytes, c.cast("string")).otherwise(whole.cast("string"))


def compare_caseless(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the lower-cased texts' bytes."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 0).when(x < y, -1).when(x > y, 1)


def joined(*texts: Column) -> Column:
    """The texts one after another, made valid; null counts as empty."""
    return F.concat(*[F.coalesce(made_valid(t), F.lit("")) for t in texts])
