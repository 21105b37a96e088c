"""Stable hashes as Column expressions: draws, ranks and ids that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts, sep: str = ":") -> Column:
    return F.concat_ws(sep, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hex_rank(seed, value: Column) -> Column:
    """First 16 hex digits of SHA-256("{seed}:{value}"): they sort as the unsigned 64-bit number does."""
    return F.substring(F.sha2(joined(seed, value.cast("string")), 256), 1, 16)


def unit_draw(text: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256 of a string."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<20 hex digits> over the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 20))


def scoped_id(scope: Column, value: Column) -> Column:
    """One-way id of a value within a scope; a zero character lies between them."""
    return F.sha2(F.concat(scope, F.lit("\0"), value), 256)
