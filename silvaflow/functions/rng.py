"""Seeded draws from md5: the 16 bytes of md5(key), read as a little-endian unsigned integer, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG_PRIME = (1 << 62) - 57


def rank_key(key: Column) -> Column:
    """A string that sorts as the draw of key does: its bytes reversed, in hex."""
    return F.regexp_replace(F.reverse(F.md5(key)), "(.)(.)", "$2$1")


def _limb(hexed: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(hexed, at, width), 16, 10)


def draw_mod(key: Column, n: int | Column) -> Column:
    """The draw of key modulo n, 1 <= n < 2^31."""
    n = F.lit(n) if isinstance(n, int) else n
    hexed, out = rank_key(key), F.lit(0).cast("long")
    for i in range(4):
        out = (out * F.lit(1 << 32) + _limb(hexed, 1 + 8 * i, 8).cast("long")) % n.cast("long")
    return out


def draw_mod_large(key: Column, n: int = BIG_PRIME) -> Column:
    """The draw of key modulo n, n < 2^63, as a long."""
    hexed, out = rank_key(key), F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        limb = _limb(hexed, 1 + 8 * i, 8).cast("decimal(20,0)")
        out = ((out * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)") + limb).cast("decimal(38,0)") % F.lit(n).cast("decimal(20,0)")
        out = out.cast("decimal(20,0)")
    return out.cast("long")


def draw_unit(key: Column) -> Column:
    """The draw of key modulo 2^53, divided by 2^53."""
    low = _limb(rank_key(key), 17, 16).cast("decimal(20,0)") % F.lit(1 << 53).cast("decimal(20,0)")
    return low.cast("double") / F.lit(float(1 << 53))


def draw_is_even(key: Column) -> Column:
    return _limb(rank_key(key), 32, 1).cast("int") % 2 == 0
