"""Deterministic pseudo-random draws.

An engine-side ``rand`` depends on how rows are partitioned, so draws come
from the MD5 of the seed and the row's identity: the same row gets the same
draw on any cluster, and a retried task repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thirteen hex digits are 52 bits, the most a double holds exactly.
_HEX_DIGITS = 13
_SCALE = float(16**_HEX_DIGITS)


def draw_key(*parts) -> Column:
    """Hex digest that orders rows at random but repeatably."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(*parts) -> Column:
    """Uniform in [0, 1)."""
    return F.conv(F.substring(draw_key(*parts), 1, _HEX_DIGITS), 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform_between(low: float, high: float, *parts) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(*parts)


def integer_between(low, high, *parts) -> Column:
    """Uniform integer in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(*parts) * (high - low + 1))).cast("int")
