"""Seeded draws that any engine can repeat: digits of an MD5 digest instead of a generator's state."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.values import Name, col


def digest(salt: str, *by: Name) -> Column:
    """Lower-case hex of "salt:by1:by2..."; null parts are empty."""
    parts = [F.coalesce(col(b).cast("string"), F.lit("")) for b in by]
    return F.md5(F.concat_ws(":", F.lit(salt), *parts))


def draw(n: Name, salt: str, *by: Name) -> Column:
    """A whole number from 0 to n - 1, the same for the same salt and values; null unless n is positive."""
    value = F.conv(F.substring(digest(salt, *by), 1, 8), 16, 10).cast("long")
    n = F.lit(n) if isinstance(n, int) else col(n)
    return F.when(n > 0, value % n)


def draw_between(low: Name, high: Name, salt: str, *by: Name) -> Column:
    """A whole number from low to high; null if there is none."""
    low = F.lit(low) if isinstance(low, int) else col(low)
    high = F.lit(high) if isinstance(high, int) else col(high)
    return low + draw(high - low + 1, salt, *by)


def normal(mean: Name, deviation: Name, salt: str, *by: Name) -> Column:
    """A normally distributed number, from two uniform ones of one digest."""
    d = digest(salt, *by)
    u = [F.conv(F.substring(d, at, 8), 16, 10).cast("double") / float(1 << 32) for at in (1, 9)]
    standard = F.sqrt(-2 * F.log(u[0] + 0.5 / (1 << 32))) * F.cos(2 * math.pi * u[1])
    lit = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else col(x)
    return lit(mean) + lit(deviation) * standard


def shuffled(values: Column, salt: str, *by: Name) -> Column:
    """An array of texts in drawn order; equal values keep together."""
    pairs = F.transform(values, lambda x: F.struct(digest(salt, *by, x).alias("d"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])
