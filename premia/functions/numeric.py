"""Numbers: rounding of scaled values, finite checks, quantiles and hash-based uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int = 6) -> Column:
    """value at so many places: the scaled value rounded half to even."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def finite(value: Column) -> Column:
    """Whether value is a number, neither NaN nor infinite; false for null."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends only on the parts: 32 bits of the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
