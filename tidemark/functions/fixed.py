"""Fixed-point numbers: value * 10^scale as BIGINT, so that sums are exact and don't depend on order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest scale, and the magnitude that a stored number stays below.
MAX_SCALE, LIMIT = 18, 2.0**62


def to_fixed(value: Column, scale: int) -> Column:
    """Half away from zero on value * 10^scale; null for null, non-finite and out-of-range values."""
    if not 0 <= scale <= MAX_SCALE:
        raise ValueError(f"scale {scale} is not in 0..{MAX_SCALE}")
    scaled = F.round(value.cast("double") * float(10**scale))
    return F.when(~F.isnan(scaled) & (F.abs(scaled) < LIMIT), scaled.cast("long"))


def from_fixed(fixed: Column, scale: int) -> Column:
    return fixed.cast("double") / float(10**scale)


def out_of_range(value: Column, scale: int) -> Column:
    """Whether a finite value is too large to store at the scale."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & to_fixed(value, scale).isNull()


def quantized(literal: float, scale: int) -> float:
    """A literal as a column of this scale would hold it; what comparisons use."""
    if not math.isfinite(literal):
        raise ValueError("a literal must be finite")
    x = abs(literal) * 10**scale
    return math.copysign(math.floor(x + 0.5), literal) / 10**scale
