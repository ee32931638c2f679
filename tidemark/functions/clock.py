"""Time buckets since 2020-01-01 UTC, strides with an origin, and durations in text."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2020-01-01T00:00:00Z in Unix seconds, from which buckets count.
EPOCH = 1_577_836_800
_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_of(ts: Column, width: int) -> Column:
    """floor((ts - EPOCH) / width); times before EPOCH are an error, as a bucket can't be negative."""
    at = F.floor((micros(ts) - EPOCH * 1_000_000) / F.lit(width * 1_000_000)).cast("long")
    return F.when(at >= 0, at).when(at.isNotNull(), F.raise_error(F.lit("time before 2020-01-01 has no bucket")).cast("long"))


def bucket_start(bucket: Column, width: int) -> Column:
    return F.timestamp_seconds(bucket * width + EPOCH).cast("timestamp_ntz")


def date_bin(ts: Column, stride_seconds: int, origin_seconds: int = 0) -> Column:
    """The start of the stride that ts lies in; strides begin at the origin."""
    step = stride_seconds * 1_000_000
    off = micros(ts) - origin_seconds * 1_000_000
    return F.timestamp_micros(off - F.pmod(off, F.lit(step)) + origin_seconds * 1_000_000).cast("timestamp_ntz")


def month_bin(ts: Column, months: int, origin_year: int = 1970) -> Column:
    """Calendar strides of whole months from January of the origin's year."""
    m = (F.year(ts) - origin_year) * 12 + F.month(ts) - 1
    at = m - F.pmod(m, F.lit(months))
    return F.add_months(F.lit(f"{origin_year:04d}-01-01").cast("date"), at).cast("timestamp_ntz")


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as `1.5m`; exact, non-negative, with a unit."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d|w)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    n = Fraction(m[1]) * _UNITS[m[2]]
    if n.denominator != 1:
        raise ValueError(f"finer than a nanosecond: {text!r}")
    return int(n)
