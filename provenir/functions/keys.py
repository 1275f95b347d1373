"""Keys, hashes and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corridor_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def age_hours(since: Column, now: Column) -> Column:
    """Hours between two timestamps, never negative; null when either is missing."""
    hours = (F.unix_micros(now) - F.unix_micros(since)) / F.lit(3.6e9)
    # greatest() skips nulls, which would turn a missing time into age zero.
    return F.when(hours.isNotNull(), F.greatest(hours, F.lit(0.0)))
