"""Joins on keys that may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Prepare an aggregate with one row per key for a join with unreduced rows.

    Adaptive execution splits a hot partition only where both inputs of the
    join come straight from a shuffle. An aggregate is already partitioned by
    the key and would be joined without one, so it is moved to another
    partitioning first. That costs a shuffle of one row per key and lets the
    rows of a hot key be joined by several tasks. A small aggregate is
    broadcast at run time as usual.
    """
    return df.repartition(F.xxhash64(*keys))
