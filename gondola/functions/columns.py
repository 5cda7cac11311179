"""Control over where expensive columns are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns whose expressions must not be repeated.

    Spark copies the expression of a column into every filter pushed below it.
    A generator of one row keeps later filters above it, so a parse runs once
    per row however often its result is used.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select(*kept, F.inline(F.array(row)))
