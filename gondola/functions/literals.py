"""Constant tables that Spark knows to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A table of literals; its tiny size estimate lets joins with it broadcast by themselves."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names))) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
