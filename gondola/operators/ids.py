"""Running ids for new rows, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.session import stage

_ROW_BITS = 33  # low bits of monotonically_increasing_id: row number in its partition


def assign_ids(
    rows: DataFrame, existing: DataFrame, order_by: list[Column] | None = None
) -> DataFrame:
    """Add ``id``: numbers that continue after the largest id in ``existing``, without a gap among ``rows``.

    With ``order_by`` the ids follow that order (range partitioning, so a
    distributed sort); without it they follow the order the rows are written in
    and nothing is shuffled. The rows are staged before the partition sizes are
    counted, so a lost executor cannot change an id. The offsets hold one row
    per written partition, which bounds both the window and the broadcast.
    """
    if order_by:
        rows = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    staged = stage(rows.withColumn("_slot", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_slot", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    last = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
    row = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    return staged.join(F.broadcast(offsets), part == F.col("_part")).select(
        (last + F.col("_offset") + row + 1).cast("bigint").alias("id"), *rows.columns
    )
