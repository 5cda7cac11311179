"""Price and validity rules as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_on(as_of: dt.date, end: Column, open_ended: bool = True) -> Column:
    """Still valid on ``as_of``; an open end counts only if ``open_ended``."""
    running = end >= F.lit(as_of)
    return running | end.isNull() if open_ended else running


def discount_percent(original: Column, price: Column) -> Column:
    """Discount in percent of the original price, two decimals; NULL on a zero original."""
    return F.round(F.try_divide(original - price, original) * 100, 2)
