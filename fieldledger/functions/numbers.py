"""Number display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped_amount(value: Column, digits: int = 9) -> Column:
    """Whole number with commas, rounded half away from zero.

    A number with more than ``digits`` digits does not fit the display and shows as ``#`` over the
    full width: the digits, their commas and a sign.
    """
    whole = F.round(value, 0)
    width = digits + (digits - 1) // 3 + 1
    return F.when(F.abs(whole) >= 10**digits, F.lit("#" * width)).otherwise(F.format_number(whole, 0))
