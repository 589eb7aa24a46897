"""Date rules on zone-less timestamps."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_column(as_of: datetime | None) -> Column:
    """The given moment, in UTC if it has a zone, or the clock of the session, read once per query."""
    if as_of is None:
        return F.localtimestamp()
    moment = as_of.astimezone(UTC) if as_of.tzinfo else as_of
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def day_mon_year(value: Column) -> Column:
    return F.date_format(value, "dd-MMM-yyyy")


def add_months_sticky(value: Column, months: Column) -> Column:
    """``months`` later as a date; the last day of a month stays the last day."""
    day = value.cast("date")
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def days_since(moment: Column, value: Column) -> Column:
    """Rounded days from ``value`` to ``moment``, counting the time of day."""

    def second_of_day(c: Column) -> Column:
        return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    days = F.datediff(moment.cast("date"), value.cast("date")).cast("bigint")
    seconds = days * 86400 + second_of_day(moment) - second_of_day(value)
    return F.round(seconds / F.lit(86400.0)).cast("int")
