"""Time arithmetic with boundary-counting semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: str | Column) -> Column:
    """Timestamp (UTC wall clock) of ISO text, NULL when it does not parse."""
    col = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(col).cast("timestamp_ntz")


def day(ts: str | Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def millis_between(start: Column, end: Column) -> Column:
    """Millisecond boundaries crossed from ``start`` to ``end``."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed, not whole minutes elapsed."""
    def minute_no(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / 60)

    return minute_no(end) - minute_no(start)
