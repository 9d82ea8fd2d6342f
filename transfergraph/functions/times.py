"""Times as numbers; columns may be TIMESTAMP or TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def micros(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / 1_000_000


def days_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / DAY
