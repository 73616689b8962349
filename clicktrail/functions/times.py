"""Timestamps, labels and slices. All follow the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed label formats.
DAY = "yyyy-MM-dd"
HOUR = "yyyy-MM-dd HH"
MINUTE = "HH:mm"
DATETIME = "yyyy-MM-dd HH:mm:ss"


def action_timestamp(text: Column) -> Column:
    return F.to_timestamp(text, DATETIME)


def day_label(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, HOUR)


def minute_label(ts: Column) -> Column:
    return F.date_format(ts, MINUTE)


def span_millis(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def time_slice(ts: Column, seconds: int) -> Column:
    """Number of the ``seconds``-wide slice of time that holds ``ts``."""
    return F.floor(F.unix_seconds(ts) / F.lit(int(seconds)))
