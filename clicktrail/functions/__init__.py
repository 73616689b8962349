"""Column expressions shared by the operators."""

from clicktrail.functions.numbers import half_up, share
from clicktrail.functions.text import count_pairs_json, csv_items, double_text
from clicktrail.functions.times import (
    DATETIME, DAY, HOUR, MINUTE, action_timestamp, day_label, hour_label, minute_label,
    span_millis, time_slice,
)

__all__ = [
    "DATETIME", "DAY", "HOUR", "MINUTE", "action_timestamp", "count_pairs_json", "csv_items",
    "day_label", "double_text", "half_up", "hour_label", "minute_label", "share",
    "span_millis", "time_slice",
]
