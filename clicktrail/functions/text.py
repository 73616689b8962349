"""Text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_items(col: Column) -> Column:
    """Items of a comma-separated text; blank items are no items."""
    return F.filter(F.split(col, ","), lambda part: F.trim(part) != "")


def double_text(col: Column) -> Column:
    return col.cast("double").cast("string")


def count_pairs_json(ordered: Column, label: str, count: str) -> Column:
    """Array of structs to JSON text: one single-key object per element, in array order."""
    return F.to_json(F.transform(ordered, lambda e: F.create_map(e[label], e[count])))
