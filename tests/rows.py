"""Hand-made input rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import types as T

from clicktrail.schemas import USER_VISIT_ACTION

START = datetime(2024, 1, 1, 10, 0, 0)
SCHEMA = T.StructType(USER_VISIT_ACTION.fields + [T.StructField("row_id", T.LongType())])


def visits(spark, rows: list[dict]):
    """Visit rows; ``at`` is seconds after 10:00, absent columns hold no action."""
    blank = dict.fromkeys(SCHEMA.fieldNames())
    out = []
    for i, row in enumerate(rows):
        when = START + timedelta(seconds=row.get("at", 0))
        full = {
            **blank, "date": when.strftime("%Y-%m-%d"),
            "action_time": when.strftime("%Y-%m-%d %H:%M:%S"), "user_id": 1, "session_id": "s",
            "page_id": 1, "click_category_id": -1, "click_product_id": -1, "city_id": 1,
            "row_id": i, **{k: v for k, v in row.items() if k != "at"},
        }
        out.append(tuple(full[c] for c in SCHEMA.fieldNames()))
    return spark.createDataFrame(out, SCHEMA)


def clicks(spark, rows: list[tuple]):
    """Ad clicks from ``(seconds after 10:00, user, ad)`` with optional area and city."""
    lines = []
    for row in rows:
        at, user, ad, *place = row
        area, city = place or ("north", "york")
        ms = int((START + timedelta(seconds=at) - datetime(1970, 1, 1)).total_seconds() * 1000)
        lines.append((f"{ms} {area} {city} {user} {ad}",))
    return spark.createDataFrame(lines, "value STRING")
