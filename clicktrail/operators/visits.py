"""Visit log: the shared filter and the ordering columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.functions import action_timestamp, time_slice
from clicktrail.params import VisitCondition

NO_CLICK = -1  # fixed value: click ids hold it on rows that are no click


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def filter_visits(visits: DataFrame, users: DataFrame, cond: VisitCondition) -> DataFrame:
    """Visits within the date bounds by users within the age and profession bounds.

    Both sides are filtered and the users cut to their id before the inner join, so the
    bounds reach the scans. The join carries no hint: Spark broadcasts the users when
    their measured size allows it and otherwise joins by shuffle, where adaptive
    execution splits the partition of a hot user.
    """
    on_visit = []
    if cond.start_date is not None:
        on_visit.append(F.col("date") >= cond.start_date)
    if cond.end_date is not None:
        on_visit.append(F.col("date") <= cond.end_date)

    on_user = []
    if cond.start_age is not None:
        on_user.append(F.col("age") >= cond.start_age)
    if cond.end_age is not None:
        on_user.append(F.col("age") <= cond.end_age)
    if cond.professionals:
        on_user.append(F.col("professional").isin(list(cond.professionals)))

    wanted = users.where(_all(on_user)).select("user_id")
    return visits.where(_all(on_visit)).join(wanted, "user_id").select(*visits.columns)


def with_order(visits: DataFrame) -> DataFrame:
    """Add ``action_ts`` and ``row_id``, the order of actions in a session, where absent.

    Times have second precision, so ``row_id`` breaks ties. A log without one gets a hash
    of its columns: rows that still tie are equal.
    """
    out = visits
    if "row_id" not in visits.columns:
        out = out.withColumn("row_id", F.xxhash64(*visits.columns))
    if "action_ts" not in visits.columns:
        out = out.withColumn("action_ts", action_timestamp(F.col("action_time")))
    return out


def in_slices(rows: DataFrame, seconds: int, by_range: bool) -> DataFrame:
    """Add ``slice``, by which the rows of a session are cut into pieces in their order.

    Either a slice is ``seconds`` of time, or, ``by_range``, a session's share of one range
    partition over session, time and row. The latter takes a shuffle more, and no piece is
    larger than a partition however many rows of a session fall into one second.
    """
    if not by_range:
        return rows.withColumn("slice", time_slice(F.col("action_ts"), seconds))
    dealt = rows.repartitionByRange("session_id", "action_ts", "row_id")
    return dealt.withColumn("slice", F.spark_partition_id())


def is_click(id_column: str) -> Column:
    return F.coalesce(F.col(id_column) != NO_CLICK, F.lit(False))


def clicked(id_column: str) -> Column:
    """As :func:`is_click`, for filters: NULL is no match there, and scans can use it."""
    return F.col(id_column) != NO_CLICK
