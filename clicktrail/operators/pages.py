"""Conversion from page to page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions import share
from clicktrail.operators.sessions import SLICE_SECONDS
from clicktrail.operators.visits import in_slices, with_order


def page_conversion(
    visits: DataFrame, flow: Sequence[int], slice_seconds: int = SLICE_SECONDS, by_range: bool = False
) -> DataFrame:
    """Jumps between neighbours of ``flow`` as a share of all visits to the first page.

    A jump is a pair of consecutive visits of a session, over all its pages. Only jumps
    that occur are returned.

    A session is cut into slices of time, so that a session holding most of the log is
    paired by many tasks. Each slice is reduced in place to its jump and visit counts and
    its first and last page. One more window, over these short rows, adds the jump from a
    slice to the session's next one. Where a session can have most of its visits within one
    slice of time, ``by_range`` cuts it by rows instead, at the price of a shuffle.
    """
    flow = [int(p) for p in flow]
    jumps = list(dict.fromkeys(zip(flow[:-1], flow[1:])))
    starts = list(dict.fromkeys(flow[:-1]))
    if not jumps:
        raise ValueError("a page flow needs at least two pages")

    in_slice = Window.partitionBy("session_id", "slice").orderBy("action_ts", "row_id")
    steps = (
        in_slices(with_order(visits).select("session_id", "page_id", "action_ts", "row_id"), slice_seconds, by_range)
        .withColumn("nxt", F.lead("page_id").over(in_slice))
        .withColumn("is_first", F.lag(F.lit(1)).over(in_slice).isNull())
        .withColumn("is_last", F.lead(F.lit(1)).over(in_slice).isNull())
    )

    def pair(a: int, b: int, left: str, right: str):
        return (F.col(left) == a) & (F.col(right) == b)

    slices = steps.groupBy("session_id", "slice").agg(
        F.max(F.when(F.col("is_first"), F.col("page_id"))).alias("first_page"),
        F.max(F.when(F.col("is_last"), F.col("page_id"))).alias("last_page"),
        *[F.count_if(pair(a, b, "page_id", "nxt")).alias(f"j{i}") for i, (a, b) in enumerate(jumps)],
        *[F.count_if(F.col("page_id") == p).alias(f"v{i}") for i, p in enumerate(starts)],
    )
    across = Window.partitionBy("session_id").orderBy("slice")
    linked = slices.withColumn("nxt", F.lead("first_page").over(across))
    totals = linked.agg(
        *[
            (F.sum(f"j{i}") + F.count_if(pair(a, b, "last_page", "nxt"))).alias(f"j{i}")
            for i, (a, b) in enumerate(jumps)
        ],
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(starts))],
    )
    report = F.array(
        *[
            F.struct(
                F.lit(f"{a}-{b}").alias("page_flow"),
                F.col(f"j{i}").alias("jump_count"),
                F.col(f"v{starts.index(a)}").alias("page_count"),
            )
            for i, (a, b) in enumerate(jumps)
        ]
    )
    return (
        totals.select(F.inline(report))
        .where(F.col("jump_count") > 0)
        .withColumn("ratio", share(F.col("jump_count"), F.col("page_count"), 1000, 10))
    )
