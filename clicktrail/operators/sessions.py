"""Session length statistics, summaries and the hourly sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions import DATETIME, half_up, hour_label, span_millis
from clicktrail.operators.visits import in_slices, is_click, with_order

# A session's actions are put in order slice by slice, so that no task holds all actions
# of a very long session at once. With minutes, a session that is a third of one day's log
# makes 1440 groups of 1/4320 of the log each.
SLICE_SECONDS = 60

# Sub-groups per hour in which the sample is ranked before the ranks are merged.
LANES = 32

# Lists of a summary, in output order.
LISTS = ("search_keywords", "click_product_ids", "order_product_ids", "pay_product_ids")


def session_spans(visits: DataFrame) -> DataFrame:
    """Start, end and number of actions of every session.

    One hash aggregate over fixed-width buffers: each map task sends one row per session.
    """
    return (
        with_order(visits)
        .groupBy("session_id")
        .agg(
            F.min("action_ts").alias("start_ts"),
            F.max("action_ts").alias("end_ts"),
            F.count(F.lit(1)).alias("step_length"),
        )
    )


def session_count(visits: DataFrame) -> DataFrame:
    sessions = visits.select("session_id").distinct()
    return sessions.agg(F.count(F.lit(1)).alias("session_count"))


def _percent(count: Column, total: Column) -> Column:
    """Share in percent with two decimals; 0.0 when there is no session."""
    scaled = F.lit(10000.0) * count / F.nullif(total, F.lit(0))
    return F.coalesce(half_up(scaled) / F.lit(100.0), F.lit(0.0))


def session_stats(visits: DataFrame, min_ms: int = 10000, min_steps: int = 5) -> DataFrame:
    """Number of sessions and the shares above and up to the two thresholds, as one row."""
    length = span_millis(F.col("start_ts"), F.col("end_ts"))
    counts = session_spans(visits).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_if(length > min_ms).alias("long"),
        F.count_if(F.col("step_length") > min_steps).alias("deep"),
    )
    total = F.col("session_count")
    return counts.select(
        "session_count",
        _percent(total - F.col("long"), total).alias("visit_length_le_ratio"),
        _percent(F.col("long"), total).alias("visit_length_gt_ratio"),
        _percent(total - F.col("deep"), total).alias("step_length_le_ratio"),
        _percent(F.col("deep"), total).alias("step_length_gt_ratio"),
    )


def _listed_action() -> Column:
    """The one list a visit row adds to, with its item, or NULL.

    A row counts for the first kind that applies: search, click, order, pay.
    """

    def entry(position: int, item: Column) -> Column:
        return F.struct(
            F.col("action_ts"), F.col("row_id"),
            F.lit(position).alias("list"), item.cast("string").alias("item"),
        )

    return (
        F.when(F.col("search_keyword").isNotNull(), entry(0, F.col("search_keyword")))
        .when(is_click("click_product_id"), entry(1, F.col("click_product_id")))
        .when(F.col("order_product_ids").isNotNull(), entry(2, F.col("order_product_ids")))
        .when(F.col("pay_product_ids").isNotNull(), entry(3, F.col("pay_product_ids")))
    )


def _joined(entries: Column, position: int) -> Column:
    """Items of one list as text; NULL for no items, which differs from one empty item."""
    mine = F.filter(entries, lambda e: e["list"] == position)
    return F.when(F.size(mine) > 0, F.array_join(F.transform(mine, lambda e: e["item"]), ","))


def session_summary(visits: DataFrame, slice_seconds: int = SLICE_SECONDS, by_range: bool = False) -> DataFrame:
    """Per session: start, steps, length in ms, and its searches, clicks, orders and pays.

    The lists are in time order and joined by commas. They are built in two steps: the
    actions of a session within one slice of time are sorted and joined, then the pieces
    are put in slice order. The second step holds only text that ends up in the row, so a
    session can be as long as one row can: its lists must fit Spark's 2 GB per text. Where a
    session can have most of its actions within one slice of time, ``by_range`` cuts it by
    rows instead, at the price of a shuffle.
    """
    entries = with_order(visits).select("session_id", "action_ts", "row_id", _listed_action().alias("entry"))
    rows = in_slices(entries, slice_seconds, by_range)
    pieces = (
        rows.groupBy("session_id", "slice")
        .agg(
            F.min("action_ts").alias("start_ts"),
            F.max("action_ts").alias("end_ts"),
            F.count(F.lit(1)).alias("steps"),
            F.array_sort(F.collect_list("entry")).alias("entries"),
        )
        .select(
            "session_id", "start_ts", "end_ts", "steps",
            F.struct(
                "slice", *[_joined(F.col("entries"), i).alias(c) for i, c in enumerate(LISTS)]
            ).alias("piece"),
        )
    )
    sessions = pieces.groupBy("session_id").agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("steps").alias("step_length"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
    )
    return sessions.select(
        "session_id",
        F.date_format("start_ts", DATETIME).alias("start_time"),
        "step_length",
        span_millis(F.col("start_ts"), F.col("end_ts")).alias("visit_length"),
        *[F.array_join(F.col("pieces")[c], ",").alias(c) for c in LISTS],
    )


def hour_quotas(starts: DataFrame, n: int) -> DataFrame:
    """Sessions to draw per starting hour: its share of all sessions times ``n``, rounded.

    ``starts`` has one row per session with its ``start_ts``. The quota never exceeds the
    hour's sessions. Rounding is per hour, so the sum can miss ``n``.
    """
    sizes = starts.groupBy(hour_label(F.col("start_ts")).alias("day_hour")).agg(
        F.count(F.lit(1)).alias("bucket_size")
    )
    total = sizes.agg(F.sum("bucket_size")).scalar()
    quota = half_up(F.col("bucket_size").cast("double") / total * F.lit(n))
    return sizes.select(
        "day_hour", "bucket_size", F.least(quota, F.col("bucket_size")).alias("quota")
    )


def hourly_pick(visits: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Ids of the sampled sessions: per hour, the quota's first sessions in hash order.

    The order is that of ``md5(session_id + '|' + seed)``, so a draw can be repeated. An
    hour can hold most sessions; it is ranked in lanes first, each of which sends at most
    ``n`` sessions on.
    """
    starts = with_order(visits).groupBy("session_id").agg(F.min("action_ts").alias("start_ts"))
    quotas = hour_quotas(starts, n).where(F.col("quota") > 0).select("day_hour", "quota")
    keyed = starts.select(
        "session_id",
        hour_label(F.col("start_ts")).alias("day_hour"),
        F.md5(F.concat_ws("|", F.col("session_id"), F.lit(str(seed)))).alias("draw"),
        F.pmod(F.xxhash64("session_id"), F.lit(LANES)).alias("lane"),
    )
    order = ("draw", "session_id")
    per_lane = Window.partitionBy("day_hour", "lane").orderBy(*order)
    per_hour = Window.partitionBy("day_hour").orderBy(*order)
    finalists = keyed.withColumn("rk", F.row_number().over(per_lane)).where(F.col("rk") <= n)
    return (
        finalists.join(quotas, "day_hour")
        .where(F.col("rk") <= F.col("quota"))
        .withColumn("rk", F.row_number().over(per_hour))
        .where(F.col("rk") <= F.col("quota"))
        .select("session_id")
    )


def session_hourly_sample(visits: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Summaries of a random sample of sessions, drawn in proportion to hourly traffic.

    The draw needs start times only; lists are built for the drawn sessions alone. There
    are at most ``2 * n`` of them: a quota of at least 1 means an unrounded share of at
    least 0.5, so rounding at most doubles it. Adaptive execution broadcasts them if few.
    """
    pick = hourly_pick(visits, n, seed).withColumnRenamed("session_id", "picked")
    same = F.col("session_id").eqNullSafe(F.col("picked"))
    chosen = visits.join(pick, same, "left_semi")
    return session_summary(chosen)
