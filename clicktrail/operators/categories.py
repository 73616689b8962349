"""Category ranking, and the leading sessions of each category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions import csv_items
from clicktrail.operators.visits import clicked, is_click


def category_counts(visits: DataFrame) -> DataFrame:
    """Clicks, orders and pays of every category.

    A row counts for the first kind that applies: click, order, pay. Orders and pays list
    several categories and count once for each. One pass: the row's kind and categories
    are exploded, and the counts are combined before the shuffle.
    """
    click = is_click("click_category_id")
    order = F.col("order_category_ids").isNotNull()
    pay = F.col("pay_category_ids").isNotNull()
    kind = F.when(click, "click").when(order, "order").when(pay, "pay")
    ids = (
        F.when(click, F.array(F.col("click_category_id").cast("string")))
        .when(order, csv_items(F.col("order_category_ids")))
        .when(pay, csv_items(F.col("pay_category_ids")))
    )
    return (
        visits.select(kind.alias("kind"), F.explode(ids).alias("category_id"))
        .groupBy("category_id")
        .agg(
            F.count_if(F.col("kind") == "click").alias("click_count"),
            F.count_if(F.col("kind") == "order").alias("order_count"),
            F.count_if(F.col("kind") == "pay").alias("pay_count"),
        )
    )


def category_top(visits: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` categories with most clicks, then most orders; pays and id break ties."""
    return (
        category_counts(visits)
        .orderBy(
            F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id"
        )
        .limit(k)
    )


def category_session_counts(visits: DataFrame, categories: DataFrame) -> DataFrame:
    """Clicks per session on each of the given categories.

    Rows that are no click are filtered at the scan, and clicks are counted per session
    before the join with the categories.
    """
    wanted = categories.select(F.col("category_id").cast("bigint").alias("click_category_id"))
    return (
        visits.where(clicked("click_category_id"))
        .groupBy("click_category_id", "session_id")
        .agg(F.count(F.lit(1)).alias("click_count"))
        .join(wanted, "click_category_id", "left_semi")
        .select(F.col("click_category_id").cast("string").alias("category_id"), "session_id", "click_count")
    )


def category_session_top(visits: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sessions with most clicks in each of the given categories.

    The rank filter is applied per task before the shuffle by category, so a category
    with most of the clicks sends ``k`` rows per task.
    """
    by_clicks = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return (
        category_session_counts(visits, categories)
        .withColumn("rk", F.row_number().over(by_clicks))
        .where(F.col("rk") <= k)
        .drop("rk")
    )
