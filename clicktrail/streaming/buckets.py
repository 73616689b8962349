"""Clicks per ad and minute in short buckets of arrival, laid out by hour."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicktrail.functions import minute_label
from clicktrail.operators.ads import SLIDE, in_window, minute_lists, window_bounds
from clicktrail.sources import replace_parts
from clicktrail.sources.storage import Storage

BUCKETS = T.StructType([
    T.StructField("ads_id", T.StringType()), T.StructField("minute", T.StringType()), T.StructField("bucket_ts", T.TimestampType()),
    T.StructField("click_count", T.LongType()), T.StructField("hour", T.LongType()), T.StructField("batch_id", T.LongType())])


def bucket_counts(clicks: DataFrame, seconds: int = SLIDE) -> DataFrame:
    """Clicks per ad, minute label and ``seconds``-wide bucket of ``arrival``.

    Sliding windows over the last hour would copy each click into every window that holds
    it. Buckets as wide as the slide hold it once and are added up on reading.
    """
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("arrival") / F.lit(seconds)) * F.lit(seconds))
    return clicks.groupBy("ads_id", minute_label(F.col("ts")).alias("minute"), bucket.alias("bucket_ts")).agg(
        F.count(F.lit(1)).alias("click_count"))


def hour_number(ts: Column) -> Column:
    """Hours since 1970."""
    return F.floor(F.unix_seconds(ts) / F.lit(3600)).cast("bigint")


def last_minutes_of_buckets(buckets: DataFrame, as_of: datetime | Column, minutes: int = 60) -> DataFrame:
    """Clicks of each ad by minute label, over the window of arrivals at ``as_of``.

    The same window as :func:`clicktrail.operators.ads.last_hour_minutes` takes. It is
    evaluated on reading, so it moves on when no clicks arrive.
    """
    per_minute = (
        buckets.where(in_window("bucket_ts", as_of, minutes))
        .groupBy("ads_id", "minute")
        .agg(F.sum("click_count").alias("click_count"))
    )
    return minute_lists(per_minute)


class ArrivalBuckets:
    """The buckets of a stream of clicks, a folder per hour of arrival and batch.

    Arrival is the time of the batch unless given: a replayed batch keeps its time, so nothing
    is ever late, whatever the clicks' own times are. Each batch adds its own counts; no state
    is kept, and a replay replaces what it wrote before. A report reads the folders of
    the hours its window touches, two for a last hour.
    """

    def __init__(self, spark: SparkSession, root: str, keep_hours: int = 25):
        self.spark, self.keep_hours = spark, keep_hours
        self.checkpoint, self.path = f"{root}/checkpoints/buckets", f"{root}/ads_buckets"
        self.storage = Storage(spark)
        self.storage.make(self.path)

    def hours(self) -> list[int]:
        return sorted(int(name[5:]) for name in self.storage.names(self.path) if name.startswith("hour="))

    def rows(self, since: int | None = None) -> DataFrame:
        """Rows of all hours, or of those from ``since`` on, whose folders alone are looked at."""
        if since is None:
            return self.spark.read.schema(BUCKETS).parquet(self.path)
        paths = [f"{self.path}/hour={hour}" for hour in self.hours() if hour >= since]
        if not paths:
            return self.spark.createDataFrame([], BUCKETS)
        return self.spark.read.schema(BUCKETS).option("basePath", self.path).parquet(*paths)

    def add(self, clicks: DataFrame, batch_id: int) -> None:
        """Count a batch of clicks with their ``arrival``; hours older than kept ones go."""
        counts = bucket_counts(clicks).withColumn("hour", hour_number(F.col("bucket_ts")))
        replace_parts(counts.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self.path, "hour", "batch_id")
        hours = self.hours()
        for hour in hours:
            if hour < hours[-1] - self.keep_hours:
                self.storage.remove(f"{self.path}/hour={hour}")

    def last_minutes(self, as_of: datetime | Column, minutes: int = 60) -> DataFrame:
        start, end = window_bounds(as_of, minutes)
        since = self.spark.range(1).select(hour_number(start)).first()[0]
        rows = self.rows(since).where(F.col("hour").between(hour_number(start), hour_number(end)))
        return last_minutes_of_buckets(rows, as_of, minutes)

    def start(self, clicks: DataFrame, trigger: dict | None = None, arrival: Column | None = None,
              publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
        def step(batch: DataFrame, batch_id: int) -> None:
            self.add(batch, batch_id)
            if publish is not None:
                publish(self.last_minutes(F.current_timestamp()))

        stamped = clicks.withColumn("arrival", F.current_timestamp() if arrival is None else arrival)
        return (
            stamped.writeStream.foreachBatch(step).option("checkpointLocation", self.checkpoint)
            .trigger(**(trigger or {"processingTime": f"{SLIDE} seconds"})).start())
