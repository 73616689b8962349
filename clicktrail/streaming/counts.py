"""Running counts on a stream of clicks, kept in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicktrail.functions import day_label
from clicktrail.sources.storage import Storage

EVERY_FIVE = {"processingTime": "5 seconds"}


def running_day_counts(clicks: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """Clicks per key and day so far.

    Without ``delay`` every key is kept for good. With it, the counts of a UTC day are
    closed once event time is that far past its end; later clicks of it are not counted,
    and the query's progress reports how many (``numRowsDroppedByWatermark``).
    """
    if delay is None:
        grouped = clicks.groupBy(*keys, day_label(F.col("ts")).alias("day"))
        return grouped.agg(F.count(F.lit(1)).alias("click_count"))
    day = F.window("ts", "1 day")
    counts = clicks.withWatermark("ts", delay).groupBy(*keys, day.alias("w")).agg(
        F.count(F.lit(1)).alias("click_count")
    )
    return counts.select(*keys, day_label(F.col("w.start")).alias("day"), "click_count")


class RunningCounts:
    """Clicks per key and day of a stream, as one query and a reader.

    The counts are the query's own state, read by Spark's state store source: nothing else is
    written while days are open. With a ``delay``, days that are closed leave the state for good
    and go to files once, by Spark's file sink; a read takes both.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, keys: list[str], delay: str | None = None):
        self.spark, self.keys, self.delay = spark, keys, delay
        self.checkpoint, self.closed = f"{root}/checkpoints/{name}", f"{root}/{name}"
        self.schema = T.StructType(
            [*[T.StructField(k, T.StringType()) for k in (*keys, "day")], T.StructField("click_count", T.LongType())])

    def start(self, clicks: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        writer = running_day_counts(clicks, self.keys, self.delay).writeStream.option("checkpointLocation", self.checkpoint)
        if self.delay is None:
            writer = writer.outputMode("update").format("noop")
        else:
            writer = writer.outputMode("append").format("parquet").option("path", self.closed)
        return writer.trigger(**(trigger or EVERY_FIVE)).start()

    def read(self) -> DataFrame:
        """Counts as of the last finished batch."""
        storage = Storage(self.spark)
        if not any(name.isdigit() for name in storage.names(f"{self.checkpoint}/commits")):
            return self.spark.createDataFrame([], self.schema)
        state = self.spark.read.format("statestore").load(self.checkpoint)
        inner = {f.name: f.dataType for f in state.schema["key"].dataType.fields}
        parts = list(inner)         # the keys, then the day or its window
        day = F.col(f"key.`{parts[-1]}`")
        if isinstance(inner[parts[-1]], T.StructType):
            day = day_label(day["start"])
        counts = state.select(
            *[F.col(f"key.`{p}`").alias(k) for p, k in zip(parts, self.keys)], day.alias("day"), F.col("value.count").alias("click_count"))
        if self.delay is not None and storage.exists(f"{self.closed}/_spark_metadata"):
            counts = counts.unionByName(self.spark.read.schema(self.schema).parquet(self.closed))
        return counts
