"""The leading ads of each area and day, kept up to date by what a batch changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicktrail.operators.ads import top_ads_lists
from clicktrail.sources import replace_parts
from clicktrail.sources.storage import Storage
from clicktrail.streaming.counts import EVERY_FIVE, running_day_counts

GROUP = ["day", "area"]
MOST_DAYS = 1000       # listed to pick folders; a batch of more days is matched by key alone
VERSIONS = 3           # of a day that stay, so that a read has two batches to finish
RANKED = T.StructType([
    T.StructField("area", T.StringType()), T.StructField("ads_id", T.StringType()), T.StructField("click_count", T.LongType()),
    T.StructField("rk", T.IntegerType()), T.StructField("day", T.StringType()), T.StructField("batch_id", T.LongType())])


class AreaRanks:
    """The ``k`` most clicked ads per day and area, a folder per day and batch that changed it.

    Counts only grow, so an ad outside a group's list can enter it only in a batch that counts
    it: the new list comes from the old one and the batch's totals. A batch reads and writes
    the lists of its own days, ``k`` rows per area, and neither other days nor any counts.
    """

    def __init__(self, spark: SparkSession, root: str, k: int = 3):
        self.spark, self.k = spark, k
        self.checkpoint, self.path = f"{root}/checkpoints/area_ads", f"{root}/area_ads_top"
        self.storage = Storage(spark)
        self.storage.make(self.path)

    def _rows(self, days: list[str] | None = None) -> DataFrame:
        """Rows of all days, or of the given ones, whose folders alone are looked at."""
        if days is None:
            return self.spark.read.schema(RANKED).parquet(self.path)
        there = set(self.storage.names(self.path))
        paths = [f"{self.path}/day={day}" for day in days if f"day={day}" in there]
        if not paths:
            return self.spark.createDataFrame([], RANKED)
        return self.spark.read.schema(RANKED).option("basePath", self.path).parquet(*paths)

    def before(self, days: list[str] | None, batch_id: int) -> DataFrame:
        """The lists as of before a batch, of the given days."""
        return _newest(self._rows(days).where(F.col("batch_id") < batch_id))

    def update(self, changed: DataFrame, batch_id: int) -> list[str] | None:
        """Take in the totals (``day``, ``area``, ``ads_id``, ``click_count``) that a batch changed;
        returns its days if they can be listed."""
        columns = [*GROUP, "ads_id", "click_count"]
        listed = [r.day for r in changed.select("day").distinct().limit(MOST_DAYS + 1).collect()]
        days = listed if len(listed) <= MOST_DAYS else None
        old = self.before(days, batch_id)
        if days is None:
            old = old.join(changed.select("day").distinct(), "day", "left_semi")
        totals = old.select(columns).unionByName(changed.select(columns)).groupBy(*GROUP, "ads_id").agg(
            F.max("click_count").alias("click_count"))
        by_clicks = Window.partitionBy(*GROUP).orderBy(F.desc("click_count"), "ads_id")
        ranked = totals.withColumn("rk", F.row_number().over(by_clicks)).where(F.col("rk") <= self.k)
        replace_parts(ranked.withColumn("batch_id", F.lit(batch_id).cast("bigint")).repartition("day"), self.path, "day", "batch_id")
        return days

    def tidy(self, days: list[str]) -> None:
        """Remove what newer versions have replaced, on the given days."""
        for day in days:
            versions = sorted(self.storage.names(f"{self.path}/day={day}"), key=lambda name: int(name.rsplit("=", 1)[1]))
            for name in versions[:-VERSIONS]:
                self.storage.remove(f"{self.path}/day={day}/{name}")

    def start(self, clicks: DataFrame, trigger: dict | None = None, publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
        """Keep the lists of a stream of clicks. ``publish`` gets those that a batch made anew."""
        def step(changed: DataFrame, batch_id: int) -> None:
            changed = changed.persist()
            try:
                days = self.update(changed, batch_id)
                self.tidy(days or ())
                if publish is not None:
                    # the lists of the batch's days, less those of areas that it left alone
                    touched = changed.select(*GROUP).distinct()
                    publish(self.lists(self._rows(days).where(F.col("batch_id") == batch_id).join(touched, GROUP, "left_semi")))
            finally:
                changed.unpersist()

        return (
            running_day_counts(clicks, ["area", "ads_id"]).writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", self.checkpoint).trigger(**(trigger or EVERY_FIVE)).start())

    def lists(self, rows: DataFrame | None = None) -> DataFrame:
        """One JSON text per day and area."""
        return top_ads_lists(_newest(self._rows() if rows is None else rows))


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max("batch_id").over(Window.partitionBy("day"))
    return rows.withColumn("newest", newest).where(F.col("batch_id") == F.col("newest")).drop("newest")
