"""Click guard on a stream: drop clicks of flagged users, keep the others, flag more users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicktrail.functions import day_label
from clicktrail.operators.ads import CLICK_COLUMNS
from clicktrail.schemas import ADS_CLICK
from clicktrail.session import adaptive
from clicktrail.streaming.batches import BatchFolders
from clicktrail.streaming.counts import running_day_counts

KEYS = ["user_id", "ads_id", "day"]
_TEXT = [T.StructField(k, T.StringType()) for k in KEYS]
DROPPED = T.StructType([*_TEXT, T.StructField("n", T.LongType())])
BLACKLIST = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("flag_batch", T.LongType())])


class ClickGuard:
    """The guard's folders under one root.

    A batch is handled in the order of the reference rules: users listed when the batch starts
    lose their clicks; the remaining clicks are counted per user, ad and day; a user clicking
    an ad whose total before this batch is over the threshold is flagged, from the next batch
    on. ``listed`` is called once per batch and gives the ``user_id`` of users that others list;
    they are dropped next to the flagged ones for as long as they stand there.

    The totals live in Spark's state store: the query's plan is the batch's clicks and, as
    further rows, the running totals of their keys. So a batch costs what its own keys cost,
    and a user who sends most of the clicks is combined per task before the shuffle. Totals
    count all clicks. Those dropped by a list of others are taken off again (``dropped``);
    those of flagged users do not matter, since a flag stays.

    What a batch writes depends on its rows, on earlier batches and on what it has published
    itself, so a driver may be lost at any step: the replay writes what is missing.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int = 100,
                 listed: Callable[[], DataFrame] | None = None):
        self.spark, self.threshold, self.listed = spark, threshold, listed
        self.clean = BatchFolders(spark, f"{root}/clean", ADS_CLICK)
        self.dropped = BatchFolders(spark, f"{root}/dropped", DROPPED)
        self.blacklist = BatchFolders(spark, f"{root}/blacklist", BLACKLIST)

    def with_totals(self, clicks: DataFrame) -> DataFrame:
        """The clicks, with ``total`` null, and the totals of their keys so far."""
        clicks = clicks.select(*CLICK_COLUMNS)
        totals = running_day_counts(clicks, KEYS[:-1]).withColumnRenamed("click_count", "total")
        return clicks.unionByName(totals, allowMissingColumns=True)

    def step(self, rows: DataFrame, batch_id: int) -> None:
        """Handle one batch of :meth:`with_totals`."""
        rows = rows.persist()
        counts = self._counts(rows)
        try:
            with adaptive(rows.sparkSession):
                rows.count()        # a replay that finds all published has to compute the totals, too
                flagged = self.blacklist.read(before=batch_id).select("user_id")
                self.clean.publish(self._kept(rows, flagged), batch_id)
                if self.listed is not None:
                    counts = counts.persist()       # what is dropped and who is flagged
                over = self._prior(counts, flagged, batch_id).where(F.col("prior") > self.threshold)
                users = over.select("user_id").distinct().join(flagged, "user_id", "left_anti")
                self.blacklist.publish_rows(users.select("user_id", F.lit(batch_id).cast("bigint").alias("flag_batch")), batch_id)
        finally:
            counts.unpersist()
            rows.unpersist()

    def _kept(self, rows: DataFrame, flagged: DataFrame) -> DataFrame:
        """The clicks of users that are not listed. The lists, which may be long, are not repeated:
        adaptive execution splits the clicks of a frequent user."""
        out = flagged if self.listed is None else flagged.union(self.listed().select("user_id"))
        return rows.where("total is null").select(*CLICK_COLUMNS).join(out, "user_id", "left_anti").select(*CLICK_COLUMNS)

    def _counts(self, rows: DataFrame) -> DataFrame:
        """The keys of the batch, with their clicks in it (``n``) and up to its end (``total``)."""
        keyed = rows.select("user_id", "ads_id", F.coalesce("day", day_label(F.col("ts"))).alias("day"), "total")
        return keyed.groupBy(*KEYS).agg(F.max("total").alias("total"), F.count_if(F.col("total").isNull()).alias("n"))

    def _prior(self, counts: DataFrame, flagged: DataFrame, batch_id: int) -> DataFrame:
        """Kept clicks before this batch, of the keys with clicks kept in it."""
        if self.listed is not None:
            counts = self._heard(counts, flagged, batch_id)
        prior = F.col("total") - F.col("n")
        counts = counts.where(prior > self.threshold)       # clicks taken off only lower it
        if self.dropped.complete():
            before = self.dropped.read(before=batch_id).groupBy(*KEYS).agg(F.sum("n").alias("gone"))
            counts, prior = counts.join(before, KEYS, "left"), prior - F.coalesce("gone", F.lit(0))
        return counts.select("user_id", prior.alias("prior"))

    def _heard(self, counts: DataFrame, flagged: DataFrame, batch_id: int) -> DataFrame:
        """The counts of users whose clicks were kept. Those of others are published as dropped,
        unless a flag dropped them; which they are is read off the clicks published."""
        kept = self.clean.batch(batch_id).select("user_id").distinct()
        gone = counts.join(kept, "user_id", "left_anti").join(flagged, "user_id", "left_anti")
        self.dropped.publish_rows(gone.select(*KEYS, "n"), batch_id)
        return counts.join(kept, "user_id", "left_semi")

    def start(self, clicks: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (
            self.with_totals(clicks).writeStream.outputMode("update").foreachBatch(self.step)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"}))
            .start()
        )

    def clean_clicks(self) -> DataFrame:
        """Kept clicks of all batches."""
        return self.clean.read().select(*CLICK_COLUMNS)

    def clean_stream(self, **options) -> DataFrame:
        """Kept clicks as a stream, fed as batches are published."""
        return (
            self.spark.readStream.schema(ADS_CLICK).options(**options)
            .parquet(f"{self.clean.root}/batch_id=*").select(*CLICK_COLUMNS)
        )

    def users(self) -> DataFrame:
        """Flagged users with the batch that flagged them."""
        return self.blacklist.read().groupBy("user_id").agg(F.min("flag_batch").alias("flag_batch"))

    def drop_clean(self, before: int) -> None:
        """Remove the kept clicks of batches below ``before``, once all their readers are
        past them. A stream lists the folders that are left on every trigger."""
        for batch_id in self.clean.complete():
            if batch_id < before:
                self.clean.remove(batch_id)
