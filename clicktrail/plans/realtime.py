"""The ad reports on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clicktrail.operators.ads import parse_observed_ads_log
from clicktrail.session import configure
from clicktrail.streaming.buckets import ArrivalBuckets
from clicktrail.streaming.counts import RunningCounts
from clicktrail.streaming.guard import ClickGuard
from clicktrail.streaming.ranks import AreaRanks

REPORTS = ("user_ads_day_count", "area_city_ads_day_count", "area_ads_top", "last_hour")


class RealtimeAds:
    """Guard, running counts and reports under one root folder seen by all nodes.

    The guard reads the log and publishes the kept clicks; a query per report reads those,
    each with its own checkpoint. The reports are batch frames, taken when called.
    """

    def __init__(
        self, spark: SparkSession, root: str, threshold: int = 100, delay: str | None = None,
        time_zone: str | None = None, listed: Callable[[], DataFrame] | None = None, k: int = 3,
    ):
        """``time_zone`` labels days and minutes; the session's own unless given. ``listed``
        gives the users that others want dropped, anew for every batch. ``delay`` closes the
        days of the two counts that are kept for good otherwise."""
        zone = time_zone or spark.conf.get("spark.sql.session.timeZone")
        self.spark, self.root = configure(spark, zone, streaming=True), root.rstrip("/")
        self.guard = ClickGuard(spark, f"{self.root}/guard", threshold, listed)
        self.users = RunningCounts(spark, self.root, "user_ads_day", ["user_id", "ads_id"], delay)
        self.cities = RunningCounts(spark, self.root, "area_city_ads_day", ["area", "city", "ads_id"], delay)
        self.ranks = AreaRanks(spark, self.root, k)
        self.buckets = ArrivalBuckets(spark, self.root)

    def start_guard(self, lines: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """Guard over log lines; each trigger is one batch of the flagging rule."""
        return self.guard.start(parse_observed_ads_log(lines), f"{self.root}/checkpoints/guard", trigger)

    def start_counts(
        self, clicks: DataFrame | None = None, trigger: dict | None = None,
        publish: Callable[[str, DataFrame], None] | None = None, arrival: Column | None = None,
        only: Iterable[str] = REPORTS,
    ) -> list[StreamingQuery]:
        """The queries behind the reports in ``only``, over the kept clicks or another stream.

        ``publish`` gets the name and frame of a report after each batch of its query:
        ``area_ads_top``, the lists of the days and areas that the batch changed, and
        ``last_hour`` as of that moment. ``arrival`` stands in for the time of the batch.
        """
        def source() -> DataFrame:
            return clicks if clicks is not None else self.guard.clean_stream()

        def out(name: str):
            return None if publish is None else lambda frame: publish(name, frame)

        starts = {
            "user_ads_day_count": lambda: self.users.start(source(), trigger),
            "area_city_ads_day_count": lambda: self.cities.start(source(), trigger),
            "area_ads_top": lambda: self.ranks.start(source(), trigger, out("area_ads_top")),
            "last_hour": lambda: self.buckets.start(source(), trigger, arrival, out("last_hour")),
        }
        return [starts[name]() for name in only]

    def user_blacklist(self) -> DataFrame:
        return self.guard.users()

    def user_ads_day_count(self) -> DataFrame:
        return self.users.read()

    def area_city_ads_day_count(self) -> DataFrame:
        return self.cities.read()

    def area_ads_top(self) -> DataFrame:
        return self.ranks.lists()

    def last_hour(self, as_of: datetime | Column, minutes: int = 60) -> DataFrame:
        return self.buckets.last_minutes(as_of, minutes)
