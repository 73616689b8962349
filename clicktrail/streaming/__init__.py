"""Streaming forms of the ad reports."""

from clicktrail.streaming.batches import BatchFolders
from clicktrail.streaming.buckets import ArrivalBuckets, last_minutes_of_buckets
from clicktrail.streaming.counts import RunningCounts, running_day_counts
from clicktrail.streaming.guard import ClickGuard
from clicktrail.streaming.ranks import AreaRanks

__all__ = [
    "AreaRanks", "ArrivalBuckets", "BatchFolders", "ClickGuard", "RunningCounts",
    "last_minutes_of_buckets", "running_day_counts",
]
