"""Jobs: the operators put together, from inputs to written reports."""

from clicktrail.plans.offline import OfflineReports
from clicktrail.plans.realtime import RealtimeAds

__all__ = ["OfflineReports", "RealtimeAds"]
