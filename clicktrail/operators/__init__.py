"""Batch operators: each takes DataFrames and returns a lazy DataFrame."""

from clicktrail.operators.ads import (
    ads_log_rejects, area_ads_day_count, area_ads_top, area_city_ads_day_count, click_buckets,
    click_guard, flagged_users, drop_users, guarded_day_counts, last_hour_minutes, parse_ads_log,
    user_ads_day_count,
)
from clicktrail.operators.areas import (
    area_product_clicks, area_product_top, city_remark, register_city_remark,
)
from clicktrail.operators.categories import (
    category_counts, category_session_counts, category_session_top, category_top,
)
from clicktrail.operators.pages import page_conversion
from clicktrail.operators.sessions import (
    session_count, session_hourly_sample, session_spans, session_stats, session_summary,
)
from clicktrail.operators.visits import filter_visits

__all__ = [
    "ads_log_rejects", "area_ads_day_count", "area_ads_top", "area_city_ads_day_count",
    "area_product_clicks", "area_product_top", "category_counts", "category_session_counts",
    "category_session_top", "category_top", "city_remark", "click_buckets", "click_guard",
    "drop_users", "filter_visits", "flagged_users", "guarded_day_counts", "last_hour_minutes", "page_conversion",
    "parse_ads_log", "register_city_remark", "session_count", "session_hourly_sample", "session_spans",
    "session_stats", "session_summary", "user_ads_day_count",
]
