"""The registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from clicktrail import operators as op
from clicktrail.operators.ads import CLICK_COLUMNS, SLIDE
from clicktrail.operators.areas import city_remark, top_products
from clicktrail.operators.sessions import hour_quotas
from clicktrail.params import VisitCondition
from clicktrail.plans import OfflineReports, RealtimeAds
from clicktrail.session import configure
from clicktrail.sources import append_sink, file_lines, overwrite_table, read_table, replace_parts
from clicktrail.sources.shared import shared_root, work_folder

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL counterparts.
CONDITION = VisitCondition(
    start_date="2024-01-05", end_date="2024-01-25", start_age=20, end_age=50,
    professionals=("BUILDING", "MACHINERY", "HOUSEHOLD"), target_page_flow=(1, 2, 3, 4, 5, 6, 7),
)
FLOW = CONDITION.target_page_flow
TASK = "task-1"
SAMPLE, SEED = 1000, 42
BUCKET_SECONDS, THRESHOLD = 3600, 1
BUCKETS = 16

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def _clicks(spark, sf_dir):
    return op.parse_ads_log(views.ads_lines(spark, sf_dir))


def _bucketed(spark, sf_dir):
    return op.click_buckets(_clicks(spark, sf_dir), BUCKET_SECONDS)


def _clean(spark, sf_dir):
    return op.click_guard(_bucketed(spark, sf_dir), THRESHOLD)


def _click_text(clicks):
    return clicks.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"), *CLICK_COLUMNS[1:]
    )


@query
def visit_filter(spark, sf_dir):
    visits = views.log_columns(views.user_visit_action(spark, sf_dir))
    return op.filter_visits(visits, views.user_info(spark, sf_dir), CONDITION)


@query
def session_count(spark, sf_dir):
    return op.session_count(views.user_visit_action(spark, sf_dir))


@query
def session_stats(spark, sf_dir):
    return op.session_stats(views.user_visit_action(spark, sf_dir))


@query
def session_stats_filtered(spark, sf_dir):
    visits = views.user_visit_action(spark, sf_dir)
    return op.session_stats(op.filter_visits(visits, views.user_info(spark, sf_dir), CONDITION))


@query
def session_summary(spark, sf_dir):
    return op.session_summary(views.user_visit_action(spark, sf_dir))


@query
def session_hour_quotas(spark, sf_dir):
    spans = op.session_spans(views.user_visit_action(spark, sf_dir))
    return hour_quotas(spans.select("session_id", "start_ts"), SAMPLE)


@query
def session_hourly_sample(spark, sf_dir):
    return op.session_hourly_sample(views.user_visit_action(spark, sf_dir), SAMPLE, SEED)


@query
def category_action_counts(spark, sf_dir):
    return op.category_counts(views.user_visit_action(spark, sf_dir))


@query
def category_top10(spark, sf_dir):
    return op.category_top(views.user_visit_action(spark, sf_dir))


@query
def category_session_counts(spark, sf_dir):
    visits = views.user_visit_action(spark, sf_dir)
    return op.category_session_counts(visits, op.category_top(visits))


@query
def category_session_top10(spark, sf_dir):
    visits = views.user_visit_action(spark, sf_dir)
    return op.category_session_top(visits, op.category_top(visits))


@query
def page_conversion(spark, sf_dir):
    return op.page_conversion(views.user_visit_action(spark, sf_dir), FLOW)


@query
def session_summary_by_range(spark, sf_dir):
    return op.session_summary(views.user_visit_action(spark, sf_dir), by_range=True)


@query
def page_conversion_by_range(spark, sf_dir):
    return op.page_conversion(views.user_visit_action(spark, sf_dir), FLOW, by_range=True)


@query
def area_product_clicks(spark, sf_dir):
    return (
        op.area_product_clicks(
            views.user_visit_action(spark, sf_dir),
            views.city_info(spark, sf_dir),
            views.product_info(spark, sf_dir),
        )
        .groupBy("area", "product_id", "product_name")
        .agg(F.sum("n").alias("clickcount"))
    )


@query
def area_product_top3(spark, sf_dir):
    return op.area_product_top(
        views.user_visit_action(spark, sf_dir),
        views.city_info(spark, sf_dir),
        views.product_info(spark, sf_dir),
    )


@query
def city_remark_lines(spark, sf_dir):
    return city_remark(views.order_line_detail(spark, sf_dir), ["area", "product_id", "product_name"])


@query
def area_product_top3_sql(spark, sf_dir):
    """The same report written in SQL, with the remark as a registered function."""
    op.register_city_remark(spark)
    views.user_visit_action(spark, sf_dir).createOrReplaceTempView("user_visit_action")
    views.city_info(spark, sf_dir).createOrReplaceTempView("city_info")
    views.product_info(spark, sf_dir).createOrReplaceTempView("product_info")
    return spark.sql("""
        WITH city_counts AS (
          SELECT c.area, p.product_id, p.product_name, c.city_name, sum(v.n) AS n
          FROM (SELECT click_product_id, city_id, count(*) AS n FROM user_visit_action
                WHERE click_product_id <> -1 GROUP BY click_product_id, city_id) v
          JOIN city_info c ON v.city_id = c.city_id
          JOIN product_info p ON p.product_id = v.click_product_id
          GROUP BY c.area, p.product_id, p.product_name, c.city_name),
        leaders AS (
          SELECT area, product_id, product_name, clickcount FROM (
            SELECT *, row_number() OVER (
              PARTITION BY area ORDER BY clickcount DESC, product_id, product_name) AS rk
            FROM (SELECT area, product_id, product_name, sum(n) AS clickcount
                  FROM city_counts GROUP BY area, product_id, product_name))
          WHERE rk <= 3)
        SELECT l.area, l.product_id, l.product_name, first(clickcount) AS clickcount,
               city_remark(collect_list(struct(city_name, n))) AS cityremark
        FROM leaders l JOIN city_counts c
          ON l.area <=> c.area AND l.product_id = c.product_id AND l.product_name <=> c.product_name
        GROUP BY l.area, l.product_id, l.product_name""")


@query
def area_product_top3_lines(spark, sf_dir):
    return top_products(views.order_line_detail(spark, sf_dir))


@query
def ads_log_parse(spark, sf_dir):
    return _click_text(_clicks(spark, sf_dir))


@query
def ads_log_rejects(spark, sf_dir):
    """Lines of which some are cut short, have a field too many or an epoch out of range."""
    return op.ads_log_rejects(views.mixed_ads_lines(spark, sf_dir))


@query
def ads_blacklist(spark, sf_dir):
    return op.flagged_users(_bucketed(spark, sf_dir), THRESHOLD)


@query
def ads_clean_clicks(spark, sf_dir):
    return _click_text(_clean(spark, sf_dir))


@query
def ads_listed_users_dropped(spark, sf_dir):
    """Clicks left when a ready list of users is dropped."""
    listed = op.flagged_users(_bucketed(spark, sf_dir), THRESHOLD)
    return _click_text(op.drop_users(_clicks(spark, sf_dir), listed))


@query
def ads_user_day_count(spark, sf_dir):
    return op.guarded_day_counts(_bucketed(spark, sf_dir), ["user_id", "ads_id"], THRESHOLD)


@query
def area_city_ads_day_count(spark, sf_dir):
    return op.guarded_day_counts(_bucketed(spark, sf_dir), ["area", "city", "ads_id"], THRESHOLD)


@query
def area_ads_day_count(spark, sf_dir):
    return op.area_ads_day_count(area_city_ads_day_count(spark, sf_dir))


@query
def area_ads_top3(spark, sf_dir):
    return op.area_ads_top(area_city_ads_day_count(spark, sf_dir))


def _last_minutes(spark, sf_dir, minutes):
    """Over the guarded clicks, in the first window that is complete after the last click."""
    last = _clicks(spark, sf_dir).agg((F.max("ts") + F.expr(f"INTERVAL {SLIDE} SECONDS"))).scalar()
    return op.last_hour_minutes(_clean(spark, sf_dir), last, minutes)


@query
def last_hour_ads_minutes(spark, sf_dir):
    return _last_minutes(spark, sf_dir, 60)


@query
def last_day_ads_minutes(spark, sf_dir):
    return _last_minutes(spark, sf_dir, 24 * 60)


# Report tables: each report is appended to a store and read back.


def _report(spark, sf_dir, name):
    reports = OfflineReports(
        views.user_visit_action(spark, sf_dir), views.user_info(spark, sf_dir),
        views.city_info(spark, sf_dir), views.product_info(spark, sf_dir),
        CONDITION, TASK, SAMPLE, SEED,
    )
    folder = work_folder(spark, "report")
    reports.write(lambda report, df: append_sink(df, "parquet", f"{folder}/{report}"), only=[name])
    return spark.read.parquet(f"{folder}/{name}")


@query
def report_session_stat_info(spark, sf_dir):
    return _report(spark, sf_dir, "session_stat_info")


@query
def report_random_session_info(spark, sf_dir):
    return _report(spark, sf_dir, "random_session_info")


@query
def report_category_top10(spark, sf_dir):
    return _report(spark, sf_dir, "category_top10")


@query
def report_category_top10_session_count(spark, sf_dir):
    return _report(spark, sf_dir, "category_top10_session_count")


@query
def report_page_convert_rate(spark, sf_dir):
    return _report(spark, sf_dir, "page_convert_rate")


@query
def report_page_convert_rate_tried_again(spark, sf_dir):
    """Two tasks write the report, the first one twice."""
    rates = op.page_conversion(op.filter_visits(
        views.user_visit_action(spark, sf_dir), views.user_info(spark, sf_dir), CONDITION), FLOW).select(
        F.col("page_flow").alias("pageFlow"), "ratio")
    folder = work_folder(spark, "report")
    for task in (TASK, "task-2", TASK):
        replace_parts(rates.withColumn("taskId", F.lit(task)), folder, "taskId")
    return spark.read.parquet(folder)


def _database(spark) -> str:
    """One database per application, so that no folder of an earlier one is in the way."""
    name = re.sub(r"\W", "_", f"clicktrail_{spark.sparkContext.applicationId}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_root(spark)}/{name}'")
    return name


@query
def visit_filter_bucketed(spark, sf_dir):
    """The filter over a log and users that are both stored in buckets by user."""
    database = _database(spark)
    visits = views.log_columns(views.user_visit_action(spark, sf_dir))
    overwrite_table(visits, "visits_by_user", database, buckets=BUCKETS, by="user_id")
    overwrite_table(views.user_info(spark, sf_dir), "users_by_id", database, buckets=BUCKETS, by="user_id")
    return op.filter_visits(
        read_table(spark, "visits_by_user", database), read_table(spark, "users_by_id", database), CONDITION)


@query
def table_sink_and_scan(spark, sf_dir):
    """The visit log replaced in the catalog twice, then read by name."""
    database = _database(spark)
    visits = views.log_columns(views.user_visit_action(spark, sf_dir))
    for _ in range(2):
        overwrite_table(visits, "user_visit_action", database)
    return read_table(spark, "user_visit_action", database)


# Streaming forms. They run to the end of their input when called; the frames returned
# read the tables they wrote.

NOW = {"availableNow": True}
ARRIVALS = 4  # log deliveries, by quarter of the day


def _guarded(spark, sf_dir, *counted: str, external: bool = False) -> RealtimeAds:
    """The guard over the log delivered in parts, one batch each, restarted in between; the
    kept clicks go into the queries of the reports ``counted`` after each. If ``external``,
    users of another seventh are listed at each delivery."""
    root = work_folder(spark, "stream")
    lines = views.ads_lines(spark, sf_dir)
    hour = F.hour(F.timestamp_millis(F.split("value", " ")[0].cast("bigint")))
    # all lines are made once, laid out by delivery
    lines.withColumn("part", F.floor(hour * ARRIVALS / 24)).write.partitionBy("part").parquet(f"{root}/deliveries")
    deliveries = spark.read.schema("value string, part bigint").parquet(f"{root}/deliveries")
    users = views.user_info(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"))
    listed = (lambda: spark.read.parquet(f"{root}/listed")) if external else None
    for part in range(ARRIVALS):
        delivered = deliveries.where(F.col("part") == part).select("value")
        delivered.write.mode("append").text(f"{root}/ads_log")
        if external:
            users.where(F.col("user_id").cast("bigint") % 7 == part).write.mode("overwrite").parquet(f"{root}/listed")
        app = RealtimeAds(spark, root, THRESHOLD, listed=listed)
        app.start_guard(file_lines(spark, f"{root}/ads_log"), NOW).awaitTermination()
        for running in app.start_counts(trigger=NOW, only=counted):
            running.awaitTermination()
    return app


@query
def stream_ads_blacklist(spark, sf_dir):
    return _guarded(spark, sf_dir).user_blacklist()


@query
def stream_ads_clean_clicks(spark, sf_dir):
    return _click_text(_guarded(spark, sf_dir).guard.clean_clicks())


@query
def stream_ads_external_list(spark, sf_dir):
    return _click_text(_guarded(spark, sf_dir, external=True).guard.clean_clicks())


@query
def stream_ads_user_day_count(spark, sf_dir):
    return _guarded(spark, sf_dir, "user_ads_day_count").user_ads_day_count()


@query
def stream_area_city_ads_day_count(spark, sf_dir):
    return _guarded(spark, sf_dir, "area_city_ads_day_count").area_city_ads_day_count()


@query
def stream_area_ads_top3(spark, sf_dir):
    return _guarded(spark, sf_dir, "area_ads_top").area_ads_top()


@query
def stream_last_hour_ads_minutes(spark, sf_dir):
    """Clicks by arrival: all were delivered within the hour, hours to weeks after their time."""
    app = _guarded(spark, sf_dir, "last_hour")
    last = app.buckets.rows().agg(F.max("bucket_ts") + F.expr(f"INTERVAL {SLIDE} SECONDS")).scalar()
    return app.last_hour(last, 60)
