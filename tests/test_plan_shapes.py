"""What the physical plans must and must not hold."""

import re
import uuid

import pytest

from checks.queries import REGISTRY
from clicktrail import operators as op
from clicktrail.params import VisitCondition
from clicktrail.schemas import USER_INFO, USER_VISIT_ACTION
from clicktrail.sources import overwrite_table
from tests.rows import visits

LAZY = [n for n in REGISTRY if not n.startswith(("stream_", "report_", "table_sink", "visit_filter_bucketed"))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", text)]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_of_all_rows_and_no_python(spark, sf_dir, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    for node in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in text


def test_statistics_read_two_columns(spark, sf_dir):
    text = plan(REGISTRY["session_stats"](spark, sf_dir))
    assert read_schemas(text) == [{"ts", "user_id"}]


@pytest.mark.parametrize("name, limits", [
    ("category_session_top10", 1), ("area_product_top3", 1), ("area_ads_top3", 1), ("session_hourly_sample", 1),
])
def test_ranks_are_cut_before_the_shuffle(spark, sf_dir, name, limits):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert len(re.findall(r"WindowGroupLimit .* Partial", text)) == limits


def test_category_ranking_keeps_ten_rows_per_task(spark, sf_dir):
    assert "TakeOrderedAndProject(limit=10" in plan(REGISTRY["category_top10"](spark, sf_dir))


def test_shared_shuffles_run_once(spark, sf_dir):
    for name in ("area_product_top3_lines", "session_hourly_sample"):
        df = REGISTRY[name](spark, sf_dir)
        df.collect()
        assert "ReusedExchange" in plan(df)


def test_paging_reads_the_log_once(spark, sf_dir):
    assert len(read_schemas(plan(REGISTRY["page_conversion"](spark, sf_dir)))) == 1


def test_bounds_reach_the_scans(spark):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    log = visits(spark, [{"at": d * 86400} for d in range(4)])
    log.write.partitionBy("date").parquet(f"{base}/visits")
    spark.createDataFrame([(1, 20, "a")], "user_id BIGINT, age INT, professional STRING").write.parquet(f"{base}/users")
    users = spark.read.parquet(f"{base}/users")
    stored = spark.read.schema(log.schema).parquet(f"{base}/visits")
    condition = VisitCondition(start_date="2024-01-02", start_age=18, professionals=("a",))
    kept = op.filter_visits(stored, users, condition)
    text = plan(kept)
    assert re.search(r"PartitionFilters: \[.*date#\d+ >= 2024-01-02", text)
    assert "GreaterThanOrEqual(age,18)" in text and "EqualTo(professional,a)" in text
    assert kept.count() == 3


def test_rows_that_are_no_click_are_filtered_at_the_scan(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    visits(spark, [{"at": d} for d in range(4)]).write.parquet(path)
    log = spark.read.parquet(path)
    text = plan(op.category_session_counts(log, op.category_top(log)))
    assert "Not(EqualTo(click_category_id,-1))" in text


def test_city_remark_shuffles_once(spark, sf_dir):
    text = plan(REGISTRY["city_remark_lines"](spark, sf_dir))
    keyed = re.findall(r"Exchange hashpartitioning\(area#\d+, product_id#\d+L?, product_name#\d+(?:, city_name#\d+)?, \d+\)", text)
    assert len(keyed) == 1 and "city_name" not in keyed[0]


def test_tables_in_buckets_are_joined_without_an_exchange(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    users = spark.createDataFrame([(i, "n", "n", 20, "a", "F") for i in range(50)], USER_INFO)
    log = visits(spark, [{"at": i, "user_id": i % 60} for i in range(200)]).select(*USER_VISIT_ACTION.fieldNames())
    overwrite_table(log, "visits_by_user", "shop", buckets=4, by="user_id")
    overwrite_table(users, "users_by_id", "shop", buckets=4, by="user_id")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = op.filter_visits(
            spark.table("shop.visits_by_user"), spark.table("shop.users_by_id"), VisitCondition(start_age=18, start_date="2024-01-01"))
        text = plan(kept)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert kept.count() == sum(i % 60 < 50 for i in range(200))
        # a log that is dealt otherwise is moved
        text = plan(op.filter_visits(log, spark.table("shop.users_by_id"), VisitCondition(start_age=18)))
        assert "Exchange" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
