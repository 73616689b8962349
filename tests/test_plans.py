import re
import uuid

from pyspark.sql import functions as F

import pytest

from clicktrail.params import VisitCondition
from clicktrail.plans import OfflineReports
from clicktrail.schemas import REPORT_COLUMNS, USER_VISIT_ACTION
from clicktrail.sources import append_sink, overwrite_table, read_files, read_table
from clicktrail.sources.streams import topic_lines
from tests.rows import visits
from tests.test_areas import dims


@pytest.fixture
def reports(spark):
    rows = [{"session_id": f"s{i % 5}", "user_id": i % 2 + 1, "at": i * 7, "page_id": i % 3 + 1,
             "click_category_id": i % 4 + 1, "click_product_id": i % 6 + 1, "city_id": i % 4 + 1} for i in range(40)]
    users = spark.createDataFrame([(1, 20, "a"), (2, 70, "b")], "user_id BIGINT, age INT, professional STRING")
    condition = VisitCondition(end_age=60, target_page_flow=(1, 2, 3))
    return OfflineReports(visits(spark, rows), users, *dims(spark), condition, task_id="t1", sample=3)


def test_reports_have_the_table_columns_and_append(spark, reports):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    for _ in range(2):
        reports.write(lambda name, df: append_sink(df, "parquet", f"{base}/{name}"))
    for name, columns in REPORT_COLUMNS.items():
        written = spark.read.parquet(f"{base}/{name}")
        once = getattr(reports, name)()
        assert written.columns == columns
        assert written.count() == 2 * once.count() > 0
        if columns[0] == "taskId":
            assert [r.taskId for r in written.select("taskId").distinct().collect()] == ["t1"]


def test_reports_written_twice_are_there_once(spark, reports):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    reports.write_files(base)
    other, reports.task_id = reports.task_id, "t2"
    reports.write_files(base)
    reports.task_id = other
    reports.write_files(base)
    for name, columns in REPORT_COLUMNS.items():
        written = spark.read.parquet(f"{base}/{name}")
        assert set(written.columns) == {*columns, "taskId"}
        assert written.count() == 2 * getattr(reports, name)().count() > 0
        assert {r.taskId for r in written.select("taskId").distinct().collect()} == {"t1", "t2"}


def test_condition_applies_to_all_but_the_area_report(spark, reports):
    stat = reports.session_stat_info().first()
    assert '"endAge": 60' in stat.condition and stat.sessionCount == 5
    assert reports.category_top10().agg(F.sum("clickCount")).first()[0] == 20
    assert reports.area_product_top3().agg(F.sum("clickcount")).first()[0] > 20


def test_staged_visits_give_the_same_reports(spark, reports):
    before = {n: sorted(map(tuple, df.collect())) for n, df in reports.all().items()}
    reports.stage(f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}")
    for name in set(REPORT_COLUMNS) - {"area_product_top3"}:    # that one is over the whole log
        plan = getattr(reports, name)()._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\bage#", plan)
    assert {n: sorted(map(tuple, df.collect())) for n, df in reports.all().items()} == before


def test_table_sink_replaces_and_reads_back(spark):
    log = visits(spark, [{"at": i} for i in range(3)]).select(*USER_VISIT_ACTION.fieldNames())
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for n in (3, 2):
        overwrite_table(log.limit(n), "user_visit_action", "shop")
        assert read_table(spark, "user_visit_action", "shop").count() == n
    with pytest.raises(ValueError):
        overwrite_table(log.drop("page_id"), "user_visit_action", "shop")
        read_table(spark, "user_visit_action", "shop")


def test_files_are_checked_on_read(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="missing columns"):
        read_files(spark, "city_info", path)


def test_topic_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        topic_lines(spark, "localhost:9092")
