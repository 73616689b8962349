import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import views
from checks.compare import compare, duck
from checks.oracle import ORACLE
from checks.queries import REGISTRY

BATCH = [n for n in REGISTRY if not n.startswith("stream_")]
STREAMS = [n for n in REGISTRY if n.startswith("stream_")]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", BATCH)
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("name", STREAMS)
def test_stream_equals_sql(spark, sf_dir, name):
    small = sf_dir.replace("sf0.01", "sf0.001")
    ok, note = compare(spark, duck(small), small, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_training_data_part():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "from checks.queries import REGISTRY; assert set(e.queries()) == set(REGISTRY) == set(e.oracle_sql())")
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_deliveries_of_a_stream_make_each_line_once(spark, sf_dir, monkeypatch):
    calls, lines = spark.sparkContext.accumulator(0), views.ads_lines

    def counted(value):
        calls.add(1)
        return value

    monkeypatch.setattr(views, "ads_lines", lambda *args: lines(*args).select(F.udf(counted, "string")("value").alias("value")))
    n = lines(spark, sf_dir).count()
    REGISTRY["stream_last_hour_ads_minutes"](spark, sf_dir).collect()
    # at most once for the line and once for its hour
    assert n <= calls.value <= 2 * n
