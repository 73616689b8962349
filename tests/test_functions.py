from pyspark.sql import functions as F

from clicktrail.functions import count_pairs_json, csv_items, half_up, share
from clicktrail.params import VisitCondition
from clicktrail.schemas import USER_INFO, conform

import pytest


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("z"))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("x, want", [(0.5, 1), (1.49, 1), (2.5, 3), (-0.5, 0), (0.0, 0)])
def test_half_up(spark, x, want):
    assert one(spark, half_up(F.col("x")), x=x) == want


def test_share_rounds_and_keeps_null_for_empty_whole(spark):
    assert one(spark, share(F.col("a"), F.col("b"), 10000, 100), a=2, b=3) == 66.67
    assert one(spark, share(F.col("a"), F.col("b"), 1000, 10), a=1, b=8) == 12.5
    assert one(spark, share(F.col("a"), F.col("b"), 1000, 10), a=1, b=0) is None


@pytest.mark.parametrize("text, want", [("1,2,,", ["1", "2"]), ("", []), ("7", ["7"]), (",3", ["3"])])
def test_csv_items(spark, text, want):
    assert one(spark, csv_items(F.col("t")), t=text) == want


def test_count_pairs_json(spark):
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in (("2", 8), ("1", 5))])
    assert one(spark, count_pairs_json(rows, "k", "n")) == '[{"2":8},{"1":5}]'


def test_condition_json_round_trip_and_missing_keys():
    text = '{"startDate":"2024-01-01","endAge":50,"professionals":"\'a\',\'b\'","targetPageFlow":"1,2,3"}'
    cond = VisitCondition.from_json(text)
    assert cond.start_date == "2024-01-01" and cond.end_date is None
    assert cond.end_age == 50 and cond.start_age is None
    assert cond.professionals == ("a", "b") and cond.target_page_flow == (1, 2, 3)
    assert VisitCondition.from_json(cond.to_json()) == cond
    assert VisitCondition.from_json("{}") == VisitCondition()


def test_conform_names_the_fault(spark):
    with pytest.raises(ValueError, match="missing columns"):
        conform(spark.range(1), USER_INFO, "user_info")
    bad = spark.createDataFrame([], "user_id STRING, username STRING, name STRING, age INT, professional STRING, gender STRING")
    with pytest.raises(ValueError, match="user_id is string"):
        conform(bad, USER_INFO, "user_info")
