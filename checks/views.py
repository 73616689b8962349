"""Clickstream tables as views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clicktrail.functions import DATETIME, DAY
from clicktrail.schemas import USER_VISIT_ACTION


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Its schema is read from the files once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _pair(first, second):
    return F.concat_ws(",", first.cast("string"), second.cast("string"))


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visit row per event, with ``row_id`` and ``action_ts`` next to the log's columns."""
    k, kind = F.col("k"), F.col("event_type")
    day = F.date_format("ts", DAY)
    click, order, pay = kind == "click", kind == "signup", kind == "purchase"
    return _events(table(spark, sf_dir, "events")).select(
        day.alias("date"),
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("session_id"),
        (k % 8 + 1).alias("page_id"),
        F.date_format("ts", DATETIME).alias("action_time"),
        F.when(kind == "view", F.concat(F.lit("kw"), (k % 6).cast("string"))).alias("search_keyword"),
        F.when(click, k % 20 + 1).otherwise(-1).alias("click_category_id"),
        F.when(click, k).otherwise(-1).alias("click_product_id"),
        F.when(order, _pair(k % 20 + 1, (k + 7) % 20 + 1)).alias("order_category_ids"),
        F.when(order, _pair(k, (k + 7) % 100)).alias("order_product_ids"),
        F.when(pay, _pair(k % 20 + 1, (k + 3) % 20 + 1)).alias("pay_category_ids"),
        F.when(pay, _pair(k, (k + 3) % 100)).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"),
        F.col("event_id").alias("row_id"),
        F.date_trunc("second", "ts").alias("action_ts"),
    )


def log_columns(visits: DataFrame) -> DataFrame:
    return visits.select(*USER_VISIT_ACTION.fieldNames())


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        (F.lit(10) + key % 50).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("extend_info"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("area"),
    )


def ads_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Ad log lines as text, one per event; ``events`` may be a stream."""
    rows = _events(events if events is not None else table(spark, sf_dir, "events"))

    def word(name: str):
        return F.replace(F.col(name), F.lit(" "), F.lit("_"))

    return (
        rows.withColumn("city_id", F.col("user_id") % 25)
        .join(city_info(spark, sf_dir), "city_id")
        .select(
            F.concat_ws(
                " ",
                F.unix_millis("ts").cast("string"), word("area"), word("city_name"),
                F.col("user_id").cast("string"), (F.col("k") % 6 + 1).cast("string"),
            ).alias("value")
        )
    )


def mixed_ads_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad log lines, good ones and, by event id, some with a fault of each kind.

    Areas keep their spaces, so that those of two words give a field too many.
    """
    rows = _events(table(spark, sf_dir, "events")).withColumn("city_id", F.col("user_id") % 25).join(
        city_info(spark, sf_dir), "city_id")
    m = F.col("event_id") % 11
    epoch = (
        F.when(m == 1, "99999999999999999").when(m == 2, "9223372036854775808").when(m == 3, "-5")
        .when(m == 4, "253402300800000").when(m == 5, "12x").otherwise(F.unix_millis("ts").cast("string"))
    )
    user = F.when(m == 6, F.lit(None)).otherwise(F.col("user_id").cast("string"))
    return rows.select(F.concat_ws(
        " ", epoch, "area", F.replace(F.col("city_name"), F.lit(" "), F.lit("_")), user,
        (F.col("k") % 6 + 1).cast("string")).alias("value"))


def order_line_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines per area, product and city, counted by key before the wide joins."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("city_id")),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    by_id = (
        lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_partkey").alias("product_id"), "city_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        by_id.join(city_info(spark, sf_dir), "city_id")
        .join(product_info(spark, sf_dir), "product_id")
        .select("area", "product_id", "product_name", "city_name", "n")
    )
