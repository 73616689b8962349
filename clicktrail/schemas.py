"""Column layouts of the input tables and of the tables written by the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# Fixed names and types of the clickstream tables.
USER_VISIT_ACTION = _struct(
    "date STRING, user_id BIGINT, session_id STRING, page_id BIGINT, action_time STRING, "
    "search_keyword STRING, click_category_id BIGINT, click_product_id BIGINT, "
    "order_category_ids STRING, order_product_ids STRING, "
    "pay_category_ids STRING, pay_product_ids STRING, city_id BIGINT"
)
USER_INFO = _struct(
    "user_id BIGINT, username STRING, name STRING, age INT, professional STRING, gender STRING"
)
PRODUCT_INFO = _struct("product_id BIGINT, product_name STRING, extend_info STRING")
CITY_INFO = _struct("city_id BIGINT, city_name STRING, area STRING")
ADS_LOG = _struct("value STRING")
ADS_CLICK = _struct("ts TIMESTAMP, area STRING, city STRING, user_id STRING, ads_id STRING")

INPUT_TABLES = {
    "user_visit_action": USER_VISIT_ACTION,
    "user_info": USER_INFO,
    "product_info": PRODUCT_INFO,
    "city_info": CITY_INFO,
    "ads_log": ADS_LOG,
}

# Fixed names of the report tables and of their columns.
REPORT_COLUMNS = {
    "session_stat_info": [
        "taskId", "condition", "sessionCount", "visitLength_le_10_ratio",
        "visitLength_gt_10_ratio", "stepLength_le_5_ratio", "stepLength_gt_5_ratio",
    ],
    "random_session_info": [
        "taskId", "sessionId", "startTime", "stepLength", "visitLength", "searchKeywords",
        "clickProductIds", "orderProductIds", "payProductIds",
    ],
    "category_top10": ["taskId", "categoryId", "clickCount", "orderCount", "payCount"],
    "category_top10_session_count": ["taskId", "category_id", "sessionId", "clickCount"],
    "page_convert_rate": ["taskId", "pageFlow", "ratio"],
    "area_product_top3": ["area", "product_id", "product_name", "clickcount", "cityremark"],
}


def conform(df: DataFrame, schema: T.StructType, name: str = "table") -> DataFrame:
    """Check that ``df`` has the columns of ``schema`` with the same types.

    Further columns (a ``row_id`` tie-breaker, say) are kept.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    wrong = [
        f"{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in schema.fields
        if have[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    return df
