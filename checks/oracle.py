"""SQL counterparts of the registered queries."""

from __future__ import annotations

from checks.queries import (
    ARRIVALS, BUCKET_SECONDS, CONDITION, FLOW, SAMPLE, SEED, TASK, THRESHOLD,
)

VISITS = """
ev AS (
  SELECT event_id, user_id, event_type, ts, CAST(props->>'$.k' AS BIGINT) AS k FROM events
),
visits AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date, user_id,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         k % 8 + 1 AS page_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time,
         CASE WHEN event_type = 'view' THEN 'kw' || (k % 6) END AS search_keyword,
         CASE WHEN event_type = 'click' THEN k % 20 + 1 ELSE -1 END AS click_category_id,
         CASE WHEN event_type = 'click' THEN k ELSE -1 END AS click_product_id,
         CASE WHEN event_type = 'signup' THEN (k % 20 + 1) || ',' || ((k + 7) % 20 + 1) END AS order_category_ids,
         CASE WHEN event_type = 'signup' THEN k || ',' || ((k + 7) % 100) END AS order_product_ids,
         CASE WHEN event_type = 'purchase' THEN (k % 20 + 1) || ',' || ((k + 3) % 20 + 1) END AS pay_category_ids,
         CASE WHEN event_type = 'purchase' THEN k || ',' || ((k + 3) % 100) END AS pay_product_ids,
         user_id % 25 AS city_id, event_id AS row_id, date_trunc('second', ts) AS action_ts
  FROM ev
),
users AS (
  SELECT c_custkey AS user_id, 10 + c_custkey % 50 AS age, c_mktsegment AS professional FROM customer
)"""

CITIES = """
cities AS (
  SELECT n_nationkey AS city_id, n_name AS city_name, r_name AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SPANS = """
spans AS (
  SELECT session_id, min(action_ts) AS s, max(action_ts) AS e, count(*) AS steps,
         epoch_ms(max(action_ts)) - epoch_ms(min(action_ts)) AS len
  FROM {visits} GROUP BY session_id
)"""

CLICKS = """
clicks AS (
  SELECT epoch_us(ts) // 1000 AS ms, date_trunc('millisecond', ts) AS ts,
         replace(area, ' ', '_') AS area, replace(city_name, ' ', '_') AS city,
         CAST(user_id AS VARCHAR) AS user_id, CAST(k % 6 + 1 AS VARCHAR) AS ads_id
  FROM ev JOIN cities ON user_id % 25 = city_id
),
bucketed AS (SELECT *, {bucket} AS bucket, strftime(ts, '%Y-%m-%d') AS day FROM clicks),
running AS (
  SELECT user_id, bucket, sum(count(*)) OVER (
           PARTITION BY user_id, ads_id, day ORDER BY bucket
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM bucketed GROUP BY user_id, ads_id, day, bucket
),
flags AS (
  SELECT user_id, min(bucket) AS flag_bucket FROM running WHERE prior > {threshold} GROUP BY user_id
),
clean AS (
  SELECT b.* FROM bucketed b LEFT JOIN flags f USING (user_id)
  WHERE f.flag_bucket IS NULL OR b.bucket <= f.flag_bucket
),
city_counts AS (
  SELECT area, city, ads_id, day, count(*) AS click_count FROM clean GROUP BY ALL
),
area_counts AS (
  SELECT day, area, ads_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM city_counts GROUP BY ALL
)"""

CATEGORIES = """
cat AS (
  SELECT CAST(click_category_id AS VARCHAR) AS category_id, 'click' AS kind FROM visits WHERE click_category_id <> -1
  UNION ALL
  SELECT unnest(string_split(order_category_ids, ',')), 'order' FROM visits
  WHERE click_category_id = -1 AND order_category_ids IS NOT NULL
  UNION ALL
  SELECT unnest(string_split(pay_category_ids, ',')), 'pay' FROM visits
  WHERE click_category_id = -1 AND order_category_ids IS NULL AND pay_category_ids IS NOT NULL
),
cat_counts AS (
  SELECT category_id, count(*) FILTER (kind = 'click') AS click_count,
         count(*) FILTER (kind = 'order') AS order_count, count(*) FILTER (kind = 'pay') AS pay_count
  FROM cat WHERE trim(category_id) <> '' GROUP BY category_id
),
cat_top AS (
  SELECT * FROM cat_counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
),
cat_sessions AS (
  SELECT CAST(click_category_id AS VARCHAR) AS category_id, session_id, count(*) AS click_count
  FROM visits WHERE CAST(click_category_id AS VARCHAR) IN (SELECT category_id FROM cat_top)
  GROUP BY ALL
)"""

SUMMARY = """
action AS (
  SELECT *, CASE WHEN search_keyword IS NOT NULL THEN 0 WHEN click_product_id <> -1 THEN 1
                 WHEN order_product_ids IS NOT NULL THEN 2 WHEN pay_product_ids IS NOT NULL THEN 3 END AS list
  FROM visits
),
summary AS (
  SELECT session_id, strftime(min(action_ts), '%Y-%m-%d %H:%M:%S') AS start_time, count(*) AS step_length,
    epoch_ms(max(action_ts)) - epoch_ms(min(action_ts)) AS visit_length,
    coalesce(string_agg(search_keyword, ',' ORDER BY action_ts, row_id) FILTER (list = 0), '') AS search_keywords,
    coalesce(string_agg(CAST(click_product_id AS VARCHAR), ',' ORDER BY action_ts, row_id) FILTER (list = 1), '') AS click_product_ids,
    coalesce(string_agg(order_product_ids, ',' ORDER BY action_ts, row_id) FILTER (list = 2), '') AS order_product_ids,
    coalesce(string_agg(pay_product_ids, ',' ORDER BY action_ts, row_id) FILTER (list = 3), '') AS pay_product_ids
  FROM action GROUP BY session_id
)"""

QUOTAS = f"""
hours AS (
  SELECT strftime(s, '%Y-%m-%d %H') AS day_hour, count(*) AS bucket_size FROM spans GROUP BY ALL
),
quotas AS (
  SELECT day_hour, bucket_size,
    least(CAST(floor(CAST(bucket_size AS DOUBLE) / (SELECT sum(bucket_size) FROM hours) * {SAMPLE} + 0.5) AS BIGINT),
          bucket_size) AS quota
  FROM hours
)"""

FILTERED = f"""
filtered AS (
  SELECT v.* FROM visits v JOIN users u ON v.user_id = u.user_id
  WHERE date >= '{CONDITION.start_date}' AND date <= '{CONDITION.end_date}'
    AND age >= {CONDITION.start_age} AND age <= {CONDITION.end_age}
    AND professional IN ({', '.join(f"'{p}'" for p in CONDITION.professionals)})
)"""

VISIT_CLICKS = """
counts AS (
  SELECT area, product_id, product_name, city_name, count(*) AS n
  FROM (SELECT c.area, p.p_partkey AS product_id, p.p_name AS product_name, c.city_name
        FROM visits v JOIN cities c ON v.city_id = c.city_id
        JOIN part p ON p.p_partkey = v.click_product_id)
  GROUP BY ALL
)"""

LINE_CLICKS = """
counts AS (
  SELECT c.area, p.p_partkey AS product_id, p.p_name AS product_name, c.city_name, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN cities c ON c_nationkey = c.city_id JOIN part p ON p.p_partkey = l_partkey
  GROUP BY ALL
)"""

REMARK = """
ranked AS (
  SELECT *, row_number() OVER g AS rk, sum(n) OVER (PARTITION BY area, product_id, product_name) AS total,
         count(*) OVER (PARTITION BY area, product_id, product_name) AS cities_n
  FROM counts WINDOW g AS (PARTITION BY area, product_id, product_name ORDER BY n DESC, city_name)
),
ratios AS (
  SELECT area, product_id, product_name, CAST(max(total) AS BIGINT) AS clickcount, max(cities_n) AS cities_n,
    max(city_name) FILTER (rk = 1) AS c1, max(city_name) FILTER (rk = 2) AS c2,
    max(floor(n / CAST(total AS DOUBLE) * 10000 + 0.5) / 1e2) FILTER (rk = 1) AS r1,
    max(floor(n / CAST(total AS DOUBLE) * 10000 + 0.5) / 1e2) FILTER (rk = 2) AS r2
  FROM ranked GROUP BY ALL
),
remarks AS (
  SELECT area, product_id, product_name, clickcount,
    c1 || ':' || r1 || '%' || CASE WHEN c2 IS NULL THEN '' ELSE ',' || c2 || ':' || r2 || '%' END ||
    CASE WHEN cities_n > 2
      THEN ',其他:' || floor((floor((1e2 - r1) * 1e2 + 0.5) / 1e2 - r2) * 1e2 + 0.5) / 1e2 || '%'
      ELSE '' END AS cityremark
  FROM ratios
),
top3 AS (
  SELECT area, product_id, product_name, clickcount, cityremark FROM remarks
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY clickcount DESC, product_id, product_name) <= 3
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _stats(source: str) -> str:
    def pct(condition: str) -> str:
        return f"coalesce(floor(1e4 * count(*) FILTER ({condition}) / nullif(count(*), 0) + 0.5) / 1e2, 0e0)"

    return f"""SELECT count(*) AS session_count,
      {pct('len <= 10000')} AS visit_length_le_ratio, {pct('len > 10000')} AS visit_length_gt_ratio,
      {pct('steps <= 5')} AS step_length_le_ratio, {pct('steps > 5')} AS step_length_gt_ratio
    FROM {source}"""


def _flow() -> str:
    pairs = ", ".join(f"({a}, {b})" for a, b in zip(FLOW[:-1], FLOW[1:]))
    return f"""
steps AS (
  SELECT page_id, lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, row_id) AS nxt FROM visits
),
flow(a, b) AS (VALUES {pairs}),
jumps AS (SELECT a, b, count(*) AS jump_count FROM steps JOIN flow ON page_id = a AND nxt = b GROUP BY ALL),
pages_n AS (SELECT page_id, count(*) AS page_count FROM visits GROUP BY ALL)"""


USER_DAY = "SELECT user_id, ads_id, day, count(*) AS click_count FROM clean GROUP BY ALL"
TOP_ADS = """
    SELECT day, area, '[' || string_agg('{"' || ads_id || '":' || click_count || '}', ',' ORDER BY rk) || ']' AS top_ads
    FROM (SELECT *, row_number() OVER (PARTITION BY day, area ORDER BY click_count DESC, ads_id) AS rk FROM area_counts)
    WHERE rk <= 3 GROUP BY day, area"""
CLICK_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS event_time, area, city, user_id, ads_id"
LOG = ("date, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, "
       "order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id")
GUARD = {"threshold": THRESHOLD}
ADS = (VISITS, CITIES, CLICKS.format(bucket=f"ms // 1000 // {BUCKET_SECONDS}", **GUARD))
DELIVERED = (VISITS, CITIES, CLICKS.format(bucket=f"hour(ts) * {ARRIVALS} // 24", **GUARD))
# Users of another seventh are listed by others at each delivery.
LISTED = (VISITS, CITIES, DELIVERED[2].replace(
    "FROM clicks)", f"FROM clicks WHERE NOT (CAST(user_id AS BIGINT) % 7 = hour(ts) * {ARRIVALS} // 24 AND CAST(user_id AS BIGINT) IN (SELECT c_custkey FROM customer)))"))
# The filtered log under the name ``visits``, for the reports.
KEPT = (
    VISITS.replace("visits AS (", "all_visits AS ("),
    FILTERED.replace("filtered AS (", "visits AS (").replace("FROM visits v", "FROM all_visits v"),
)
V_SPANS = SPANS.format(visits="visits")


CATEGORY_SESSION_TOP = """
    SELECT {columns} FROM cat_sessions
    QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) <= 10"""
SAMPLED = f"""
    SELECT {{columns}} FROM summary s JOIN (
      SELECT session_id FROM (
        SELECT session_id, quota, row_number() OVER (
                 PARTITION BY day_hour ORDER BY md5(session_id || '|{SEED}'), session_id) AS rk
        FROM spans JOIN quotas ON strftime(s, '%Y-%m-%d %H') = day_hour)
      WHERE rk <= quota) d ON s.session_id = d.session_id"""
CONVERSION = """
    SELECT {columns} FROM (
      SELECT a || '-' || b AS page_flow, jump_count, page_count,
             floor(jump_count / CAST(page_count AS DOUBLE) * 1000 + 0.5) / 1e1 AS ratio
      FROM jumps JOIN pages_n ON a = page_id)"""
TASK_ID = f"'{TASK}' AS \"taskId\""


def _minutes(*parts: str, condition: str = "true") -> str:
    return _with(
        *parts,
        select=f"""
    SELECT ads_id, '[' || string_agg('{{"' || minute || '":' || n || '}}', ',' ORDER BY minute) || ']'
             AS minute_counts
    FROM (SELECT ads_id, strftime(ts, '%H:%M') AS minute, count(*) AS n FROM clean
          WHERE {condition} GROUP BY ALL)
    GROUP BY ads_id""",
    )


def _last(minutes: int) -> str:
    """In the window of whole ten seconds that is complete after the last click."""
    end = "(SELECT (max(ms) // 10000 + 1) * 10000 FROM clicks)"
    return f"ms >= {end} - {minutes} * 60000 AND ms < {end}"


ORACLE: dict[str, str] = {
    "visit_filter": _with(VISITS, FILTERED, select=f"SELECT {LOG} FROM filtered"),
    "session_count": _with(VISITS, select="SELECT count(DISTINCT session_id) AS session_count FROM visits"),
    "session_stats": _with(VISITS, V_SPANS, select=_stats("spans")),
    "session_stats_filtered": _with(
        VISITS, FILTERED, SPANS.format(visits="filtered"), select=_stats("spans")),
    "session_summary": _with(VISITS, SUMMARY, select="SELECT * FROM summary"),
    "session_hour_quotas": _with(
        VISITS, V_SPANS, QUOTAS, select="SELECT day_hour, bucket_size, quota FROM quotas"),
    "session_hourly_sample": _with(
        VISITS, SUMMARY, V_SPANS, QUOTAS, select=SAMPLED.format(columns="s.*")),
    "category_action_counts": _with(VISITS, CATEGORIES, select="SELECT * FROM cat_counts"),
    "category_top10": _with(VISITS, CATEGORIES, select="SELECT * FROM cat_top"),
    "category_session_counts": _with(VISITS, CATEGORIES, select="SELECT * FROM cat_sessions"),
    "category_session_top10": _with(VISITS, CATEGORIES, select=CATEGORY_SESSION_TOP.format(columns="*")),
    "page_conversion": _with(VISITS, _flow(), select=CONVERSION.format(columns="*")),
    "area_product_clicks": _with(VISITS, CITIES, VISIT_CLICKS, select="""
        SELECT area, product_id, product_name, CAST(sum(n) AS BIGINT) AS clickcount FROM counts GROUP BY ALL"""),
    "area_product_top3": _with(VISITS, CITIES, VISIT_CLICKS, REMARK, select="SELECT * FROM top3"),
    "area_product_top3_sql": _with(VISITS, CITIES, VISIT_CLICKS, REMARK, select="SELECT * FROM top3"),
    "city_remark_lines": _with(CITIES, LINE_CLICKS, REMARK, select="SELECT * FROM remarks"),
    "area_product_top3_lines": _with(CITIES, LINE_CLICKS, REMARK, select="SELECT * FROM top3"),
    "ads_log_parse": _with(*ADS, select=f"SELECT {CLICK_TEXT} FROM clicks"),
    "ads_log_rejects": _with(VISITS, CITIES, select="""
        SELECT value FROM (
          SELECT concat_ws(' ', CASE event_id % 11 WHEN 1 THEN '99999999999999999' WHEN 2 THEN '9223372036854775808'
                     WHEN 3 THEN '-5' WHEN 4 THEN '253402300800000' WHEN 5 THEN '12x' ELSE CAST(epoch_us(ts) // 1000 AS VARCHAR) END,
                   area, replace(city_name, ' ', '_'), CASE WHEN event_id % 11 <> 6 THEN user_id END, k % 6 + 1) AS value
          FROM ev JOIN cities ON user_id % 25 = city_id)
        WHERE len(string_split(value, ' ')) <> 5
           OR coalesce(try_cast(string_split(value, ' ')[1] AS BIGINT) NOT BETWEEN 0 AND 253402300799999, true)"""),
    "ads_blacklist": _with(*ADS, select="SELECT user_id, flag_bucket FROM flags"),
    "ads_clean_clicks": _with(*ADS, select=f"SELECT {CLICK_TEXT} FROM clean"),
    "ads_listed_users_dropped": _with(
        *ADS, select=f"SELECT {CLICK_TEXT} FROM clicks WHERE user_id NOT IN (SELECT user_id FROM flags)"),
    "ads_user_day_count": _with(*ADS, select=USER_DAY),
    "area_city_ads_day_count": _with(*ADS, select="SELECT * FROM city_counts"),
    "area_ads_day_count": _with(*ADS, select="SELECT * FROM area_counts"),
    "area_ads_top3": _with(*ADS, select=TOP_ADS),
    "last_hour_ads_minutes": _minutes(*ADS, condition=_last(60)),
    "last_day_ads_minutes": _minutes(*ADS, condition=_last(1440)),
    "report_session_stat_info": _with(*KEPT, V_SPANS, select=f"""
        SELECT {TASK_ID}, '{CONDITION.to_json()}' AS condition, session_count AS "sessionCount",
          visit_length_le_ratio AS "visitLength_le_10_ratio", visit_length_gt_ratio AS "visitLength_gt_10_ratio",
          step_length_le_ratio AS "stepLength_le_5_ratio", step_length_gt_ratio AS "stepLength_gt_5_ratio"
        FROM ({_stats("spans")})"""),
    "report_random_session_info": _with(*KEPT, SUMMARY, V_SPANS, QUOTAS, select=SAMPLED.format(columns=f"""
        {TASK_ID}, s.session_id AS "sessionId", start_time AS "startTime", step_length AS "stepLength",
        visit_length AS "visitLength", search_keywords AS "searchKeywords", click_product_ids AS "clickProductIds",
        order_product_ids AS "orderProductIds", pay_product_ids AS "payProductIds\"""")),
    "report_category_top10": _with(*KEPT, CATEGORIES, select=f"""
        SELECT {TASK_ID}, category_id AS "categoryId", click_count AS "clickCount",
               order_count AS "orderCount", pay_count AS "payCount" FROM cat_top"""),
    "report_category_top10_session_count": _with(*KEPT, CATEGORIES, select=CATEGORY_SESSION_TOP.format(
        columns=f'{TASK_ID}, category_id, session_id AS "sessionId", click_count AS "clickCount"')),
    "report_page_convert_rate": _with(*KEPT, _flow(), select=CONVERSION.format(
        columns=f'{TASK_ID}, page_flow AS "pageFlow", ratio')),
    "table_sink_and_scan": _with(VISITS, select=f"SELECT {LOG} FROM visits"),
    "stream_ads_blacklist": _with(*DELIVERED, select="SELECT user_id, flag_bucket AS flag_batch FROM flags"),
    "stream_ads_clean_clicks": _with(*DELIVERED, select=f"SELECT {CLICK_TEXT} FROM clean"),
    "stream_ads_external_list": _with(*LISTED, select=f"SELECT {CLICK_TEXT} FROM clean"),
    "stream_ads_user_day_count": _with(*DELIVERED, select=USER_DAY),
    "stream_area_city_ads_day_count": _with(*DELIVERED, select="SELECT * FROM city_counts"),
    "stream_area_ads_top3": _with(*DELIVERED, select=TOP_ADS),
    "stream_last_hour_ads_minutes": _minutes(*DELIVERED),
}
ORACLE["session_summary_by_range"] = ORACLE["session_summary"]
ORACLE["page_conversion_by_range"] = ORACLE["page_conversion"]
ORACLE["visit_filter_bucketed"] = ORACLE["visit_filter"]
ORACLE["report_page_convert_rate_tried_again"] = f"""
    SELECT t.task AS "taskId", r."pageFlow", r.ratio
    FROM ({ORACLE["report_page_convert_rate"]}) r, (VALUES ('{TASK}'), ('task-2')) t(task)"""
