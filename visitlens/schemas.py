"""Fixed input / output schemas of the reports (nothing is inferred at query time)."""

from pyspark.sql import types as T

USER_VISIT_ACTION = T.StructType([
    T.StructField("date", T.StringType()),              # yyyy-MM-dd, compared as text
    T.StructField("user_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("action_time", T.StringType()),
    T.StructField("search_keyword", T.StringType()),
    T.StructField("click_category_id", T.LongType()),   # -1 = no click
    T.StructField("click_product_id", T.LongType()),    # -1 = no click
    T.StructField("order_category_ids", T.StringType()),  # comma-joined ids, null/"" = none
    T.StructField("order_product_ids", T.StringType()),
    T.StructField("pay_category_ids", T.StringType()),
    T.StructField("pay_product_ids", T.StringType()),
    T.StructField("city_id", T.LongType()),
])

USER_INFO = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("professional", T.StringType()),
    T.StructField("gender", T.StringType()),
])

CITY_INFO = T.StructType([
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("area", T.StringType()),
])

PRODUCT_INFO = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("extend_info", T.StringType()),
])

# One parsed ad-click log line: "<epoch ms> <area> <city> <user id> <ad id>".
ADS_LOG = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("area", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ads_id", T.StringType()),
])

# Report outputs.
CATEGORY_TOP10 = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("click_count", T.LongType()),
    T.StructField("order_count", T.LongType()),
    T.StructField("pay_count", T.LongType()),
])

CATEGORY_SESSION_TOP10 = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("click_count", T.LongType()),
])

AREA_COUNT_INFO = T.StructType([
    T.StructField("area", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("clickcount", T.LongType()),
    T.StructField("city_remark", T.StringType()),
])

# Report parameters (lenient JSON, unquoted keys, string values, "" = bound off).
REPORT_PARAMS = T.StructType([
    T.StructField("startDate", T.StringType()),
    T.StructField("endDate", T.StringType()),
    T.StructField("startAge", T.StringType()),
    T.StructField("endAge", T.StringType()),
])

# Counts per day, user, category and session; ``date`` is the partition column.
DAILY_COUNTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("click_count", T.LongType()),
    T.StructField("order_count", T.LongType()),
    T.StructField("pay_count", T.LongType()),
    T.StructField("date", T.StringType()),
])
