"""Named queries over the driver's tables: ``(spark, sf_dir) -> DataFrame``.

Each reads whole tables through the adapter views and runs one report or one operator of
it. Their DuckDB twins live in ``visitlens.plans.oracle`` under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitlens import schemas as S
from visitlens.operators import guard as G
from visitlens.operators.actions import category_counts, category_events, classify
from visitlens.operators.city_ratio import (city_counts, city_ratio, city_ratio_sql, city_shares,
                                             register_city_ratio)
from visitlens.operators.colocated import filter_placed, place
from visitlens.operators.daily import read_days, update_days
from visitlens.operators.visits import filter_visits
from visitlens.plans import offline as O
from visitlens.sources import adapters as A
from visitlens.sources import adslog
from visitlens.session import shared_dir
from visitlens.sources.params import VisitFilter
from visitlens.sources.sinks import overwrite_table
from visitlens.sources.tables import read_table, typed

# Fixed parameters of the registered queries (shared with the oracle SQL).
TASK_ID = "task-0001"
# Report parameters in the original configuration format (lenient JSON), with bounds inside the
# fixture's month and one key that no report knows.
PARAMS_JSON = ('{startDate:"2024-01-03", endDate:"2024-01-27", startAge:"20", endAge:"50", '
               'colour:"any"}')
OPEN_PARAMS_JSON = '{startDate:"", endDate:"", startAge:"", endAge:""}'
# The default block threshold (100) never fires on the fixture (at most ~10 clicks per
# user and day at sf0.01), so the registered guard queries use 2.
GUARD_THRESHOLD = 2
# Last day of the first and first day of the second of the two updates that fill the daily counts.
DAILY_LAST, DAILY_NEXT = "2024-01-15", "2024-01-16"

VISIT_COLS = ["date", "user_id", "session_id", "page_id", "action_time", "search_keyword",
              "click_category_id", "click_product_id", "order_category_ids", "order_product_ids",
              "pay_category_ids", "pay_product_ids", "city_id"]


def _inputs(spark: SparkSession, sf: str, flt: VisitFilter | None = None):
    return A.user_visit_action(spark, sf, flt), A.user_info(spark, sf)


def _flt(spark: SparkSession, text: str = PARAMS_JSON) -> VisitFilter:
    return VisitFilter.from_json(spark, text)


def q_visit_filter(spark, sf):
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    return filter_visits(v, u, flt).select(*VISIT_COLS)


def q_visit_filter_open_bounds(spark, sf):
    v, u = _inputs(spark, sf)
    return filter_visits(v, u, _flt(spark, OPEN_PARAMS_JSON)).select(*VISIT_COLS)


def q_visit_filter_sql(spark, sf):
    """The visit filter as parameterized Spark SQL over temp views of the adapter tables."""
    from visitlens.plans.sql_reports import visit_filter_sql
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    v.createOrReplaceTempView("vl_user_visit_action")
    u.createOrReplaceTempView("vl_user_info")
    return visit_filter_sql(spark, "vl_user_visit_action", "vl_user_info", flt).select(*VISIT_COLS)


def q_visit_filter_colocated(spark, sf):
    """The visit filter over both tables stored side by side: joined without a shuffle."""
    v, u = _inputs(spark, sf)
    place(v, u, "visitlens_placed_visits", root=shared_dir(spark, "tables", "placed"))
    return filter_placed(spark, "visitlens_placed_visits", _flt(spark)).select(*VISIT_COLS)


def q_action_classify(spark, sf):
    v = A.user_visit_action(spark, sf)
    return classify(v).select("user_id", "session_id", "action_time", "click_category_id",
                              "order_category_ids", "pay_category_ids", "kind")


def q_category_events(spark, sf):
    v = A.user_visit_action(spark, sf)
    return category_events(v, keep=("user_id", "session_id")).select(
        "user_id", "session_id", "kind", "category_id")


def q_category_counts(spark, sf):
    return category_counts(A.user_visit_action(spark, sf))


def q_category_top10(spark, sf):
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    return O.category_top10(v, u, flt, TASK_ID)


def q_top_category_clicks(spark, sf):
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    return O.top_category_clicks(v, u, flt, O.category_top10(v, u, flt, TASK_ID))


def q_category_session_counts(spark, sf):
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    return O.category_session_counts(v, u, flt, O.category_top10(v, u, flt, TASK_ID))


def q_category_session_top10(spark, sf):
    flt = _flt(spark)
    v, u = _inputs(spark, sf, flt)
    return O.category_session_top10(v, u, flt, TASK_ID)


def _daily_counts(spark, sf):
    """The daily counts of all visits, taken in by two updates as two half months arrive."""
    path = shared_dir(spark, "tables", "daily-counts")
    v = A.user_visit_action(spark, sf)
    update_days(v, path, last=DAILY_LAST)
    update_days(v, path, first=DAILY_NEXT)
    return path


def q_daily_counts(spark, sf):
    return read_days(spark, _daily_counts(spark, sf))


def q_category_top10_from_days(spark, sf):
    return O.category_reports_from_days(spark, _daily_counts(spark, sf), A.user_info(spark, sf), _flt(spark), TASK_ID)[0]


def q_category_session_top10_from_days(spark, sf):
    return O.category_reports_from_days(spark, _daily_counts(spark, sf), A.user_info(spark, sf), _flt(spark), TASK_ID)[1]


def _visit_clicks(spark, sf):
    return O.visit_city_clicks(A.user_visit_action(spark, sf), A.city_info(spark, sf))


def q_visit_city_join(spark, sf):
    return _visit_clicks(spark, sf)


def q_area_product_counts(spark, sf):
    return O.area_product_counts(_visit_clicks(spark, sf))


def q_city_share(spark, sf):
    keys = ["area", "click_product_id"]
    s = city_shares(city_counts(_visit_clicks(spark, sf), keys), keys)
    return s.select("area", "click_product_id", "city_name", "city_clicks", "clickcount", "share",
                    "city_rank")


def q_city_ratio(spark, sf):
    return city_ratio(_visit_clicks(spark, sf), ["area", "click_product_id"])


def q_city_ratio_sql(spark, sf):
    _visit_clicks(spark, sf).createOrReplaceTempView("vl_clicks_by_place")
    return city_ratio_sql(spark, "vl_clicks_by_place", ["area", "click_product_id"])


def q_city_ratio_function(spark, sf):
    """``city_ratio(...)`` called by name in a user's own SQL."""
    register_city_ratio(spark)
    _visit_clicks(spark, sf).createOrReplaceTempView("vl_clicks_by_place")
    return spark.sql("""
        SELECT area, click_product_id, sum(n) AS clickcount, city_ratio(collect_list(struct(city_name, n))) AS city_remark
        FROM (SELECT area, click_product_id, city_name, count(*) AS n
              FROM vl_clicks_by_place GROUP BY area, click_product_id, city_name)
        GROUP BY area, click_product_id""")


def q_area_product_rank(spark, sf):
    summary = O.area_product_summary(_visit_clicks(spark, sf))
    return O.area_product_rank(summary).select("area", "click_product_id", "clickcount",
                                               "city_remark", "rk")


def q_area_product_top3(spark, sf):
    return O.area_product_top3(_visit_clicks(spark, sf), A.product_info(spark, sf))


def q_area_product_top3_lineitem(spark, sf):
    return O.area_product_top3(A.lineitem_clicks(spark, sf), A.product_info(spark, sf))


def q_area_product_top3_sql(spark, sf):
    """Q3 through Spark SQL text over temp views of the adapter tables."""
    from visitlens.plans.sql_reports import area_top3_sql
    A.user_visit_action(spark, sf).createOrReplaceTempView("vl_user_visit_action")
    A.city_info(spark, sf).createOrReplaceTempView("vl_city_info")
    A.product_info(spark, sf).createOrReplaceTempView("vl_product_info")
    return area_top3_sql(spark, "vl_user_visit_action", "vl_city_info", "vl_product_info")


def q_table_overwrite(spark, sf):
    """Q3 stored with drop-and-save-as-table semantics (S4), read back typed from the catalog."""
    path = shared_dir(spark, "tables", "area_count_info")
    overwrite_table(q_area_product_top3(spark, sf), "visitlens_area_count_info", path=path)
    return typed(read_table(spark, "visitlens_area_count_info"), S.AREA_COUNT_INFO)


def q_ads_format(spark, sf):
    return adslog.format_lines(A.ads_log(spark, sf, A.WIDE_BATCH_ROWS), keep=("batch_id",))


def q_ads_parse(spark, sf):
    lines = adslog.format_lines(A.ads_log(spark, sf, A.WIDE_BATCH_ROWS))
    return adslog.accepted(adslog.parse_lines(lines))


def _ads(spark, sf, batch_rows: int = A.BATCH_ROWS):
    return G.with_day(A.ads_log(spark, sf, batch_rows))


def q_blacklist_users(spark, sf):
    return G.blocked_users(_ads(spark, sf), GUARD_THRESHOLD)


def q_admitted_clicks(spark, sf):
    return G.admitted_clicks(_ads(spark, sf, A.WIDE_BATCH_ROWS), GUARD_THRESHOLD).select(
        "batch_id", "ts", "day", "area", "city", "user_id", "ads_id")


def _admitted(spark, sf, batch_rows: int = A.BATCH_ROWS):
    return G.admitted_counts(_ads(spark, sf, batch_rows), GUARD_THRESHOLD)


def q_user_ad_day_counts(spark, sf):
    return G.user_ad_day_counts(_admitted(spark, sf))


def q_area_city_ads_count(spark, sf):
    return G.area_city_ads_count(_admitted(spark, sf))


def q_area_ads_rollup(spark, sf):
    return G.area_ads_rollup(G.area_city_ads_count(_admitted(spark, sf)))


def q_area_top3_ads(spark, sf):
    return G.area_top3_ads(G.area_city_ads_count(_admitted(spark, sf)))


def q_area_top3_ads_by_day(spark, sf):
    return G.area_top3_ads_by_day(G.area_top3_ads(G.area_city_ads_count(_admitted(spark, sf, A.WIDE_BATCH_ROWS))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "visit_filter": q_visit_filter,
    "visit_filter_open_bounds": q_visit_filter_open_bounds,
    "visit_filter_sql": q_visit_filter_sql,
    "visit_filter_colocated": q_visit_filter_colocated,
    "action_classify": q_action_classify,
    "category_events": q_category_events,
    "category_counts": q_category_counts,
    "category_top10": q_category_top10,
    "top_category_clicks": q_top_category_clicks,
    "category_session_counts": q_category_session_counts,
    "category_session_top10": q_category_session_top10,
    "daily_counts": q_daily_counts,
    "category_top10_from_days": q_category_top10_from_days,
    "category_session_top10_from_days": q_category_session_top10_from_days,
    "visit_city_join": q_visit_city_join,
    "area_product_counts": q_area_product_counts,
    "city_share": q_city_share,
    "city_ratio": q_city_ratio,
    "city_ratio_sql": q_city_ratio_sql,
    "city_ratio_function": q_city_ratio_function,
    "area_product_rank": q_area_product_rank,
    "area_product_top3": q_area_product_top3,
    "area_product_top3_lineitem": q_area_product_top3_lineitem,
    "area_product_top3_sql": q_area_product_top3_sql,
    "table_overwrite": q_table_overwrite,
    "ads_format": q_ads_format,
    "ads_parse": q_ads_parse,
    "blacklist_users": q_blacklist_users,
    "admitted_clicks": q_admitted_clicks,
    "user_ad_day_counts": q_user_ad_day_counts,
    "area_city_ads_count": q_area_city_ads_count,
    "area_ads_rollup": q_area_ads_rollup,
    "area_top3_ads": q_area_top3_ads,
    "area_top3_ads_by_day": q_area_top3_ads_by_day,
}
