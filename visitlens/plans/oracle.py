"""DuckDB twins of the registered queries (same names, same column names and types).

They are written from the report semantics, not from the Spark code: the city summary, for
instance, uses ordered list aggregates instead of a window. The adapter views are inlined
as CTEs over the raw tables ``events customer nation region part lineitem orders``.
"""

from __future__ import annotations

from visitlens.plans.registry import GUARD_THRESHOLD, TASK_ID

START_DATE, END_DATE, START_AGE, END_AGE = "2024-01-03", "2024-01-27", 20, 50

ADAPTERS = """
uva AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date, user_id,
         concat('s_', CAST(user_id AS VARCHAR), '_', CAST(k % 3 AS VARCHAR)) AS session_id,
         CAST(k % 50 + 1 AS BIGINT) AS page_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time,
         CASE WHEN event_type = 'view' THEN concat('kw', CAST(k % 6 AS VARCHAR)) END AS search_keyword,
         CAST(CASE WHEN event_type = 'click' THEN k % 20 + 1 ELSE -1 END AS BIGINT) AS click_category_id,
         CAST(CASE WHEN event_type = 'click' THEN event_id % 200 ELSE -1 END AS BIGINT) AS click_product_id,
         CASE WHEN event_type = 'purchase' THEN concat(CAST(k % 20 + 1 AS VARCHAR), ',',
              CAST((k + event_id) % 20 + 1 AS VARCHAR), ',') END AS order_category_ids,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END AS order_product_ids,
         CASE WHEN event_type = 'signup' THEN CAST(k % 20 + 1 AS VARCHAR) END AS pay_category_ids,
         CASE WHEN event_type = 'signup' THEN CAST(event_id % 200 AS VARCHAR) END AS pay_product_ids,
         CAST(user_id % 25 AS BIGINT) AS city_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
),
ui AS (
  SELECT c_custkey AS user_id, c_name AS username, c_name AS name,
         CAST(10 + c_custkey % 50 AS INTEGER) AS age, c_mktsegment AS professional,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender
  FROM customer
),
ci AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
pi AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS extend_info FROM part),
ads AS (
  SELECT event_id // 2000 AS batch_id, epoch_us(ts) // 1000 AS ts, area, city_name AS city,
         CAST(user_id AS VARCHAR) AS user_id, CAST(k % 6 + 1 AS VARCHAR) AS ads_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 25 AS cid
        FROM events WHERE event_type = 'click') e
  JOIN ci ON cid = ci.city_id
)"""

#: The same, the click log numbered by micro-batches of 500 events.
FINE_ADAPTERS = ADAPTERS.replace("event_id // 2000 AS batch_id", "event_id // 500 AS batch_id")

VISIT_COLS = ("v.date, v.user_id, v.session_id, v.page_id, v.action_time, v.search_keyword, "
              "v.click_category_id, v.click_product_id, v.order_category_ids, v.order_product_ids, "
              "v.pay_category_ids, v.pay_product_ids, v.city_id")

FILTERED = f"""
fv AS (
  SELECT {VISIT_COLS} FROM uva v, ui u
  WHERE v.user_id = u.user_id AND v.date >= '{START_DATE}' AND v.date <= '{END_DATE}'
    AND u.age >= {START_AGE} AND u.age <= {END_AGE}
)"""


def _java_split(x: str) -> str:
    # Java String.split(","): trailing empty parts dropped, "" -> [""]
    return (f"CASE WHEN {x} = '' THEN [''] WHEN rtrim({x}, ',') = '' THEN []::VARCHAR[] "
            f"ELSE string_split(rtrim({x}, ','), ',') END")


def _kinds(src: str) -> str:
    return f"""
k AS (
  SELECT *, CASE WHEN click_category_id <> -1 THEN 'click'
                 WHEN order_category_ids IS NOT NULL AND length(order_category_ids) > 0 THEN 'order'
                 WHEN pay_category_ids IS NOT NULL AND length(pay_category_ids) > 0 THEN 'pay' END AS kind
  FROM {src}
),
ev AS (
  SELECT date, user_id, session_id, kind, CAST(click_category_id AS VARCHAR) AS category_id FROM k WHERE kind = 'click'
  UNION ALL
  SELECT date, user_id, session_id, kind, unnest({_java_split('order_category_ids')}) AS category_id FROM k WHERE kind = 'order'
  UNION ALL
  SELECT date, user_id, session_id, kind, unnest({_java_split('pay_category_ids')}) AS category_id FROM k WHERE kind = 'pay'
),
cc AS (
  SELECT category_id,
         CAST(count(*) FILTER (WHERE kind = 'click') AS BIGINT) AS click_count,
         CAST(count(*) FILTER (WHERE kind = 'order') AS BIGINT) AS order_count,
         CAST(count(*) FILTER (WHERE kind = 'pay') AS BIGINT) AS pay_count
  FROM ev GROUP BY category_id
)"""


TOP10 = f"""
top10 AS (
  SELECT '{TASK_ID}' AS task_id, category_id, click_count, order_count, pay_count FROM cc
  ORDER BY click_count DESC, order_count DESC, category_id ASC LIMIT 10
),
tcc AS (
  SELECT date, user_id, session_id, click_category_id FROM fv
  WHERE click_category_id IN (SELECT TRY_CAST(category_id AS BIGINT) FROM top10)
),
scnt AS (
  SELECT click_category_id AS category_id, session_id, CAST(count(*) AS BIGINT) AS click_count
  FROM tcc GROUP BY click_category_id, session_id
)"""

VISIT_CLICKS = """
vac AS (
  SELECT ci.area, ci.city_name, uv.click_product_id
  FROM uva uv INNER JOIN ci ON uv.city_id = ci.city_id WHERE uv.click_product_id > 0
)"""

LINEITEM_CLICKS = """
lic AS (
  SELECT r_name AS area, n_name AS city_name, l_partkey AS click_product_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_partkey > 0
)"""


def _summary(src: str, p: str = "") -> str:
    """Per (area, product): clickcount + city remark, from ordered per-city count lists."""
    return f"""
{p}c AS (SELECT area, click_product_id, city_name, count(*) AS cc FROM {src} GROUP BY ALL),
{p}g AS (
  SELECT area, click_product_id, CAST(sum(cc) AS BIGINT) AS clickcount, count(*) AS n_cities,
         list(coalesce(city_name, 'null') ORDER BY cc DESC, city_name ASC NULLS FIRST) AS names,
         list(cc ORDER BY cc DESC, city_name ASC NULLS FIRST) AS cnts
  FROM {p}c GROUP BY ALL
),
{p}r AS (
  SELECT *, floor(CAST(cnts[1] AS DOUBLE) / CAST(clickcount AS DOUBLE) * 1000 + 0.5) / 10 AS r1,
         CASE WHEN n_cities >= 2
              THEN floor(CAST(cnts[2] AS DOUBLE) / CAST(clickcount AS DOUBLE) * 1000 + 0.5) / 10 END AS r2
  FROM {p}g
),
{p}s AS (
  SELECT area, click_product_id, clickcount,
         concat_ws(',', names[1] || ':' || CAST(r1 AS VARCHAR) || '%',
                   CASE WHEN n_cities >= 2 THEN names[2] || ':' || CAST(r2 AS VARCHAR) || '%' END,
                   CASE WHEN n_cities > 2
                        THEN '其他:' || CAST(floor((100.0 - r1 - r2) * 10 + 0.5) / 10 AS VARCHAR) || '%' END
         ) AS city_remark
  FROM {p}r
),
{p}rk AS (
  SELECT area, click_product_id, clickcount, city_remark,
         CAST(rank() OVER (PARTITION BY area ORDER BY clickcount DESC) AS INTEGER) AS rk
  FROM {p}s
),
{p}top3 AS (
  SELECT area, p.product_name, clickcount, city_remark
  FROM {p}rk t3, pi p WHERE t3.rk <= 3 AND t3.click_product_id = p.product_id
)"""


def guard_sql(src: str = "ads") -> str:
    """Closed-form click guard + Q5 + Q6 over a CTE ``src`` (batch_id, ts, area, city, user_id, ads_id)."""
    return f"""
ad AS (SELECT *, strftime(epoch_ms(ts), '%Y-%m-%d') AS day FROM {src}),
per AS (SELECT batch_id, day, user_id, ads_id, count(*) AS n FROM ad GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY day, user_id, ads_id ORDER BY batch_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM per
),
bl AS (SELECT user_id, min(batch_id) AS blocked_batch FROM cum WHERE cum >= {GUARD_THRESHOLD} GROUP BY user_id),
adm AS (
  SELECT ad.* FROM ad LEFT JOIN bl ON ad.user_id = bl.user_id
  WHERE bl.blocked_batch IS NULL OR ad.batch_id <= bl.blocked_batch
),
q5 AS (SELECT day, area, city, ads_id, CAST(count(*) AS BIGINT) AS click_count FROM adm GROUP BY ALL),
roll AS (SELECT day, area, ads_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM q5 GROUP BY ALL),
q6 AS (
  SELECT day, area,
         '[' || string_agg('{{"' || ads_id || '":' || CAST(click_count AS VARCHAR) || '}}', ',' ORDER BY rn) || ']'
           AS top3_json
  FROM (SELECT *, row_number() OVER (PARTITION BY day, area ORDER BY click_count DESC, ads_id ASC) AS rn
        FROM roll) t
  WHERE rn <= 3 GROUP BY day, area
)"""


GUARD = guard_sql("ads")

LINES = """
lines AS (SELECT batch_id, concat_ws(' ', CAST(ts AS VARCHAR), area, city, user_id, ads_id) AS value FROM ads),
parsed AS (
  SELECT batch_id, TRY_CAST(p[1] AS BIGINT) AS ts, p[2] AS area, p[3] AS city, p[4] AS user_id,
         p[5] AS ads_id, len(p) >= 5 AND TRY_CAST(p[1] AS BIGINT) IS NOT NULL AS valid
  FROM (SELECT batch_id, string_split(rtrim(value, ' '), ' ') AS p FROM lines) x
),
parsed_ok AS (SELECT batch_id, ts, area, city, user_id, ads_id FROM parsed WHERE valid)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_BASE, _FINE = ADAPTERS, FINE_ADAPTERS

ORACLE_SQL: dict[str, str] = {
    "visit_filter": _with(_BASE, FILTERED) + "\nSELECT * FROM fv",
    "visit_filter_sql": _with(_BASE, FILTERED) + "\nSELECT * FROM fv",
    "visit_filter_open_bounds": _with(_BASE) + f"\nSELECT {VISIT_COLS} FROM uva v, ui u WHERE v.user_id = u.user_id",
    "action_classify": _with(_BASE, _kinds("uva")) +
        "\nSELECT user_id, session_id, action_time, click_category_id, order_category_ids, pay_category_ids, kind FROM k",
    "category_events": _with(_BASE, _kinds("uva")) + "\nSELECT user_id, session_id, kind, category_id FROM ev",
    "category_counts": _with(_BASE, _kinds("uva")) + "\nSELECT * FROM cc",
    "category_top10": _with(_BASE, FILTERED, _kinds("fv"), TOP10) + "\nSELECT * FROM top10",
    "top_category_clicks": _with(_BASE, FILTERED, _kinds("fv"), TOP10) + "\nSELECT * FROM tcc",
    "category_session_counts": _with(_BASE, FILTERED, _kinds("fv"), TOP10) + "\nSELECT * FROM scnt",
    "category_session_top10": _with(_BASE, FILTERED, _kinds("fv"), TOP10) + f"""
SELECT '{TASK_ID}' AS task_id, category_id, session_id, click_count FROM scnt
QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id ASC) <= 10""",
    "visit_city_join": _with(_BASE, VISIT_CLICKS) + "\nSELECT * FROM vac",
    "area_product_counts": _with(_BASE, VISIT_CLICKS) +
        "\nSELECT area, click_product_id, count(*) AS clickcount FROM vac GROUP BY area, click_product_id",
    "city_share": _with(_BASE, VISIT_CLICKS) + """,
c AS (SELECT area, click_product_id, city_name, count(*) AS city_clicks FROM vac GROUP BY ALL)
SELECT area, click_product_id, city_name, city_clicks,
       CAST(sum(city_clicks) OVER w AS BIGINT) AS clickcount,
       floor(CAST(city_clicks AS DOUBLE) / CAST(sum(city_clicks) OVER w AS DOUBLE) * 1000 + 0.5) / 10 AS share,
       CAST(row_number() OVER (PARTITION BY area, click_product_id
                               ORDER BY city_clicks DESC, city_name ASC NULLS FIRST) AS INTEGER) AS city_rank
FROM c WINDOW w AS (PARTITION BY area, click_product_id)""",
    "city_ratio": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM s",
    "city_ratio_sql": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM s",
    "city_ratio_function": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM s",
    "area_product_rank": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM rk WHERE rk <= 3",
    "area_product_top3": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM top3",
    "area_product_top3_lineitem": _with(_BASE, LINEITEM_CLICKS, _summary("lic")) + "\nSELECT * FROM top3",
    "table_overwrite": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM top3",
    "area_product_top3_sql": _with(_BASE, VISIT_CLICKS, _summary("vac")) + "\nSELECT * FROM top3",
    "ads_format": _with(_BASE, LINES) + "\nSELECT batch_id, value FROM lines",
    "ads_parse": _with(_BASE, LINES) +
        "\nSELECT ts, area, city, user_id, ads_id, strftime(epoch_ms(ts), '%Y-%m-%d') AS day FROM parsed WHERE valid",
    "blacklist_users": _with(_FINE, GUARD) + "\nSELECT * FROM bl",
    "admitted_clicks": _with(_BASE, GUARD) + "\nSELECT batch_id, ts, day, area, city, user_id, ads_id FROM adm",
    "user_ad_day_counts": _with(_FINE, GUARD) +
        "\nSELECT day, user_id, ads_id, CAST(count(*) AS BIGINT) AS click_count FROM adm GROUP BY ALL",
    "area_city_ads_count": _with(_FINE, GUARD) + "\nSELECT * FROM q5",
    "area_ads_rollup": _with(_FINE, GUARD) + "\nSELECT * FROM roll",
    "area_top3_ads": _with(_FINE, GUARD) + "\nSELECT * FROM q6",
    "area_top3_ads_by_day": _with(_BASE, GUARD) + """
SELECT day, '{' || string_agg('"' || area || '":"' || replace(top3_json, '"', '\\"') || '"', ',' ORDER BY area) || '}'
         AS areas_json
FROM q6 GROUP BY day""",
    "daily_counts": _with(_BASE, _kinds("uva")) + """
SELECT date, user_id, category_id, session_id,
       CAST(count(*) FILTER (WHERE kind = 'click') AS BIGINT) AS click_count,
       CAST(count(*) FILTER (WHERE kind = 'order') AS BIGINT) AS order_count,
       CAST(count(*) FILTER (WHERE kind = 'pay') AS BIGINT) AS pay_count
FROM ev GROUP BY date, user_id, category_id, session_id""",
}
ORACLE_SQL["visit_filter_colocated"] = ORACLE_SQL["visit_filter"]
ORACLE_SQL["category_top10_from_days"] = ORACLE_SQL["category_top10"]
ORACLE_SQL["category_session_top10_from_days"] = ORACLE_SQL["category_session_top10"]
