"""The area report and the visit filter as single Spark SQL statements, for SQL-first users.

Table names are the caller's; values are bound parameters, never text pasted into a statement. The
area report calls ``city_ratio`` by name over per-city counts, so each group's array has one entry per
city; plans have the same partial aggregations and window group limit as the DataFrame version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.fixed import TOP_PRODUCTS
from visitlens.operators.city_ratio import register_city_ratio
from visitlens.sources.params import VisitFilter

AREA_REPORT = """
WITH per_city AS (
  SELECT area, click_product_id AS product_id, city_name, count(*) AS n
  FROM {visits} JOIN {cities} USING (city_id)
  WHERE click_product_id > 0
  GROUP BY area, click_product_id, city_name
), per_product AS (
  SELECT area, product_id, sum(n) AS clickcount, city_ratio(collect_list(struct(city_name, n))) AS city_remark
  FROM per_city
  GROUP BY area, product_id
), placed AS (
  SELECT *, rank() OVER (PARTITION BY area ORDER BY clickcount DESC) AS place FROM per_product
)
SELECT placed.area, names.product_name, placed.clickcount, placed.city_remark
FROM placed JOIN {products} AS names ON names.product_id = placed.product_id
WHERE placed.place <= :places
"""

VISIT_FILTER = """
SELECT visit.*
FROM {visits} AS visit JOIN {users} AS person ON person.user_id = visit.user_id
WHERE (:first_day IS NULL OR visit.date >= :first_day)
  AND (:last_day IS NULL OR visit.date <= :last_day)
  AND (:youngest IS NULL OR person.age >= :youngest)
  AND (:oldest IS NULL OR person.age <= :oldest)
"""


def area_top3_sql(spark: SparkSession, visits: str, cities: str, products: str,
                  n: int = TOP_PRODUCTS) -> DataFrame:
    """Run the area report over three table / view names."""
    register_city_ratio(spark)
    return spark.sql(AREA_REPORT.format(visits=visits, cities=cities, products=products), args={"places": int(n)})


def visit_filter_sql(spark: SparkSession, visits: str, users: str, flt: VisitFilter) -> DataFrame:
    """The visit filter over two table / view names; a bound that is off is a null parameter."""
    args = {"first_day": flt.start_date or None, "last_day": flt.end_date or None,
            "youngest": int(flt.start_age) if flt.start_age else None,
            "oldest": int(flt.end_age) if flt.end_age else None}
    return spark.sql(VISIT_FILTER.format(visits=visits, users=users), args=args)
