"""Batch reports.

Q1 ``category_top10``: the 10 categories with most clicks, then most orders, over filtered visits.
Q2 ``category_session_top10``: for each Q1 category, the 10 sessions that clicked it most.
Q3 ``area_product_top3``: per area the products with the 3 highest click counts (ties kept)
   with a city-share summary, named after the cut.

Plan shape (checked with ``explain``):
* Q1 counts per (user, category) *before* joining users, then multiplies by the number of
  matching user rows: the join sees pre-aggregated rows, not raw visits, so a user with a
  third of all visits is one small group. The final top-10 is TakeOrderedAndProject.
* Q2 restricts visits to the 10 categories with a broadcast left-semi join (the broadcast
  side is a ``limit(10)``: its size bound is structural), counts per (category, session)
  and keeps 10 per category with ``row_number``; the partial WindowGroupLimit cuts each
  category to 10 rows per task before the shuffle.
* Q3 pre-aggregates clicks per (area, product, city) map-side, builds the summary with one
  window + one aggregate on the same partitioning, ranks per area (partial limit before the
  shuffle) and joins product names last. Dimension joins are left to AQE, which broadcasts a
  side only after measuring it (``autoBroadcastJoinThreshold``) and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.fixed import TOP_CATEGORIES, TOP_CITIES, TOP_PRODUCTS, TOP_SESSIONS
from visitlens.operators.actions import category_events, kind_counts
from visitlens.operators.city_ratio import city_counts, city_shares, city_summary
from visitlens.operators.daily import read_days
from visitlens.operators.joins import hot_key_join
from visitlens.operators.topk import rank_cut, top_n, top_n_per_group
from visitlens.operators.visits import filter_visits, user_multiplicity
from visitlens.sources.params import VisitFilter, apply
from visitlens.sources.tables import persisted


def category_counts_filtered(visits: DataFrame, users: DataFrame, flt: VisitFilter) -> DataFrame:
    """Per category: click / order / pay counts over the filtered visits (A1, A2 after J1)."""
    v = apply(visits.select("date", "user_id", "click_category_id", "order_category_ids",
                            "pay_category_ids"), flt.date_predicate("date"))
    per_user = kind_counts(category_events(v, keep=("user_id",)), ("user_id", "category_id"))
    m = user_multiplicity(users, flt)
    j = per_user.join(m, "user_id")
    return j.groupBy("category_id").agg(
        *[F.sum(F.col(f"{k}_count") * F.col("mult")).cast("bigint").alias(f"{k}_count")
          for k in ("click", "order", "pay")])


def category_top10(visits: DataFrame, users: DataFrame, flt: VisitFilter, task_id: str = "") -> DataFrame:
    """Q1. Sort keys: click desc, order desc (pay is not a key); then category_id asc."""
    return _top_categories(category_counts_filtered(visits, users, flt), task_id)


def top_category_clicks(visits: DataFrame, users: DataFrame, flt: VisitFilter,
                        top10: DataFrame) -> DataFrame:
    """Filtered click visits on the top categories (P9 / J4): broadcast left-semi join.

    Category ids are text in Q1; a non-numeric id cannot match a click id and is dropped.
    """
    v = filter_visits(visits.select("date", "user_id", "session_id", "click_category_id"), users, flt)
    return v.join(F.broadcast(_top_ids(top10)), "click_category_id", "left_semi")


def _top_ids(top10: DataFrame) -> DataFrame:
    return top10.select(F.expr("try_cast(category_id AS BIGINT)").alias("click_category_id"))


def category_session_counts(visits: DataFrame, users: DataFrame, flt: VisitFilter,
                            top10: DataFrame) -> DataFrame:
    """Clicks per (top category, session) over filtered visits (A3)."""
    v = apply(visits.select("date", "user_id", "session_id", "click_category_id"),
              flt.date_predicate("date"))
    clicks = v.join(F.broadcast(_top_ids(top10)), "click_category_id", "left_semi")
    per_user = persisted(clicks.groupBy("user_id", "click_category_id", "session_id")
                         .agg(F.count(F.lit(1)).alias("n")), "category-session-counts")
    # a hot user keeps one row per (category, session): its join with the user table is salted
    j = hot_key_join(per_user, user_multiplicity(users, flt), "user_id")
    return (j.groupBy(F.col("click_category_id").alias("category_id"), "session_id")
             .agg(F.sum(F.col("n") * F.col("mult")).cast("bigint").alias("click_count")))


def visit_counts(visits: DataFrame, flt: VisitFilter) -> DataFrame:
    """Visits inside the date bound -> counts per (user, category, session) and kind.

    One scan feeds both category reports; the counts are stored in the shared folder.
    """
    v = apply(visits.select("date", "user_id", "session_id", "click_category_id", "order_category_ids",
                            "pay_category_ids"), flt.date_predicate("date"))
    events = category_events(v, keep=("user_id", "session_id"))
    return persisted(kind_counts(events, ("user_id", "category_id", "session_id")), "visit-counts")


def category_reports(visits: DataFrame, users: DataFrame, flt: VisitFilter, task_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(Q1, Q2) from one scan of the visits and one of the users."""
    return _reports(visit_counts(visits, flt), users, flt, task_id)


def category_reports_from_days(spark: SparkSession, path: str, users: DataFrame, flt: VisitFilter,
                               task_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(Q1, Q2) from the daily counts below ``path``: the date range opens its days and reads no visits."""
    return _reports(read_days(spark, path, flt), users, flt, task_id)


def _reports(per_user: DataFrame, users: DataFrame, flt: VisitFilter, task_id: str) -> tuple[DataFrame, DataFrame]:
    """(Q1, Q2) from stored counts per (user, category, session) and kind; a key may have several rows."""
    m = persisted(user_multiplicity(users, flt), "user-multiplicity")
    weighted = persisted(hot_key_join(per_user, m, "user_id").groupBy("category_id", "session_id").agg(
        *[F.sum(F.col(f"{k}_count") * F.col("mult")).cast("bigint").alias(f"{k}_count")
          for k in ("click", "order", "pay")]), "session-counts")
    totals = weighted.groupBy("category_id").agg(*[F.sum(f"{k}_count").cast("bigint").alias(f"{k}_count")
                                                   for k in ("click", "order", "pay")])
    q1 = persisted(_top_categories(totals, task_id), "category-top10")
    clicks = (weighted.filter(F.col("click_count") > 0)
              .select(F.expr("try_cast(category_id AS BIGINT)").alias("click_category_id"), "session_id", "click_count")
              .join(F.broadcast(_top_ids(q1)), "click_category_id", "left_semi")
              .withColumnRenamed("click_category_id", "category_id"))
    return q1, _top_sessions(clicks, task_id)


def _top_categories(counts: DataFrame, task_id: str) -> DataFrame:
    top = top_n(counts, [F.col("click_count").desc(), F.col("order_count").desc(),
                         F.col("category_id").asc()], TOP_CATEGORIES)
    return top.select(F.lit(task_id).alias("task_id"), "category_id", "click_count",
                      "order_count", "pay_count")


def _top_sessions(counts: DataFrame, task_id: str, n: int = TOP_SESSIONS) -> DataFrame:
    top = top_n_per_group(counts, ["category_id"],
                          [F.col("click_count").desc(), F.col("session_id").asc()], n)
    return top.select(F.lit(task_id).alias("task_id"), "category_id", "session_id", "click_count")


def category_session_top10(visits: DataFrame, users: DataFrame, flt: VisitFilter,
                           task_id: str = "", top10: DataFrame | None = None) -> DataFrame:
    """Q2. Exactly <= 10 sessions per category: count desc, then session_id asc.

    ``top10`` may be a stored Q1 result; without it both reports come from one scan.
    """
    if top10 is None:
        return category_reports(visits, users, flt, task_id)[1]
    return _top_sessions(category_session_counts(visits, users, flt, top10), task_id)


def visit_city_clicks(visits: DataFrame, cities: DataFrame) -> DataFrame:
    """Product clicks with their city and area (J2 + P5)."""
    v = visits.select("city_id", "click_product_id").filter(F.col("click_product_id") > 0)
    return v.join(cities.select("city_id", "city_name", "area"), "city_id").select(
        "area", "city_name", "click_product_id")


def area_product_counts(clicks: DataFrame) -> DataFrame:
    """``count(*) group by area, click_product_id`` (A5)."""
    return clicks.groupBy("area", "click_product_id").agg(F.count(F.lit(1)).alias("clickcount"))


def area_product_summary(clicks: DataFrame) -> DataFrame:
    """Per (area, product): clickcount and city_remark (A5 + A6).

    The cities come from the city table, so a group has at most one row for each city of its area: one window over
    them costs a shuffle less than ``city_ratio``, which takes any text.
    """
    keys = ["area", "click_product_id"]
    shares = city_shares(city_counts(clicks, keys), keys)
    return city_summary(shares.where(F.col("city_rank") <= TOP_CITIES), keys)


def area_product_rank(summary: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """``rank() over (partition by area order by clickcount desc) <= n``, ties kept."""
    return rank_cut(summary, ["area"], [F.col("clickcount").desc()], n, rank_col="rk")


def area_product_top3(clicks: DataFrame, products: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """Q3 from (area, city_name, click_product_id) click rows; names joined after the cut."""
    ranked = area_product_rank(area_product_summary(clicks), n)
    p = products.select("product_id", "product_name")
    return (ranked.join(p, ranked.click_product_id == p.product_id, "inner")
                  .select("area", "product_name", "clickcount", "city_remark"))


def area_report(visits: DataFrame, cities: DataFrame, products: DataFrame) -> DataFrame:
    """Q3 end to end from the visit table."""
    return area_product_top3(visit_city_clicks(visits, cities), products)
