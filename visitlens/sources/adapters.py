"""Adapter views: give the driver's TPC-H-ish / events tables the shape of the report inputs.

The reports read ``user_visit_action``, ``user_info``, ``city_info``, ``product_info`` and an
ad-click log. These functions derive them from ``events``, ``customer``, ``nation``/``region``,
``part`` and ``lineitem`` with plain projections and joins, so every query's work grows with
the given tables. Each has a DuckDB twin in ``visitlens.plans.oracle``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.params import VisitFilter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _iso_day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text) if text and len(text) == 10 else None
    except ValueError:
        return None


def in_days(df: DataFrame, first: str | None, last: str | None, ts: str = "ts") -> DataFrame:
    """Rows whose day lies in [first, last], as a range of ``ts`` that reaches the scan.

    A bound that is off, or no ``yyyy-MM-dd`` text, is left to the filter on the day's text.
    """
    kind = df.schema[ts].dataType
    if day := _iso_day(first):
        df = df.filter(F.col(ts) >= F.lit(f"{day} 00:00:00").cast(kind))
    if day := _iso_day(last):
        df = df.filter(F.col(ts) < F.lit(f"{day + timedelta(days=1)} 00:00:00").cast(kind))
    return df


def user_visit_action(spark: SparkSession, sf_dir: str, flt: VisitFilter | None = None) -> DataFrame:
    """One visit row per event; error events carry no action.

    ``flt`` is the filter that will be applied to the result: its date bounds are given to the scan.
    """
    e = _t(spark, sf_dir, "events")
    if flt is not None:
        e = in_days(e, flt.start_date, flt.end_date)
    e = e.withColumn("k", _k())
    et, k, eid = F.col("event_type"), F.col("k"), F.col("event_id")
    s = lambda c: c.cast("string")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("user_id"),
        F.concat(F.lit("s_"), s(F.col("user_id")), F.lit("_"), s(k % 3)).alias("session_id"),
        (k % 50 + 1).alias("page_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("action_time"),
        F.when(et == "view", F.concat(F.lit("kw"), s(k % 6))).alias("search_keyword"),
        F.when(et == "click", k % 20 + 1).otherwise(F.lit(-1)).cast("bigint").alias("click_category_id"),
        F.when(et == "click", eid % 200).otherwise(F.lit(-1)).cast("bigint").alias("click_product_id"),
        F.when(et == "purchase", F.concat(s(k % 20 + 1), F.lit(","), s((k + eid) % 20 + 1), F.lit(",")))
         .alias("order_category_ids"),
        F.when(et == "purchase", s(eid % 200)).alias("order_product_ids"),
        F.when(et == "signup", s(k % 20 + 1)).alias("pay_category_ids"),
        F.when(et == "signup", s(eid % 200)).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"),
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        (F.lit(10) + F.col("c_custkey") % 50).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("area"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names repeat in the fixture: names are not keys."""
    p = _t(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("extend_info"),
    )


BATCH_ROWS = 500  # fixed micro-batch width of the replayed click log (event_id div 500)
WIDE_BATCH_ROWS = 2000  # width of the queries whose SQL numbers the batches by event_id div 2000


def ads_log(spark: SparkSession, sf_dir: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Parsed ad-click log rows with a fixed micro-batch number per row.

    ``batch_id`` pins the micro-batch edges the click guard depends on; ``ts`` is epoch
    millis (truncated, as Spark's ``unix_millis`` does).
    """
    e = (_t(spark, sf_dir, "events")
         .filter(F.col("event_type") == "click")
         .select("event_id", "ts", "user_id", _k().alias("k"),
                 (F.col("user_id") % 25).alias("cid")))
    c = city_info(spark, sf_dir)
    j = e.join(c, e.cid == c.city_id)
    return j.select(
        F.expr(f"event_id div {int(batch_rows)}").alias("batch_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("area"),
        F.col("city_name").alias("city"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("k") % 6 + 1).cast("string").alias("ads_id"),
    )


def lineitem_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume input for the area report: one (area, city, product) click per line item."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").filter(F.col("l_partkey") > 0)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = (o.join(cu, F.col("o_custkey") == cu.c_custkey)
              .join(city_info(spark, sf_dir), F.col("c_nationkey").cast("bigint") == F.col("city_id"))
              .select("o_orderkey", "area", "city_name"))
    # lineitem, by far the largest, is shuffled once, against the finished places
    return (li.join(places, li.l_orderkey == places.o_orderkey)
              .select("area", "city_name", F.col("l_partkey").alias("click_product_id")))
