"""Counts per (day, user, category, session) and kind, kept up to date day by day.

The category reports bound visits by date and users by age, so per-day counts with the user among their
keys answer every such report without reading the visits again: a date range opens the folders of its days
only, and the users are joined afterwards as they stand now.

``update_days`` counts the visits of a range of days and replaces those days in the table through Spark's
dynamic partition overwrite; other days are not touched, so late visits are taken in by updating their days
again. Every day that has or had visits keeps one marker row (null category): it is what empties a day whose
visits are gone. Days are spread by ``REBALANCE``, which splits a large day over tasks.

Defined results: a null date is a day of its own that no date bound keeps, an empty date text is stored as
null; visits of unknown (null) users are counted but join no user; repeated visits count as often as they
occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators.actions import KINDS, category_events, kind_counts
from visitlens.schemas import DAILY_COUNTS
from visitlens.sources.params import VisitFilter, apply

KEYS = ("date", "user_id", "category_id", "session_id")
VISIT_INPUT = ("date", "user_id", "session_id", "click_category_id", "order_category_ids", "pay_category_ids")


def day_counts(visits: DataFrame) -> DataFrame:
    """``date, user_id, category_id, session_id`` -> click, order and pay counts."""
    v = visits.select(*VISIT_INPUT).withColumn("date", F.nullif("date", F.lit("")))
    return kind_counts(category_events(v, keep=("date", "user_id", "session_id")), KEYS)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_COUNTS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def update_days(visits: DataFrame, path: str, first: str | None = None, last: str | None = None) -> None:
    """Count the visits of the days in [first, last] (an open end: None) and replace those days below ``path``."""
    spark = visits.sparkSession
    days = VisitFilter(first, last).date_predicate("date")
    v = apply(visits.select(*VISIT_INPUT), days)
    present = v.select(F.nullif("date", F.lit("")).alias("date")).distinct()
    if _exists(spark, path):
        present = present.union(apply(_stored(spark, path).select("date"), days)).distinct()
    zero = [F.lit(0).cast("bigint").alias(f"{k}_count") for k in KINDS]
    marks = present.select("date", *[F.lit(None).cast(DAILY_COUNTS[k].dataType).alias(k) for k in KEYS[1:]], *zero)
    (day_counts(v).unionByName(marks).hint("rebalance", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def read_days(spark: SparkSession, path: str, flt: VisitFilter | None = None) -> DataFrame:
    """The stored counts; the date bounds of ``flt`` choose the folders that are opened."""
    rows = _stored(spark, path)
    if flt is not None:
        rows = apply(rows, flt.date_predicate("date"))
    return rows.filter(F.col("category_id").isNotNull()).select(*KEYS, *[f"{k}_count" for k in KINDS])
