"""Action classification and per-category counting.

A visit counts as exactly one kind, first match wins:
  click  when click_category_id != -1              -> 1 for that category
  order  else when order_category_ids is non-empty -> 1 per listed id (duplicates count)
  pay    else when pay_category_ids is non-empty   -> 1 per listed id
A click row's order / pay lists are ignored; an order row's pay list is ignored, even when
the order list splits into nothing (``","``). Lists split like Java's ``String.split``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.text import java_split, non_empty

KINDS = ("click", "order", "pay")


def action_kind() -> Column:
    click = F.col("click_category_id") != F.lit(-1)
    return (F.when(click, F.lit("click"))
             .when(non_empty("order_category_ids"), F.lit("order"))
             .when(non_empty("pay_category_ids"), F.lit("pay")))


def classify(visits: DataFrame) -> DataFrame:
    """Visits with a ``kind`` column (null = the visit counts for nothing)."""
    return visits.withColumn("kind", action_kind())


def _category_ids(kind: Column) -> Column:
    return (F.when(kind == "click", F.array(F.col("click_category_id").cast("string")))
             .when(kind == "order", java_split("order_category_ids"))
             .when(kind == "pay", java_split("pay_category_ids")))


def category_events(visits: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per counted (category_id STRING, kind); ``keep`` carries visit columns along."""
    kind = action_kind()
    # explode_outer + null filter: split never yields null elements, so this keeps exactly
    # explode's rows, but stops Catalyst from inferring a size(ids) > 0 filter and pushing
    # the whole classification expression below the projection a second time.
    return (visits
            .select(*keep, kind.alias("kind"), _category_ids(kind).alias("__ids"))
            .select(*keep, "kind", F.explode_outer("__ids").alias("category_id"))
            .filter(F.col("category_id").isNotNull()))


def kind_counts(events: DataFrame, keys: tuple, weight: Column | None = None) -> DataFrame:
    """Per key: click_count, order_count, pay_count (0 when absent), optionally weighted."""
    w = F.lit(1) if weight is None else weight
    aggs = [F.sum(F.when(F.col("kind") == k, w).otherwise(F.lit(0))).cast("bigint").alias(f"{k}_count")
            for k in KINDS]
    return events.groupBy(*keys).agg(*aggs)


def category_counts(visits: DataFrame) -> DataFrame:
    """One row per category with its three counts (A1 + A2)."""
    return kind_counts(category_events(visits), ("category_id",))
